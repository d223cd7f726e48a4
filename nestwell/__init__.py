"""Nested, ordered key/value data as versioned DataFrames."""
