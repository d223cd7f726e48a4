"""Operators for preparing training text: a self-contained subpackage."""
