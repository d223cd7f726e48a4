"""Nested buckets as rows.

A bucket's path is text: the names from the root in hexadecimal, each followed by ``/``; the root is empty.
``/`` sorts before every digit, so text order of paths is depth-first order of the tree, equality and
``startswith`` on a path reach the Parquet scan, and a subtree is a prefix.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRIES = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("kind", T.StringType(), False), T.StructField("value", T.BinaryType()), T.StructField("next_int", T.LongType())])
TTL = T.StructType([T.StructField("path", T.StringType(), False), T.StructField("key", T.BinaryType(), False), T.StructField("expires_at_ms", T.LongType(), False)])


def path_of(names: Iterable[bytes]) -> str:
    return "".join(n.hex() + "/" for n in names)


def names_of(path: str) -> list[bytes]:
    return [bytes.fromhex(p) for p in path.split("/")[:-1]]


def child_path(path: Column | str = "path", key: Column | str = "key") -> Column:
    """The path of the bucket that an entry names."""
    p, k = (F.col(c) if isinstance(c, str) else c for c in (path, key))
    return F.concat(p, F.lower(F.hex(k)), F.lit("/"))


def children(entries: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    rows = entries.where(F.col("path") == path)
    return (rows if kind is None else rows.where(F.col("kind") == kind)).orderBy("key")


def subtree(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(F.col("path").startswith(path)) if path else entries


def without_subtree(entries: DataFrame, path: str) -> DataFrame:
    return entries.where(~F.col("path").startswith(path))


def depth_first(entries: DataFrame) -> DataFrame:
    """All entries in the order of a depth-first walk: a bucket right before what it holds."""
    return entries.withColumn("_at", child_path()).orderBy("_at").drop("_at")


def depth(path: str = "path") -> Column:
    return F.length(F.regexp_replace(path, "[^/]", ""))
