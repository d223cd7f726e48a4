"""Rules that a tree's rows keep, as queries for the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwell.operators.tree import child_path


def violations(entries: DataFrame) -> DataFrame:
    """invariant, path, key of every broken rule; empty for a sound tree.

    unique_key: no two entries of a bucket share a key.  parent_exists: a bucket that holds entries is
    itself an entry.  kind_shape: values for kv alone, counters for buckets alone.
    """
    twice = entries.groupBy("path", "key").count().where("count > 1").select(F.lit("unique_key").alias("invariant"), "path", "key")
    buckets = entries.where("kind = 'bucket'").select(child_path().alias("path"))
    used = entries.where("path <> ''").select("path").distinct()
    orphan = used.join(buckets, "path", "left_anti").select(F.lit("parent_exists").alias("invariant"), "path", F.lit(None).cast("binary").alias("key"))
    good = ((F.col("kind") == "kv") & F.col("value").isNotNull() & F.col("next_int").isNull()) | ((F.col("kind") == "bucket") & F.col("value").isNull() & F.col("next_int").isNotNull())
    shape = entries.where(~F.coalesce(good, F.lit(False))).select(F.lit("kind_shape").alias("invariant"), "path", "key")
    return twice.unionByName(orphan).unionByName(shape)
