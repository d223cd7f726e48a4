"""Writes as pure transformations: last write wins, conditional writes, counters and ordered loads.

Operations come as rows with an explicit order column; Parquet rows have none of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_write_wins(ops: DataFrame, keys: list[str], seq: list[str], values: list[str]) -> DataFrame:
    """One row per key with the values of its last operation: one aggregation, combined before the shuffle,
    so a key that holds a third of all operations costs one row per task."""
    last = F.max_by(F.struct(*values), F.struct(*seq)).alias("_last")
    return ops.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def upsert(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """``batch`` over ``base``: both have the same columns and ``batch`` one row per key."""
    return base.join(batch.select(*keys), keys, "left_anti").unionByName(batch.select(*base.columns))


def delete_keys(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def removed_count(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows the keys remove: each once, however often it is named."""
    return base.join(gone.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("removed"))


def put_if_absent(base: DataFrame, wanted: DataFrame, keys: list[str], value: str, new: str) -> DataFrame:
    """applied, observed, current for each wanted key (one operation per key)."""
    j = wanted.join(base.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_there")), keys, "left")
    absent = F.col("_there").isNull()
    return j.select(*keys, absent.alias("applied"), F.col("_old").alias("observed"), F.when(absent, F.col(new)).otherwise(F.col("_old")).alias("current"))


def compare_exchange(base: DataFrame, wanted: DataFrame, keys: list[str], value: str, expected: str, new: str) -> DataFrame:
    """applied, observed, current: the new value where the old one equals the expected; null means missing."""
    j = wanted.join(base.select(*keys, F.col(value).alias("_old")), keys, "left")
    same = F.col("_old").eqNullSafe(F.col(expected))
    return j.select(*keys, same.alias("applied"), F.col("_old").alias("observed"), F.when(same, F.col(new)).otherwise(F.col("_old")).alias("current"))


def delete_if_value(base: DataFrame, wanted: DataFrame, keys: list[str], value: str, expected: str) -> DataFrame:
    """Like ``compare_exchange`` towards absence; a missing key is a conflict, not an error."""
    j = wanted.join(base.select(*keys, F.col(value).alias("_old")), keys, "left")
    same = F.coalesce(F.col("_old") == F.col(expected), F.lit(False))
    return j.select(*keys, same.alias("applied"), F.col("_old").alias("observed"), F.when(~same, F.col("_old")).alias("current"))


def fold_conditional(base: DataFrame, ops: DataFrame, keys: list[str], seq: list[str], value: str) -> DataFrame:
    """Chains of conditional writes: per key, the final value after all of them, in order.

    ``ops`` has ``expected`` (null: must be missing) and ``new`` (null: delete).  A chain depends on its own
    order, so a key's operations are gathered: give this a batch whose keys have few operations each.
    """
    chain = ops.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*seq, "expected", "new"))).alias("_ops"))
    j = chain.join(base.select(*keys, F.col(value).alias("_old")), keys, "left")
    step = lambda acc, op: F.struct(F.when(acc["v"].eqNullSafe(op["expected"]), op["new"]).otherwise(acc["v"]).alias("v"), (acc["n"] + acc["v"].eqNullSafe(op["expected"]).cast("int")).alias("n"))
    done = F.aggregate("_ops", F.struct(F.col("_old").alias("v"), F.lit(0).alias("n")), step)
    return j.select(*keys, done.alias("_d")).select(*keys, F.col("_d.v").alias(value), F.col("_d.n").alias("applied"))


def fetch_add(ops: DataFrame, key: str, amount: str, base: DataFrame | None = None, value: str = "value") -> DataFrame:
    """The total of each counter: sums combine before the shuffle."""
    total = ops.groupBy(key).agg(F.sum(amount).alias("_sum"))
    if base is None:
        return total.withColumnRenamed("_sum", value)
    return total.join(base.select(key, F.col(value).alias("_old")), key, "left").select(key, (F.coalesce("_old", F.lit(0)) + F.col("_sum")).alias(value))


def fetch_add_previous(ops: DataFrame, key: str, seq: list[str], amount: str, out: str = "previous", slices: int = 32) -> DataFrame:
    """What each addition saw before it.

    The first order column (a number) is cut into slices at its approximate quantiles.  Sums run within
    (key, slice), and totals of earlier slices are added from one small row per key and slice: a counter
    that takes a third of all additions is spread over all its slices.
    """
    cuts = sorted(set(ops.approxQuantile(seq[0], [k / slices for k in range(1, slices)], 0.01)))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(seq[0]).cast("double"))) if cuts else F.lit(0)
    sliced = ops.withColumn("_slice", place)
    totals = sliced.groupBy(key, "_slice").agg(F.sum(amount).alias("_sum"))
    earlier = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(key, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, "_slice").orderBy(*seq).rowsBetween(W.unboundedPreceding, -1)
    running = sliced.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return running.join(offsets, [key, "_slice"]).withColumn(out, F.col("_before") + F.col("_inside")).drop("_slice", "_inside", "_before")


def insert_ordered(ops: DataFrame, key: str, seq: list[str], blocks: int = 64) -> DataFrame:
    """inserted, ordered: whether keys strictly rise along ``seq``.

    Range partitions of the order are checked each by itself and then at their seams, so no task sees
    all rows: a window over everything would.
    """
    placed = ops.select(*seq, F.col(key).alias("_k")).repartitionByRange(blocks, *seq).withColumn("_p", F.spark_partition_id())
    inner = W.partitionBy("_p").orderBy(*seq)
    rows = placed.withColumn("_ok", F.coalesce(F.lag("_k").over(inner) < F.col("_k"), F.lit(True)))
    parts = rows.groupBy("_p").agg(F.count("*").alias("n"), F.bool_and("_ok").alias("ok"), F.min_by("_k", F.struct(*seq)).alias("lo"), F.max_by("_k", F.struct(*seq)).alias("hi"))
    seam = F.coalesce(F.lag("hi").over(W.partitionBy(F.lit(0)).orderBy("_p")) < F.col("lo"), F.lit(True))
    return parts.withColumn("seam", seam).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("inserted"), F.coalesce(F.bool_and(F.col("ok") & F.col("seam")), F.lit(True)).alias("ordered"))


def appearances(ops: DataFrame, bucket: list[str], key: str, seq: list[str], present: Column) -> DataFrame:
    """Per bucket, how often a key went from absent to present along ``seq``: what an insertion counter gains.

    ``present`` says whether the key is there after the operation; keys start absent.
    """
    w = W.partitionBy(*bucket, key).orderBy(*seq)
    rose = present & ~F.coalesce(F.lag(present).over(w), F.lit(False))
    return ops.withColumn("_rose", rose).groupBy(*bucket).agg(F.sum(F.col("_rose").cast("long")).alias("next_int"))
