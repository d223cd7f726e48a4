"""Recursive merge of two trees: one full outer join, and what conflicts drop found by joins on ancestors."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.operators.tree import child_path


class ConflictPolicy(Enum):
    OVERWRITE = "overwrite"
    KEEP_EXISTING = "keep_existing"
    ERROR = "error"


@dataclass(frozen=True)
class MergeReport:
    inserted: int = 0
    updated: int = 0
    unchanged: int = 0
    skipped: int = 0
    buckets_created: int = 0
    buckets_merged: int = 0
    type_conflicts_resolved: int = 0


REPORT = tuple(MergeReport.__dataclass_fields__)


def ancestors(path: Column) -> Column:
    """Paths of all buckets around an entry, itself not included."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def _below(rows: DataFrame, roots: DataFrame, negate: bool) -> DataFrame:
    """Rows under one of the ``roots`` (column ``root``, paths), or those that aren't.

    Each row meets the roots through its ancestors' paths: an equi-join, as long as the tree is deep.
    Paths that hold no entry of their own don't travel; distinct paths do, not rows.
    """
    paths = rows.select("path").distinct().where(F.col("path") != "")
    hit = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root")).join(roots.distinct(), "root", "left_semi").select("path").distinct()
    return rows.join(hit, "path", "left_anti" if negate else "left_semi")


def joined(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Both sides of every entry: path, key, and d_/s_ columns kind, value, next_int, ttl."""
    side = lambda df, p: df.select("path", "key", *[F.col(c).alias(f"{p}_{c}") for c in ("kind", "value", "next_int", "ttl")])
    return side(src, "s").join(side(dst, "d"), ["path", "key"], "full_outer")


def plan(dst: DataFrame, src: DataFrame, policy: ConflictPolicy) -> DataFrame:
    """Every entry of either side with what becomes of it.

    Inputs have path, key, kind, value, next_int and ttl (milliseconds or null).  Output adds ``action``
    (insert, update, same, skip, create, merge, replace_kv, replace_bucket, keep, drop, conflict) and the
    resulting kind, value, next_int and ttl, null where nothing remains.

    Below a source bucket that meets a plain destination value the destination holds nothing, so the
    decisions of one join never cascade: what remains is to take out source rows below skipped buckets and
    destination rows below overwritten ones.
    """
    j = joined(dst, src)
    s, d = F.col("s_kind"), F.col("d_kind")
    over, keep = policy is ConflictPolicy.OVERWRITE, policy is ConflictPolicy.KEEP_EXISTING
    clash = lambda name: F.lit(name if over else "skip" if keep else "conflict")
    same = (F.col("s_value").eqNullSafe(F.col("d_value"))) & F.col("s_ttl").eqNullSafe(F.col("d_ttl"))
    action = (
        F.when(s.isNull(), "keep")
        .when((s == "kv") & d.isNull(), "insert")
        .when((s == "kv") & (d == "kv"), F.when(same, "same").otherwise(clash("update")))
        .when(s == "kv", clash("replace_bucket"))
        .when(d.isNull(), "create")
        .when(d == "bucket", "merge")
        .otherwise(clash("replace_kv"))
    )
    rows = j.withColumn("action", action)
    if keep:
        # a source bucket that meets a value is one skip: nothing below it is looked at
        blocked = rows.where((F.col("action") == "skip") & (F.col("s_kind") == "bucket")).select(child_path().alias("root"))
        rows = _below(rows, blocked, negate=True)
    if over:
        dropped = rows.where(F.col("action") == "replace_bucket").select(child_path().alias("root"))
        under = _below(rows.where("d_kind is not null"), dropped, negate=False).select("path", "key", F.lit(True).alias("_gone"))
        rows = rows.join(under, ["path", "key"], "left").withColumn("action", F.when(F.col("_gone") & F.col("s_kind").isNull(), "drop").otherwise(F.col("action"))).drop("_gone")
    from_src = F.col("action").isin("insert", "update", "create", "replace_kv", "replace_bucket")
    pick = lambda c: F.when(F.col("action") == "drop", None).when(from_src, F.col(f"s_{c}")).otherwise(F.col(f"d_{c}")).alias(c)
    counter = F.when(F.col("action") == "merge", F.greatest("s_next_int", "d_next_int")).when(from_src, F.col("s_next_int")).when(F.col("action") != "drop", F.col("d_next_int")).alias("next_int")
    return rows.select("path", "key", "action", pick("kind"), pick("value"), counter, pick("ttl"))


def report(planned: DataFrame) -> DataFrame:
    """One row of seven counters."""
    n = lambda *actions: F.coalesce(F.sum(F.col("action").isin(*actions).cast("long")), F.lit(0))
    return planned.agg(
        n("insert", "replace_bucket").alias("inserted"),
        n("update").alias("updated"),
        n("same").alias("unchanged"),
        n("skip").alias("skipped"),
        n("create", "replace_kv").alias("buckets_created"),
        n("merge").alias("buckets_merged"),
        n("replace_kv", "replace_bucket").alias("type_conflicts_resolved"),
    )


def first_conflict(planned: DataFrame) -> DataFrame:
    """The conflict that a depth-first walk meets first: one row, null without any."""
    return planned.where("action = 'conflict'").agg(F.min(child_path()).alias("at"))


def merged(planned: DataFrame) -> DataFrame:
    return planned.where("kind is not null").select("path", "key", "kind", "value", "next_int", "ttl")
