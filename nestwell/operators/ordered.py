"""Ordered reads over keyed rows: point, range, prefix, neighbour and page reads.

Everything takes a DataFrame and the name of its key column and stays declarative: ranges and prefixes turn
into comparisons that reach the Parquet scan, limits into top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.functions.codecs import successor


@dataclass(frozen=True)
class Bound:
    value: Any
    inclusive: bool = True


def point(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def multi_get(df: DataFrame, key: str, wanted: DataFrame, pos: str = "pos") -> DataFrame:
    """Every wanted key at its position, also twice and also when nothing is found (nulls).

    The table meets the distinct wanted keys in a semi-join first, so of a large table only what was asked
    for is shuffled: Spark broadcasts the keys up to ``spark.sql.autoBroadcastJoinThreshold``, which
    checks their size, and else joins by sorting.
    """
    return wanted.join(df.join(wanted.select(key).distinct(), key, "left_semi"), key, "left").orderBy(pos)


def only_keys(df: DataFrame, key: str, keys: list) -> DataFrame:
    """Rows with one of a few keys, as a condition that reaches the scan; more than 256 are left to the join."""
    found = {bytes(k) if isinstance(k, bytearray) else k for k in keys}
    return df.where(F.col(key).isin(*[F.lit(k) for k in sorted(found)])) if len(found) <= 256 else df


def within(key: str, low: Bound | None = None, high: Bound | None = None) -> Column:
    """The condition for keys between two bounds, each of which may be missing or exclusive."""
    c, out = F.col(key), F.lit(True)
    if low is not None:
        out = out & (c >= F.lit(low.value) if low.inclusive else c > F.lit(low.value))
    if high is not None:
        out = out & (c <= F.lit(high.value) if high.inclusive else c < F.lit(high.value))
    return out


def key_range(df: DataFrame, key: str, low: Bound | None = None, high: Bound | None = None, reverse: bool = False) -> DataFrame:
    return df.where(within(key, low, high)).orderBy(F.col(key).desc() if reverse else F.col(key))


def has_prefix(key: str, prefix: bytes | str) -> Column:
    """A prefix as a range, which the scan can skip by; ``startswith`` on binary columns can't."""
    raw = prefix.encode("utf-8") if isinstance(prefix, str) else prefix
    after = successor(raw)
    if isinstance(prefix, str):
        # text compares like its UTF-8 bytes, but the successor's bytes need not be text
        return F.col(key).startswith(prefix)
    low = F.col(key) >= F.lit(raw)
    return low if after is None else low & (F.col(key) < F.lit(after))


def prefix_scan(df: DataFrame, key: str, prefix: bytes | str) -> DataFrame:
    return df.where(has_prefix(key, prefix)).orderBy(key)


def seek_lower(df: DataFrame, key: str, value: Any) -> DataFrame:
    """From the first key at or above ``value``."""
    return df.where(F.col(key) >= F.lit(value)).orderBy(key)


def seek_parked(df: DataFrame, key: str, value: Any) -> DataFrame:
    """From ``value`` if it is a key, else from the one before it, else from the first key.

    The place is looked up first, by a maximum over a range that the scan can skip by, so that the rows
    themselves are read by a range as well.
    """
    at = df.where(F.col(key) <= F.lit(value)).agg(F.max(key).alias("at")).first()["at"]
    return (df if at is None else df.where(F.col(key) >= F.lit(at))).orderBy(key)


def page_after(df: DataFrame, key: str, token: Any | None, limit: int) -> DataFrame:
    """Up to ``limit`` rows behind the token; a last row beyond them tells the caller that more follow."""
    rows = df if token is None else df.where(F.col(key) > F.lit(token))
    return rows.orderBy(key).limit(limit + 1 if limit else 0)


def in_place(df: DataFrame, key: str) -> DataFrame:
    """All rows in key order with ``_at``: their range partition's number and, in its low 33 bits, their place there.

    Stage the result before it is read: another run may cut the ranges elsewhere.
    """
    return df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id())


def numbered(placed: DataFrame, out: str) -> DataFrame:
    """Staged rows of ``in_place`` numbered from 0 in key order; one count per range partition reaches the driver."""
    part = F.shiftright("_at", 33).alias("_part")
    offsets, before = [], 0
    for r in sorted(placed.groupBy(part).count().collect()):
        offsets.append((r["_part"], before))
        before += r["count"]
    starts = placed.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    rows = placed.select("*", part).join(F.broadcast(starts), "_part")
    return rows.withColumn(out, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def ends(df: DataFrame, key: str, value: str, prefix: str = "") -> DataFrame:
    """One row: the first and last key with their values, in one combining aggregation."""
    return df.agg(F.min(key).alias(f"{prefix}first_key"), F.min_by(value, key).alias(f"{prefix}first_value"), F.max(key).alias(f"{prefix}last_key"), F.max_by(value, key).alias(f"{prefix}last_value"))
