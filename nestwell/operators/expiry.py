"""Deadlines: what is visible at a moment, and which rows a bounded purge takes.

``now`` is given once per query as milliseconds; rows never read a clock of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deadline_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, without time zone taken as UTC, truncated."""
    return F.unix_millis(ts.cast("timestamp"))


def is_live(expires: str, now_ms: int) -> Column:
    return F.col(expires).isNull() | (F.col(expires) > now_ms)


def live(entries: DataFrame, ttl: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """Entries whose deadline, if any, lies ahead: an anti-join with the expired ones alone."""
    return entries.join(ttl.where(F.col("expires_at_ms") <= now_ms).select(*keys), keys, "left_anti")


def due(ttl: DataFrame, order: list[str], now_ms: int, limit: int) -> DataFrame:
    """The rows that a purge takes: expired, in order, up to the limit. A top-k, not a sort of everything."""
    return ttl.where(F.col("expires_at_ms") <= now_ms).orderBy(*order).limit(limit)


def clear(ttl: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return ttl.join(gone.select(*keys).distinct(), keys, "left_anti")
