"""Replay, retention and gaps of a journal: headers (tx_id, truncated, n_changes) and changes (tx_id, seq, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def retained(headers: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` transactions: a top-k, so the journal is never sorted whole."""
    return headers.orderBy(F.col("tx_id").desc()).limit(keep)


def replay(headers: DataFrame, changes: DataFrame, after: int, limit: int, condition: Column | None = None) -> DataFrame:
    """Changes of the first ``limit`` transactions behind ``after``, in order.

    A filter trims changes, not transactions: those left empty still have one row, with nulls.
    """
    picked = headers.where(F.col("tx_id") > after).orderBy("tx_id").limit(limit)
    kept = changes if condition is None else changes.where(condition)
    return picked.join(kept, "tx_id", "left").orderBy("tx_id", "seq")


def gap(headers: DataFrame, after: int) -> DataFrame:
    """oldest, newest and whether transactions behind ``after`` are gone already."""
    return headers.agg(F.min("tx_id").alias("oldest"), F.max("tx_id").alias("newest")).withColumn("gap", F.coalesce(F.lit(after + 1) < F.col("oldest"), F.lit(False)))
