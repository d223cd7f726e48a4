"""Positions of regular-expression matches as Spark columns, without Python on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 256
_ids = iter(range(1 << 60))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """One output for each item of an array, with a running value; ``kind`` is the output's SQL type.

    Appending to an array copies it, so outputs gather in blocks of 256 and the blocks in turn: near-linear
    up to millions of items.
    """
    none = F.array().cast(f"array<{kind}>")
    blocks = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), ((F.size(items) - 1) / _BLOCK).cast("int")), lambda b: F.slice(items, b * _BLOCK + 1, F.lit(_BLOCK)))).otherwise(F.slice(F.array(items), 1, 0))

    def inner(carry: Column, block: Column) -> Column:
        return F.aggregate(block, F.struct(carry.alias("c"), none.alias("o")), lambda a, x: F.struct(step(a["c"], x).alias("c"), F.concat(a["o"], F.array(emit(a["c"], x))).alias("o")))

    whole = F.aggregate(blocks, F.struct(zero.alias("c"), F.array().cast(f"array<array<{kind}>>").alias("o")), lambda a, b: let(inner(a["c"], b), lambda r: F.struct(r["c"].alias("c"), F.concat(a["o"], F.array(r["o"])).alias("o"))))
    return F.flatten(whole["o"])


SPAN = "struct<start: int, end: int, match: string, before: string, after: string>"


def add_spans(df: DataFrame, text: str, out: str, pattern: str, likely: Column | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """Adds ``out``: all matches, leftmost and non-overlapping, with code points from ``start`` up to ``end``.

    Splitting at the matches gives what lies between them; running lengths of both give positions.
    ``before`` and ``after`` characters on both sides come along, whatever they belong to.
    ``pattern`` must not capture groups or match the empty string; ``likely`` is a cheap necessary condition.
    """
    t, m, g = F.col(text), f"_m{next(_ids)}", f"_g{next(_ids)}"
    has = t.rlike(pattern) if likely is None else likely & t.rlike(pattern)
    df = df.withColumn(m, F.when(has, F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(g, F.when(F.size(m) > 0, let(F.split(t, pattern, -1), lambda s: F.arrays_zip(F.slice(s, 1, F.size(m)).alias("gap"), F.col(m).alias("m"), F.slice(s, 2, F.size(m)).alias("next")))))
    place = lambda at, x: ((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["m"])).alias("end"), x["m"].alias("match"))
    if before or after:
        # what lies before a match runs along as a tail of bounded length, what lies behind it as a head from the other end
        ends = lambda a, b, n: F.right(F.concat(a, F.right(b, F.lit(n))), F.lit(n))
        heads = lambda a, b, n: F.left(F.concat(F.left(a, F.lit(n)), b), F.lit(n))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        step = lambda c, x: F.struct((c["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"), ends(ends(c["tail"], x["gap"], before), x["m"], before).alias("tail"))
        placed = scan(F.col(g), zero, step, lambda c, x: F.struct(*place(c["at"], x), ends(c["tail"], x["gap"], before).alias("before")), "struct<start: int, end: int, match: string, before: string>")
        behind = F.reverse(scan(F.reverse(F.col(g)), F.lit(""), lambda c, x: heads(x["m"], heads(x["next"], c, after), after), lambda c, x: heads(x["next"], c, after), "string"))
        spans = F.zip_with(placed, behind, lambda p, a: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["match"].alias("match"), p["before"].alias("before"), a.alias("after")))
    else:
        spans = scan(F.col(g), F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["m"]), lambda at, x: F.struct(*place(at, x), F.lit("").alias("before"), F.lit("").alias("after")), SPAN)
    return df.withColumn(out, F.when(F.size(m) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))).drop(m, g)


def joined(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
