"""Exact duplicates: a minimal perfect hash over the digests that occur already, and byte-checked lookups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace, id_and_text, unused

#: Mean digests in a bucket of the hash, and in a group that shares one displacement.
BUCKET, GROUP = 2048, 4
#: Modulus of the displacement polynomial: the Mersenne prime 2**31 - 1, so that products fit 64 bits.
PRIME = 2**31 - 1
_INDEX = "bucket long, n int, shifts array<int>, slot int, known binary, winner long, copies long, historical boolean"


def _words(digest: bytes) -> tuple[int, ...]:
    return tuple(int.from_bytes(digest[i : i + 4], "big") & 0x7FFFFFFF for i in range(8, 28, 4))


def place(a, b, c, d, n):
    """Slot among ``n`` of a digest with words a, b, c under displacement d; integers, arrays or columns."""
    return (a + d * b + (d * d) % PRIME * c) % PRIME % n


def build_bucket(digests: list[bytes]) -> tuple[list[int], list[int]]:
    """Displacements for the groups and each digest's slot: hash and displace, large groups first.

    Distinct digests of 31-bit words meet under every displacement only if three words agree.
    """
    n = len(digests)
    words = np.array([_words(d) for d in digests], np.int64).reshape(n, 5)
    groups = max(1, -(-n // GROUP))
    of, taken, shifts, slots = words[:, 3] % groups, np.zeros(n, bool), [0] * groups, np.full(n, -1)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(groups + 1))
    for g in sorted(range(groups), key=lambda g: starts[g] - starts[g + 1]):
        rows = order[starts[g] : starts[g + 1]]
        if not len(rows):
            continue
        a, b, c = (words[rows, k][:, None] for k in range(3))
        first = 0
        while True:
            d = np.arange(first, first + 256, dtype=np.int64)[None, :]
            at = place(a, b, c, d, n)
            good = ~taken[at].any(0)
            if len(rows) > 1:
                ranked = np.sort(at, 0)
                good &= (ranked[1:] != ranked[:-1]).all(0)
            if good.any():
                k = int(np.argmax(good))
                shifts[g], slots[rows] = first + k, at[:, k]
                taken[at[:, k]] = True
                break
            first += 256
            if first >= 2**24:
                raise ValueError("digests agree in three words: they can't be told apart by this hash")
    return shifts, slots.tolist()


def _word(digest: Column, k: int) -> Column:
    """The k-th 31-bit word of a binary digest, as ``_words`` has it."""
    return F.conv(F.hex(F.substring(digest, 9 + 4 * k, 4)), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 7)), 16, 10).cast("long") % buckets


def build_index(ws: Workspace, known: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """A minimal perfect hash over ``known`` (digest, winner, copies, historical), one row per slot, and its buckets.

    Digests are spread over buckets by their first bytes; each bucket of about 2,048 at most is hashed by itself,
    so no task holds more however many there are.  ``most`` bounds their number: where digests have many
    copies, counting rows is cheap and only makes buckets smaller.  Every slot holds the full digest and its winner.
    """
    buckets = max(1, -(-(known.count() if most is None else most) // BUCKET))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        shifts, slots = build_bucket(rows["digest"].tolist())
        return pd.DataFrame({"bucket": rows["bucket"], "n": len(rows), "shifts": [shifts if s == 0 else None for s in slots], "slot": slots, "known": rows["digest"], "winner": rows["winner"], "copies": rows["copies"], "historical": rows["historical"]})

    index = known.withColumn("bucket", _bucket(F.col("digest"), buckets)).groupBy("bucket").applyInPandas(build, _INDEX)
    return ws.stage(index, "index"), buckets


def look_up(rows: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (with digest) beside what the hash holds for them: place (bucket and slot), winner, copies, historical; nulls for nonmembers.

    Two joins, on the bucket and on the slot.  A digest that is not in the hash lands on some slot as well:
    only equality of the full digests makes it a member.  Both are plain equi-joins whose left side Spark
    may split, so a digest of a third of all rows is no task's burden.
    """
    heads = index.filter("slot = 0").select(F.col("bucket").alias("_b"), F.col("n").alias("_n"), F.col("shifts").alias("_shifts"))
    d = F.col("digest")
    shift = F.element_at("_shifts", (_word(d, 3) % F.size("_shifts") + 1).cast("int")).cast("long")
    at = rows.withColumn("_b", _bucket(d, buckets)).join(heads, "_b", "left").withColumn("_d", shift)
    at = at.withColumn("_slot", place(_word(d, 0), _word(d, 1), _word(d, 2), F.col("_d"), F.col("_n"))).drop("_n", "_shifts", "_d")
    slots = index.select(F.col("bucket").alias("_b"), F.col("slot").cast("long").alias("_slot"), "known", "winner", "copies", "historical")
    found, same = at.join(slots, ["_b", "_slot"], "left"), F.col("known") == d
    here = {c: F.when(same, F.col(c)) for c in ("winner", "copies", "historical")} | {"place": F.when(same, F.struct("_b", "_slot"))}
    return found.withColumns(here).drop("_b", "_slot", "known")


def exact_groups(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    Texts are equal when identical; null counts as empty.  A minimal perfect hash is built over the distinct
    digests of what was there before: ``history`` (digest binary, doc_id), or without it the earlier part of
    ``docs`` itself, up to the median doc_id.  Its slots hold the full digest and the winner so far.  Every
    document looks itself up, and the full digests are compared byte by byte.  Members meet at their slot,
    which tells the group's size and last winner; nonmembers are grouped by digest, among themselves alone.
    The winner is the historical document if ``history`` has one, else the largest doc_id of the group.

    Equal rows with equal ids are ties: all of them are marked kept (``drop_repeats`` keeps one).  A null id
    loses to any other and belongs to the later part; a group of null ids only has no winner to name, and
    its rows stay.  Repeated rows count in group_size.  An empty table gives an empty one; other columns
    are ignored.
    """
    ws = Workspace(docs.sparkSession, "exact_dedup")
    plain = id_and_text(docs, id_col, text_col)
    rows = ws.stage(plain.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest")), "digests")
    if history is None:
        middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
        past, outside = rows.filter(F.col("doc_id") <= F.lit(middle).cast("long")), False
    else:
        past, outside = history, True
    known = past.groupBy("digest").agg(F.max("doc_id").cast("long").alias("winner"), F.count("*").alias("copies")).withColumn("historical", F.lit(outside))
    index, buckets = build_index(ws, known, past.count())
    member = F.col("place").isNotNull()
    # members meet at their slot, nonmembers at their digest: no bucket is negative and no digest empty
    meet = {"_b": F.when(member, F.col("place._b")).otherwise(-1), "_slot": F.when(member, F.col("place._slot")).otherwise(-1), "_alone": F.when(member, F.lit(b"")).otherwise(F.col("digest"))}
    asked = ws.stage(look_up(rows, index, buckets).withColumns(meet).drop("place"), "asked")
    # staged, so that the join below reads plain shuffles, which Spark may split where a group is hot
    sizes = ws.stage(asked.groupBy(*meet).agg(F.max("doc_id").alias("last"), F.count("*").alias("group_size")), "sizes")
    out, gone = asked.join(sizes, list(meet)), F.coalesce("historical", F.lit(False))
    # the place of a slot says who won before; a later document of the table itself may have come since
    keep = F.when(gone, F.col("winner")).otherwise(F.greatest("winner", "last"))
    return out.select("doc_id", keep.alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (~gone & keep.eqNullSafe(F.col("doc_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), gone.alias("in_history"))


def drop_repeats(docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with the columns of ``docs``; of rows tied in id and text one stays.

    Rows are told apart by id and text, so ids that are null or shared by differing texts lose nothing: each
    text's winner stays, and of a text that has null ids only all rows but ties, that is one.  Nulls count
    as empty texts; columns may have any names; an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "drop_repeats")
    groups = ws.stage(exact_groups(docs, history, id_col, text_col).select("doc_id", "kept", "group_size", "text_sha256"), "groups")
    i, sha = unused(docs.columns, "_id", "_sha")
    key = [F.col(f"`{id_col}`").cast("long"), F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256)]

    def among(kind: str, keys: DataFrame, rows: DataFrame) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(i), F.col("text_sha256").alias(sha))
        return rows.join(keys, key[0].eqNullSafe(F.col(i)) & (key[1] == F.col(sha)), kind)

    stay = among("left_anti", groups.filter("not kept"), docs)
    tied = groups.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n")).filter("n > 1")
    if tied.isEmpty():
        return stay
    tied = ws.stage(tied, "tied")
    one = among("left_semi", tied, stay).withColumns({i: key[0], sha: key[1]}).dropDuplicates([i, sha]).drop(i, sha)
    return among("left_anti", tied, stay).unionByName(one)
