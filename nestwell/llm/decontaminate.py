"""Benchmark decontamination: prefix-filtered join of item windows with documents, in SQL functions only."""

from __future__ import annotations

import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace, id_and_text, text_key, without

#: Windows joined at once: each has some 200 bytes as a row, so a block's broadcast stays below 64 MB.
BLOCK_WINDOWS = 250_000
#: What parts words: all ASCII but digits and small letters, once A to Z are small.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and anything beyond ASCII; only A to Z become small letters."""
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP, -1), lambda w: w != "")


def _split(text: Column) -> Column:
    """As ``words``, but with an empty string where the text begins or ends with a gap: cheaper, for whole documents."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP, -1)


def windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, words, size: each run of ``window`` words of an item, or all of a shorter one; distinct."""
    w = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1)))
    return w.select("item_id", "w", start.alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words")).distinct().withColumn("size", F.size("words"))


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


#: A token of no shingle, behind the last word: it brings one row of every document through the join with windows.
_END = 0x5EED0FD0C5


def _occurrences(docs: DataFrame, wanted: DataFrame, pairs: bool, ends: bool = False) -> DataFrame:
    """Documents' columns, ``at`` (place in ``w`` from 1) and ``wanted``'s, where its ``token`` occurs.

    Shingles are hashed within the row and exploded as numbers, which are looked up as they pass: one
    pipelined pass, nothing is shuffled.  They are made a step before they are exploded, so that exploding
    and looking up compile into one loop over a document's row: its words are never copied for each word.
    """
    tokens = F.transform("w", lambda x, k: _pair(x, F.get("w", k + 1)) if pairs else F.xxhash64(x))
    if ends:
        tokens = F.concat(tokens, F.array(F.lit(_END).cast("long")))
    made = docs.select("*", tokens.alias("_tokens"))
    # the outer form: from the plain one a filter on the tokens' size is inferred, which would make them, and split the text, once more for each word
    each = made.select(*docs.columns, F.posexplode_outer("_tokens").alias("_p", "token"))
    return each.select(*docs.columns, (F.col("_p") + 1).alias("at"), "token").join(F.broadcast(wanted), "token")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated; one row per input row.

    A window is ``window`` consecutive words of an item (all of a shorter one); it is contained in a
    document where its words occur in order without a gap.  Word ``shingles`` of two (one for windows of a
    single word) are ordered by how often all documents have them; since every shingle of a window must
    occur, its rarest alone is its prefix, joined with the documents' shingles.  A candidate is dropped
    unless the window fits between the document's first and last word (positional and length bounds) and
    then compared word by word.

    Items are handled in blocks of windows, so a broadcast is bounded however large the benchmark, and a
    passage that a third of all documents share only makes one row per occurrence.  Hits of a document
    meet again in one row; no other gathering takes place.

    Null or wordless texts have no words and no hits; wordless items have no window; null document ids
    stay null; items without an id count in ``n_hit`` and ``contaminated``, not in ``items`` and ``n_items``;
    repeated documents give repeated rows, repeated items count once; empty tables give no hits or no
    rows; other columns are ignored.
    """
    return _decontaminated(docs, items, window, id_col, text_col, item_col, item_text_col).drop("k1", "k2")


def _decontaminated(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``decontaminate`` with the rows' ``text_key`` as k1 and k2."""
    ws = Workspace(docs.sparkSession, "decontaminate")
    plain = id_and_text(docs, id_col, text_col)
    named = items.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    wins = ws.stage(windows(named, window), "windows")
    # empty strings stand at either end only and belong to no window: they stay, and aren't counted
    key = text_key(F.col("text"))
    whole = plain.select("doc_id", key[0].alias("k1"), key[1].alias("k2"), F.spark_partition_id().alias("part"), _split(F.col("text")).alias("w"))
    found, counted = [], False
    for pairs in (True, False):
        kind = wins.filter("size > 1" if pairs else "size = 1")
        blocks = -(-kind.count() // BLOCK_WINDOWS)
        for block in range(blocks):
            part = kind.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)) == block) if blocks > 1 else kind
            found.append(_block_hits(ws, whole, part, pairs, ends=not counted))
            counted = True
    if not counted:
        found = [whole.select("doc_id", "k1", "k2", "part", _n_words().alias("n_words"), F.lit(None).cast("string").alias("item_id"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))]
    hits = ws.stage(reduce(DataFrame.union, found), "hits")
    # every document has one row with its number of words; copies count by the task that read them, so none brings back more than it read
    all_rows = hits.filter("n_words is not null").groupBy("doc_id", "k1", "k2", "part").agg(F.max("n_words").cast("long").alias("n_words"), F.count("*").cast("int").alias("_rows"))
    spans = hits.filter("n_words is null").groupBy("doc_id", "k1", "k2").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["to"], s["end"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")), lambda a: a["n"])
    k = spans.select(F.col("doc_id").alias("_d"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), covered.alias("_n"), "items")
    out = all_rows.join(k, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    n_hit = F.coalesce("_n", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"), "k1", "k2", F.explode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_row")).drop("_row")


def _n_words() -> Column:
    return F.size("w") - (F.get("w", F.lit(0)) == "").cast("int") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")


def _block_hits(ws: Workspace, docs: DataFrame, wins: DataFrame, pairs: bool, ends: bool) -> DataFrame:
    """doc_id, k1, k2, part, n_words (null), item_id, start, end (places in ``w`` from 0, end exclusive) of every occurrence of the windows.

    With ``ends`` one row more for each document, with its number of words and no occurrence.
    """
    places = F.explode(F.sequence(F.lit(1), F.col("size") - 1)) if pairs else F.explode(F.array(F.lit(1)))
    mine = wins.select("item_id", "words", "size", places.alias("off"))
    word = lambda k: F.element_at("words", k)
    mine = mine.withColumn("token", _pair(word(F.col("off")), word(F.col("off") + 1)) if pairs else F.xxhash64(word(F.col("off"))))
    mine = ws.stage(mine, "shingles")
    frequency = ws.stage(_occurrences(docs.select("w"), mine.select("token").distinct(), pairs).groupBy("token").agg(F.count("*").alias("n")), "frequency")
    # a window with a shingle that no document has occurs nowhere: its least frequency is 0
    ranked = mine.join(F.broadcast(frequency), "token", "left").groupBy("item_id", "words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "token")).alias("p"))
    prefix = ranked.filter("p.n > 0").select("p.token", "p.off", "words", "size", "item_id")
    if ends:
        prefix = prefix.union(docs.sparkSession.range(1).select(F.lit(_END).cast("long"), F.lit(0), F.array().cast("array<string>"), F.lit(0), F.lit(None).cast("string")))
    at = _occurrences(docs, ws.stage(prefix, "prefix"), pairs, ends)
    begin, is_end = F.col("at") - F.col("off"), F.col("size") == 0
    fits = F.when(is_end, F.col("at") == F.size("w") + 1).otherwise((F.col("at") <= F.size("w")) & (begin >= 0) & (begin + F.col("size") <= F.size("w")))
    same = at.filter(fits).filter(is_end | (F.slice("w", begin + 1, F.col("size")) == F.col("words")))
    return same.select("doc_id", "k1", "k2", "part", F.when(is_end, _n_words()).alias("n_words"), "item_id", F.when(~is_end, begin).alias("start"), F.when(~is_end, begin + F.col("size")).alias("end"))


def report(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, with the columns of ``docs``.

    Rows are told apart by id and text: of rows with one id, or none, only those go whose own text has a hit.
    Null and wordless texts stay; repeated rows share their fate; columns may have any names; an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "drop_contaminated")
    gone = ws.stage(_decontaminated(docs, items, window, id_col, text_col).filter("contaminated").select("doc_id", "k1", "k2").distinct(), "gone")
    return without(docs, gone, id_col, text_col)
