"""Near duplicates: b-bit MinHash signatures, band candidates, and links confirmed on whole shingle sets."""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace, frugal, id_and_text, text_key, without

#: 128 hashes: 32 bands of 4 miss a pair at similarity 0.8 once in 2e7; 4 low bits of each minimum are kept.
HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Candidates go on to the sets unless their estimate is this many standard errors under the threshold.
SIGMAS = 6.0
#: Shingles of a group's rests that so many of its sets share count as common to the group.
COMMON = 16
#: A bucket of a band is cut into slices of about so many rows, each with pivots of its own.
SLICE = 256
#: One-bit minima in the longer signature that tells apart what has left the pivots unlinked.
FINE = 2048
_LANES = 0x1111111111111111


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    """64-bit hashes of words, kept up to a bounded number."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 100_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_hashes = _WordHash()


def forget() -> None:
    _hashes.clear()


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; a shorter text is one run, an empty one none.

    A to Z count as lower case; words end at blanks and the controls 9 to 13, as bytes have it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h ^ w[k : len(w) - n + 1 + k]) if k == 0 else _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    seeds = _mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:HASHES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[HASHES:] >> np.uint64(32)).astype(np.uint32)


def minima(shingle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of HASHES hash functions over the set; memory stays bounded however long the text."""
    x, out = (shingle >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (x[i : i + 2048, None] * a + b).min(0), out=out)
    return out


def pack_bits(low: np.ndarray) -> np.ndarray:
    """The BITS low bits of each minimum, 16 of them in a 64-bit integer."""
    lanes = (low & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).astype(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed signatures: equal lanes by bit counts, less those that agree by chance (2**-BITS)."""
    pairs = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))
    differ = F.transform(pairs, lambda x: F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))).bitwiseAND(F.lit(_LANES))))
    equal = 1 - F.aggregate(differ, F.lit(0), lambda s, n: s + n) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def fine_signature(shingle: np.ndarray) -> np.ndarray:
    """One bit of each of FINE minima, 64 to an integer; a minimum is mixed, so that unequal ones agree by half in every function anew."""
    seeds = _mix(np.arange(1, 2 * FINE + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    a, b = (seeds[:FINE] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[FINE:] >> np.uint64(32)).astype(np.uint32)
    x, out = (shingle.astype(np.uint64) >> np.uint64(32)).astype(np.uint32), np.full(FINE, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(out, (x[i : i + 256, None] * a + b).min(0), out=out)
    out ^= out >> np.uint32(16)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return np.packbits((out >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def fine_estimate(a: Column, b: Column) -> Column:
    """Similarity from fine signatures: equal bits, less the half of the unequal ones that agree by chance."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return 1 - 2 * differ / FINE


def least_fine_estimate(threshold: float) -> float:
    p = (1 + threshold) / 2
    return threshold - SIGMAS * 2 * (p * (1 - p) / FINE) ** 0.5


def _set_digest(shingle: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle.tobytes(), digest_size=16).digest()


def _signatures(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        a, b = _parameters()
        lane = (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, sets, sigs, bands = [], [], [], []
            for x in batch.column("text"):
                s = shingles(x.as_py(), size)
                n.append(len(s))
                if not len(s):
                    sets.append(None), sigs.append(None), bands.append(None)
                    continue
                sets.append(_set_digest(s))
                m = minima(s, a, b)
                sigs.append(pack_bits(m))
                h = lane.copy()
                for k in range(ROWS):
                    h = _mix(h ^ m.reshape(BANDS, ROWS)[:, k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                bands.append(h.astype(np.int64))
            longs = pa.list_(pa.int64())
            keys = [batch.column(c) for c in ("doc_id", "k1", "k2")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(sigs, longs), pa.array(bands, longs)], ["doc_id", "k1", "k2", "n_shingles", "set", "sig", "bands"])

    return rows.mapInArrow(frugal(run, forget), "doc_id long, k1 long, k2 long, n_shingles long, set binary, sig array<long>, bands array<long>")


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the undirected ``edges`` (u, v) reaches.

    In every round nodes take the least label within two steps, what their labels point at takes it, too,
    and labels are followed once, so rounds grow far slower than paths.  Every node has an edge to itself,
    which brings its own label without a join.  Aggregations combine before the shuffle and Spark may
    split the joins; labels are staged, which also cuts the lineage.
    """
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = ws.stage(ends.union(ends.select("u", F.col("u").alias("v"))).distinct(), "edges")
    labels = ws.stage(both.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        after = labels.withColumn("old", F.col("label"))
        for _ in range(2):
            near = both.join(after.withColumnRenamed("node", "v"), "v")
            after = near.groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("old"))).alias("old"))
        hooks = after.select(F.col("old").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        after = after.union(hooks).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        jumped = after.join(after.select(F.col("node").alias("label"), F.col("label").alias("next")), "label").select("node", F.col("next").alias("label"), "old")
        after = ws.stage(jumped, "labels")
        changed = not after.filter("label <> old").isEmpty()
        ws.drop(labels)
        labels = after.select("node", "label")
        labels._staged_at = after._staged_at
        if not changed:
            ws.drop(both)
            return labels


def link_near(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Two documents are linked when their sets of ``size``-word shingles have a Jaccard similarity of
    ``threshold`` or more; ``component_id`` is the smallest doc_id that links reach, and that document is kept.

    1. Documents with equal sets form a class, and classes alone go on, under numbers of their own.
    2. Signatures of 128 minima; equal bands of 4 full minima make candidates.  A bucket of a band is cut
       into slices of about 256; in each only pairs with one of two pivots are made, and of the slices'
       pivots only pairs with one of theirs.
    3. b-bit signatures estimate their similarity by bit counts; hopeless pairs go.  Each set's best
       pivots are confirmed on the full sets, and components merge.
    4. Where a bucket still holds several components, all its pairs across them that can be links are found
       by bounds on set sizes and overlaps and by signatures of 2,048 bits (see ``_left_over``), and
       confirmed.  So no link that bands can find is lost (each estimate leaves six standard errors), and
       neither copies nor texts of one template make all their pairs as rows.

    Null or wordless texts have no set and are linked with nothing.  Ids may be null or shared by differing
    texts: each text has its own class, a null id is no component's least, and a group of null ids only has
    component_id null and keeps its rows.  Repeated rows fall into one class; all rows of the smallest id are
    marked kept.  An empty table gives an empty one; other columns are ignored.
    """
    return _linked(docs, threshold, size, id_col, text_col).drop("k1", "k2")


def _linked(docs: DataFrame, threshold: float, size: int, id_col: str, text_col: str) -> DataFrame:
    """``link_near`` with the rows' ``text_key`` as k1 and k2."""
    ws = Workspace(docs.sparkSession, "near_dedup")
    key = text_key(F.col(f"`{text_col}`"))
    rows = id_and_text(docs, id_col, text_col, key[0].alias("k1"), key[1].alias("k2"))
    signed = ws.stage(_signatures(rows, size), "signed")
    # the text of a class is read again at the row of its smallest id; only one with null ids alone has none
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    same = signed.filter("set is not null").groupBy("set").agg(F.min("doc_id").alias("rep"), F.min(row).alias("at"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = ws.stage(same.withColumn("node", F.monotonically_increasing_id()), "classes")
    merged = _merge(ws, rows, classes, threshold, size)
    members = classes.select("set", "rep", "node").join(merged, "node")
    least = members.groupBy("label").agg(F.min("rep").alias("component_id"))
    place = members.join(least, "label").select("set", "component_id")
    out = signed.select("doc_id", "k1", "k2", "n_shingles", "set").join(classes.select("set", "rep"), "set", "left").join(place, "set", "left")
    component = F.coalesce("component_id", "rep", "doc_id")
    return out.select("doc_id", "k1", "k2", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _merge(ws: Workspace, rows: DataFrame, classes: DataFrame, threshold: float, size: int) -> DataFrame:
    """node, label of classes that are linked with others; a label is a node of the component."""
    each = classes.select("node", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    cut = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("n") / SLICE).cast("long"))
    buckets = ws.stage(each.join(shared, "band").select("band", "node", cut.alias("slice"), (F.col("n") > SLICE).alias("sliced")), "buckets")
    sigs = classes.select("node", "sig")
    near = classes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "at.doc_id", "at.k1", "at.k2")
    sets = _stage_sets(ws, _sets(rows.join(near.withColumnRenamed("doc_id", "_id"), F.col("doc_id").eqNullSafe(F.col("_id")) & (rows["k1"] == near["k1"]) & (rows["k2"] == near["k2"])).select("node", "text").dropDuplicates(["node"]), size))
    floor, percent = least_estimate(threshold), round(threshold * 100)
    links: list[DataFrame] = []

    def estimated(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("su")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("sv")), "v")
        return pairs.withColumn("e", estimate(F.col("su"), F.col("sv"))).filter(F.col("e") >= floor).drop("su", "sv")

    def beside(pairs: DataFrame) -> DataFrame:
        return pairs.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("hu")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("hv")), "v")

    def confirmed(pairs: DataFrame) -> DataFrame:
        sized = beside(pairs.select("u", "v")).withColumn("both", F.size(F.array_intersect("hu", "hv")))
        new = sized.filter(F.col("both") * 100 >= (F.size("hu") + F.size("hv") - F.col("both")) * percent)
        links.append(ws.stage(new.select("u", "v"), "links"))
        return links[-1]

    by = [F.min_by("node", F.xxhash64("node", "band", F.lit(turn))).alias(f"u{turn}") for turn in range(2)]
    pivots = ws.stage(buckets.groupBy("band", "slice", "sliced").agg(*by), "pivots")
    star = buckets.join(pivots.drop("sliced"), ["band", "slice"]).select(F.col("node").alias("v"), F.posexplode(F.array("u0", "u1")).alias("turn", "u"))
    # slices hang together by their pivots, one of which stands for the bucket
    tops = pivots.filter("sliced").select("band", F.explode(F.array("u0", "u1")).alias("node")).distinct()
    top = tops.groupBy("band").agg(F.min_by("node", F.xxhash64("node", "band", F.lit(2))).alias("u"))
    star = star.union(tops.join(top, "band").select(F.col("node").alias("v"), F.lit(2).alias("turn"), "u"))
    star = estimated(star.filter("u <> v").select("u", "v", "turn").distinct())
    labels = components(ws, confirmed(star.groupBy("v", "turn").agg(F.max_by("u", F.struct("e", "u")).alias("u")).select("u", "v").distinct()))
    here = ws.stage(_labelled(buckets, labels), "labelled")
    left = ws.stage(_left_over(ws, here, links[0], labels, estimated, beside, threshold), "left_over")
    late = confirmed(left)
    if not late.isEmpty():
        # what is merged already counts as one node each
        end = lambda c: (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")), c)
        lifted = late.join(*end("u"), "left").join(*end("v"), "left").select(F.coalesce("lu", "u").alias("u"), F.coalesce("lv", "v").alias("v"))
        again = components(ws, lifted)
        every = labels.union(late.select(F.explode(F.array("u", "v")).alias("node")).join(labels, "node", "left_anti").distinct().select("node", F.col("node").alias("label")))
        labels = ws.stage(every.join(again.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    sets._unlist()
    ws.drop(buckets, here, left, pivots)
    return labels


def _stage_sets(ws: Workspace, sets: DataFrame) -> DataFrame:
    """``sets`` written once, bucketed by node: all confirmations join them where they lie, and a lost executor costs a read."""
    spark, path = ws.spark, ws.path("sets")
    name, n = f"near_sets_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets.repartition(n, "node").write.option("compression", "uncompressed").bucketBy(n, "node").option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._unlist = lambda: (spark.sql(f"DROP TABLE IF EXISTS {name}"), ws._delete(path))
    return out


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.select("band", "node").join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("c"))


def _left_over(ws: Workspace, here: DataFrame, links: DataFrame, labels: DataFrame, estimated, beside, threshold: float) -> DataFrame:
    """u, v: every pair across components that shares a bucket and can still be a link, without making all pairs as rows.

    A bucket of two is one pair.  In a larger one each set x is taken apart by the set p of its largest
    component's best-linked document, and by what COMMON or more sets of the group share beside it, as H:
    a = |x & H| and the rest B = x - H.  For two sets x and y, |x & y| <= min(a_x, a_y) + |B_x & B_y|, while a link needs t / (1 + t) * (|x| + |y|).  So

    * either their rests have nothing in common and both a are that large, a join on binned sizes; signatures
      of 2,048 bits are compared within the join, so texts of one template, which share much and differ
      each in another part, don't leave it as pairs (they are compared there, though, size bin by size bin);
    * or they share one of the rarest shingles of their rests, as many as leave too few for a link behind
      them: a prefix-filtered join, in which a shingle meets fewer than COMMON others, and the same signatures.

    Both keep every pair that could be a link, and what a large group shares takes part in neither.
    """
    t = threshold
    sized = here.groupBy("band", "c").agg(F.count("*").alias("n"))
    several = sized.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("n"), F.max_by("c", F.struct("n", "c")).alias("top")).filter("parts > 1")
    ends = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    centers = ends.join(labels, "node").groupBy(F.col("label").alias("top")).agg(F.max_by("node", F.struct("degree", "node")).alias("center"))
    several = ws.stage(several.join(centers, "top", "left").select("band", "n", "top", F.coalesce("center", "top").alias("p")), "several")
    mine = ws.stage(here.join(several, "band"), "mine")
    two = mine.filter("n = 2").groupBy("band").agg(F.min("node").alias("u"), F.max("node").alias("v")).select("u", "v")
    many = mine.filter("n > 2").select(F.col("p").alias("u"), F.col("node").alias("v"), "c", "top").distinct()
    apart = ws.stage(_taken_apart(beside(many).select(F.col("u").alias("p"), F.col("v").alias("x"), "c", "top", "hu", "hv")), "apart")
    rest = apart.select("p", "x", F.explode("rest").alias("s"))
    often = rest.groupBy("p", "s").agg(F.count("*").alias("df"))
    counted = ws.stage(rest.join(often.filter("df > 1"), ["p", "s"]), "counted")
    shared = counted.filter(F.col("df") >= COMMON).groupBy("p", "x").agg(F.count("*").alias("more"))
    more = F.coalesce("more", F.lit(0))
    apart = apart.select("p", "x", "c", "top", "n", "a", "fine", F.size("rest").alias("b")).join(shared, ["p", "x"], "left").withColumns({"a": F.col("a") + more, "b": F.col("b") - more}).drop("more")
    apart = ws.stage(apart.withColumn("cap", F.col("a") * ((1 + t) / t) - F.col("n") + 1e-6), "sized")

    # sizes in bins as wide as a link allows, so that a set looks into three at most; a bin is dealt out in four
    step = max(1e-6, -math.log(t))
    bin_of = lambda c: F.floor(F.log(c) / step).cast("int")
    outer = apart.filter("c <> top").select("p", F.col("x").alias("u"), F.col("c").alias("cu"), F.col("n").alias("nu"), F.col("cap").alias("capu"), F.col("fine").alias("fu")).filter(F.col("capu") >= F.col("nu") * t)
    outer = outer.withColumn("bin", F.explode(F.sequence(bin_of(F.col("nu") * t), bin_of(F.greatest(F.lit(1.0), F.least("capu", F.col("nu") / t)))))).withColumn("deal", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    other = apart.select("p", F.col("x").alias("v"), F.col("c").alias("cv"), F.col("n").alias("nv"), F.col("cap").alias("capv"), F.col("fine").alias("fv"), bin_of(F.col("n")).alias("bin"), F.pmod(F.xxhash64("x"), F.lit(4)).cast("int").alias("deal"))
    alike = fine_estimate(F.col("fu"), F.col("fv")) >= least_fine_estimate(t)
    by_size = outer.join(other, ["p", "bin", "deal"]).filter("cu <> cv and nv <= capu and nu <= capv").filter(alike).select("u", "v")

    # shingles that one set alone has stand first in the order of rarity and link nothing
    need = F.greatest(F.lit(1), F.ceil(F.col("n") * t - F.col("a") - 1e-6).cast("int"))
    rare = counted.filter(F.col("df") < COMMON).join(apart.select("p", "x", "c", "b", need.alias("need")), ["p", "x"])
    ranks = W.partitionBy("p", "x")
    rare = rare.withColumn("rank", F.col("b") - F.count("*").over(ranks) + F.row_number().over(ranks.orderBy("df", "s"))).filter("rank <= b - need + 1")
    one = lambda r, c: rare.select("p", "s", F.col("x").alias(r), F.col("c").alias(c))
    by_rest = one("u", "cu").join(one("v", "cv"), ["p", "s"]).filter("u < v and cu <> cv").select("u", "v").distinct()
    fine = lambda r: apart.select(F.col("x").alias(r), F.col("fine").alias(f"f{r}")).dropDuplicates([r])
    by_rest = by_rest.join(fine("u"), "u").join(fine("v"), "v").filter(alike).select("u", "v")
    pairs = estimated(two).select("u", "v").union(by_size).union(by_rest)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _taken_apart(pairs: DataFrame) -> DataFrame:
    """p, x, c, top, n, a, fine, rest from pairs of sets: the overlap's size, hv's fine signature, and what of hv isn't in hu."""

    def run(batches):
        for batch in batches:
            n, a, fine, rest = [], [], [], []
            for hu, hv in zip(batch.column("hu"), batch.column("hv"), strict=True):
                p, x = hu.values.to_numpy(), hv.values.to_numpy()
                inside = np.isin(x, p, assume_unique=True)
                n.append(len(x))
                a.append(int(inside.sum()))
                fine.append(fine_signature(x.view(np.uint64)))
                rest.append(x[~inside])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in ("p", "x", "c", "top")], pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(fine, longs), pa.array(rest, longs)], ["p", "x", "c", "top", "n", "a", "fine", "rest"])

    return pairs.mapInArrow(frugal(run), "p long, x long, c long, top long, n long, a long, fine array<long>, rest array<long>")


def _sets(rows: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            hashes = [shingles(x.as_py(), size).astype(np.int64) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(hashes, pa.list_(pa.int64()))], ["node", "hashes"])

    return rows.mapInArrow(frugal(run, forget), "node long, hashes array<long>")


def drop_near(docs: DataFrame, threshold: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents kept by ``link_near``, with the columns of ``docs``: one of each group.

    Rows are told apart by id and text, so of rows with one id, or none, only those go whose own text has a
    smaller id in its group.  Null and wordless texts stay, repeated rows share their fate, columns may have
    any names, and an empty table gives an empty one.
    """
    ws = Workspace(docs.sparkSession, "drop_near")
    gone = ws.stage(_linked(docs, threshold, size, id_col, text_col).filter("not kept").select("doc_id", "k1", "k2").distinct(), "gone")
    return without(docs, gone, id_col, text_col)
