"""Token-id output: a content-addressed store of id chunks with document recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace, frugal, id_and_text, prefix_sums

#: The rolling hash covers this many ids; a chunk ends where its top MASK_BITS bits are zero.
WINDOW, MASK_BITS, LEAST, MOST = 4, 10, 64, 8192
_POLY = 0xEDB88320


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of content-defined chunks: places depend on the WINDOW ids before them, so equal passages give equal chunks."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    g ^= g >> np.uint32(15)
    g *= np.uint32(0x85EBCA77)
    h, m = g.copy(), 1
    for k in range(1, WINDOW):
        m = m * 0xC2B2AE3D % 2**32
        h[k:] += g[: n - k] * np.uint32(m)
    hits = np.flatnonzero(h < np.uint32(1 << (32 - MASK_BITS))) + 1
    ends, start, k = [], 0, 0
    while start < n:
        k = int(np.searchsorted(hits, start + LEAST))
        end = min(int(hits[k]) if k < len(hits) else n, start + MOST, n)
        ends.append(end)
        start = end
    return ends


def digest(ids: np.ndarray) -> bytes:
    """A chunk's address: the SHA-256 of its ids as little-endian 32-bit integers, however they are stored."""
    return hashlib.sha256(ids.astype("<u4").tobytes()).digest()


def unpack(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is, and leaves and nodes are hashed apart."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2) modulo the CRC's, bits reflected."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What a block with this CRC-32 adds to that of a stream in which ``n_bytes`` bytes follow it.

    CRC-32 is linear: a stream's is the XOR of what its blocks add, so blocks can be read in any order.
    """
    out, left, power = crc.astype(np.uint32), n_bytes.astype(np.int64), np.array([1 << 23], np.uint32)  # x^8
    while left.any():
        out = np.where(left & 1, _times(np.broadcast_to(power, out.shape).copy(), out), out)
        power, left = _times(power, power), left >> 1
    return out


def write_store(ws: Workspace, docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes all documents and writes ``chunks``, ``recipes`` and ``manifest`` below the workspace.

    * ``chunks`` (digest, n, payload): each distinct chunk of ids once, little-endian in 16 bits where
      the vocabulary allows, else 32; its address is the SHA-256 of its ids in 32 bits.
    * ``recipes`` (doc_id, start, place, n_tokens, digests, sizes, root), range-partitioned in ascending order
      of doc_id (nulls first, ties by content): the chunks of each document, how many ids and documents are
      before it, and the Merkle root of its chunks.
    * ``manifest`` (level, node, n_docs, n_tokens, root): the Merkle tree over all documents' roots.

    A task sends a chunk's payload on only when it first meets it, so a chunk that a third of all documents
    share is shuffled at most once per task.  Null text is empty (only the end id); repeated rows are kept
    as documents of their own; with an empty table all three tables are empty.
    """
    spark = ws.spark
    spec = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())
    schema = "doc_id long, row long, n_tokens long, root binary, digests array<binary>, sizes array<int>, fresh array<struct<digest: binary, n: int, payload: binary>>"

    def encode(batches):
        from nestwell.llm._tokens import encoder

        enc, seen = encoder(spec.value), set()
        width = "<u2" if max(enc.tok.get_vocab_size(), end_id or 0) < 2**16 else "<u4"
        kind = pa.struct([("digest", pa.binary()), ("n", pa.int32()), ("payload", pa.binary())])
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            cols = [[], [], [], [], []]
            for x in batch.column("text"):
                ids = enc.ids(x.as_py())
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], "<u4"))
                digests, sizes, fresh, at = [], [], [], 0
                for end in cut_points(ids):
                    digests.append(d := digest(ids[at:end]))
                    sizes.append(end - at)
                    if d not in seen:
                        seen.add(d)
                        fresh.append({"digest": d, "n": end - at, "payload": ids[at:end].astype(width).tobytes()})
                    at = end
                for c, v in zip(cols, (len(ids), merkle(digests), digests, sizes, fresh), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(kind))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "row", "n_tokens", "root", "digests", "sizes", "fresh"])

    encoded = ws.stage(id_and_text(docs, id_col, text_col).mapInArrow(frugal(encode), schema), "encoded")
    fresh = encoded.select(F.explode("fresh").alias("c")).select("c.*")
    chunks = ws.stage(fresh.groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload")), "chunks")
    # equal rows differ by their number alone, so that many of them spread over many tasks
    recipes = prefix_sums(ws, encoded.drop("fresh"), ["doc_id", "root", "row"], "n_tokens", "start", "place").drop("row")
    manifest = _manifest(ws, recipes)
    ws.drop(encoded)
    return {"chunks": chunks, "recipes": recipes, "manifest": manifest}


def _manifest(ws: Workspace, recipes: DataFrame) -> DataFrame:
    """level, node, n_docs, n_tokens, root: the Merkle tree over all documents in stream order, written level by level.

    A node of level 0 covers 1,024 documents, one of level k as many nodes of level k - 1; six levels reach
    2**60 documents.  Every group is bounded and none reaches the driver.
    """

    def roots(batches):
        for batch in batches:
            found = [merkle([n["root"] for n in nodes.as_py()]) for nodes in batch.column("nodes")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "n_docs", "n_tokens")], pa.array(found, pa.binary())], ["node", "n_docs", "n_tokens", "root"])

    level = recipes.select(F.shiftright("place", 10).alias("node"), F.col("place").alias("below"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "root")
    levels = []
    for k in range(6):
        level = level.groupBy("node").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("below", "root"))).alias("nodes"))
        level = ws.stage(level.mapInArrow(frugal(roots), "node long, n_docs long, n_tokens long, root binary"), f"level{k}")
        levels.append(level.select(F.lit(k).alias("level"), "*"))
        level = level.select(F.shiftright("node", 10).alias("node"), F.col("node").alias("below"), "n_docs", "n_tokens", "root")
    return reduce(DataFrame.union, levels)


def _agree(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests have the same nodes; one number reaches the driver."""
    both = a.select("*", F.lit(1).alias("_side")).union(b.select("*", F.lit(-1).alias("_side")))
    return both.groupBy("level", "node", "n_docs", "n_tokens", "root").agg(F.sum("_side").alias("n")).filter("n <> 0").isEmpty()


def verify_store(store: dict) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32 and ``sound``.

    A document is sound if every chunk of it has its address and size, its recipe's digests give the recipe's
    root, and its sizes its number of tokens.  The whole tree is rebuilt from the recipes' roots, too: where
    it differs from the manifest in any node, its counts or its root (a recipe was exchanged, added or lost),
    no document is sound.  If no recipe is left, there is no row to say so.

    Each distinct chunk is read once; its bytes are hashed and compared with the address.  A document's
    CRC-32 is the XOR of its chunks' shifted CRCs, so no document is gathered in one place.
    """

    def read(batches):
        import zlib

        for batch in batches:
            chunks = [unpack(p.as_py(), n.as_py()) for p, n in zip(batch.column("payload"), batch.column("n"), strict=True)]
            crcs, sound = [zlib.crc32(c.tobytes()) for c in chunks], [digest(c) == d.as_py() for c, d in zip(chunks, batch.column("digest"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(map(len, chunks), pa.int64()), pa.array(crcs, pa.int64()), pa.array(sound, pa.bool_())], ["digest", "n", "crc", "sound"])

    def uses(batches):
        for batch in batches:
            docs, starts, digests, tails, wants, wholes = [], [], [], [], [], []
            for doc, start, n_tokens, found, sizes, root in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "digests", "sizes", "root")], strict=True):
                docs += [doc] * max(1, len(found))
                starts += [start] * max(1, len(found))
                digests += found or [None]
                fit = (sizes + [0] * len(found))[: len(found)]
                tails += (4 * (sum(fit) - np.cumsum(fit, dtype=np.int64))).tolist() or [0]
                wants += fit or [0]
                wholes += [len(sizes) == len(found) and sum(sizes) == n_tokens and merkle(found) == root] * max(1, len(found))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(digests, pa.binary()), pa.array(tails, pa.int64()), pa.array(wants, pa.int64()), pa.array(wholes, pa.bool_())], ["doc_id", "start", "digest", "tail", "want", "whole"])

    def shifted(batches):
        for batch in batches:
            crc, tail = batch.column("crc").to_numpy(), batch.column("tail").to_numpy()
            yield batch.set_column(batch.schema.get_field_index("crc"), "crc", pa.array(shift_crc(crc, tail).astype(np.int64), pa.int64()))

    ws = Workspace(store["recipes"].sparkSession, "verify_store")
    agrees = _agree(_manifest(ws, store["recipes"]), store["manifest"])
    ws.close()
    found = store["chunks"].mapInArrow(frugal(read), "digest binary, n long, crc long, sound boolean")
    wanted = store["recipes"].select("doc_id", "start", "n_tokens", "digests", "sizes", "root").mapInArrow(frugal(uses), "doc_id long, start long, digest binary, tail long, want long, whole boolean")
    each = wanted.join(found, "digest", "left").select("doc_id", "start", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("crc", F.lit(0)).cast("long").alias("crc"), "tail", (F.coalesce("sound", F.col("digest").isNull()) & F.col("whole") & (F.coalesce("n", F.lit(0)) == F.col("want")) & F.lit(agrees)).alias("sound"))
    each = each.mapInArrow(frugal(shifted), "doc_id long, start long, n long, crc long, tail long, sound boolean")
    return each.groupBy("doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.bool_and("sound").alias("sound"))


def read_documents(store: dict) -> DataFrame:
    """doc_id, start and ids (array<int>) rebuilt from recipes and chunks, one row per document."""
    uses = store["recipes"].select("doc_id", "start", F.posexplode("digests").alias("seq", "digest"))
    parts = uses.join(store["chunks"], "digest").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "payload"))).alias("parts"))

    def join(batches):
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"], p["n"]) for p in x.as_py()]).astype(np.int32) for x in batch.column("parts")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return parts.mapInArrow(frugal(join), "doc_id long, start long, ids array<int>")


def open_store(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, **columns) -> dict:
    return write_store(Workspace(spark, "token_store"), docs, tokenizer_path, end_id, **columns)
