"""Packing along a Hilbert curve: neighbouring documents share sequences, and only the last one is padded."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestwell.llm._common import Workspace, frugal, id_and_text, prefix_sums

DIMS, BITS = 4, 8
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, curve_key long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def projection(vocab: int) -> np.ndarray:
    """For each id, DIMS signs: feature hashing straight into the space that the curve fills."""
    h = _mix(np.arange(1, vocab + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.stack([np.where(h >> np.uint64(40 + d) & np.uint64(1), 1.0, -1.0) for d in range(DIMS)], 1)


def cells(ids: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The cell of a document: its distinct ids' signs summed, scaled to unit variance, and the normal law's quantile in 2**BITS steps."""
    distinct = np.unique(ids)
    z = signs[distinct].sum(0) / np.sqrt(max(1, len(distinct)))
    return np.minimum((1 / (1 + np.exp(-1.702 * z)) * 2**BITS).astype(np.int64), 2**BITS - 1)


def hilbert(points: np.ndarray) -> np.ndarray:
    """Keys of points (n, DIMS) along the Hilbert curve over a grid of 2**BITS steps a side.

    Gray-code walk from the top bit: every level fixes which orthant holds the point, then the axes
    below are mirrored or swapped with the first one as the curve enters that orthant.
    """
    x = points.T.astype(np.int64).copy()
    bit = 1 << (BITS - 1)
    while bit > 1:
        low = bit - 1
        for d in range(DIMS):
            inside = (x[d] & bit) != 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
        bit >>= 1
    for d in range(1, DIMS):
        x[d] ^= x[d - 1]
    last, bit = np.zeros_like(x[0]), 1 << (BITS - 1)
    while bit > 1:
        last = np.where(x[DIMS - 1] & bit, last ^ (bit - 1), last)
        bit >>= 1
    x ^= last
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for d in range(DIMS):
            key = key << 1 | (x[d] >> b & 1)
    return key


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int | None = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence of at most ``length`` ids.

    A document's distinct ids are hashed to a vector of few dimensions, whose cell gives its key on a
    Hilbert curve.  All documents in the order (key, doc_id) form one stream of ids, cut every ``length``:
    neighbours on the curve lie in the same or adjoining sequences, and only the very last sequence is not
    full.  ``sequence_id`` counts from 0 along the curve; ``offset`` is the piece's place in its sequence.

    Copies share a key, so the range sort goes on by id and by row: a third of all rows with one key
    spread over as many tasks as their number asks for.  Ids are staged once; only (key, doc_id, size) is
    sorted, and the places go back to the ids by row number.

    Null text is empty: with ``end_id`` such a document still has that id, without it no piece.  A null id
    sorts first; repeated rows are packed each; an empty table gives no pieces; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "packing")
    spec = docs.sparkSession.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read())

    def encode(batches):
        from nestwell.llm._tokens import encoder

        enc, signs = encoder(spec.value), None
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            if signs is None:
                signs = projection(enc.tok.get_vocab_size(with_added_tokens=True) + 1)
            sizes, points, blobs = [], [], []
            for x in batch.column("text"):
                ids = enc.ids(x.as_py())
                points.append(cells(ids, signs))
                if end_id is not None:
                    ids = np.append(ids, np.array([end_id], "<u4"))
                sizes.append(len(ids))
                blobs.append(ids.astype("<u2" if len(signs) < 2**16 else "<u4").tobytes())
            keys = hilbert(np.array(points, np.int64).reshape(-1, DIMS))
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], ["row", "doc_id", "size", "key", "ids"])

    encoded = ws.stage(id_and_text(docs, id_col, text_col).mapInArrow(frugal(encode), "row long, doc_id long, size long, key long, ids binary"), "encoded")
    places = prefix_sums(ws, encoded.select("key", "doc_id", "row", "size"), ["key", "doc_id", "row"], "size", "at").select("row", "at")

    def cut(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve_key", "ids")}
            for doc_id, size, key, blob, at in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "size", "key", "ids", "at")], strict=True):
                if not size:
                    continue
                ids, start = np.frombuffer(blob, "<u2" if len(blob) == 2 * size else "<u4").astype("<u4"), 0
                while start < size:
                    offset = (at + start) % length
                    n = min(size - start, length - offset)
                    part = ids[start : start + n]
                    for k, v in zip(out, (doc_id, start, n, zlib.crc32(part.tobytes()), size, (at + start) // length, offset, key, part.tolist() if with_ids else None), strict=True):
                        out[k].append(v)
                    start += n
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)][: 8 + with_ids], list(out)[: 8 + with_ids])

    return encoded.join(places, "row").select("doc_id", "size", "key", "ids", "at").mapInArrow(frugal(cut), PIECES + ", ids array<int>" * with_ids)
