import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from nestwell.llm import packing, token_store  # noqa: E402
from nestwell.llm._common import Workspace  # noqa: E402
from nestwell.llm._tokens import Encoder, ranks  # noqa: E402
from nestwell.llm.token_counts import count_tokens  # noqa: E402

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=[BYTES, WORDS])
def enc(request):
    return Encoder(open(request.param, encoding="utf-8").read())


def direct(enc, text):
    return enc.tok.encode(text, add_special_tokens=False).ids


def test_every_token_of_the_vocabulary_encodes_to_itself():
    """What the fast engine's use rests on: neighbours whose union is a token are joined in no other way."""
    import json

    for path in (BYTES, WORDS):
        spec = json.load(open(path, encoding="utf-8"))
        assert ranks(spec)
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        order = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        special = {x["content"] for x in spec["added_tokens"]}
        for token in set(model["vocab"]) - special:
            ends = bool(suffix) and token.endswith(suffix)
            parts = list(token[: -len(suffix)] if ends else token)
            if ends:
                parts[-1] += suffix
            while len(parts) > 1:
                k = min(range(len(parts) - 1), key=lambda i: order.get((parts[i], parts[i + 1]), 1 << 30))
                assert (parts[k], parts[k + 1]) in order, token
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert parts == [token]


def test_encoder_and_resynchronisation_equal_the_library(enc):
    rnd = random.Random(4)
    bits = ["a", "Bc", " ", "  ", "\n", "'s", "é", "é", "12", "!!", "_", "<|endoftext|>", "<|", "日", "\t", "x" * 30, "ſ", "Σ", "ß", "'", "\x1c"]
    for i in range(1500):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 120)))
        want = direct(enc, text)
        assert enc.ids(text).tolist() == want, text
        if text:
            got, chunks, widened = enc.resync(text, chunk=rnd.randint(5, 40), overlap=rnd.randint(2, 30))
            assert got.tolist() == want, text
    long_word = "z" * 3000 + " end. " + "y" * 500
    got, chunks, widened = enc.resync(long_word, chunk=200, overlap=50)
    assert got.tolist() == direct(enc, long_word) and widened


def test_counts(spark, frame, oddities, enc):
    tok = Encoder(open(BYTES, encoding="utf-8").read()).tok
    got = count_tokens(frame(oddities), BYTES, chunk_chars=20_000, overlap_chars=64).collect()
    want = sorted((str(i), len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in oddities)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) and (r.n_chunks > 1) == (r.n_bytes > 100_000) for r in got)
    assert count_tokens(frame([]), BYTES).count() == 0


def test_store_round_trip(spark, frame, oddities):
    tok = Encoder(open(WORDS, encoding="utf-8").read()).tok
    store = token_store.open_store(spark, frame(oddities), WORDS, end_id=2)
    want, at = [], 0
    texts = sorted(((i is not None, i or 0), t or "") for i, t in oddities)
    got = token_store.verify_store(store).orderBy("start").collect()
    docs = {r.start: r.ids for r in token_store.read_documents(store).collect()}
    assert [r.doc_id for r in got] == [k[1] if k[0] else None for k, _ in texts]
    for r in got:
        assert r.start == at and r.sound
        ids = docs[r.start]
        assert (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) == (r.n_tokens, r.ids_crc32) and ids[-1] == 2
        want.append((r.doc_id, tuple(ids)))
        at += r.n_tokens
    assert sorted(map(repr, want)) == sorted(repr((i, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]))) for i, t in oddities)
    # equal texts share chunks; the Merkle manifest covers all
    n = store["chunks"].count()
    assert n == store["chunks"].select("digest").distinct().count() < sum(len(r.digests) for r in store["recipes"].collect())
    top = store["manifest"].orderBy("level").collect()[-1]
    assert (top.n_docs, top.n_tokens) == (len(oddities), at)
    empty = token_store.open_store(spark, frame([]), WORDS)
    assert token_store.verify_store(empty).count() == 0 and empty["manifest"].count() == 0


def test_a_damaged_or_missing_chunk_is_noticed(spark, frame, prose):
    from pyspark.sql import functions as F

    store = token_store.open_store(spark, frame([(1, prose(40, 5)), (2, prose(40, 6))]), WORDS)
    one = store["chunks"].first().digest
    bad = store | {"chunks": store["chunks"].withColumn("payload", F.when(F.col("digest") == F.lit(one), F.reverse(F.col("payload").cast("string")).cast("binary")).otherwise(F.col("payload")))}
    assert not all(r.sound for r in token_store.verify_store(bad).collect())
    gone = store | {"chunks": store["chunks"].where(F.col("digest") != F.lit(one))}
    assert sum(not r.sound for r in token_store.verify_store(gone).collect()) == 1


def test_a_damaged_or_missing_recipe_is_noticed(spark, frame, prose):
    from pyspark.sql import functions as F

    store = token_store.open_store(spark, frame([(1, prose(6000, 5)), (2, prose(6000, 6)), (3, prose(60, 7))]), WORDS)
    assert sorted(r.level for r in store["manifest"].collect()) == [0, 1, 2, 3, 4, 5]
    sound = lambda recipes: {r.doc_id: r.sound for r in token_store.verify_store(store | {"recipes": recipes}).collect()}
    r = store["recipes"]
    assert min(x.n for x in r.select(F.size("digests").alias("n")).where("doc_id < 3").collect()) > 1
    assert sound(r) == {1: True, 2: True, 3: True}
    first = lambda c, v: r.withColumn(c, F.when(F.col("doc_id") == 1, v).otherwise(F.col(c)))
    swapped = first("digests", F.reverse("digests")).withColumn("sizes", F.when(F.col("doc_id") == 1, F.reverse("sizes")).otherwise(F.col("sizes")))
    assert sound(swapped) == {1: False, 2: True, 3: True}
    short = first("digests", F.slice("digests", 1, F.size("digests") - 1))
    assert not sound(short)[1] and not sound(short.withColumn("sizes", F.slice("sizes", 1, F.size("digests"))))[1]
    assert not sound(first("sizes", F.reverse("sizes")))[1] and not sound(first("sizes", F.slice("sizes", 1, 1)))[1]
    # recipes that are sound in themselves: one lost, one in another's place
    assert not any(sound(r.where("doc_id <> 3")).values())
    other = r.where("doc_id = 2").select("digests", "sizes", "root", "n_tokens").first()
    lit = lambda x: F.array(*map(F.lit, map(bytes, x)))
    assert not any(sound(first("digests", lit(other.digests)).withColumn("sizes", F.when(F.col("doc_id") == 1, F.array(*map(F.lit, other.sizes))).otherwise(F.col("sizes"))).withColumn("root", F.when(F.col("doc_id") == 1, F.lit(bytes(other.root))).otherwise(F.col("root"))).withColumn("n_tokens", F.when(F.col("doc_id") == 1, F.lit(other.n_tokens)).otherwise(F.col("n_tokens")))).values())


def test_crc_of_blocks_and_cut_points():
    rnd = np.random.default_rng(1)
    ids = rnd.integers(0, 49_000, 60_000).astype("<u4")
    ends = token_store.cut_points(ids)
    assert ends[-1] == len(ids) and all(0 < b - a <= token_store.MOST for a, b in zip([0, *ends], ends, strict=False))
    data = ids.tobytes()
    parts = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    tails = np.array([len(data) - 4 * e for e in ends])
    each = token_store.shift_crc(np.array([zlib.crc32(p) for p in parts], np.uint32), tails)
    assert np.bitwise_xor.reduce(each) == zlib.crc32(data)
    # a passage set in other surroundings is cut at the same places
    moved = token_store.cut_points(np.concatenate([ids[:777], ids[20_000:50_000]]))
    assert {e + 20_000 - 777 for e in moved[4:]} & set(ends)


def test_packing(spark, frame, oddities):
    tok = Encoder(open(BYTES, encoding="utf-8").read()).tok
    rows = packing.pack(frame(oddities), BYTES, length=64, end_id=0, with_ids=True).collect()
    seqs: dict = {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        seqs.setdefault(r.sequence_id, []).append(r)
    sizes = []
    for s in sorted(seqs):
        at = 0
        for r in sorted(seqs[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert sorted(seqs) == list(range(len(seqs))) and all(n == 64 for n in sizes[:-1]) and sizes[-1] <= 64
    # pieces put together give the documents
    whole: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        whole.setdefault((r.doc_id, r.curve_key), []).append(r)
    flat = sorted(x for v in whole.values() for r in v for x in r.ids)
    want = sorted(x for _, t in oddities for x in [*tok.encode(t or "", add_special_tokens=False).ids, 0])
    assert flat == want and packing.pack(frame([]), BYTES).count() == 0
    assert not [r for r in packing.pack(frame([(1, None)]), BYTES, end_id=None).collect()]


def test_hilbert_neighbours():
    """Consecutive keys of a Hilbert curve are neighbouring cells, and keys are a permutation."""
    old = packing.BITS
    try:
        packing.BITS = 3
        grid = np.stack(np.meshgrid(*[np.arange(8)] * packing.DIMS, indexing="ij"), -1).reshape(-1, packing.DIMS)
        keys = packing.hilbert(grid)
        assert sorted(keys) == list(range(8**packing.DIMS))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
    finally:
        packing.BITS = old


def test_staging_survives_in_the_shared_folder(spark):
    ws = Workspace(spark, "t")
    df = ws.stage(spark.range(5), "x")
    assert df.count() == 5 and ws.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    ws.drop(df)


def test_chunks_of_plain_texts_equal_the_library():
    """The fast engine's chunks: pre-tokens by pattern, offsets by tokens' sizes, beside chunks that the library encodes."""
    enc, rnd = Encoder(open(BYTES, encoding="utf-8").read()), random.Random(9)
    bits = ["a", "Word", "über", " ", "  ", "\n", "\n\n", "'s", "'ll", "'", "é", "12", "!!", "_", "ÿ", "x" * 30, "don't", " ...", "×", "日"]
    for i in range(1500):
        kinds = bits[: rnd.choice([len(bits), len(bits) - 2])]
        text = "".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 150)))
        ids, at, first = enc._chunk(text, 0, len(text))
        whole = enc.tok.encode(text, add_special_tokens=False)
        starts = [k for k, w in enumerate(whole.word_ids) if k == 0 or w != whole.word_ids[k - 1]]
        assert ids.tolist() == whole.ids and first.tolist() == starts and at.tolist() == [whole.offsets[k][0] for k in starts], text
        got, chunks, widened = enc.resync(text, chunk=rnd.randint(5, 60), overlap=rnd.randint(2, 40))
        assert got.tolist() == whole.ids, text
