"""Rows told apart by id and text, long texts, templates, and operators against independent versions."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from nestwell.llm import chat, decontaminate, exact_dedup, near_dedup, pii, quality, queries, secret_scan

SF = "/root/testdata/sf0.001"
#: Names of the operators' own temporary columns.
OWN = "_id long, _ID2 long, _sha string, _k1 long, _k2 long, k1 long, k2 long, n_words long, ballot string, keys string, values string, node long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "s", 3, 4, 5, 6, 7, "b", "k", "v", 8) for i, t in rows], f"doc_id long, text string, {OWN}").repartition(3)


def left(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_stages_drop_rows_and_not_ids(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id int, text string")
    rows = [(None, "x a b c"), (None, "clean one"), (7, "x a b c"), (7, "fine text"), (8, None)]
    out = decontaminate.drop_contaminated(clashing(spark, rows), items)
    assert left(out) == [("7", "fine text"), ("8", None), ("None", "clean one")] and out.columns == clashing(spark, rows).columns
    rows = [(1, "p q r s t u"), (2, "p q r s t u"), (2, "another text of its own"), (None, "p q r s t u"), (None, "only here"), (None, "only here")]
    assert left(near_dedup.drop_near(clashing(spark, rows))) == [("1", "p q r s t u"), ("2", "another text of its own"), ("None", "only here"), ("None", "only here")]
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "b"), (None, "c"), (None, "c"), (None, "b"), (3, None), (4, "")]
    out = exact_dedup.drop_repeats(clashing(spark, rows))
    assert left(out) == [("1", "a"), ("2", "b"), ("4", ""), ("None", "c")] and out.columns == clashing(spark, rows).columns
    kept = quality.drop_rejected(clashing(spark, rows))
    assert kept.columns == clashing(spark, rows).columns


def test_long_texts_are_decontaminated_in_linear_time(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(4))
    passage = [word() for _ in range(25)]
    items, took = spark.createDataFrame([(5, " ".join(passage))], "item_id int, text string"), []
    for n in (20_000, 125_000, 250_000, 500_000):
        words = [word() for _ in range(n)]
        words[n - 30 : n - 5] = passage
        words[100:112] = passage[3:15]
        docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
        at = time.monotonic()
        r = decontaminate.report(decontaminate.decontaminate(docs, items)).first()
        took.append(time.monotonic() - at)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, 37, 1, hashlib.sha256(b"5").hexdigest())
    assert took[3] <= 2.5 * took[2] and took[2] <= 2.5 * took[1] + 1


def test_templates_leave_few_candidates(spark, monkeypatch):
    """Texts that share most of a hundred passages, none enough for a link."""
    rnd, seen, real = random.Random(1), [], near_dedup._left_over
    passages = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(12)) for _ in range(100)]

    def spy(ws, *more):
        seen.append(ws.stage(real(ws, *more), "spy"))
        return seen[-1]

    monkeypatch.setattr(near_dedup, "_left_over", spy)
    rows = []
    for i in range(200):
        pick = set(rnd.sample(range(100), 78))
        rows.append((i, " ".join(p for k, p in enumerate(passages) if k in pick)))
    got = near_dedup.link_near(spark.createDataFrame(rows, "doc_id long, text string"), 0.8, 4).collect()
    sets = [near_dedup.shingles(t, 4) for _, t in rows]
    links = sum(100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for i, a in enumerate(sets) for b in sets[:i])
    assert links == 0 and len({r.component_id for r in got}) == 200
    assert seen[0].count() < 600, "of 19,900 pairs"


def test_fine_signatures_estimate_similarity():
    rnd = np.random.default_rng(3)
    for n, share in ((5, 0.8), (60, 0.6), (3000, 0.8), (3000, 0.3)):
        common = rnd.integers(0, 2**63, int(n * share), dtype=np.uint64)
        rest = [rnd.integers(0, 2**63, n - len(common), dtype=np.uint64) for _ in range(2)]
        a, b = (near_dedup.fine_signature(np.concatenate([common, r])) for r in rest)
        true = len(common) / (2 * n - len(common))
        differ = sum(int(x).bit_count() for x in (a ^ b).view(np.uint64))
        assert abs(1 - 2 * differ / near_dedup.FINE - true) < 0.12


def plain_measure(text):
    """``quality.measure`` word by word, without its short cuts."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, {}
    fold = lambda w: "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isalnum() else c for c in w)
    shapes = Counter(zlib.crc32(re.sub(r"(.)\1+", r"\1", fold(w)).encode("utf-8", "surrogatepass")) % quality.DIMS for w in words)
    odd = set("#$%&*@^~<>{}|\\=!")
    lines, many = [x for x in text.split("\n") if x], n > 30
    seen = {
        "odd_marks": sum(c in odd for w in words for c in w) / n,
        "odd_ends": sum(w[-1] in odd for w in words) / n,
        "capitals": sum(w.isupper() and len(w) > 1 for w in words) / n,
        "shouts": sum(w.endswith("!") for w in words) / n,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "sameness": 1 - len(set(words)) / n if many else 0.0,
        "one_word": max(Counter(words).values()) / n if many else 0.0,
        "bare_marks": sum(not any(c.isalnum() for c in w) for w in words) / n,
        "no_sentences": 1 - sum(w[-1] in ".?" for w in words) / n if many else 0.0,
        "same_lines": 1 - len(set(lines)) / len(lines) if len(lines) > 4 else 0.0,
    }
    feats = {k: (c / n) ** 0.5 for k, c in shapes.items()}
    for name, v in seen.items():
        k = zlib.crc32(f"{name} {min(9, int(v * 10))}".encode()) % quality.DIMS
        feats[k] = feats.get(k, 0.0) + 0.5
    return n, feats


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_score_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    w = quality.train(docs)["weights"]
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    for r in docs.collect():
        n, feats = plain_measure(r.text or "")
        z = w[-1] + sum(w[k] * v for k, v in feats.items())
        want = 1 / (1 + np.exp(-z)) if n else 0.0
        assert got[r.doc_id].n_words == n and abs(got[r.doc_id].quality - want) < 2e-6


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


def test_levels_of_long_chains_and_cycles(spark):
    chain = [(1, f"n{i}", [f"n{i - 1}"] if i else []) for i in range(200)]
    odd = [(2, "a", ["b"]), (2, "b", ["a"]), (2, "c", ["a", "d"]), (2, "d", []), (2, "e", ["d", "gone"]), (2, "f", ["e", "d"]), (2, "s", ["s"]), (3, "x", ["y"]), (3, "y", [])]
    ws = chat.Workspace(spark, "levels")
    got = {(r.conv_id, r.id): r.level for r in chat._levels(ws, spark.createDataFrame(chain + odd, "conv_id long, id string, after array<string>")).collect()}
    assert all(got[1, f"n{i}"] == i for i in range(200)) and ws._count <= 12
    assert [got[2, k] for k in "abcdefs"] == [None, None, None, 0, 1, 2, None] and (got[3, "x"], got[3, "y"]) == (1, 0)


def test_answers_as_calls_edges(spark):
    turns = [(1, 0, "assistant", "first"), (1, 1, "user", "q"), (1, 2, "Assistant", "a"), (1, 3, "system", None), (None, 1, "assistant", "lost"), (2, None, "assistant", "no turn"), (3, 0, None, None)]
    got = chat.format_chat(chat.as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")), tools=chat.ANSWER, per_call=True).collect()
    calls = {(r.conv_id, r.turn): (r.level, r.status, r.errors) for r in got if r.kind == "call"}
    assert calls == {(1, 0): (0, "linked", "missing:question"), (1, 4): (1, "linked", "")}
    assert sorted((str(r.conv_id), str(r.turn)) for r in got if r.kind == "message") == sorted([("1", "0"), ("1", "2"), ("1", "4"), ("1", "6"), ("None", "2"), ("2", "None"), ("3", "0")])
    assert chat.as_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_weak_secrets_and_context(frame):
    found = {r.doc_id: r.spans for r in secret_scan.report(secret_scan.scan_secrets(frame([(1, "user=bob auth: secret=abcdefgh12"), (2, "user=bob pass: hunter2!x")]))).collect()}
    assert found == {1: "weak_id:0:8,assign:15:32", 2: "weak_id:0:8,weak_secret:9:24"}
    texts = {1: "visa card no. 77, exp 12/27: 4111111111111111", 2: "card " + "x" * 60 + " 4111111111111111", 3: "4111111111111111 then 12 and card", 4: "4111111111111111 then 12 and more x card"}
    got = {r.doc_id: r.scores for r in pii.report(pii.find_pii(frame(texts.items()))).collect()}
    assert got == {1: "1.0", 2: "0.8", 3: "1.0", 4: "1.0" if len(texts[4]) - 16 <= 24 else "0.8"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_every_document_counts_as_the_library_has_it(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.token_counts(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(got[r.doc_id].n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids) for r in docs)
    assert sum(r.n_chunks > 1 for r in got.values()) > 10
