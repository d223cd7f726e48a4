import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from nestwell.llm import exact_dedup, near_dedup
from nestwell.llm._common import Workspace


def test_minimal_perfect_hash():
    for n in (1, 2, 5, 100, 2048):
        digests = [hashlib.sha256(f"{n}-{i}".encode()).digest() for i in range(n)]
        shifts, slots = exact_dedup.build_bucket(digests)
        assert sorted(slots) == list(range(n)) and len(shifts) == -(-n // exact_dedup.GROUP)


def test_exact_groups_equal_brute_force(frame, oddities):
    rows = [(i, t) for i, t in oddities if i is not None] + [(100 + i, f"text {i % 37}") for i in range(300)]
    got = exact_dedup.exact_groups(frame(rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want
    assert exact_dedup.exact_groups(frame([])).count() == 0


def test_history_and_nonmembers(spark, frame):
    rows = [(1, "seen"), (2, "seen"), (3, "new"), (4, "twice"), (5, "twice"), (None, "lost")]
    past = spark.createDataFrame([(90, bytearray(hashlib.sha256(b"seen").digest())), (80, bytearray(hashlib.sha256(b"seen").digest())), (91, bytearray(hashlib.sha256(b"other").digest()))], "doc_id long, digest binary")
    got = {r.doc_id: (r.keep_id, r.kept, r.in_history) for r in exact_dedup.exact_groups(frame(rows), past).collect()}
    assert got == {1: (90, False, True), 2: (90, False, True), 3: (3, True, False), 4: (5, False, False), 5: (5, True, False), None: (None, True, False)}
    assert sorted(str(r.doc_id) for r in exact_dedup.drop_repeats(frame(rows), past).collect()) == ["3", "5", "None"]


def test_a_slot_of_another_digest_is_no_member(spark):
    ws = Workspace(spark, "t")
    digest = lambda s: bytearray(hashlib.sha256(s.encode()).digest())
    known = spark.createDataFrame([(digest(f"k{i}"), i, 2, False) for i in range(3000)], "digest binary, winner long, copies long, historical boolean")
    index, buckets = exact_dedup.build_index(ws, known)
    asked = spark.createDataFrame([(i, digest(f"k{i}")) for i in range(0, 6000, 7)], "doc_id long, digest binary")
    for r in exact_dedup.look_up(asked, index, buckets).collect():
        assert r.winner == (r.doc_id if r.doc_id < 3000 else None)


def test_ties_keep_one(frame):
    rows = [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "c")]
    out = exact_dedup.drop_repeats(frame(rows))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a"), (3, "b"), (4, "c")] and out.columns == frame(rows).columns


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def mutate(rnd, text, share):
    return " ".join(w + "x" if rnd.random() < share else w for w in text.split())


def test_near_groups_equal_brute_force(frame, prose):
    rnd = random.Random(11)
    rows = [(i, prose(rnd.randint(1, 120), i)) for i in range(60)]
    for k in range(12):
        base = prose(100, 1000 + k)
        rows += [(200 + 20 * k + j, mutate(rnd, base, 0.004 * j)) for j in range(14)]
    rows += [(900, "The  Same\tSET"), (901, "the same set"), (902, None), (903, ""), (904, "É one"), (905, "é one")]
    got = near_dedup.link_near(frame(rows), 0.8, 4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute(rows, 4, 80)


def test_a_large_group_that_hangs_together_loosely(frame, prose, monkeypatch):
    """Outliers of a group, some sharing a passage: what bounds on rests must find."""
    monkeypatch.setattr(near_dedup, "COMMON", 4)
    rnd = random.Random(3)
    base, passage = prose(150, 77), prose(20, 78)
    rows = []
    for i in range(150):
        t = mutate(rnd, base, rnd.choice([0.01, 0.02, 0.04, 0.05]))
        rows.append((i, t + (" " + passage if i % 3 == 0 else "")))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.link_near(frame(rows), 0.8, 4).collect()}
    assert got == brute(rows, 4, 80) and len({c for _, c, _ in got.values()}) > 3


def test_near_edges(frame, oddities):
    got = near_dedup.link_near(frame(oddities), 0.8, 4).collect()
    assert len(got) == len(oddities)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept, r.n_shingles))
    assert by[1] == {(1, True, 0)} and by[2] == {(2, True, 0)} and by[3] == {(3, True, 0)} and by[4] == {(4, True, 1)}
    assert {c for c, _, _ in by[6]} == {5} and by[10] == {(7, False, next(iter(by[7]))[2])} and {(c, k) for c, k, _ in by[None]} == {(None, True)}
    assert near_dedup.link_near(frame([])).count() == 0
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")]
    kept = near_dedup.drop_near(frame(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == frame(rows).columns


def test_estimate_matches_lane_by_lane_counts(spark):
    rnd = np.random.default_rng(2)
    a = rnd.integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32)
    b = np.where(rnd.random(near_dedup.HASHES) < 0.7, a, rnd.integers(0, 2**32, near_dedup.HASHES, dtype=np.uint32)).astype(np.uint32)
    equal = ((a & 15) == (b & 15)).mean()
    df = spark.createDataFrame([(near_dedup.pack_bits(a).tolist(), near_dedup.pack_bits(b).tolist())], "a array<long>, b array<long>")
    got = df.select(near_dedup.estimate(F.col("a"), F.col("b")).alias("e")).first().e
    assert abs(got - (equal - 1 / 16) / (15 / 16)) < 1e-9


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(201, 200), (202, 200), (203, 202)]
    random.Random(1).shuffle(edges)
    got = near_dedup.components(Workspace(spark, "t"), spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.label for r in got.collect()} == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {i: 200 for i in range(200, 204)}
