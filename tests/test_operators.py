import random

import pytest
from pyspark.sql import functions as F

from nestwell.operators import expiry, integrity, merge, ordered, tree, writes
from nestwell.operators.merge import ConflictPolicy


def entries_of(node, path=""):
    """Rows of a nested dict: dicts are buckets, (value, ttl) pairs are values; a bucket's counter is its size."""
    for name, v in sorted(node.items()):
        if isinstance(v, dict):
            yield path, bytearray(name), "bucket", None, len(v), None
            yield from entries_of(v, path + name.hex() + "/")
        else:
            yield path, bytearray(name), "kv", bytearray(v[0]), None, v[1]


class Conflict(Exception):
    pass


def merged(dst, src, policy, report, at=""):
    """The recursive model: what a depth-first walk over the source does to the destination."""
    for name in sorted(src):
        s, d, here = src[name], dst.get(name), at + name.hex() + "/"
        clash = d is not None and (isinstance(s, dict) != isinstance(d, dict) or not isinstance(s, dict) and s != d)
        if clash and policy is ConflictPolicy.ERROR:
            raise Conflict(here)
        if clash and policy is ConflictPolicy.KEEP_EXISTING:
            report["skipped"] += 1
        elif isinstance(s, dict):
            if isinstance(d, dict):
                report["buckets_merged"] += 1
            else:
                report["buckets_created"] += 1
                report["type_conflicts_resolved"] += d is not None
                dst[name] = {}
            merged(dst[name], s, policy, report, here)
        elif d == s:
            report["unchanged"] += 1
        else:
            report["updated" if isinstance(d, tuple) else "inserted"] += 1
            report["type_conflicts_resolved"] += isinstance(d, dict)
            dst[name] = s


def random_tree(rnd, depth):
    names = [b"a", b"a\0", b"\xff", b"b", b"c/", b""]
    out = {}
    for n in rnd.sample(names, rnd.randint(0, 5)):
        out[n] = random_tree(rnd, depth - 1) if depth and rnd.random() < 0.5 else (rnd.choice([b"1", b"2"]), rnd.choice([None, None, 5, 6]))
    return out


@pytest.mark.parametrize("policy", list(ConflictPolicy))
def test_merge_equals_the_recursive_model(spark, policy):
    rnd = random.Random(policy.value)
    schema = "path string, key binary, kind string, value binary, next_int bigint, ttl bigint"
    import copy

    for _ in range(4):
        dst, src = random_tree(rnd, 3), random_tree(rnd, 3)
        planned = merge.plan(spark.createDataFrame(list(entries_of(dst)), schema), spark.createDataFrame(list(entries_of(src)), schema), policy)
        want, report = copy.deepcopy(dst), dict.fromkeys(merge.REPORT, 0)
        try:
            merged(want, src, policy, report)
        except Conflict as e:
            assert merge.first_conflict(planned).first()["at"] == str(e)
            continue
        assert merge.report(planned).first().asDict() == report
        strip = lambda rows: sorted((p, bytes(k), kind, None if v is None else bytes(v), t) for p, k, kind, v, _, t in rows)
        assert strip(merge.merged(planned).collect()) == strip(entries_of(want))


def test_paths_order_depth_first(spark):
    rows = list(entries_of({b"a": {b"z": {b"q": (b"1", None)}}, b"a\0": (b"1", None), b"\xff": {}, b"": (b"1", None)}))
    df = spark.createDataFrame(rows, "path string, key binary, kind string, value binary, next_int bigint, ttl bigint")
    got = [(r.path, bytes(r.key)) for r in tree.depth_first(df).collect()]
    assert got == [("", b""), ("", b"a"), ("61/", b"z"), ("61/7a/", b"q"), ("", b"a\0"), ("", b"\xff")]
    assert tree.names_of(tree.path_of([b"", b"a/", b"\0"])) == [b"", b"a/", b"\0"]


def test_conditional_chain_and_counters(spark):
    base = spark.createDataFrame([("a", "1")], "k string, v string")
    ops = spark.createDataFrame([("a", 1, "1", "2"), ("a", 2, "1", "x"), ("a", 3, "2", None), ("a", 4, None, "3"), ("b", 1, "?", "y"), ("b", 2, None, "z")], "k string, seq int, expected string, new string")
    got = {r.k: (r.v, r.applied) for r in writes.fold_conditional(base, ops, ["k"], ["seq"], "v").collect()}
    assert got == {"a": ("3", 3), "b": ("z", 1)}
    adds = spark.range(1000).selectExpr("if(id % 10 = 0, id % 3, 7) as k", "id as seq", "id % 5 as n")
    seen: dict = {}
    for r in writes.fetch_add_previous(adds, "k", ["seq"], "n", slices=6).orderBy("seq").collect():
        assert r.previous == seen.get(r.k, 0)
        seen[r.k] = r.previous + r.n
    totals = {r.k: r.value for r in writes.fetch_add(adds, "k", "n", spark.createDataFrame([(7, 100)], "k bigint, value bigint")).collect()}
    assert totals == {k: v + 100 * (k == 7) for k, v in seen.items()}


@pytest.mark.parametrize("keys,rises", [([], True), ([1], True), (list(range(500)), True), ([*range(250), 249, *range(250, 400)], False), ([2, 1], False), ([1, 1], False)])
def test_insert_ordered(spark, keys, rises):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "seq int, k int")
    r = writes.insert_ordered(df, "k", ["seq"], blocks=7).first()
    assert (r.inserted, r.ordered) == (len(keys), rises)


def test_appearances_count_returns(spark):
    ops = spark.createDataFrame([("b", "x", 1, True), ("b", "x", 2, True), ("b", "x", 3, False), ("b", "x", 4, True), ("b", "y", 1, False)], "b string, k string, seq int, here boolean")
    assert writes.appearances(ops, ["b"], "k", ["seq"], F.col("here")).first().next_int == 2


def test_purge_is_ordered_and_bounded(spark):
    ttl = spark.createDataFrame([("b", "k1", 5), ("a", "k2", 9), ("a", "k1", 9), ("a", "k3", 11)], "path string, key string, expires_at_ms bigint")
    assert [(r.path, r.key) for r in expiry.due(ttl, ["path", "expires_at_ms", "key"], 10, 2).collect()] == [("a", "k1"), ("a", "k2")]
    entries = spark.createDataFrame([("a", "k3"), ("a", "k1"), ("c", "k1")], "path string, key string")
    assert sorted(map(tuple, expiry.live(entries, ttl, ["path", "key"], 9).collect())) == [("a", "k3"), ("c", "k1")]


def test_violations(spark):
    rows = [("", bytearray(b"a"), "bucket", None, 1), ("61/", bytearray(b"k"), "kv", bytearray(b"v"), None), ("61/", bytearray(b"k"), "kv", bytearray(b"v"), None), ("62/", bytearray(b"k"), "kv", bytearray(b"v"), None), ("61/", bytearray(b"z"), "kv", None, None), ("61/", bytearray(b"y"), "odd", None, None)]
    got = sorted((r.invariant, r.path) for r in integrity.violations(spark.createDataFrame(rows, tree.ENTRIES)).collect())
    assert got == [("kind_shape", "61/"), ("kind_shape", "61/"), ("parent_exists", "62/"), ("unique_key", "61/")]


def test_binary_ranges_and_prefixes_reach_the_scan(spark, tmp_path):
    df = spark.range(1000).selectExpr("unhex(lpad(hex(id), 16, '0')) as key", "id")
    df.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    prefix = ordered.prefix_scan(rows, "key", b"\0\0\0\0\0\0\1")
    plan = prefix._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan and prefix.count() == 256
    assert [r.id for r in ordered.seek_parked(rows.where("id % 2 = 0"), "key", (7).to_bytes(8, "big")).limit(2).collect()] == [6, 8]
    assert ordered.seek_parked(rows.where("id > 5"), "key", b"\0").first().id == 6
