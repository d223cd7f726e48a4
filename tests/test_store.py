import io
import json
import random
import subprocess
import sys
import tarfile

import pytest
from pyspark.sql import functions as F

from nestwell import errors as E
from nestwell.functions.codecs import U64
from nestwell.operators.merge import ConflictPolicy, MergeReport
from nestwell.operators.ordered import Bound
from nestwell.sources import maintenance
from nestwell.sources.store import FormatInfo, Options, Store, Verification

U = U64()


def kv(bucket):
    return [(bytes(r.key), bytes(r.value)) for r in bucket.kv_pairs().collect()]


def test_large_layers_are_not_broadcast(store, spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.range(150_000).select(U.encode(F.col("id")).alias("key"), F.encode(F.lit("v"), "UTF-8").alias("value"))
    few = rows.limit(5)
    with store.update() as tx:
        b = tx.create_bucket("b")
        assert b.put_if_absent_many(rows).where("applied").count() == 150_000
        assert b.delete_if_value_many(few.withColumnRenamed("value", "expected")).where("applied").count() == 5
        assert b.len() == 149_995 and "BroadcastHashJoin" in plan(tx.entries)  # the few deletions
        assert "BroadcastHashJoin" not in plan(rows.join(b._each_once(rows).select("key"), "key", "left_semi"))
    with store.update() as tx:
        b = tx.get_bucket("b")
        b.insert_many(rows.withColumn("value", F.encode(F.lit("w"), "UTF-8")))
    with store.view() as tx:
        assert "SortMergeJoin" in plan(tx.entries) and "BroadcastHashJoin" not in plan(tx.entries)
        assert tx.get_bucket("b").len() == 150_000


def test_shuffled_inserts_scan_in_order(store):
    ints = list(range(1001))
    random.Random(3).shuffle(ints)
    with store.update() as tx:
        b = tx.create_bucket("abc")
        assert b.insert_many([(U.pack(i), str(i)) for i in ints]) == 1001
        assert b.next_int() == 1001 and b.get("absent") is None
    with store.view() as tx:
        assert kv(tx.get_bucket("abc")) == [(U.pack(i), str(i).encode()) for i in range(1001)]


def test_snapshot_isolation_and_rollback(store):
    with store.update() as tx:
        tx.create_bucket("abc").insert_many([(U.pack(i), str(i)) for i in range(11)])
    reader = store.read_tx()
    with store.update() as tx:
        tx.get_bucket("abc").insert_many([(U.pack(i), str(i) * 4) for i in range(101)])
        assert tx.get_bucket("abc").next_int() == 101
    assert reader.get_bucket("abc").len() == 11 and reader.get_bucket("abc").next_int() == 11
    with store.view() as tx:
        assert tx.get_bucket("abc").len() == 101
    with pytest.raises(ZeroDivisionError), store.update() as tx:
        tx.get_bucket("abc").put("x", "y")
        1 / 0
    with store.view() as tx:
        assert tx.get_bucket("abc").get("x") is None and tx.tx_id == 2
    reader.close()


def test_mixed_kinds_ranges_and_seek(store):
    with store.update() as tx:
        b = tx.create_bucket("abc")
        for i, k in enumerate("ace"):
            b.put(k, str(2 * i + 1))
        for k in "bdf":
            b.create_bucket(k)
        assert [n for n, _ in b.buckets()] == [b"b", b"d", b"f"]
        assert kv(b) == [(b"a", b"1"), (b"c", b"3"), (b"e", b"5")]
        keys = lambda df: b"".join(bytes(r.key) for r in df.collect())
        assert keys(b.range(Bound(b"aa"), Bound(b"e", False))) == b"bcd"
        assert keys(b.range(None, Bound(b"e"))) == b"abcde"
        assert keys(b.range(Bound(b"b", False))) == b"cdef"
        assert keys(b.seek("bb")) == b"bcdef" and keys(b.seek("0")) == b"abcdef" and keys(b.reverse()) == b"fedcba"
        with pytest.raises(E.IncompatibleValue):
            b.put("b", "x")
        with pytest.raises(E.IncompatibleValue):
            b.get_bucket("a")
        with pytest.raises(E.BucketExists):
            b.create_bucket("b")
        with pytest.raises(E.KeyValueMissing):
            b.delete("zz")
        d = b.get_bucket("d")
        b.delete_bucket("d")
        with pytest.raises(RuntimeError):
            d.put("x", "y")
        assert b.create_bucket("d").len() == 0 and b.next_int() == 7


def test_atomic_and_map_style(store):
    with store.update() as tx:
        b = tx.create_bucket("items")
        assert b.put_if_absent("key", "one").applied and not b.put_if_absent("key", "x").applied
        assert b.compare_exchange("key", "one", "two").current == b"two"
        assert b.compare_exchange("key", None, "x").observed == b"two"
        assert b.compare_exchange("new", None, "created").applied
        assert not b.delete_if_value("gone", "x").applied and b.delete_if_value("key", "two").applied
        m = tx.create_bucket("map")
        for k, v in (("a1", "1"), ("a2", "2"), ("b1", "3")):
            m.put(k, v)
        assert (m.len(), m.first().key, m.last().key) == (3, b"a1", b"b1")
        assert m.multi_get(["b1", "?", "a1", "b1"]) == [b"3", None, b"1", b"3"]
        assert m.delete_prefix("a") == 2
        m.put("c", "4")
        assert m.update_value("c", lambda v: b"5") == b"4" and m.get_kv("c").value == b"5"
        m.update_value("c", lambda v: None)
        assert not m.contains_key("c") and m.remove("c") is None
        assert m.remove_many(["b1", "b1", "zz"]) == 1 and m.is_empty()
    with store.view() as tx:
        assert kv(tx.get_bucket("items")) == [(b"new", b"created")]
        with pytest.raises(E.ReadOnlyTx):
            tx.get_or_create_bucket("items")


def test_deadlines(store):
    with store.update() as tx:
        s = tx.create_bucket("sessions")
        assert s.put_with_ttl("token", "alive", 1010).expires_at_millis == 1_010_000
        assert tx.get_bucket("sessions").next_int() == 3
        assert s.get_live("token", 1000).value == b"alive" and s.get_live("token", 1010.001) is None and s.get_live("token", 1010) is None
        s.put("token", "again")
        assert s.get_live("token", 1010.001) is None, "a raw put keeps the deadline"
        s.delete("token")
        s.put("token", "third")
        assert s.get_live("token", 2000) is None, "and so does a key that comes back"
        assert s.clear_ttl("token") and not s.clear_ttl("token") and s.get_live("token", 2000)
        r = tx.create_bucket("root")
        r.put_with_ttl("a-future", "x", 100)
        r.put_with_ttl("z-expired", "x", 10)
        r.create_bucket("nested").put_with_ttl("expired", "x", 10)
        assert tx.purge_expired(20, 1) == 1 and tx.get_bucket("root").len() == 1
        assert tx.purge_expired(20, 10) == 1 and tx.purge_expired(20, 10) == 0
        with pytest.raises(ValueError):
            r.put_with_ttl("x", "y", -1)


def _pair(spark, tmp_path):
    return Store(spark, str(tmp_path / "dst")), Store(spark, str(tmp_path / "src"))


def test_merge_overwrite(spark, tmp_path):
    dst, src = _pair(spark, tmp_path)
    with dst.update() as tx:
        a = tx.create_bucket("alpha")
        a.put("same", "1"), a.put("changed", "old"), a.put("node", "value"), a.put("only-dst", "x")
        a.create_bucket("leaf").put("gone", "x")
        a.create_bucket("common").put("keep", "x")
    with src.update() as tx:
        a = tx.create_bucket("alpha")
        a.put("same", "1"), a.put("changed", "new"), a.put("fresh", "1"), a.put("leaf", "now a value")
        a.create_bucket("node").put("inside", "1")
        a.create_bucket("common").put("added", "1")
        tx.create_bucket("beta").put("b", "1")
    with dst.update() as tx, src.view() as other:
        assert tx.merge_from(other) == MergeReport(5, 1, 1, 0, 2, 2, 2)
    with dst.view() as tx:
        a = tx.get_bucket("alpha")
        assert a.get_kv("leaf").value == b"now a value" and a.get_kv("changed").value == b"new" and a.get_kv("only-dst")
        assert [r.key.decode() for r in a.get_bucket("common").kv_pairs().collect()] == ["added", "keep"]
        assert a.get_bucket("node").get_kv("inside") and tx.get_bucket("beta").get_kv("b")
    dst.verify()


def test_merge_policies(spark, tmp_path):
    dst, src = _pair(spark, tmp_path)
    with dst.update() as tx:
        r = tx.create_bucket("root")
        r.put("b-conflict", "1"), r.put("node", "value"), r.create_bucket("leaf").put("k", "1")
        r.put_with_ttl("t", "1", 50)
    with src.update() as tx:
        r = tx.create_bucket("root")
        r.put("a-new", "1"), r.put("b-conflict", "2"), r.put("leaf", "value"), r.put("t", "1")
        r.create_bucket("node").create_bucket("deep").put("x", "1")
    with src.view() as other:
        with pytest.raises(E.MergeConflict) as e, dst.update() as tx:
            tx.merge_from(other, ConflictPolicy.ERROR)
        assert e.value.path == [b"root", b"b-conflict"]
        with dst.update() as tx:
            assert tx.merge_from(other, ConflictPolicy.KEEP_EXISTING) == MergeReport(1, 0, 0, 4, 0, 1, 0)
            r = tx.get_bucket("root")
            assert r.get_kv("b-conflict").value == b"1" and r.get_kv("node") and r.get_bucket("leaf").get_kv("k")
            assert r.get_live("t", 60) is None
        with dst.update() as tx:
            tx.merge_from(other)
            assert tx.get_bucket("root").get_live("t", 60), "a source without a deadline clears it"
    dst.verify()


def test_merge_takes_the_larger_counter(spark, tmp_path):
    dst, src = _pair(spark, tmp_path)
    with src.update() as tx:
        s = tx.create_bucket("source")
        for i in range(5):
            s.put(str(i), "x")
        s.delete("0"), s.delete("1")
    with dst.update() as tx, src.view() as other:
        tx.create_bucket("source")
        tx.merge_from(other)
        b = tx.get_bucket("source")
        assert (b.next_int(), b.len()) == (5, 3)


def test_scopes_locks_and_options(spark, store):
    assert store.write(lambda tx: tx.create_bucket("a").put("k", "v")) is None
    with pytest.raises(E.TransactionError) as e:
        store.read(lambda tx: tx.get_bucket("nope"))
    assert isinstance(e.value.storage, E.BucketMissing)
    with pytest.raises(E.TransactionError) as e:
        store.write(lambda tx: 1 // 0)
    assert isinstance(e.value.application, ZeroDivisionError)
    w = store.write_tx()
    assert store.try_write_tx() is None
    with pytest.raises(E.WriterTimeout):
        store.write_tx(0.05)
    w.rollback()
    ro = Store(spark, store.root, Options(read_only=True, verify_on_open=True))
    with pytest.raises(E.ReadOnlyStore):
        ro.write_tx()
    with pytest.raises(E.InvalidStore):
        Store(spark, store.root, Options(page_size=8192))
    for bad in ({"page_size": 512}, {"num_pages": 3}, {"max_file_bytes": 100}, {"growth_increment": 0}):
        with pytest.raises(ValueError):
            Options(**bad)
    small = Store(spark, store.root, Options(max_file_bytes=4096))
    with pytest.raises(E.CapacityExceeded), small.update() as tx:
        tx.get_bucket("a").insert_many([(str(i), "x" * 100) for i in range(500)])
    assert store.latest().tx_id == 1


def test_crash_points(spark, store):
    with store.update() as tx:
        tx.create_bucket("state").put("value", "old")
    for stage, after in (("after-entries-write", b"old"), ("before-manifest", b"old"), ("after-manifest", b"new")):
        def crash(at, stage=stage):
            if at == stage:
                raise KeyboardInterrupt

        other = Store(spark, store.root, hook=crash)
        tx = other.write_tx()
        tx.get_bucket("state").put("value", "new")
        with pytest.raises(KeyboardInterrupt):
            tx.commit()
        with Store(spark, store.root, Options(verify_on_open=True)).view() as tx:
            assert tx.get_bucket("state").get_kv("value").value == after


def test_many_commits_fold_and_vacuum(store):
    for i in range(11):
        with store.update() as tx:
            b = tx.get_or_create_bucket("b")
            b.put(f"k{i}", str(i))
            if i == 5:
                b.delete("k1")
    assert len(store.latest().segments) < 9
    with store.view() as tx:
        assert tx.get_bucket("b").len() == 10 and tx.get_bucket("b").next_int() == 11
    s = store.stats()
    assert s.current_tx_id == 11 and s.committed_transactions == 11 and s.pending_pages > 0
    assert store.vacuum() > 0 and store.stats().pending_pages == 0
    store.verify()


def test_corruption_is_found_and_salvaged(spark, store, tmp_path):
    with store.update() as tx:
        tx.create_bucket("records").insert_many([(U.pack(i), bytes([i]) * 80) for i in range(100)])
    with store.update() as tx:
        tx.create_bucket("later").put("k", "v")
    done = maintenance.salvage_to(store, str(tmp_path / "good"))
    assert (done.copied_buckets, done.copied_records, done.skipped_pages) == (2, 101, [])
    name = next(iter(store.latest().segments[1]["files"]))
    with open(f"{store.root}/{name}", "r+b") as f:
        f.seek(30)
        f.write(b"\xff\0\xff")
    assert [r.invariant for r in store.verify_report().collect()] == ["file_hash"]
    with pytest.raises(E.InvalidStore):
        store.verify()
    done = maintenance.salvage_to(store, str(tmp_path / "rest"))
    assert len(done.skipped_pages) == 1 and done.copied_records >= 100 - 100 * (len(store.latest().segments[1]["files"]) > 1)


def test_backup_compact_physical_stream(spark, store, tmp_path):
    with store.update() as tx:
        r = tx.create_bucket("root")
        r.put("keep", "value"), r.put("deleted", "x"), r.delete("deleted")
        r.create_bucket("nested").put("number", U.pack(42))
        r.get_bucket("nested").put_with_ttl("t", "x", 10)
    maintenance.backup_to(store, str(tmp_path / "b"))
    maintenance.compact_to(store, str(tmp_path / "c"), 8192)
    maintenance.physical_backup_to(store, str(tmp_path / "p"))
    out = io.BytesIO()
    maintenance.backup_writer(store, out)
    out.seek(0)
    tarfile.open(fileobj=out).extractall(tmp_path / "t", filter="data")
    for n in "bcpt":
        s = Store(spark, str(tmp_path / n), Options(verify_on_open=True))
        with s.view() as tx:
            r = tx.get_bucket("root")
            assert r.next_int() == 3 and r.get_bucket("nested").next_int() == 4 and r.get_bucket("nested").get_live("t", 20) is None
    assert FormatInfo.inspect(spark, str(tmp_path / "c")).page_size == 8192
    with pytest.raises(FileExistsError):
        maintenance.backup_to(store, str(tmp_path / "b"))
    with pytest.raises(ValueError):
        maintenance.backup_to(store, store.root)


def test_full_verification_refuses_a_broken_tree(spark, store):
    full = Store(spark, store.root, Options(verification=Verification.FULL))
    tx = full.write_tx()
    tx.set_entry("6e6f/", b"k", ("kv", b"v", None))
    with pytest.raises(E.InvalidStore):
        tx.commit()
    assert store.latest().tx_id == 0


def test_random_model(store):
    rnd, model = random.Random(0x1A5ACE), {}
    for _ in range(6):
        with store.update() as tx:
            b = tx.get_or_create_bucket("m")
            for _ in range(rnd.randint(5, 15)):
                k = f"{rnd.randrange(64):02d}".encode()
                if rnd.random() < 0.65:
                    v = str(rnd.random()).encode()
                    b.put(k, v)
                    model[k] = v
                else:
                    assert b.remove(k) == model.pop(k, None)
        with store.view() as tx:
            assert kv(tx.get_bucket("m")) == sorted(model.items())
    store.verify()


def test_command_line(store, tmp_path):
    with store.update() as tx:
        tx.create_bucket("b").put("k", "v")
    from nestwell.__main__ import main

    assert main(["--json", "verify", store.root]) == 0 and main(["--json", "stats", store.root]) == 0
    assert main(["--json", "compact", store.root, str(tmp_path / "c"), "2048"]) == 0
    assert main(["--json", "info", str(tmp_path / "none")]) == 1
    out = subprocess.run([sys.executable, "-m", "nestwell", "--json", "info", str(tmp_path / "none")], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parent.parent))
    assert out.returncode == 1 and json.loads(out.stderr)["ok"] is False
