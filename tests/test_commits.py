"""The commit point, what it leaves behind, and batches of conditional writes."""

import pytest

from nestwell import errors as E
from nestwell.collection import CollectionDef
from nestwell.functions.codecs import I64Value, U64, Utf8
from nestwell.sources import store as S
from nestwell.sources.store import Options, Store
from nestwell.streaming.feed import consume_journal, enable_journal, replay_journal

NAMES, COUNTS = CollectionDef("names", U64(), Utf8()), CollectionDef("counts", U64(), I64Value())


def test_only_published_changes_reach_consumers(spark, store):
    seen = []
    take = lambda: consume_journal(spark, store.root, "c", lambda rows, batch: seen.extend((r.tx_id, bytes(r.key)) for r in rows.orderBy("tx_id", "seq").collect()))
    enable_journal(store)
    with store.update() as tx:
        tx.create_bucket("b").put("a", "1")
    small = Store(spark, store.root, Options(max_file_bytes=4096))
    with pytest.raises(E.CapacityExceeded), small.update() as tx:
        tx.get_bucket("b").insert_many([(f"ghost{i}", "x" * 200) for i in range(300)])

    def crash(stage):
        if stage == "after-journal-write":
            raise KeyboardInterrupt

    tx = Store(spark, store.root, hook=crash).write_tx()
    tx.get_bucket("b").put("lost", "1")
    with pytest.raises(KeyboardInterrupt):
        tx.commit()
    take()
    assert seen == [(2, b"b"), (2, b"a")]
    with store.update() as tx:
        assert tx.tx_id == 3
        tx.get_bucket("b").put("real", "1")
    take()
    take()
    assert seen[2:] == [(3, b"real")]
    assert [[c.key for c in t.changes] for t in replay_journal(store, 2, 9).transactions] == [[b"real"]]
    enable_journal(store, 1)
    store.vacuum()
    listed = {S.rows_of(h) for h in store.latest().journal["headers"] if h["n"]}
    assert {f"journal/{n}" for n, _ in store.files.list("journal")} == listed


def test_folding_leaves_large_segments_alone():
    assert S.fold_start([]) == 0 and S.fold_start([5] * 7) == 7 and S.fold_start([5] * 8) == 0
    assert S.fold_start([10**9] + [3] * 7) == 8 and S.fold_start([10**9] + [3] * 8) == 1
    assert S.fold_start([10**9, 200, 100, 100, 100, 3, 3, 3, 3]) == 1, "eight of the next class"


def test_a_file_that_is_too_large_is_a_typed_error(spark, store, monkeypatch):
    monkeypatch.setattr(S, "MAX_FILE_BYTES", 100)
    with pytest.raises(E.CapacityExceeded), store.update() as tx:
        tx.create_bucket("b").put("k", "v" * 500)
    assert store.files.list("data") == [] and store.latest().tx_id == 0


def test_missing_files_are_typed_errors(store):
    with store.update() as tx:
        tx.create_bucket("b").put("k", "v")
    store.files.delete(store.latest().segments[0]["entries"])
    with pytest.raises(E.InvalidStore), store.view() as tx:
        tx.get_bucket("b")


def test_batches(spark, store):
    rows = lambda *r: spark.createDataFrame(list(r), "key bigint, amount bigint, seq bigint")
    with store.update() as tx:
        c = tx.collection_mut(NAMES)
        pairs = spark.createDataFrame([(1, "a"), (2, "b")], "key bigint, value string")
        assert sorted((int(r.key), r.applied) for r in c.put_if_absent_many(pairs).collect()) == [(1, True), (2, True)]
        assert sorted((int(r.key), r.applied, r.current) for r in c.compare_exchange_many(spark.createDataFrame([(1, "a", "x"), (2, "no", "x"), (3, None, "new")], "key bigint, expected string, value string")).collect()) == [(1, True, "x"), (2, False, "b"), (3, True, "new")]
        assert sorted((int(r.key), r.applied) for r in c.delete_if_value_many(spark.createDataFrame([(1, "x"), (2, "x"), (9, "x")], "key bigint, expected string")).collect()) == [(1, True), (2, False), (9, False)]
        assert c.bucket.next_int() == 3
        with pytest.raises(ValueError):
            c.put_if_absent_many(pairs.union(pairs))
        n = tx.collection_mut(COUNTS)
        steps = n.fetch_add_many(rows((1, 5, 0), (1, -2, 1), (2, 7, 2)))
        assert sorted((int(r.key), int(r.seq), int(r.previous)) for r in steps.collect()) == [(1, 0, 0), (1, 1, 5), (2, 2, 0)] and n.get(1) == 3
        with pytest.raises(OverflowError):
            n.fetch_add_many(rows((1, 2**63 - 1, 0)))
    with store.view() as tx:
        assert [(int(r.key), r.value) for r in tx.collection(NAMES).iter().collect()] == [(2, "b"), (3, "new")] and tx.collection(COUNTS).get(2) == 7
