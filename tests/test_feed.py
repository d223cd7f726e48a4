import pytest

from nestwell import errors as E
from nestwell.streaming.feed import WatchFilter, checkpoint_journal, consume_journal, enable_journal, journal_checkpoint, replay_journal, watch
from nestwell.tx import Change


def test_watch(store):
    every, some = watch(store, 8), watch(store, 8, WatchFilter().bucket_path("root").with_prefix("a").operations("put"))
    tiny = watch(store, 1)
    with store.update() as tx:
        r = tx.create_bucket("root")
        r.put("a", "1"), r.put("b", "2")
        r.create_bucket("nested")
    got = every.try_recv()
    assert [c.op for c in got.changes] == ["bucket_create", "put", "put", "bucket_create"] and got.changes[1] == Change((b"root",), b"a", "put")
    assert [c.key for c in some.recv().changes] == [b"a"]
    with pytest.raises(E.WatchEmpty):
        every.try_recv()
    with store.update() as tx:
        tx.get_bucket("root").delete("b")
    assert tiny.recv().changes and pytest.raises(E.WatchOverflow, tiny.recv)
    with pytest.raises(E.WatchEmpty):
        some.try_recv()
    every.try_recv(), every.close()
    with pytest.raises(E.WatchDisconnected):
        every.recv()


def test_change_sets_are_bounded(store):
    w = watch(store, 1)
    with store.update() as tx:
        tx.create_bucket("b").insert_many([(f"{i:05d}", "x") for i in range(4200)])
    got = w.recv()
    assert len(got.changes) == 4096 and got.truncated
    assert got.changes[1].key == b"00000"


def test_journal(store):
    assert replay_journal(store, 0, 10).transactions == ()
    with pytest.raises(E.BucketMissing):
        checkpoint_journal(store, "indexer", 1)
    enable_journal(store)
    with store.update() as tx:
        u = tx.create_bucket("users")
        u.put("a", "1"), u.put("b", "2")
    with store.update() as tx:
        tx.get_bucket("users").delete("a")
    r = replay_journal(store, 1, 10)
    assert [len(t.changes) for t in r.transactions] == [3, 1] and r.gap is None and (r.oldest, r.newest) == (1, 3)
    r = replay_journal(store, 1, 10, WatchFilter().operations("delete"))
    assert [(t.tx_id, len(t.changes)) for t in r.transactions] == [(2, 0), (3, 1)]
    checkpoint_journal(store, "indexer", 3)
    assert journal_checkpoint(store, "indexer") == 3 and journal_checkpoint(store, "other") is None
    with pytest.raises(E.InvalidStore):
        enable_journal(store, 0)
    enable_journal(store, 2)
    r = replay_journal(store, 1, 10)
    assert (r.oldest, r.newest, r.gap.oldest) == (4, 5, 4) and [len(t.changes) for t in r.transactions] == [0, 0]


def test_stream_delivers_once(spark, store):
    enable_journal(store)
    seen = []

    def handle(rows, batch):
        seen.extend((r.tx_id, bytes(r.key)) for r in rows.orderBy("tx_id", "seq").collect())

    for k in "ab":
        with store.update() as tx:
            tx.get_or_create_bucket("b").put(k, "1")
        consume_journal(spark, store.root, "c", handle, WatchFilter().operations("put"))
    assert seen == [(2, b"a"), (3, b"b")]


def test_windowed_counts_is_a_stream_and_a_batch(spark):
    from nestwell.streaming.feed import windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", "put"), ("2024-01-01 00:50:00", "put"), ("2024-01-01 01:10:00", "delete")], "ts string, op string").selectExpr("cast(ts as timestamp) as ts", "op")
    assert sorted((r.op, r["count"]) for r in windowed_counts(rows, "ts").collect()) == [("delete", 1), ("put", 2)]
