import os
import random

import pytest

from nestwell import errors as E
from nestwell.collection import BulkLoad, CollectionDef, OpenPolicy, TypedBucket
from nestwell.functions.codecs import I64Value, MessagePack, StringPair, U64, Utf8
from nestwell.operators.ordered import Bound

USERS = CollectionDef("users", U64(), Utf8(), schema_id="example.users")
COUNTERS = CollectionDef("counters", U64(), U64())
AUDIT = CollectionDef("audit", U64(), Utf8()).nested("tenant", "application")


def pairs(df):
    return [(int(r.key), r.value if isinstance(r.value, str) else int(r.value)) for r in df.collect()]


def test_users(store):
    with store.update() as tx:
        u = tx.collection_mut(USERS)
        assert u.insert(1, "Ada") is None and u.insert_many([(2, "Grace"), (3, "Linus")]) == 2
        assert u.insert(2, "Hopper") == "Grace"
        assert u.multi_get([3, 9, 1]) == ["Linus", None, "Ada"]
    with store.view() as tx:
        u = tx.collection(USERS)
        assert pairs(u.iter()) == [(1, "Ada"), (2, "Hopper"), (3, "Linus")] and pairs(u.iter_rev())[0] == (3, "Linus")
        page = u.page_after(None, 2)
        assert [k for k, _ in page.items] == [1, 2]
        rest = u.page_after(page.next, 2)
        assert [k for k, _ in rest.items] == [3] and rest.next is None and u.page_after(None, 0).items == []
        assert pairs(u.range_rev(1, 3)) == [(2, "Hopper"), (1, "Ada")] and pairs(u.range(2, 9)) == [(2, "Hopper"), (3, "Linus")]
        assert pairs(u.range_bounds(Bound(1, False), Bound(3))) == [(2, "Hopper"), (3, "Linus")]
        assert pairs(u.seek(2)) == [(2, "Hopper"), (3, "Linus")] and pairs(u.prefix(b"\0" * 7 + b"\3")) == [(3, "Linus")]
        assert (u.first(), u.last(), u.len()) == ((1, "Ada"), (3, "Linus"), 3)
        assert [r.value for r in u.values().collect()] == ["Ada", "Hopper", "Linus"]
        with pytest.raises(E.SchemaMismatch):
            tx.collection(CollectionDef("users", U64(), Utf8(), schema_id="other"))
        with pytest.raises(E.BucketMissing):
            tx.collection(COUNTERS)
        with pytest.raises(E.InvalidDefinition):
            tx.collection(CollectionDef("", U64(), Utf8()))


def test_pages_are_those_of_page_after(store, spark):
    with store.update() as tx:
        u = tx.collection_mut(USERS)
        u.insert_many([(k * k, f"v{k}") for k in range(1, 61)])
        u.insert(7, "expired", expires_at=10)
        tx.collection_mut(COUNTERS)
    with store.view() as tx:
        u, token, want, tokens = tx.collection(USERS), None, [], []
        while not want or token is not None:
            page = u.page_after(token, 7)
            want += [(len(tokens), k, v) for k, v in page.items]
            tokens.append(token := page.next)
        jobs = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
        got = sorted((r.page, int(r.key), r.value) for r in u.pages(7).collect())
        assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs) < len(tokens)
        assert got == want and len(got) == 60 and got[-1][0] == 8
        assert sorted(r.value for r in u.pages(7, tokens[0]).where("page = 0").collect()) == sorted(v for p, _, v in want if p == 1)
        assert tx.collection(COUNTERS).pages(7).collect() == [] and u.pages(1000).agg({"page": "max"}).first()[0] == 0
        with pytest.raises(ValueError):
            u.pages(0)
        aside = list(tx._aside)
    assert aside and not any(os.path.exists(p) for p in aside)


def test_writes(store):
    with store.update() as tx:
        tx.create_bucket("raw")
        with pytest.raises(E.SchemaMissing):
            tx.collection_mut(CollectionDef("raw", U64(), Utf8()))
        c = tx.collection_mut(COUNTERS)
        assert (c.fetch_add(1, 5), c.fetch_add(1, 2), c.get(1)) == (0, 5, 7)
        with pytest.raises(OverflowError):
            c.fetch_add(1, 2**64)
        with pytest.raises(E.BucketExists):
            tx.collection_mut(CollectionDef("counters", U64(), U64(), policy=OpenPolicy.CREATE))
        assert c.insert_ordered([(2, 1), (3, 1)]) == BulkLoad(2, True) and c.insert_ordered([(5, 1), (4, 1)]) == BulkLoad(2, False)
        e = c.entry(9)
        assert e.is_vacant() and e.or_insert(4) == 4 and c.entry(9).and_modify(lambda v: v + 1).get() == 5
        assert c.compare_exchange(9, 5, 6).applied and not c.compare_exchange(9, 5, 7).applied
        assert c.pop_first() == (1, 7) and c.pop_last() == (9, 6)
        assert c.remove_many([2, 2, 77]) == [1, None, None] and c.delete_range(3, 5) == 2
        assert pairs(c.iter()) == [(5, 1)] and c.delete_prefix(b"\0") == 1 and c.clear() == 0
        a = tx.collection_mut(AUDIT)
        a.insert(1, "x")
        assert tx.get_bucket("tenant").get_bucket("application").get_bucket("audit").len() == 1
        with pytest.raises(E.CodecError):
            a.fetch_add(1, 1)


def test_deadlines_hide_records(store):
    with store.update() as tx:
        u = tx.collection_mut(CollectionDef("items", U64(), Utf8()))
        u.insert(1, "keep"), u.insert(2, "first", expires_at=10), u.insert(3, "second", expires_at=10)
        assert pairs(u.iter()) == [(1, "keep")] and (u.len(), u.live_count()) == (3, 1) and not u.contains_key(2)
        assert u.delete_range(0, 9) == 1 and u.len() == 2
        assert u.insert(2, "back") == "first" and u.get(2) == "back"
        assert u.remove(3) == "second" and u.remove(3) is None
        t = TypedBucket(u.bucket, U64())
        u.insert(4, "gone", expires_at=10)
        assert t.get(4) == "gone" and t.put(4, "still") == "gone" and not u.contains_key(4) and t.delete(2) == "back"
        assert pairs(t.entries()) == [(4, "still")] and pairs(t.range_inclusive(4, 4)) == [(4, "still")]


def test_batch_and_codecs(store):
    docs = CollectionDef("docs", StringPair(), MessagePack())
    with store.update() as tx:
        b = tx.batch().insert(USERS, 1, "Ada").insert(COUNTERS, 7, 7).remove(USERS, 1)
        assert (b.len(), b.apply(), b.is_empty()) == (3, 3, True)
        d = tx.collection_mut(docs)
        d.insert(("a", "\0"), {"n": [1, None]})
        assert d.get(("a", "\0")) == {"n": [1, None]}
        n = tx.collection_mut(CollectionDef("unordered", I64Value(), Utf8()))
        with pytest.raises(E.OrderingRequired):
            n.range(1, 2)
    with store.view() as tx:
        assert tx.collection(COUNTERS).get(7) == 7 and tx.collection(USERS).is_empty()


def test_bulk_from_a_dataframe(spark, store):
    with store.update() as tx:
        c = tx.collection_mut(COUNTERS)
        rows = spark.range(1000).selectExpr("id % 100 as key", "id as value", "id as seq")
        assert c.insert_many(rows) == 1000 and c.len() == 100 and c.bucket.next_int() == 100
        assert c.get(5) == 905


def test_random_model(store):
    rnd, model = random.Random(7), {}
    with store.update() as tx:
        u = tx.collection_mut(USERS)
        for _ in range(60):
            k = rnd.randrange(64)
            if rnd.random() < 0.65:
                v = str(rnd.random())
                assert u.insert(k, v) == model.get(k)
                model[k] = v
            else:
                assert u.remove(k) == model.pop(k, None)
        assert pairs(u.iter()) == sorted(model.items())
