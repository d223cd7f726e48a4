"""Transactions and buckets: snapshots to read, and layers of changes over them to write."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwell import errors as E
from nestwell.functions.codecs import to_bytes
from nestwell.operators import expiry, merge, ordered, tree, writes
from nestwell.session import scratch_root
from nestwell.sources.store import CHANGES, DELTA, FILE_BYTES, MAX_FILE_ROWS, TTL_DELTA, Files, Manifest, Snapshot, by_rows, fold_start, lay_over, lay_ttl_over, newest_first, ttl_rows

#: A change set lists this many changes, of so many bytes of path and key, and is marked truncated beyond.
MAX_CHANGES, MAX_CHANGE_BYTES = 4_096, 4 << 20
#: The deadline of a mark, at path + "#", that a bucket has had deadlines; no clock reaches it.
FOREVER = (1 << 63) - 1
_ROW = T.StructType([*tree.ENTRIES.fields, T.StructField("deleted", T.BooleanType(), False)])
_DEADLINE = T.StructType([*tree.TTL.fields[:2], T.StructField("expires_at_ms", T.LongType())])


@dataclass(frozen=True)
class Change:
    bucket_path: tuple[bytes, ...]
    key: bytes
    op: str


@dataclass(frozen=True)
class ChangeSet:
    tx_id: int
    changes: tuple[Change, ...]
    truncated: bool = False


@dataclass(frozen=True)
class KV:
    key: bytes
    value: bytes


@dataclass(frozen=True)
class Atomic:
    applied: bool
    observed: bytes | None
    current: bytes | None


@dataclass(frozen=True)
class TtlWrite:
    previous: KV | None
    expires_at_millis: int


@dataclass(frozen=True)
class JournalGap:
    requested: int
    oldest: int


@dataclass(frozen=True)
class JournalReplay:
    transactions: tuple[ChangeSet, ...] = ()
    oldest: int | None = None
    newest: int | None = None
    gap: JournalGap | None = None


def now_ms() -> int:
    return int(time.time() * 1000)


def millis(at: float | int) -> int:
    """Seconds since 1970 as whole milliseconds; times before it are refused."""
    if at < 0:
        raise ValueError("a time before 1970")
    return int(at * 1000)


class _Layer:
    """Point writes that lie over a DataFrame, by (path, key); None marks what is gone."""

    def __init__(self) -> None:
        self.entries: dict[tuple[str, bytes], tuple | None] = {}
        self.ttl: dict[tuple[str, bytes], int | None] = {}

    def __bool__(self) -> bool:
        return bool(self.entries or self.ttl)


class Tx:
    """A snapshot, with a writer's changes over it until ``commit``.

    Point writes gather in a layer in memory and bulk writes are DataFrames; reads of rows lay them over
    the snapshot.  Nothing of it is visible to others before ``commit`` and nothing remains after ``rollback``.
    """

    def __init__(self, store, manifest: Manifest, token: str | None):
        self.store, self.manifest, self.writable, self.open = store, manifest, token is not None, True
        self._snapshot = Snapshot(store, manifest)
        self._base, self._base_ttl = self._snapshot.entries, self._snapshot.ttl
        self._layer, self._layers = _Layer(), []
        self._dropped: set[str] = set()
        self.root_next_int = manifest.root_next_int
        self.tx_id = manifest.tx_id + self.writable
        self.schemas, self.journal, self.checkpoints = dict(manifest.schemas), manifest.journal, dict(manifest.checkpoints)
        self.changes: list[Change] = []
        self._bytes, self.truncated = 0, False
        self._id, self._token = uuid.uuid4().hex, token
        self._heap = [0, 0]
        self._aside: list[str] = []
        #: No bucket has more rows.
        self.most_rows = sum(s["rows"] for s in manifest.segments)
        if not self.writable:
            store.readers[self._id] = manifest.tx_id

    def __enter__(self) -> Tx:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    # rows

    @property
    def spark(self):
        return self.store.spark

    def _flush(self) -> None:
        """Turns the point writes so far into a DataFrame layer."""
        if not self._layer:
            return
        rows = [(p, k, *(v or ("kv", None, None)), v is None) for (p, k), v in self._layer.entries.items()]
        ttl = [(p, k, v) for (p, k), v in self._layer.ttl.items()]
        self._push((self.spark.createDataFrame(rows, _ROW), len(rows)) if rows else (None, 0), (self.spark.createDataFrame(ttl, _DEADLINE), len(ttl)) if ttl else (None, 0), [])
        self._layer = _Layer()

    def _push(self, delta: tuple[DataFrame | None, int], ttl: tuple[DataFrame | None, int], drops: list[str]) -> None:
        """Lays rows and deadlines, each with their number, over what there is."""
        self._layers.append((delta, ttl, drops))
        self._base, self._base_ttl = lay_over(self._base, delta[0], drops, delta[1]), lay_ttl_over(self._base_ttl, ttl[0], drops, ttl[1])
        self.most_rows += delta[1]

    def bulk(self, delta: DataFrame | None = None, ttl: DataFrame | None = None, drops: list[str] | None = None) -> None:
        """A layer of many rows: path, key, kind, value, next_int, deleted, one per key.

        The rows are staged at once: they often come from this transaction's own view, and a view over its
        own past would double its plan with every layer.
        """
        self.need_write()
        self._flush()
        delta, ttl = self._staged(delta), self._staged(ttl)
        if delta[1] or ttl[1] or drops:
            self._push(delta, ttl, drops or [])

    def keep(self, df: DataFrame, count: bool = True) -> DataFrame:
        """``df`` staged below the store until this transaction ends; with ``count`` it belongs to what a commit writes."""
        path = f"staging/{self._id}/{uuid.uuid4().hex}"
        with E.typed_reads():
            df.write.parquet(f"{self.store.root}/{path}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.store.root}/{path}")
        if count:
            self._heap = [self._heap[0] + out.count(), self._heap[1] + sum(n for _, n in self.store.files.list(path))]
        return out

    def aside(self, df: DataFrame) -> DataFrame:
        """``df`` staged outside the store until this transaction ends: readers write nothing below it, and ``vacuum`` takes nothing away."""
        at = scratch_root(self.spark, "aside")
        self._aside.append(at)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _staged(self, df: DataFrame | None) -> tuple[DataFrame | None, int]:
        if df is None:
            return None, 0
        before = self._heap[0]
        out = self.keep(df)
        rows = self._heap[0] - before
        return out if rows else None, rows

    @property
    def entries(self) -> DataFrame:
        self._flush()
        return self._base

    @property
    def ttl(self) -> DataFrame:
        self._flush()
        return self._base_ttl

    @E.typed_reads()
    def find(self, path: str, key: bytes) -> tuple | None:
        """(kind, value, next_int) of an entry, or None."""
        if (path, key) in self._layer.entries:
            return self._layer.entries[path, key]
        r = self._base.where((F.col("path") == path) & (F.col("key") == F.lit(key))).select("kind", "value", "next_int").first()
        return None if r is None else (r.kind, None if r.value is None else bytes(r.value), r.next_int)

    @E.typed_reads()
    def deadline(self, path: str, key: bytes) -> int | None:
        if (path, key) in self._layer.ttl:
            return self._layer.ttl[path, key]
        r = self._base_ttl.where((F.col("path") == path) & (F.col("key") == F.lit(key))).first()
        return None if r is None else r.expires_at_ms

    def set_entry(self, path: str, key: bytes, entry: tuple | None) -> None:
        self._layer.entries[path, key] = entry

    def set_deadline(self, path: str, key: bytes, at: int | None) -> None:
        self._layer.ttl[path, key] = at

    def count_insert(self, path: str, n: int = 1) -> None:
        """A bucket's counter of insertions; the root's stands in the manifest."""
        if not n:
            return
        if not path:
            self.root_next_int += n
            return
        *above, name = tree.names_of(path)
        up = tree.path_of(above)
        kind, value, count = self.find(up, name)
        self.set_entry(up, name, (kind, value, count + n))

    def record(self, path: str, key: bytes, op: str) -> None:
        size = len(path) // 2 + len(key)
        if len(self.changes) >= MAX_CHANGES or self._bytes + size > MAX_CHANGE_BYTES:
            self.truncated = True
            return
        self._bytes += size
        self.changes.append(Change(tuple(tree.names_of(path)), key, op))

    def record_many(self, path: str, keys: DataFrame, op: str, order: str = "key") -> None:
        """The first changes of many, as far as the change set has room: a bounded top-k."""
        room = MAX_CHANGES - len(self.changes)
        rows = keys.select("key", order).orderBy(order).limit(room + 1).collect() if room >= 0 else []
        for r in rows:
            self.record(path, bytes(r.key), op)

    def need_write(self) -> None:
        if not self.writable:
            raise E.ReadOnlyTx("a read transaction")

    # buckets of the root

    @property
    def root(self) -> Bucket:
        return Bucket(self, "")

    def get_bucket(self, name) -> Bucket:
        return self.root.get_bucket(name)

    def create_bucket(self, name) -> Bucket:
        return self.root.create_bucket(name)

    def get_or_create_bucket(self, name) -> Bucket:
        return self.root.get_or_create_bucket(name)

    def delete_bucket(self, name) -> None:
        self.root.delete_bucket(name)

    def buckets(self) -> Iterator[tuple[bytes, Bucket]]:
        return self.root.buckets()

    # typed collections

    def collection(self, definition):
        from nestwell.collection import open_read

        return open_read(self, definition)

    def collection_mut(self, definition):
        from nestwell.collection import open_write

        return open_write(self, definition)

    def batch(self):
        from nestwell.collection import Batch

        return Batch(self)

    # whole-tree operations

    def purge_expired(self, now: float, limit: int) -> int:
        """Expired rows of the whole tree, buckets before what they hold, up to the limit; how many went."""
        return self.root._purge(millis(now), limit, whole=True)

    def merge_from(self, source: Tx, policy: merge.ConflictPolicy = merge.ConflictPolicy.OVERWRITE) -> merge.MergeReport:
        return self.root.merge_from(source.root, policy)

    def set_journal(self, max_transactions: int = 10_000) -> None:
        self.need_write()
        if max_transactions < 1:
            raise E.InvalidStore("a journal keeps one transaction at least")
        self.journal = {"keep": max_transactions, "headers": (self.journal or {"headers": []})["headers"]}

    def set_checkpoint(self, consumer: bytes | str, tx_id: int) -> None:
        self.need_write()
        name = to_bytes(consumer)
        if not 1 <= len(name) <= 255:
            raise E.InvalidStore("a consumer's name has 1 to 255 bytes")
        if self.journal is None:
            raise E.BucketMissing("there is no journal")
        self.checkpoints[name.hex()] = tx_id

    # end

    @E.typed_reads()
    def commit(self) -> ChangeSet:
        """Writes the segment and the journal's rows under names of their own; the manifest that lists both is the commit point.

        Rows that no manifest lists reach no consumer: a refused commit takes its own away, what a crash
        leaves goes with ``vacuum``, and a number that is used again has other names.
        """
        self.need_write()
        if not self.open:
            raise E.StoreError("this transaction has ended")
        try:
            self._flush()
            m = Manifest(self.tx_id, list(self.manifest.segments), self.root_next_int, self.manifest.page_size, self.schemas, self.journal, self.checkpoints)
            rows = None
            if self.journal is not None:
                rows = f"journal/{self.tx_id:020d}-{self._id}" if self.changes else None
                headers = [*self.journal["headers"], {"tx_id": self.tx_id, "truncated": self.truncated, "n": len(self.changes), "name": rows}]
                m.journal = {"keep": self.journal["keep"], "headers": headers[-self.journal["keep"] :]}
            try:
                if rows:
                    listed = [(self.tx_id, i, tree.path_of(c.bucket_path), c.key, c.op) for i, c in enumerate(self.changes)]
                    self.spark.createDataFrame(listed, CHANGES).coalesce(1).write.parquet(f"{self.store.root}/{rows}")
                    self.store.hook("after-journal-write")
                self.store.publish(m, self._segment(m) if self._layers else None)
            except Exception:
                if rows:
                    self.store.files.delete(rows)
                raise
            self.store.hook("after-manifest")
        finally:
            self._release()
        done = ChangeSet(self.tx_id, tuple(self.changes), self.truncated)
        self.store.watches.publish(done)
        return done

    def _segment(self, m: Manifest):
        """All layers as one staged segment, together with the newest segments of like size if they have become many."""
        start = fold_start([s["rows"] for s in m.segments])
        folded, m.segments = m.segments[start:], m.segments[:start]
        read = self._snapshot._read
        layers = [((s["entries"] and read(s["entries"], DELTA), s["rows"]), (s["ttl"] and read(s["ttl"], TTL_DELTA), ttl_rows(s)), s["drops"]) for s in folded] + self._layers
        entries, ttl = newest_first([(e, d, n) for (e, n), _, d in layers]), newest_first([(t, d, n) for _, (t, n), d in layers])
        drops = [p for _, _, dropped in layers for p in dropped]
        if not start:  # nothing lies below: what was taken out need not be told
            entries, ttl, drops = entries and entries.where("not deleted"), ttl and ttl.where("expires_at_ms is not null"), []
        n = self._heap[0] + sum(s["rows"] for s in folded)
        size = self._heap[1] + sum(f["bytes"] for s in folded for f in s["files"].values())
        return self.store.stage(self.tx_id, entries, ttl, drops, MAX_FILE_ROWS if size < FILE_BYTES else max(1, FILE_BYTES * n // size))

    def rollback(self) -> None:
        self._release()

    close = rollback

    def _release(self) -> None:
        if self.open:
            self.open = False
            for at in self._aside:
                Files(self.spark, at).delete("")
            if self.writable:
                self.store.files.delete(f"staging/{self._id}")
                self.store.unlock(self._token)
            else:
                self.store.readers.pop(self._id, None)


class Bucket:
    """A namespace of a transaction: ordered keys with values or further buckets."""

    def __init__(self, tx: Tx, path: str):
        self.tx, self.path = tx, path

    def _alive(self) -> None:
        if any(self.path.startswith(p) for p in self.tx._dropped):
            raise RuntimeError("this bucket was deleted in this transaction")

    @property
    def names(self) -> list[bytes]:
        return tree.names_of(self.path)

    @property
    def rows(self) -> DataFrame:
        """Everything in this bucket: key, kind, value, next_int."""
        self._alive()
        return self.tx.entries.where(F.col("path") == self.path)

    @property
    def values(self) -> DataFrame:
        return self.rows.where("kind = 'kv'")

    @property
    def deadlines(self) -> DataFrame:
        return self.tx.ttl.where(F.col("path") == self.path)

    def _find(self, key) -> tuple | None:
        self._alive()
        return self.tx.find(self.path, to_bytes(key))

    # nested buckets

    def get_bucket(self, name) -> Bucket:
        e = self._find(name)
        if e is None:
            raise E.BucketMissing(f"no bucket {name!r}")
        if e[0] != "bucket":
            raise E.IncompatibleValue(f"{name!r} is a value")
        return Bucket(self.tx, self.path + to_bytes(name).hex() + "/")

    def create_bucket(self, name) -> Bucket:
        self.tx.need_write()
        e, key = self._find(name), to_bytes(name)
        if e is not None:
            raise E.BucketExists(f"{name!r} exists") if e[0] == "bucket" else E.IncompatibleValue(f"{name!r} is a value")
        self.tx.set_entry(self.path, key, ("bucket", None, 0))
        self.tx.count_insert(self.path)
        self.tx.record(self.path, key, "bucket_create")
        made = self.path + key.hex() + "/"
        self.tx._dropped.discard(made)
        return Bucket(self.tx, made)

    def get_or_create_bucket(self, name) -> Bucket:
        self.tx.need_write()
        try:
            return self.get_bucket(name)
        except E.BucketMissing:
            return self.create_bucket(name)

    def delete_bucket(self, name) -> None:
        self.tx.need_write()
        gone, key = self.get_bucket(name), to_bytes(name)
        self.tx.set_entry(self.path, key, None)
        self.tx.bulk(drops=[gone.path])
        self.tx._dropped.add(gone.path)
        self.tx.record(self.path, key, "bucket_delete")

    def buckets(self) -> Iterator[tuple[bytes, Bucket]]:
        """Names and buckets in order, read as they are needed."""
        for r in self.rows.where("kind = 'bucket'").orderBy("key").select("key").toLocalIterator():
            yield bytes(r.key), Bucket(self.tx, self.path + bytes(r.key).hex() + "/")

    def next_int(self) -> int:
        self._alive()
        if not self.path:
            return self.tx.root_next_int
        *above, name = self.names
        return self.tx.find(tree.path_of(above), name)[2]

    # reads

    def get(self, key) -> KV | Bucket | None:
        e = self._find(key)
        return None if e is None else KV(to_bytes(key), e[1]) if e[0] == "kv" else Bucket(self.tx, self.path + to_bytes(key).hex() + "/")

    def get_kv(self, key) -> KV | None:
        e = self._find(key)
        return KV(to_bytes(key), e[1]) if e and e[0] == "kv" else None

    def contains_key(self, key) -> bool:
        return self.get_kv(key) is not None

    def multi_get(self, keys: Iterable) -> list[bytes | None]:
        wanted = [(i, bytearray(to_bytes(k))) for i, k in enumerate(keys)]
        if not wanted:
            return []
        want = self.tx.spark.createDataFrame(wanted, "pos int, key binary")
        rows = ordered.only_keys(self.values.select("key", "value"), "key", [k for _, k in wanted])
        with E.typed_reads():
            return [None if r.value is None else bytes(r.value) for r in ordered.multi_get(rows, "key", want).collect()]

    def cursor(self) -> DataFrame:
        return self.rows.orderBy("key")

    def kv_pairs(self) -> DataFrame:
        return self.values.select("key", "value").orderBy("key")

    def seek(self, key) -> DataFrame:
        """From ``key``, or when it is missing from the entry before it."""
        return ordered.seek_parked(self.rows, "key", to_bytes(key))

    def reverse(self) -> DataFrame:
        return self.rows.orderBy(F.col("key").desc())

    def range(self, low: ordered.Bound | None = None, high: ordered.Bound | None = None) -> DataFrame:
        return ordered.key_range(self.rows, "key", low, high)

    @E.typed_reads()
    def _end(self, order: Column) -> KV | None:
        r = self.values.orderBy(order).select("key", "value").first()
        return None if r is None else KV(bytes(r.key), bytes(r.value))

    def first(self) -> KV | None:
        return self._end(F.col("key").asc())

    def last(self) -> KV | None:
        return self._end(F.col("key").desc())

    @E.typed_reads()
    def len(self) -> int:
        return self.values.count()

    @E.typed_reads()
    def is_empty(self) -> bool:
        return self.values.isEmpty()

    # writes of one key

    def _writable_kv(self, key) -> tuple[bytes, tuple | None]:
        self.tx.need_write()
        e = self._find(key)
        if e is not None and e[0] != "kv":
            raise E.IncompatibleValue(f"{key!r} is a bucket")
        return to_bytes(key), e

    def put(self, key, value) -> KV | None:
        """Keeps the key's deadline, if it has one."""
        k, e = self._writable_kv(key)
        self.tx.set_entry(self.path, k, ("kv", to_bytes(value), None))
        if e is None:
            self.tx.count_insert(self.path)
        self.tx.record(self.path, k, "put")
        return None if e is None else KV(k, e[1])

    insert = put

    def delete(self, key) -> KV:
        """The deadline stays behind: a later ``put`` of the key inherits it."""
        k, e = self._writable_kv(key)
        if e is None:
            raise E.KeyValueMissing(f"no value {key!r}")
        self.tx.set_entry(self.path, k, None)
        self.tx.record(self.path, k, "delete")
        return KV(k, e[1])

    def remove(self, key) -> bytes | None:
        self.tx.need_write()
        kv = self.get_kv(key)
        return None if kv is None else self.delete(key).value

    def update_value(self, key, change: Callable[[bytes | None], bytes | None]) -> bytes | None:
        """``change(old)`` gives the new value or None to delete; either clears the deadline."""
        k, e = self._writable_kv(key)
        old = e[1] if e else None
        new = change(old)
        if new is not None:
            self.put(k, new)
            self.clear_ttl(k)
        elif e is not None:
            self.delete(k)
            self.clear_ttl(k)
        return old

    def put_if_absent(self, key, value) -> Atomic:
        _, e = self._writable_kv(key)
        if e is not None:
            return Atomic(False, e[1], e[1])
        self.put(key, value)
        return Atomic(True, None, to_bytes(value))

    def compare_exchange(self, key, expected, value) -> Atomic:
        _, e = self._writable_kv(key)
        old = e[1] if e else None
        if old != (None if expected is None else to_bytes(expected)):
            return Atomic(False, old, old)
        self.put(key, value)
        return Atomic(True, old, to_bytes(value))

    def delete_if_value(self, key, expected) -> Atomic:
        _, e = self._writable_kv(key)
        old = e[1] if e else None
        if old is None or old != to_bytes(expected):
            return Atomic(False, old, old)
        self.delete(key)
        return Atomic(True, old, None)

    # conditional writes of many keys

    def put_if_absent_many(self, rows: DataFrame) -> DataFrame:
        """``put_if_absent`` for every row (key, value); each key once.

        All conditional batches return key, applied, observed and current, readable until the transaction
        ends, from one join with the bucket; a key named twice is refused, as its rows would have no order.
        """
        wanted = self._each_once(rows.select("key", F.col("value").alias("new")))
        return self._conditional(writes.put_if_absent(self._values_of(wanted), wanted, ["key"], "value", "new"), "put")

    def compare_exchange_many(self, rows: DataFrame) -> DataFrame:
        """``compare_exchange`` for every row (key, expected, value); an expected null means that the key must be missing."""
        wanted = self._each_once(rows.select("key", "expected", F.col("value").alias("new")))
        return self._conditional(writes.compare_exchange(self._values_of(wanted), wanted, ["key"], "value", "expected", "new"), "put")

    def delete_if_value_many(self, rows: DataFrame) -> DataFrame:
        """``delete_if_value`` for every row (key, expected)."""
        wanted = self._each_once(rows.select("key", "expected"))
        return self._conditional(writes.delete_if_value(self._values_of(wanted), wanted, ["key"], "value", "expected"), "delete")

    def _each_once(self, wanted: DataFrame) -> DataFrame:
        self.tx.need_write()
        wanted = self.tx.keep(wanted, count=False)
        if not wanted.groupBy("key").count().where("count > 1").isEmpty():
            raise ValueError("a batch of conditional writes names a key twice")
        n = wanted.count()
        if not self.rows.where("kind = 'bucket'").join(by_rows(wanted.select("key"), n), "key", "left_semi").isEmpty():
            raise E.IncompatibleValue("a key of the batch is a bucket")
        return by_rows(wanted, n)

    def _values_of(self, wanted: DataFrame) -> DataFrame:
        return self.values.select("key", "value").join(wanted.select("key"), "key", "left_semi")

    def _conditional(self, outcome: DataFrame, op: str) -> DataFrame:
        outcome = self.tx.keep(outcome, count=False)
        applied = outcome.where("applied")
        fresh = applied.where("observed is null").count() if op == "put" else 0
        self.tx.bulk(applied.select(F.lit(self.path).alias("path"), "key", F.lit("kv").alias("kind"), F.col("current").alias("value"), F.lit(None).cast("bigint").alias("next_int"), F.lit(op == "delete").alias("deleted")))
        self.tx.count_insert(self.path, fresh)
        self.tx.record_many(self.path, applied, op)
        return outcome

    # bulk writes

    def _pairs(self, rows: DataFrame | Iterable) -> DataFrame:
        """key, value, seq of a DataFrame (with seq, or one row per key) or of pairs in order."""
        if isinstance(rows, DataFrame):
            return rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))
        data = [(bytearray(to_bytes(k)), bytearray(to_bytes(v)), i) for i, (k, v) in enumerate(rows)]
        return self.tx.spark.createDataFrame(data, "key binary, value binary, seq bigint")

    @E.typed_reads()
    def insert_many(self, rows: DataFrame | Iterable) -> int:
        """Upserts all rows, the last of a key winning; how many there were, repeats included."""
        self.tx.need_write()
        ops = self._pairs(rows)
        batch = writes.last_write_wins(ops, ["key"], ["seq"], ["value"])
        here = by_rows(self.rows.select("key", "kind"), self.tx.most_rows)
        clash = batch.join(here.where("kind = 'bucket'"), "key", "left_semi")
        if not clash.isEmpty():
            raise E.IncompatibleValue("a key of the batch is a bucket")
        fresh = batch.join(here, "key", "left_anti").count()
        n = ops.count()
        self.tx.bulk(batch.select(F.lit(self.path).alias("path"), "key", F.lit("kv").alias("kind"), "value", F.lit(None).cast("bigint").alias("next_int"), F.lit(False).alias("deleted")))
        self.tx.count_insert(self.path, fresh)
        self.tx.record_many(self.path, ops, "put", "seq")
        return n

    @E.typed_reads()
    def _remove_rows(self, gone: DataFrame, op: str = "delete") -> int:
        """Takes out entries of this bucket; ``gone`` holds their keys, each once."""
        self.tx.need_write()
        n = gone.count()
        if n:
            self.tx.record_many(self.path, gone, op)
            none = F.lit(None)
            self.tx.bulk(gone.select(F.lit(self.path).alias("path"), "key", F.lit("kv").alias("kind"), none.cast("binary").alias("value"), none.cast("bigint").alias("next_int"), F.lit(True).alias("deleted")))
        return n

    def remove_many(self, keys: DataFrame | Iterable) -> int:
        if not isinstance(keys, DataFrame):
            keys = self.tx.spark.createDataFrame([(bytearray(to_bytes(k)),) for k in keys], "key binary")
        return self._remove_rows(self.values.join(keys.select("key").distinct(), "key", "left_semi").select("key"))

    def clear(self) -> int:
        return self._remove_rows(self.values.select("key"))

    def delete_range(self, start, end) -> int:
        return self._remove_rows(self.values.where(ordered.within("key", ordered.Bound(to_bytes(start)), ordered.Bound(to_bytes(end), False))).select("key"))

    def delete_prefix(self, prefix) -> int:
        return self._remove_rows(self.values.where(ordered.has_prefix("key", to_bytes(prefix))).select("key"))

    # deadlines

    def put_with_ttl(self, key, value, expires_at: float) -> TtlWrite:
        at = millis(expires_at)
        mark = (self.path + "#", b"")
        marked = self.tx.deadline(*mark) is not None
        first = not marked and self.tx.deadline(self.path, to_bytes(key)) is None and self.deadlines.isEmpty()
        before = self.put(key, value)
        self.tx.set_deadline(self.path, to_bytes(key), at)
        if not marked:
            self.tx.set_deadline(*mark, FOREVER)
        if first:
            # the index of deadlines counts as two nested buckets, which stay when all deadlines are gone
            self.tx.count_insert(self.path, 2)
        return TtlWrite(before, at)

    def set_deadlines(self, rows: DataFrame) -> None:
        """Deadlines (key, expires_at_ms) for many keys of this bucket, each once; the first of a bucket count as by ``put_with_ttl``."""
        self.tx.need_write()
        mark = (self.path + "#", b"")
        marked, any_before = self.tx.deadline(*mark) is not None, not self.deadlines.isEmpty()
        before = self.tx._heap[0]
        self.tx.bulk(ttl=rows.select(F.lit(self.path).alias("path"), "key", "expires_at_ms"))
        if self.tx._heap[0] > before and not marked:
            self.tx.set_deadline(*mark, FOREVER)
            self.tx.count_insert(self.path, 0 if any_before else 2)

    def get_live(self, key, now: float | None = None) -> KV | None:
        kv = self.get_kv(key)
        at = self.tx.deadline(self.path, to_bytes(key))
        return None if kv is None or at is not None and at <= (now_ms() if now is None else millis(now)) else kv

    def clear_ttl(self, key) -> bool:
        self.tx.need_write()
        k = to_bytes(key)
        if self.tx.deadline(self.path, k) is None:
            return False
        self.tx.set_deadline(self.path, k, None)
        return True

    def live(self, now: int | None = None) -> DataFrame:
        """Values whose deadline, if any, lies ahead of one moment taken now."""
        return expiry.live(self.values, self.deadlines, ["path", "key"], now_ms() if now is None else now)

    def purge_expired(self, now: float, limit: int) -> int:
        return self._purge(millis(now), limit, whole=False)

    @E.typed_reads()
    def _purge(self, now: int, limit: int, whole: bool) -> int:
        self.tx.need_write()
        rows = tree.subtree(self.tx.ttl, self.path) if whole else self.deadlines
        order = ["path", "expires_at_ms", "key"]
        due = expiry.due(rows, order, now, limit)
        found = due.join(self.tx.entries.select("path", "key", "kind"), ["path", "key"], "left")
        if not found.where("kind = 'bucket'").isEmpty():
            raise E.IncompatibleValue("a deadline's key is a bucket")
        n, none = due.count(), F.lit(None)
        there = found.where("kind = 'kv'")
        for r in there.orderBy(*order).limit(max(0, MAX_CHANGES - len(self.tx.changes)) + 1).collect():
            self.tx.record(r.path, bytes(r.key), "expire")
        if n:
            gone = there.select("path", "key", "kind", none.cast("binary").alias("value"), none.cast("bigint").alias("next_int"), F.lit(True).alias("deleted"))
            self.tx.bulk(gone, due.select("path", "key", none.cast("bigint").alias("expires_at_ms")))
        return n

    # merge

    def _whole(self) -> DataFrame:
        """Entries below this bucket with paths relative to it, and their deadlines."""
        cut = lambda df: tree.subtree(df, self.path).withColumn("path", F.substr("path", F.lit(len(self.path) + 1)))
        return cut(self.tx.entries).join(cut(self.tx.ttl).select("path", "key", F.col("expires_at_ms").alias("ttl")), ["path", "key"], "left")

    @E.typed_reads()
    def merge_from(self, source: Bucket, policy: merge.ConflictPolicy = merge.ConflictPolicy.OVERWRITE) -> merge.MergeReport:
        """Merges the source's tree into this bucket, all or nothing."""
        self.tx.need_write()
        self._alive()
        if source.tx is self.tx and source.path == self.path:
            return merge.MergeReport()
        # computed once and staged: the report, the check for conflicts, the layers and the change set all read it
        plan = merge.plan(self._whole(), source._whole(), policy).where("action <> 'keep'")
        gone = F.col("action").isin("same", "skip", "merge")
        planned = self.tx.keep(plan.withColumn("value", F.when(~gone | (F.col("action") == "merge"), F.col("value"))), count=False)
        if policy is merge.ConflictPolicy.ERROR:
            at = merge.first_conflict(planned).first()["at"]
            if at is not None:
                raise E.MergeConflict(self.names + tree.names_of(at))
        report = merge.MergeReport(**merge.report(planned).first().asDict())
        full = F.concat(F.lit(self.path), F.col("path")).alias("path")
        touched = planned.where(~F.col("action").isin("keep", "same", "skip"))
        kind = F.coalesce("kind", F.lit("kv")).alias("kind")
        top = planned.where("path = '' and action in ('insert', 'create')").count()
        changed = touched.select(full, "key", "action", "kind")
        self.tx.bulk(touched.select(full, "key", kind, "value", "next_int", F.col("kind").isNull().alias("deleted")), touched.select(full, "key", F.when(F.col("kind") == "kv", F.col("ttl")).alias("expires_at_ms")))
        if self.path:
            mine, theirs = self.next_int(), source.next_int()
            *above, name = self.names
            self.tx.set_entry(tree.path_of(above), name, ("bucket", None, max(mine, theirs)))
        else:
            self.tx.count_insert("", top)
        room = MAX_CHANGES - len(self.tx.changes) + 1
        ops = {"insert": "put", "update": "put", "replace_bucket": "put", "create": "bucket_create", "replace_kv": "bucket_create"}
        for r in changed.where(F.col("action").isin(*ops)).orderBy(tree.child_path()).limit(room).collect():
            if r.action == "replace_kv":
                self.tx.record(r.path, bytes(r.key), "delete")
            elif r.action == "replace_bucket":
                self.tx.record(r.path, bytes(r.key), "bucket_delete")
            self.tx.record(r.path, bytes(r.key), ops[r.action])
        return report
