"""Change feeds: subscriptions within a process, and the durable journal as a batch or a stream."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwell import errors as E
from nestwell.functions.codecs import to_bytes
from nestwell.operators import journal, ordered, tree
from nestwell.tx import Change, ChangeSet, JournalGap, JournalReplay


@dataclass(frozen=True)
class WatchFilter:
    """All that is set must hold: an exact bucket path, a key prefix, a key range (end exclusive), operations."""

    path: tuple[bytes, ...] | None = None
    prefix: bytes | None = None
    start: bytes | None = None
    end: bytes | None = None
    ops: frozenset[str] = frozenset()

    def bucket_path(self, *names) -> WatchFilter:
        return replace(self, path=tuple(to_bytes(n) for n in names))

    def collection(self, definition) -> WatchFilter:
        return self.bucket_path(*definition.path)

    def with_prefix(self, prefix) -> WatchFilter:
        return replace(self, prefix=to_bytes(prefix))

    def within(self, start, end) -> WatchFilter:
        return replace(self, start=to_bytes(start), end=to_bytes(end))

    def operations(self, *ops: str) -> WatchFilter:
        return replace(self, ops=frozenset(ops))

    def matches(self, c: Change) -> bool:
        return (self.path is None or c.bucket_path == self.path) and (self.prefix is None or c.key.startswith(self.prefix)) and (self.start is None or self.start <= c.key < self.end) and (not self.ops or c.op in self.ops)

    def condition(self) -> Column:
        """The same as a condition on journal rows, in forms that reach the scan."""
        out = F.lit(True)
        if self.path is not None:
            out = out & (F.col("bucket_path") == tree.path_of(self.path))
        if self.prefix is not None:
            out = out & ordered.has_prefix("key", self.prefix)
        if self.start is not None:
            out = out & ordered.within("key", ordered.Bound(self.start), ordered.Bound(self.end, False))
        return out & F.col("op").isin(*sorted(self.ops)) if self.ops else out


class Subscription:
    """Change sets in order. One that falls behind its capacity ends with an overflow, after what is queued."""

    def __init__(self, watches: Watches, capacity: int, condition: WatchFilter):
        self._watches, self.filter = watches, condition
        self._queue: queue.Queue = queue.Queue(max(1, capacity))
        self._end: type[E.WatchError] | None = None

    def offer(self, changes: ChangeSet) -> bool:
        mine = tuple(c for c in changes.changes if self.filter.matches(c))
        if not mine and not changes.truncated:
            return True
        try:
            self._queue.put_nowait(ChangeSet(changes.tx_id, mine, changes.truncated))
        except queue.Full:
            self._end = E.WatchOverflow
            return False
        return True

    def try_recv(self) -> ChangeSet:
        try:
            return self._queue.get_nowait()
        except queue.Empty:
            raise (self._end or E.WatchEmpty)() from None

    def recv(self, timeout: float | None = None) -> ChangeSet:
        if self._end is not None:
            return self.try_recv()
        try:
            return self._queue.get(timeout=timeout)
        except queue.Empty:
            raise (self._end or E.WatchEmpty)() from None

    recv_event, try_recv_event = recv, try_recv

    def close(self) -> None:
        self._end = E.WatchDisconnected
        self._watches.drop(self)


class Watches:
    def __init__(self) -> None:
        self._lock, self._all = threading.Lock(), []

    def subscribe(self, capacity: int, condition: WatchFilter | None = None) -> Subscription:
        s = Subscription(self, capacity, condition or WatchFilter())
        with self._lock:
            self._all.append(s)
        return s

    def drop(self, s: Subscription) -> None:
        with self._lock:
            self._all = [x for x in self._all if x is not s]

    def publish(self, changes: ChangeSet) -> None:
        """Never waits: a full subscriber is dropped."""
        with self._lock:
            self._all = [s for s in self._all if s.offer(changes)]


def watch(store, capacity: int, condition: WatchFilter | None = None) -> Subscription:
    """Commits of this process from now on."""
    return store.watches.subscribe(capacity, condition)


def enable_journal(store, max_transactions: int = 10_000) -> None:
    with store.update() as tx:
        tx.set_journal(max_transactions)


def replay_journal(store, after: int, limit: int, condition: WatchFilter | None = None) -> JournalReplay:
    """The next transactions for a consumer; what a filter leaves empty still counts as delivered."""
    with store.view() as tx, E.typed_reads():
        if tx.manifest.journal is None:
            return JournalReplay()
        known = [h["tx_id"] for h in tx._snapshot.headers()]
        headers, changes = tx._snapshot.journal(after, limit)
        rows = journal.replay(headers, changes, after, limit, condition and condition.condition()).collect()
    sets: dict[int, list] = {}
    cut: dict[int, bool] = {}
    for r in rows:
        cut[r.tx_id] = r.truncated
        found = sets.setdefault(r.tx_id, [])
        if r.op is not None:
            found.append(Change(tuple(tree.names_of(r.bucket_path)), bytes(r.key), r.op))
    done = tuple(ChangeSet(t, tuple(c), cut[t]) for t, c in sets.items())
    oldest, newest = min(known, default=None), max(known, default=None)
    return JournalReplay(done, oldest, newest, JournalGap(after, oldest) if oldest is not None and after + 1 < oldest else None)


def checkpoint_journal(store, consumer, tx_id: int) -> None:
    """Remembers how far a consumer is, in a transaction of its own. It doesn't hold back retention."""
    with store.update() as tx:
        tx.set_checkpoint(consumer, tx_id)


def journal_checkpoint(store, consumer) -> int | None:
    return store.latest().checkpoints.get(to_bytes(consumer).hex())


def journal_stream(spark: SparkSession, root: str) -> DataFrame:
    """tx_id of transactions as they are published: a stream over the manifests, whose creation is the commit point."""
    names = spark.readStream.format("text").schema("value string").option("wholetext", "true").option("pathGlobFilter", "*.json").option("ignoreMissingFiles", "true").load(f"{root.rstrip('/')}/manifest")
    return names.select(F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("bigint").alias("tx_id"))


def consume_journal(spark: SparkSession, root: str, consumer: str, handle: Callable[[DataFrame, int], None], condition: WatchFilter | None = None) -> None:
    """Hands all new changes to ``handle(rows, batch)`` and returns; the consumer's place is kept beside the store.

    A batch of manifests only says how far the journal has come.  Its rows are those that the newest
    manifest lists behind the consumer's place, so nothing unpublished or pruned is delivered, and nothing
    is lost if manifests were vacuumed in between.  A batch that fails is handed out again, alike.
    """
    from nestwell.sources.store import Files, Manifest, Snapshot, Store

    home, store = f"consumers/{consumer}", Store(spark, root)
    files: Files = store.files

    def run(published: DataFrame, batch: int) -> None:
        # what earlier batches have reached; one that is run again finds its own place written already
        past = [(int(n.partition("-")[0]), int(n.partition("-")[2])) for n, _ in files.list(f"{home}/places")]
        mine = [t for b, t in past if b == batch]
        newest = mine[0] if mine else published.agg(F.max("tx_id")).first()[0]
        if newest is None:
            return
        if not mine:
            files.create(f"{home}/places/{batch}-{newest}", b"")
        after = max([t for b, t in past if b < batch], default=-1)
        m: Manifest = store.latest()
        snap = Snapshot(store, m)
        picked = [h for h in snap.headers(after) if h["tx_id"] <= newest]
        _, rows = snap.journal(after, len(picked))
        handle(rows if condition is None else rows.where(condition.condition()), batch)

    journal_stream(spark, root).writeStream.foreachBatch(run).option("checkpointLocation", f"{root.rstrip('/')}/{home}/state").trigger(availableNow=True).start().awaitTermination()


def windowed_counts(changes: DataFrame, ts: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An extra: changes per operation and window of a timestamped feed, with late rows up to the watermark."""
    return changes.withWatermark(ts, late).groupBy(F.window(ts, width), "op").count()
