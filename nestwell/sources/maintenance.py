"""Backup, compaction and salvage of stores, wherever Spark can read and write.

Snapshots are written by executors; only journal rows and physical copies pass file by file through Hadoop's
file systems on the driver, by a few threads.
"""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from typing import BinaryIO

from pyspark.sql import functions as F

from nestwell.errors import InvalidStore
from nestwell.sources.store import Files, Manifest, Options, Snapshot, Store, rows_of


def _copy_files(names: list[str], source: Files, target: Files, threads: int = 8) -> None:
    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(lambda n: source.copy(n, target), names))


def _place(store: Store, target: str) -> Files:
    """Files of a new folder beside the target; the target must be free, and another one than the store."""
    jvm, conf = store.spark._jvm, store.spark._jsc.hadoopConfiguration()
    full = lambda name: (lambda p: p.getFileSystem(conf).makeQualified(p).toString())(jvm.org.apache.hadoop.fs.Path(name.rstrip("/")))
    if full(target) == full(store.root):
        raise ValueError("a store can't be copied onto itself")
    if Files(store.spark, target).exists(""):
        raise FileExistsError(target)
    return Files(store.spark, f"{target.rstrip('/')}.{uuid.uuid4().hex}")


def _snapshot_copy(store: Store, m: Manifest, files: Files, page_size: int | None = None) -> None:
    """One snapshot as a store of one segment, checked."""
    made, snap = Store(store.spark, files.root, Options(page_size=page_size or m.page_size)), Snapshot(store, m)
    fresh = Manifest(m.tx_id, [], m.root_next_int, page_size or m.page_size, m.schemas, m.journal, m.checkpoints)
    staged = made.stage(m.tx_id, snap.entries.withColumn("deleted", F.lit(False)), snap.ttl, [])
    rows = [rows_of(h) for h in (m.journal or {"headers": []})["headers"] if h["n"]]
    _copy_files([n for r in rows for n, _ in store.files.walk(r)], store.files, files)
    if m.tx_id == 0:
        made.files.delete(made._manifest_name(0))
    made.publish(fresh, staged)
    made.verify()


def _write_copy(store: Store, m: Manifest, target: str, page_size: int | None = None) -> None:
    """Beside the target first, checked, then under its name."""
    files = _place(store, target)
    try:
        _snapshot_copy(store, m, files, page_size)
        files.move(target)
    except BaseException:
        files.delete("")
        raise


def backup_to(store: Store, target: str) -> None:
    """The newest snapshot, while writers go on; counters, deadlines, journal and schemas included."""
    with store.view() as tx:
        _write_copy(store, tx.manifest, target)


def compact_to(store: Store, target: str, page_size: int | None = None) -> None:
    """Live rows alone, sorted and clustered by path and key."""
    with store.view() as tx:
        _write_copy(store, tx.manifest, target, page_size)


class _Chunks(io.RawIOBase):
    """A file of a store as a stream, a block at a time."""

    def __init__(self, files: Files, name: str):
        self._blocks, self._left = files.chunks(name), b""

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        if not self._left:
            self._left = next(self._blocks, b"")
        n = min(len(out), len(self._left))
        out[:n], self._left = self._left[:n], self._left[n:]
        return n


def backup_writer(store: Store, out: BinaryIO) -> None:
    """A backup as a tar stream, made beside the store and sent block by block."""
    files = Files(store.spark, f"{store.root}.{uuid.uuid4().hex}")
    try:
        with store.view() as tx:
            _snapshot_copy(store, tx.manifest, files)
        with tarfile.open(fileobj=out, mode="w|") as tar:
            for name, size in files.walk():
                if not name.rpartition("/")[2].startswith("."):
                    entry = tarfile.TarInfo(f"./{name}")
                    entry.size = size
                    tar.addfile(entry, io.BufferedReader(_Chunks(files, name), 1 << 20))
    finally:
        files.delete("")


def physical_backup_to(store: Store, target: str) -> None:
    """The files themselves, byte for byte, while no writer is at work."""
    files = _place(store, target)
    try:
        token = store._lock(None)
        try:
            names = [n for n, _ in store.files.walk() if n != "writer.lock" and not n.rpartition("/")[2].startswith(".")]
            _copy_files(names, store.files, files)
        finally:
            store.unlock(token)
        Store(store.spark, files.root, Options(read_only=True)).verify()
        files.move(target)
    except BaseException:
        files.delete("")
        raise


@dataclass(frozen=True)
class SalvageManifest:
    copied_buckets: int
    copied_records: int
    skipped_pages: list[str]
    skipped_records: list[dict]
    #: The table of all skipped records, if there are any; ``skipped_records`` holds the first LISTED.
    skipped_table: str | None = None


LISTED = 10_000


def salvage_to(store: Store, target: str) -> SalvageManifest:
    """Copies what can be read: files whose hash or content is wrong are listed and left out.

    Entries whose bucket was lost with such a file can't be reached any more and are listed as well.
    """
    m, skipped = store.latest(), []
    segments = []
    for s in m.segments:
        bad = set(store.check_segment(s))
        skipped += sorted(bad)
        kept = {n: f for n, f in s["files"].items() if n not in bad}
        segments.append(s | {"files": kept})
    good = Snapshot(store, Manifest(**asdict(m) | {"segments": segments}))
    good._read = lambda name, schema: _sound(store, segments, name, schema)
    entries, ttl = good.entries, good.ttl
    from nestwell.operators import integrity

    lost = integrity.violations(entries).where("invariant = 'parent_exists'").select("path").distinct()
    unreachable = entries.join(lost, "path", "left_semi").select("path", F.lower(F.hex("key")).alias("key"))
    entries = entries.join(lost, "path", "left_anti")
    out = Store(store.spark, target)
    if out.latest().tx_id or out.latest().segments:
        raise FileExistsError(target)
    staged = out.stage(m.tx_id or 1, entries.withColumn("deleted", F.lit(False)), ttl, [])
    out.publish(Manifest(m.tx_id or 1, [], m.root_next_int, m.page_size, m.schemas, None, {}), staged)
    counts = {r.kind: r["count"] for r in Snapshot(out, out.latest()).entries.groupBy("kind").count().collect()}
    lost_at = None
    if not unreachable.isEmpty():
        # as many as there are: beside the salvaged store as a table, and the first of them here
        lost_at = f"{out.root}/salvage/skipped"
        unreachable.write.parquet(lost_at)
        unreachable = store.spark.read.parquet(lost_at)
    records = [r.asDict() for r in unreachable.orderBy("path", "key").limit(LISTED).collect()]
    return SalvageManifest(counts.get("bucket", 0), counts.get("kv", 0), skipped, records, lost_at)


def _sound(store: Store, segments: list[dict], name: str, schema: str):
    files = [f"{store.root}/{n}" for s in segments for n in s["files"] if n.startswith(f"{name}/")]
    return store.spark.read.schema(schema).parquet(*files) if files else store.spark.createDataFrame([], schema)


def info(store: Store) -> dict:
    from nestwell.sources.store import FormatInfo

    i = FormatInfo.inspect(store.spark, store.root)
    return {"page_size": i.page_size, "version": i.version, "transaction_id": i.transaction_id, "metadata_page": i.metadata_page, "file_bytes": i.file_bytes}


def require_local(root: str) -> None:
    """Refuses a path of this machine that holds no store before a session is started for it."""
    if "://" not in root and not os.environ.get("HADOOP_CONF_DIR") and not os.path.isdir(os.path.join(root, "manifest")):
        raise InvalidStore(f"{root}: no store here")


def require(spark, root: str) -> None:
    if not Files(spark, root).exists("manifest"):
        raise InvalidStore(f"{root}: no store here")
