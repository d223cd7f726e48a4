"""Versioned stores: immutable Parquet segments listed by numbered manifests.

A commit stages a delta segment, checks it and publishes the next manifest by creating its file, which
fails if it exists: that is the atomic point.  Readers hold the manifest they opened and never wait.
A snapshot is the oldest segment with the later ones laid over it; ``compact`` folds them into one.

File operations go through Hadoop's FileSystem, so a store may lie wherever Spark can read and where
creating a file is exclusive.  The writer's lock is such a file, too.
"""

from __future__ import annotations

import hashlib
import json
import os
import socket
import time
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestwell.errors import CapacityExceeded, InvalidStore, ReadOnlyStore, StoreError, TransactionError, WriterTimeout, typed_reads, unreadable
from nestwell.operators import integrity
from nestwell.operators.tree import ENTRIES, TTL

FORMAT = 1
DELTA = "path string, key binary, kind string, value binary, next_int bigint, deleted boolean"
TTL_DELTA = "path string, key binary, expires_at_ms bigint"
CHANGES = "tx_id bigint, seq bigint, bucket_path string, key binary, op string"
#: Rows of a data file at most, and bytes it is planned for; one above MAX_FILE_BYTES can't be hashed and refuses its commit.
MAX_FILE_ROWS, FILE_BYTES, MAX_FILE_BYTES = 1_000_000, 256 << 20, 2_000_000_000
#: So many newest segments of one size class or a smaller one are folded by a commit; a class is TIER times the one below.
FOLD_AFTER, TIER = 8, 16
#: Keys of more rows than these aren't broadcast in a join, however small their files are.
BROADCAST_ROWS = 100_000


class Verification(Enum):
    STANDARD = "standard"
    READ_BACK = "read_back"
    FULL = "full"


@dataclass(frozen=True)
class Options:
    """``page_size``, ``num_pages``, ``growth_increment`` and the two IO hints are accepted for
    completeness: columnar files need none of them."""

    read_only: bool = False
    verification: Verification = Verification.READ_BACK
    verify_on_open: bool = False
    max_file_bytes: int | None = None
    page_size: int | None = None
    num_pages: int = 32
    growth_increment: int = 8 << 20
    populate: bool = False
    direct_writes: bool = False

    def __post_init__(self) -> None:
        if self.page_size is not None and (self.page_size < 1024 or self.page_size % 8):
            raise ValueError("page_size: 1024 or more, a multiple of 8")
        if self.num_pages < 4:
            raise ValueError("num_pages: 4 or more")
        if self.max_file_bytes is not None and self.max_file_bytes < 4096:
            raise ValueError("max_file_bytes: 4096 or more")
        if self.growth_increment <= 0:
            raise ValueError("growth_increment: more than 0")


@dataclass
class Segment:
    """``drops`` are subtrees (path prefixes) that end with this segment; they don't cover its own rows."""

    entries: str | None = None
    ttl: str | None = None
    drops: list[str] = field(default_factory=list)
    files: dict[str, dict] = field(default_factory=dict)
    rows: int = 0


@dataclass
class Manifest:
    tx_id: int = 0
    segments: list[dict] = field(default_factory=list)
    root_next_int: int = 0
    page_size: int = 4096
    schemas: dict[str, list] = field(default_factory=dict)
    journal: dict | None = None
    checkpoints: dict[str, int] = field(default_factory=dict)
    format: int = FORMAT

    def text(self) -> str:
        body = json.dumps(asdict(self), sort_keys=True)
        return json.dumps({"body": body, "sha256": hashlib.sha256(body.encode()).hexdigest()})

    @staticmethod
    def parse(text: str) -> Manifest:
        outer = json.loads(text)
        if hashlib.sha256(outer["body"].encode()).hexdigest() != outer["sha256"]:
            raise InvalidStore("manifest: wrong hash")
        return Manifest(**json.loads(outer["body"]))


class Files:
    """What a store needs of a file system, through Hadoop's."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(name if name.startswith(self.root) else f"{self.root}/{name}")
        return p, p.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        p, fs = self._at(name)
        return fs.exists(p)

    def create(self, name: str, data: bytes) -> bool:
        """Writes a new file whole; False if it exists. Local file systems make it by linking, so it is never seen half-written."""
        p, fs = self._at(name)
        if fs.exists(p):
            return False
        if fs.getScheme() == "file":
            target = p.toUri().getPath()
            os.makedirs(os.path.dirname(target), exist_ok=True)
            temp = f"{target}.{uuid.uuid4().hex}"
            with open(temp, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, target)
            except FileExistsError:
                return False
            finally:
                os.unlink(temp)
            return True
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(data))
        out.close()
        return True

    def read(self, name: str) -> bytes:
        p, fs = self._at(name)
        s = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s))
        finally:
            s.close()

    def list(self, name: str) -> list[tuple[str, int]]:
        p, fs = self._at(name)
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str) -> None:
        p, fs = self._at(name)
        fs.delete(p, True)

    def walk(self, name: str = "") -> list[tuple[str, int]]:
        """All files below, by name from the root, with their sizes."""
        p, fs = self._at(name)
        out = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            inner = f"{name}/{s.getPath().getName()}".lstrip("/")
            out += self.walk(inner) if s.isDirectory() else [(inner, s.getLen())]
        return sorted(out)

    def copy(self, name: str, to: Files) -> None:
        """One file, byte for byte, to the same name below another root, whatever file systems the two lie on."""
        (p, fs), (q, other) = self._at(name), to._at(name)
        if not self.jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, other, q, False, False, self._conf):
            raise StoreError(f"{name} can't be copied")

    def move(self, target: str) -> None:
        """The whole tree to another root of the same file system; refused if something is there."""
        q = self.jvm.org.apache.hadoop.fs.Path(target)
        p, fs = self._at("")
        if fs.exists(q) or not fs.rename(p, q):
            raise FileExistsError(target)

    def chunks(self, name: str, size: int = 1 << 20):
        p, fs = self._at(name)
        s = fs.open(p)
        try:
            while data := bytes(s.readNBytes(size)):
                yield data
        finally:
            s.close()


class Snapshot:
    """One manifest's rows as DataFrames, bound when it was opened."""

    def __init__(self, store: Store, manifest: Manifest):
        self.store, self.manifest = store, manifest

    @typed_reads()
    def _read(self, name: str, schema: str) -> DataFrame:
        return self.store.spark.read.schema(schema).parquet(f"{self.store.root}/{name}")

    @property
    def entries(self) -> DataFrame:
        found = newest_first([(s["entries"] and self._read(s["entries"], DELTA), s["drops"], s["rows"]) for s in self.manifest.segments])
        return self.store.spark.createDataFrame([], ENTRIES) if found is None else found.where("not deleted").select(*ENTRIES.names)

    @property
    def ttl(self) -> DataFrame:
        found = newest_first([(s["ttl"] and self._read(s["ttl"], TTL_DELTA), s["drops"], ttl_rows(s)) for s in self.manifest.segments])
        return self.store.spark.createDataFrame([], TTL) if found is None else found.where("expires_at_ms is not null")

    def headers(self, after: int = -1, limit: int | None = None) -> list[dict]:
        """Of the retained transactions those behind ``after``, in order."""
        found = sorted((h for h in (self.manifest.journal or {"headers": []})["headers"] if h["tx_id"] > after), key=lambda h: h["tx_id"])
        return found[:limit]

    def journal(self, after: int = -1, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Headers (tx_id, truncated, n_changes) and changes of retained transactions; only the folders asked for are opened."""
        spark, picked = self.store.spark, self.headers(after, limit)
        headers = spark.createDataFrame([(h["tx_id"], h["truncated"], h["n"]) for h in picked], "tx_id bigint, truncated boolean, n_changes bigint")
        paths = [f"{self.store.root}/{rows_of(h)}" for h in picked if h["n"]]
        return headers, spark.read.schema(CHANGES).parquet(*paths) if paths else spark.createDataFrame([], CHANGES)


def rows_of(header: dict) -> str:
    """Where a transaction's journal rows lie; earlier stores named them by the number alone."""
    return header.get("name") or f"journal/{header['tx_id']:020d}"


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """One side of a join, of so many rows: large ones are kept from being broadcast.

    Spark judges Parquet files by their compressed size, and sorted keys shrink so much that 10 MB of files become hundreds of MB on the driver.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def ttl_rows(segment: dict) -> int:
    """About how many deadlines a segment holds, rather more than fewer: a row takes some 4 bytes of a file or more."""
    return sum(f["bytes"] for n, f in segment["files"].items() if segment["ttl"] and n.startswith(segment["ttl"])) // 4


def newest_first(layers: list[tuple[DataFrame | None, list[str], int]]) -> DataFrame | None:
    """The last row of every key over layers (rows, drops, number of rows) from oldest to newest, deletions included.

    The newest are joined first, so the oldest and largest layer meets the keys of all others in a single anti-join.
    A layer's drops take out rows of the layers below it, not its own.
    """
    out, dropped, above = None, [], 0
    for rows, drops, n in reversed(layers):
        if rows is not None:
            for p in dropped:
                rows = rows.where(~F.col("path").startswith(p))
            out = rows if out is None else rows.join(by_rows(out.select("path", "key"), above), ["path", "key"], "left_anti").unionByName(out)
            above += n
        dropped = dropped + drops
    return out


def fold_start(rows: list[int]) -> int:
    """Which of the segments, from oldest to newest with so many rows, the next commit folds with its own: those from this place on.

    Segments fall into classes of size. When FOLD_AFTER of the newest are of one class or smaller ones, and
    none of them outweighs the others by TIER, they become one segment; larger ones below stay untouched,
    so a small commit never rewrites a large store.
    """
    for size in range(64):
        small = next((i for i, n in enumerate(reversed(rows)) if n >= TIER ** (size + 1)), len(rows))
        newest = rows[len(rows) - small :]
        if small >= FOLD_AFTER and max(newest) <= TIER * (sum(newest) - max(newest)):
            return len(rows) - small
        if small == len(rows):
            break
    return len(rows)


def lay_over(base: DataFrame, delta: DataFrame | None, drops: list[str], rows: int) -> DataFrame:
    """A segment of so many rows over what lies below: its dropped subtrees and its keys go, its rows that aren't deletions come."""
    for p in drops:
        base = base.where(~F.col("path").startswith(p))
    if delta is None:
        return base
    fresh = delta.where("not deleted").select("path", "key", "kind", "value", "next_int")
    return base.join(by_rows(delta.select("path", "key"), rows), ["path", "key"], "left_anti").unionByName(fresh)


def lay_ttl_over(base: DataFrame, delta: DataFrame | None, drops: list[str], rows: int) -> DataFrame:
    """Like ``lay_over``; a deadline of null takes the row out."""
    for p in drops:
        base = base.where(~F.col("path").startswith(p))
    if delta is None:
        return base
    return base.join(by_rows(delta.select("path", "key"), rows), ["path", "key"], "left_anti").unionByName(delta.where("expires_at_ms is not null"))


@dataclass
class Stats:
    file_bytes: int
    page_size: int
    allocated_pages: int
    free_pages: int
    pending_pages: int
    reader_pinned_pages: int
    current_tx_id: int
    active_readers: int
    oldest_reader_tx_id: int | None
    committed_transactions: int
    bytes_written: int


class Store:
    def __init__(self, spark: SparkSession, root: str, options: Options | None = None, hook=None):
        """``hook(stage)`` is called at each step of a commit; tests raise from it to act a crash."""
        self.spark, self.options, self.hook = spark, options or Options(), hook or (lambda stage: None)
        self.root = root.rstrip("/")
        self.files = Files(spark, self.root)
        self.readers: dict[str, int] = {}
        self.committed = self.bytes_written = 0
        from nestwell.streaming.feed import Watches

        self.watches = Watches()
        if not self.files.list("manifest"):
            if self.options.read_only or self.files.list(""):
                raise InvalidStore(f"{root}: no store here")
            self.files.create(self._manifest_name(0), Manifest(page_size=self.options.page_size or 4096).text().encode())
        found = self.latest()
        if self.options.page_size not in (None, found.page_size):
            raise InvalidStore("page size differs from the store's")
        if self.options.verify_on_open:
            self.verify()

    @staticmethod
    def _manifest_name(tx_id: int) -> str:
        return f"manifest/{tx_id:020d}.json"

    def latest(self) -> Manifest:
        """The newest manifest whose hash is right."""
        for name, _ in reversed(self.files.list("manifest")):
            if name.endswith(".json"):
                try:
                    m = Manifest.parse(self.files.read(f"manifest/{name}").decode())
                except (InvalidStore, ValueError, KeyError, TypeError):
                    continue
                if m.format != FORMAT:
                    raise InvalidStore(f"format {m.format}")
                return m
        raise InvalidStore("no valid manifest")

    # transactions

    def tx(self, writable: bool):
        return self.write_tx() if writable else self.read_tx()

    def read_tx(self):
        from nestwell.tx import Tx

        return Tx(self, self.latest(), None)

    def write_tx(self, timeout: float | None = None):
        from nestwell.tx import Tx

        if self.options.read_only:
            raise ReadOnlyStore("opened read-only")
        token = self._lock(timeout)
        try:
            return Tx(self, self.latest(), token)
        except BaseException:
            self.unlock(token)
            raise

    def try_write_tx(self):
        try:
            return self.write_tx(0)
        except WriterTimeout:
            return None

    def _lock(self, timeout: float | None) -> str:
        """A lock file of a dead process on this host is taken away; others are waited for."""
        token, until = json.dumps({"host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex}), None if timeout is None else time.monotonic() + timeout
        while not self.files.create("writer.lock", token.encode()):
            try:
                owner = json.loads(self.files.read("writer.lock"))
                if owner["host"] == socket.gethostname() and not os.path.exists(f"/proc/{owner['pid']}"):
                    self.files.delete("writer.lock")
                    continue
            except Exception:  # freed meanwhile: try again
                pass
            if until is not None and time.monotonic() >= until:
                raise WriterTimeout("another writer is at work")
            time.sleep(0.002)
        return token

    def unlock(self, token: str) -> None:
        """Frees the lock if it is still this writer's."""
        try:
            mine = self.files.read("writer.lock").decode() == token
        except Exception:  # there is none any more
            return
        if mine:
            self.files.delete("writer.lock")

    def break_lock(self) -> bool:
        """Takes a lock away whose process on another host is known to be dead; whether there was one.

        Should that writer live after all, its commit fails: the next manifest's name can be created once only.
        """
        there = self.files.exists("writer.lock")
        self.files.delete("writer.lock")
        return there

    @contextmanager
    def view(self):
        tx = self.read_tx()
        try:
            yield tx
        finally:
            tx.close()

    @contextmanager
    def update(self, timeout: float | None = None):
        """Commits at the end, rolls back on any error, which goes on to the caller."""
        tx = self.write_tx(timeout)
        try:
            yield tx
        except BaseException:
            tx.rollback()
            raise
        tx.commit()

    def read(self, body):
        """``body(tx)``; a store's error and the caller's own arrive apart in ``TransactionError``."""
        return self._scoped(self.view(), body)

    def write(self, body, timeout: float | None = None):
        return self._scoped(self.update(timeout), body)

    @staticmethod
    def _scoped(scope, body):
        try:
            with scope as tx:
                return body(tx)
        except StoreError as e:
            raise TransactionError(storage=e) from e
        except Exception as e:
            if unreadable(e):
                raise TransactionError(storage=InvalidStore(f"a data file can't be read: {str(e).splitlines()[0][:200]}")) from e
            raise TransactionError(application=e) from e

    # commit

    def stage(self, tx_id: int, delta: DataFrame | None, ttl: DataFrame | None, drops: list[str], rows_per_file: int = MAX_FILE_ROWS) -> Segment:
        """Writes a segment's files, sorted by place and clustered by range, and records their hashes; on an error none of them stays."""
        seg, run = Segment(drops=drops), f"{tx_id:020d}-{uuid.uuid4().hex[:8]}"
        try:
            for kind, df in (("entries", delta), ("ttl", ttl)):
                if df is None:
                    continue
                name = f"data/{kind}-{run}"
                setattr(seg, kind, name)
                df.repartitionByRange("path", "key").sortWithinPartitions("path", "key").write.option("maxRecordsPerFile", min(MAX_FILE_ROWS, rows_per_file)).parquet(f"{self.root}/{name}")
                self.hook(f"after-{kind}-write")
                sizes = {f"{name}/{f}": size for f, size in self.files.list(name) if f.endswith(".parquet")}
                if any(size > MAX_FILE_BYTES for size in sizes.values()):
                    raise CapacityExceeded(f"a data file has more than {MAX_FILE_BYTES} bytes")
                hashes = self._hashes(list(sizes))
                if set(hashes) != set(sizes):
                    raise InvalidStore("a staged file can't be read")
                seg.files |= {f: {"bytes": sizes[f], "sha256": h} for f, h in hashes.items()}
            if delta is not None:
                seg.rows = self.spark.read.schema(DELTA).parquet(f"{self.root}/{seg.entries}").count()
        except Exception:
            self._discard(seg)
            raise
        return seg

    def _hashes(self, names: list[str]) -> dict[str, str]:
        """SHA-256 of files by name, computed where they are read; unreadable ones are left out."""
        there = {f"{d}/{f}" for d in {n.rpartition("/")[0] for n in names} for f, _ in self.files.list(d)}
        paths = [f"{self.root}/{n}" for n in names if n in there]
        if not paths:
            return {}
        found = self.spark.read.format("binaryFile").option("ignoreCorruptFiles", "true").load(paths).select("path", F.sha2("content", 256).alias("sha256"))
        return {"/".join(r.path.split("/")[-3:]): r.sha256 for r in found.collect()}

    def check_segment(self, seg: dict) -> list[str]:
        """Files that are missing or whose content has another hash than the manifest says."""
        found = self._hashes(list(seg["files"]))
        return [n for n, want in seg["files"].items() if found.get(n) != want["sha256"]]

    def publish(self, m: Manifest, staged: Segment | None) -> None:
        """Checks the staged segment and creates the next manifest; where that is refused, the segment's files go."""
        if staged is not None:
            m.segments.append(asdict(staged))
        try:
            if self.options.max_file_bytes is not None and sum(f["bytes"] for s in m.segments for f in s["files"].values()) > self.options.max_file_bytes:
                raise CapacityExceeded("the commit would exceed max_file_bytes")
            if staged is not None and self.options.verification is not Verification.STANDARD and self.check_segment(asdict(staged)):
                raise InvalidStore("staged files don't read back as written")
            if self.options.verification is Verification.FULL and not integrity.violations(Snapshot(self, m).entries).isEmpty():
                raise InvalidStore("the commit would break the tree")
            self.hook("before-manifest")
            if not self.files.create(self._manifest_name(m.tx_id), m.text().encode()):
                raise InvalidStore("another writer has published this transaction")
        except Exception:
            self._discard(staged)
            raise
        self.committed += 1
        self.bytes_written += sum(f["bytes"] for f in (staged.files if staged else {}).values())

    def _discard(self, staged: Segment | None) -> None:
        for name in (staged.entries, staged.ttl) if staged else ():
            if name:
                self.files.delete(name)

    # what a store tells of itself

    def stats(self) -> Stats:
        m, pages = self.latest(), lambda n: -(-n // m.page_size)
        live = {n: f["bytes"] for s in m.segments for n, f in s["files"].items()}
        there = {f"{d}/{f}": size for d in (f"data/{n}" for n, _ in self.files.list("data")) for f, size in self.files.list(d) if f.endswith(".parquet")}
        pinned = {n for t in self.readers.values() for n in self._files_of(t)} - set(live)
        stale = {n: b for n, b in there.items() if n not in live}
        return Stats(sum(there.values()), m.page_size, pages(sum(there.values())), pages(sum(b for n, b in stale.items() if n not in pinned)), pages(sum(stale.values())), pages(sum(stale.get(n, 0) for n in pinned)), m.tx_id, len(self.readers), min(self.readers.values(), default=None), self.committed, self.bytes_written)

    def _files_of(self, tx_id: int) -> set[str]:
        m = Manifest.parse(self.files.read(self._manifest_name(tx_id)).decode())
        return {n for s in m.segments for n in s["files"]}

    def verify_report(self) -> DataFrame:
        """invariant, path, key: wrong file hashes and broken rules of the newest snapshot; empty when all is well."""
        m = self.latest()
        bad = [("file_hash", n, None) for s in m.segments for n in self.check_segment(s)]
        files = self.spark.createDataFrame(bad, "invariant string, path string, key binary")
        return files if bad else files.unionByName(integrity.violations(Snapshot(self, m).entries))

    def verify(self) -> None:
        first = self.verify_report().first()
        if first is not None:
            raise InvalidStore(f"{first.invariant}: {first.path}")

    def vacuum(self) -> int:
        """Deletes manifests before the oldest reader's, and what no remaining manifest lists: data, journal rows of pruned or
        refused transactions, staging of writers that died; how many went.

        It holds the writer's lock, so nothing that a commit is about to publish counts as forgotten.
        """
        token = self._lock(None)
        try:
            return self._vacuum()
        finally:
            self.unlock(token)

    def _vacuum(self) -> int:
        keep_from = min([self.latest().tx_id, *self.readers.values()])
        gone, needed = [], set()
        for name, _ in self.files.list("manifest"):
            if not name.endswith(".json") or int(name.removesuffix(".json")) < keep_from:
                gone.append(f"manifest/{name}")
                continue
            m = Manifest.parse(self.files.read(f"manifest/{name}").decode())
            needed |= {n for s in m.segments for n in (s["entries"], s["ttl"]) if n} | {rows_of(h) for h in (m.journal or {"headers": []})["headers"] if h["n"]}
        gone += [f"{d}/{name}" for d in ("data", "journal") for name, _ in self.files.list(d) if f"{d}/{name}" not in needed]
        gone += [f"staging/{name}" for name, _ in self.files.list("staging")]
        for name in gone:
            self.files.delete(name)
        return len(gone)


@dataclass(frozen=True)
class FormatInfo:
    page_size: int
    version: int
    transaction_id: int
    metadata_page: str
    file_bytes: int

    @staticmethod
    def inspect(spark: SparkSession, root: str) -> FormatInfo:
        files = Files(spark, root)
        for name, _ in reversed(files.list("manifest")):
            try:
                m = Manifest.parse(files.read(f"manifest/{name}").decode())
            except (InvalidStore, ValueError, KeyError, TypeError):
                continue
            return FormatInfo(m.page_size, m.format, m.tx_id, name, sum(f["bytes"] for s in m.segments for f in s["files"].values()))
        raise InvalidStore(f"{root}: no valid manifest")
