"""Typed collections: codecs over a bucket, deadlines respected, a schema registered and checked."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestwell import errors as E
from nestwell.functions.codecs import KeyCodec, Utf8, to_bytes
from nestwell.operators import ordered, tree, writes
from nestwell.tx import Bucket, Tx, now_ms

#: A root bucket of this name is kept for registries and can't hold a collection.
RESERVED = b"\0nestwell.schema"


class OpenPolicy(Enum):
    EXISTING = "existing"
    CREATE = "create"
    CREATE_OR_OPEN = "create_or_open"


@dataclass(frozen=True)
class CollectionDef:
    name: str
    key: KeyCodec
    value: Any
    parents: tuple[str, ...] = ()
    schema_id: str | None = None
    schema_version: int = 1
    policy: OpenPolicy = OpenPolicy.CREATE_OR_OPEN

    def nested(self, *parents: str) -> CollectionDef:
        return CollectionDef(self.name, self.key, self.value, parents, self.schema_id, self.schema_version, self.policy)

    @property
    def id(self) -> str:
        return self.name if self.schema_id is None else self.schema_id

    @property
    def path(self) -> list[bytes]:
        return [to_bytes(p) for p in (*self.parents, self.name)]

    def check(self) -> None:
        if not self.name or not self.id or not all(self.parents) or self.path[0] == RESERVED or not self.schema_version:
            raise E.InvalidDefinition("a collection needs names, a schema id and a version above 0")


def _registered(tx: Tx, d: CollectionDef) -> None:
    found = tx.schemas.get(tree.path_of(d.path))
    if found is None:
        raise E.SchemaMissing(d.name)
    if found != [d.id, d.schema_version]:
        raise E.SchemaMismatch(f"{d.name}: registered as {found}")


def open_read(tx: Tx, d: CollectionDef) -> ReadCollection:
    d.check()
    bucket = tx.root
    for name in d.path:
        bucket = bucket.get_bucket(name)
    _registered(tx, d)
    return ReadCollection(bucket, d)


def open_write(tx: Tx, d: CollectionDef) -> WriteCollection:
    d.check()
    tx.need_write()
    bucket = tx.root
    for name in d.path[:-1]:
        bucket = bucket.get_bucket(name) if d.policy is OpenPolicy.EXISTING else bucket.get_or_create_bucket(name)
    there = bucket._find(d.path[-1]) is not None
    if there and d.policy is OpenPolicy.CREATE:
        raise E.BucketExists(d.name)
    if there or d.policy is OpenPolicy.EXISTING:
        bucket = bucket.get_bucket(d.path[-1])
        _registered(tx, d)
    else:
        bucket = bucket.create_bucket(d.path[-1])
        tx.schemas[tree.path_of(d.path)] = [d.id, d.schema_version]
    return WriteCollection(bucket, d)


@dataclass(frozen=True)
class ScanPage:
    items: list[tuple]
    next: bytes | None = None


class ReadCollection:
    """Reads are DataFrames with the columns key and value, decoded and in key order. Expired records are hidden."""

    def __init__(self, bucket: Bucket, definition: CollectionDef):
        self.bucket, self.definition = bucket, definition
        self._key, self._value = definition.key, definition.value

    def _need_order(self) -> None:
        if not self._key.order_preserving:
            raise E.OrderingRequired("the key codec doesn't keep order")

    def _decoded(self, rows: DataFrame, reverse: bool = False) -> DataFrame:
        order = F.col("_k").desc() if reverse else F.col("_k")
        rows = rows.select(F.col("key").alias("_k"), "value").orderBy(order)
        return rows.select(self._key.decode(F.col("_k")).alias("key"), self._value.decode(F.col("value")).alias("value"))

    def _live(self, condition: Column | None = None) -> DataFrame:
        rows = self.bucket.live()
        return rows if condition is None else rows.where(condition)

    def get(self, key: Any) -> Any | None:
        kv = self.bucket.get_live(self._key.pack(key))
        return None if kv is None else self._value.unpack(kv.value)

    get_owned = get

    def contains_key(self, key: Any) -> bool:
        return self.get(key) is not None

    def multi_get(self, keys: Iterable) -> list:
        wanted = [(i, bytearray(self._key.pack(k))) for i, k in enumerate(keys)]
        if not wanted:
            return []
        live = ordered.only_keys(self._live().select("key", "value"), "key", [k for _, k in wanted])
        rows = ordered.multi_get(live, "key", self.bucket.tx.spark.createDataFrame(wanted, "pos int, key binary"))
        with E.typed_reads():
            return [None if r.value is None else self._value.unpack(bytes(r.value)) for r in rows.collect()]

    def iter(self) -> DataFrame:
        return self._decoded(self._live())

    def iter_rev(self) -> DataFrame:
        return self._decoded(self._live(), reverse=True)

    def prefix(self, encoded: bytes) -> DataFrame:
        return self._decoded(self._live(ordered.has_prefix("key", encoded)))

    def seek(self, key: Any) -> DataFrame:
        return self._decoded(self._live(ordered.within("key", ordered.Bound(self._key.pack(key)))))

    def keys(self) -> DataFrame:
        return self.iter().select("key")

    def values(self) -> DataFrame:
        return self.iter().select("value")

    def page_after(self, token: bytes | None, limit: int) -> ScanPage:
        rows = ordered.page_after(self._live(), "key", token, limit).select("key", "value").collect() if limit else []
        items = [(self._key.unpack(bytes(r.key)), self._value.unpack(bytes(r.value))) for r in rows[:limit]]
        return ScanPage(items, bytes(rows[limit - 1].key) if len(rows) > limit else None)

    def pages(self, limit: int, token: bytes | None = None) -> DataFrame:
        """All pages that ``page_after`` gives one after the other from the token on: page (from 0), key, value, a row per record, in no order.

        One sort by key and one count per part of it, instead of a job per page; nothing but the counts reaches the
        driver. The sorted records are staged until the transaction ends.
        """
        if limit < 1:
            raise ValueError("a page has 1 record or more")
        rows = self._live(None if token is None else ordered.within("key", ordered.Bound(token, False))).select("key", "value")
        with E.typed_reads():
            found = ordered.numbered(self.bucket.tx.aside(ordered.in_place(rows, "key")), "_n")
        return found.select(F.expr(f"_n div {limit}").alias("page"), self._key.decode(F.col("key")).alias("key"), self._value.decode(F.col("value")).alias("value"))

    def range_bounds(self, low: ordered.Bound | None = None, high: ordered.Bound | None = None, reverse: bool = False) -> DataFrame:
        self._need_order()
        packed = [b and ordered.Bound(self._key.pack(b.value), b.inclusive) for b in (low, high)]
        return self._decoded(self._live(ordered.within("key", *packed)), reverse)

    def range(self, start: Any, end: Any) -> DataFrame:
        return self.range_bounds(ordered.Bound(start), ordered.Bound(end, False))

    def range_rev(self, start: Any, end: Any) -> DataFrame:
        return self.range_bounds(ordered.Bound(start), ordered.Bound(end, False), reverse=True)

    def _end(self, order: Column) -> tuple | None:
        r = self._live().orderBy(order).select("key", "value").first()
        return None if r is None else (self._key.unpack(bytes(r.key)), self._value.unpack(bytes(r.value)))

    def first(self) -> tuple | None:
        return self._end(F.col("key").asc())

    def last(self) -> tuple | None:
        return self._end(F.col("key").desc())

    def len(self) -> int:
        """Stored records, expired ones included; ``live_count`` leaves them out."""
        return self.bucket.len()

    def is_empty(self) -> bool:
        return self.bucket.is_empty()

    def live_count(self) -> int:
        return self._live().count()


@dataclass(frozen=True)
class BulkLoad:
    inserted: int
    ordered: bool


@dataclass(frozen=True)
class CompareOutcome:
    applied: bool
    observed: Any | None
    current: Any | None


class WriteCollection(ReadCollection):
    def as_read(self) -> ReadCollection:
        return ReadCollection(self.bucket, self.definition)

    def _out(self, raw: bytes | None) -> Any | None:
        return None if raw is None else self._value.unpack(raw)

    def insert(self, key: Any, value: Any, expires_at: float | None = None) -> Any | None:
        """The previous value, even an expired one. Without ``expires_at`` the record has no deadline from now on."""
        k, v = self._key.pack(key), self._value.pack(value)
        if expires_at is not None:
            before = self.bucket.put_with_ttl(k, v, expires_at).previous
        else:
            before = self.bucket.put(k, v)
            self.bucket.clear_ttl(k)
        return None if before is None else self._value.unpack(before.value)

    def remove(self, key: Any) -> Any | None:
        k = self._key.pack(key)
        raw = self.bucket.remove(k)
        if raw is not None:
            self.bucket.clear_ttl(k)
        return self._out(raw)

    def _encoded(self, rows: DataFrame | Iterable) -> DataFrame:
        """key, value, seq as bytes, from a DataFrame of typed columns or pairs in order."""
        if isinstance(rows, DataFrame):
            seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
            return rows.select(self._key.encode(F.col("key")).alias("key"), self._value.encode(F.col("value")).alias("value"), seq.alias("seq"))
        data = [(bytearray(self._key.pack(k)), bytearray(self._value.pack(v)), i) for i, (k, v) in enumerate(rows)]
        return self.bucket.tx.spark.createDataFrame(data, "key binary, value binary, seq bigint")

    def insert_many(self, rows: DataFrame | Iterable) -> int:
        """Upserts all rows, the last of a key by ``seq`` winning; a column ``expires_at_ms`` gives them deadlines (null: none)."""
        ops = self._encoded(rows)
        n = self.bucket.insert_many(ops)
        self._clear_deadlines(ops.select("key"))
        if isinstance(rows, DataFrame) and "expires_at_ms" in rows.columns:
            seq = F.col("seq") if "seq" in rows.columns else F.lit(0)
            told = rows.select(self._key.encode(F.col("key")).alias("key"), F.col("expires_at_ms").cast("bigint").alias("expires_at_ms"), seq.alias("seq"))
            last = writes.last_write_wins(told, ["key"], ["seq"], ["expires_at_ms"]).where("expires_at_ms is not null")
            self.bucket.set_deadlines(last)
        return n

    def _clear_deadlines(self, keys: DataFrame) -> None:
        had = self.bucket.deadlines.join(keys.distinct(), "key", "left_semi")
        self.bucket.tx.bulk(ttl=had.select("path", "key", F.lit(None).cast("bigint").alias("expires_at_ms")))

    def remove_many(self, keys: Iterable) -> list:
        """The removed values by position; a key named twice is gone the second time."""
        keys = list(keys)
        packed, seen, out = [self._key.pack(k) for k in keys], set(), []
        for k, v in zip(packed, self.bucket.multi_get(packed), strict=True):
            out.append(None if k in seen else self._out(v))
            seen.add(k)
        gone = self.bucket.tx.spark.createDataFrame([(bytearray(k),) for k in seen], "key binary")
        if seen:
            there = self.bucket.values.join(gone, "key", "left_semi").select("key")
            self._clear_deadlines(there)
            self.bucket.remove_many(gone)
        return out

    def insert_ordered(self, rows: DataFrame | Iterable) -> BulkLoad:
        self._need_order()
        ops = self._encoded(rows)
        seen = writes.insert_ordered(ops, "key", ["seq"]).first()
        self.bucket.insert_many(ops)
        self._clear_deadlines(ops.select("key"))
        return BulkLoad(seen.inserted, seen.ordered)

    def clear(self) -> int:
        return self.bucket.clear()

    def entry(self, key: Any) -> Entry:
        return Entry(self, key, self.get(key))

    def compare_exchange(self, key: Any, expected: Any | None, value: Any) -> CompareOutcome:
        """An expired record still counts as present; the deadline stays as it is."""
        r = self.bucket.compare_exchange(self._key.pack(key), None if expected is None else self._value.pack(expected), self._value.pack(value))
        return CompareOutcome(r.applied, self._out(r.observed), self._out(r.current))

    def _bytes_of(self, rows: DataFrame, *values: str) -> DataFrame:
        return rows.select(self._key.encode(F.col("key")).alias("key"), *[self._value.encode(F.col(c)).alias(c) for c in values])

    def _told(self, outcome: DataFrame) -> DataFrame:
        """key, applied, observed, current, decoded."""
        return outcome.select(self._key.decode(F.col("key")).alias("key"), "applied", self._value.decode(F.col("observed")).alias("observed"), self._value.decode(F.col("current")).alias("current"))

    def put_if_absent_many(self, rows: DataFrame) -> DataFrame:
        """Inserts every (key, value) whose key is missing; an expired record still counts as present. See ``Bucket.put_if_absent_many``."""
        return self._told(self.bucket.put_if_absent_many(self._bytes_of(rows, "value")))

    def compare_exchange_many(self, rows: DataFrame) -> DataFrame:
        """``compare_exchange`` for every (key, expected, value); deadlines stay as they are."""
        return self._told(self.bucket.compare_exchange_many(self._bytes_of(rows, "expected", "value")))

    def delete_if_value_many(self, rows: DataFrame) -> DataFrame:
        return self._told(self.bucket.delete_if_value_many(self._bytes_of(rows, "expected")))

    def fetch_add_many(self, rows: DataFrame) -> DataFrame:
        """``fetch_add`` for every (key, amount, seq) in the order of ``seq``, a number: key, amount, seq and the value before, ``previous``.

        Missing and expired counters start at 0, and the records lose their deadlines.  A value out of range
        at any step is an error and nothing is written.  Hot counters are cut into slices of the order.
        """
        if not getattr(self._value, "numeric", False):
            raise E.CodecError("the value codec isn't numeric")
        tx, wide = self.bucket.tx, "decimal(38,0)"
        tx.need_write()
        ops = tx.keep(rows.select(self._key.encode(F.col("key")).alias("key"), F.col("amount").cast(wide).alias("amount"), "seq"), count=False)
        old = self._live().select("key", self._value.decode(F.col("value")).cast(wide).alias("_old"))
        steps = writes.fetch_add_previous(ops, "key", ["seq"], "amount").join(old, "key", "left")
        before = (F.coalesce("_old", F.lit(0)).cast(wide) + F.col("previous").cast(wide)).cast(wide)
        steps = tx.keep(steps.select("key", "amount", "seq", before.alias("previous"), (before + F.col("amount")).cast(wide).alias("after")), count=False)
        ends = steps.agg(F.min("after"), F.max("after")).first()
        try:
            for x in ends:
                if x is not None:
                    self._value.pack(int(x))
        except Exception as e:
            raise OverflowError("fetch_add") from e
        last = writes.last_write_wins(steps, ["key"], ["seq"], ["after"])
        self.bucket.insert_many(last.select("key", self._value.encode(F.col("after")).alias("value")))
        self._clear_deadlines(last.select("key"))
        return steps.select(self._key.decode(F.col("key")).alias("key"), "amount", "seq", "previous")

    def _pop(self, found: tuple | None) -> tuple | None:
        if found is not None:
            self.remove(found[0])
        return found

    def pop_first(self) -> tuple | None:
        return self._pop(self.first())

    def pop_last(self) -> tuple | None:
        return self._pop(self.last())

    def _delete_live(self, condition: Column) -> int:
        gone = self._live(condition).select("key")
        self._clear_deadlines(gone)
        return self.bucket._remove_rows(gone)

    def delete_range(self, start: Any, end: Any) -> int:
        self._need_order()
        return self._delete_live(ordered.within("key", ordered.Bound(self._key.pack(start)), ordered.Bound(self._key.pack(end), False)))

    def delete_prefix(self, encoded: bytes) -> int:
        return self._delete_live(ordered.has_prefix("key", encoded))

    def fetch_add(self, key: Any, amount: int) -> int:
        """The value before; the record loses its deadline. Too large a sum is an error."""
        if not getattr(self._value, "numeric", False):
            raise E.CodecError("the value codec isn't numeric")
        old = self.get(key) or 0
        try:
            self._value.pack(old + amount)
        except Exception as e:
            raise OverflowError("fetch_add") from e
        self.insert(key, old + amount)
        return old


@dataclass
class Entry:
    collection: WriteCollection
    key: Any
    value: Any | None

    def is_occupied(self) -> bool:
        return self.value is not None

    def is_vacant(self) -> bool:
        return self.value is None

    def get(self) -> Any | None:
        return self.value

    def and_modify(self, change: Callable[[Any], Any]) -> Entry:
        if self.value is not None:
            self.replace(change(self.value))
        return self

    def or_insert(self, value: Any) -> Any:
        return self.or_insert_with(lambda: value)

    def or_insert_with(self, make: Callable[[], Any]) -> Any:
        if self.value is None:
            self.replace(make())
        return self.value

    def replace(self, value: Any) -> Any | None:
        before = self.collection.insert(self.key, value)
        self.value = value
        return before

    def remove(self) -> Any | None:
        self.value = None
        return self.collection.remove(self.key)


@dataclass
class Batch:
    """Writes to several collections: encoded and opened when added, applied in order."""

    tx: Tx
    _ops: list[Callable[[], Any]] = field(default_factory=list)

    def insert(self, d: CollectionDef, key: Any, value: Any, expires_at: float | None = None) -> Batch:
        c = open_write(self.tx, d)
        d.key.pack(key), d.value.pack(value)
        self._ops.append(lambda: c.insert(key, value, expires_at))
        return self

    def remove(self, d: CollectionDef, key: Any) -> Batch:
        c = open_write(self.tx, d)
        k = d.key.pack(key)
        self._ops.append(lambda: (c.bucket.remove(k), c.bucket.clear_ttl(k)))
        return self

    def len(self) -> int:
        return len(self._ops)

    def is_empty(self) -> bool:
        return not self._ops

    def apply(self) -> int:
        for op in self._ops:
            op()
        done, self._ops = len(self._ops), []
        return done


class TypedBucket:
    """Codecs over a bucket without deadlines: it reads expired records and keeps deadlines when it writes."""

    def __init__(self, bucket: Bucket, key: KeyCodec, value: Any = Utf8()):
        self.raw, self._key, self._value = bucket, key, value

    def get(self, key: Any) -> Any | None:
        kv = self.raw.get_kv(self._key.pack(key))
        return None if kv is None else self._value.unpack(kv.value)

    def put(self, key: Any, value: Any) -> Any | None:
        before = self.raw.put(self._key.pack(key), self._value.pack(value))
        return None if before is None else self._value.unpack(before.value)

    def delete(self, key: Any) -> Any:
        return self._value.unpack(self.raw.delete(self._key.pack(key)).value)

    def _decoded(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col("key").alias("_k"), "value").orderBy("_k").select(self._key.decode(F.col("_k")).alias("key"), self._value.decode(F.col("value")).alias("value"))

    def entries(self) -> DataFrame:
        return self._decoded(self.raw.values)

    def range_inclusive(self, start: Any, end: Any) -> DataFrame:
        if not self._key.order_preserving:
            raise E.OrderingRequired("the key codec doesn't keep order")
        return self._decoded(self.raw.values.where(ordered.within("key", ordered.Bound(self._key.pack(start)), ordered.Bound(self._key.pack(end)))))
