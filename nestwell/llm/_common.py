"""Shared plumbing: durable staging, id/text projection and ordered prefix sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a single-process session may fall back to a temporary folder: there, driver and executors are
    one machine.  Anything else without the setting is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="nestwell-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Workspace:
    """Parquet tables in the shared folder: they cut lineage and outlive a lost executor.

    ``stage`` writes a DataFrame and reads it back; ``drop`` removes tables that no later step reads.
    What a lazily returned result still reads stays until ``close`` or the end of the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/nestwell/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self.close)
        _opened.append(self)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count}-{name}"

    def stage(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self._delete(df._staged_at)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended: nothing can be removed through it
            return
        finally:
            atexit.unregister(self.close)
            if self in _opened:
                _opened.remove(self)


#: Workspaces not yet closed, in the order of their making.
_opened: list[Workspace] = []


@contextmanager
def scratch():
    """Closes the workspaces made within: for a result that is written before the end."""
    before = len(_opened)
    try:
        yield
    finally:
        for ws in _opened[before:]:
            ws.close()


def frugal(run: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """A task's function that hands memory back at its end: workers live on and serve later operators, too."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release(forget)

    return wrapped


def release(forget: tuple[Callable[[], None], ...]) -> None:
    import ctypes

    import pyarrow as pa

    for f in forget:
        f()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only what an operator needs, under names of its own, so that other columns can't clash. Null text is empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *more)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart: two 64-bit hashes of the text, null counting as empty."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(t), F.xxhash64(F.lit(1), t)]


def unused(taken: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes to clash with no column; case doesn't tell columns apart."""
    low, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, kind: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` that are not (or, by ``left_semi``, are) in ``gone``: doc_id and the two columns ``k1`` and ``k2`` of ``text_key``.

    A row is known by its id and its text, so what becomes of one row says nothing of another with the same or no id.
    """
    i, a, b = unused(docs.columns, "_id", "_k1", "_k2")
    keys = gone.select(F.col("doc_id").alias(i), F.col("k1").alias(a), F.col("k2").alias(b))
    mine = text_key(F.col(f"`{text_col}`"))
    return docs.join(keys, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (mine[0] == F.col(a)) & (mine[1] == F.col(b)), kind)


def prefix_sums(ws: Workspace, df: DataFrame, order: list[str], value: str, out: str, place: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before, in the total order ``order``; and ``place``, how many rows are before.

    Rows are range-partitioned; each task sums its own rows as they stream past, and only two totals per
    partition reach the driver.  Rows tied on ``order`` are spread by it alone, so end it with unique columns.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType()), T.StructField("_row", T.LongType())])

    def local(batches):
        part, total, rows = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = pc.add(pc.cumulative_sum(batch.column(value)), total)
            starts = pc.subtract(ends, batch.column(value))
            total = ends[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), starts, pa.array(range(rows, rows + batch.num_rows), pa.int64())], [*batch.schema.names, "_part", "_local", "_row"])
            rows += batch.num_rows

    placed = ws.stage(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).mapInArrow(local, schema), "ordered")
    totals = sorted(placed.groupBy("_part").agg(F.sum(value).alias("n"), F.count("*").alias("rows")).collect())
    offsets, at, rows = [], 0, 0
    for part, n, k in totals:
        offsets.append((part, at, rows))
        at, rows = at + n, rows + k
    base = ws.spark.createDataFrame(offsets, "_part int, _base long, _rows long")
    done = placed.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.col("_local"))
    if place:
        done = done.withColumn(place, F.col("_rows") + F.col("_row"))
    done = done.drop("_base", "_local", "_part", "_rows", "_row")
    done._staged_at = placed._staged_at
    return done
