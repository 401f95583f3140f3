"""Pieces that the training-data operators share: shared-folder tables, bounded
Arrow batches and prefix sums over a global order."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch handed to Python; long texts make batches short.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master may go without it (tests): it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if "LODESTONE_LOCAL_SHARED" not in os.environ:
            os.environ["LODESTONE_LOCAL_SHARED"] = tempfile.mkdtemp(prefix="lodestone-")
        base = os.environ["LODESTONE_LOCAL_SHARED"]
    return f"{base.rstrip('/')}/lodestone"


#: The folders that the run at hand has given names to; a thread has runs of its own.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are named inside, in order, for :func:`drop_but_last`."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        _made.reset(token)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None:
        _made.get().append(path)
    return path


def drop_but_last(spark: SparkSession, made: list[str]) -> None:
    """Delete the folders of a run but for the last one: what a step wrote on its way, once
    its result stands on its own."""
    conf, make = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in made[:-1]:
        make(path).getFileSystem(conf).delete(make(path), True)
    del made[:-1]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a
    lost executor costs no recomputation and random placement is fixed for good."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that :func:`materialise` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for part in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/lodestone/" in part:
            path = jvm.org.apache.hadoop.fs.Path(part)
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes, not only in rows. Workers outlive their
    tasks, so a task gives its memory back at its end."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no such function in this C library
        pass


def text_bytes(col: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text, empty for null."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def range_prefix(df: DataFrame, order: list[Column], value: str | list[str], out: str | list[str], group: str | None = None, name: str = "prefix") -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in the global
    order ``order`` (within ``group``, the first column of the order, if given; null is a
    group of its own); several values at once as lists.

    Rows are dealt by range and sorted; each task sums what it holds, and only one
    total per task (and group) is summed over all tasks. No window spans the table.
    """
    spark = df.sparkSession
    values, outs = ([value], [out]) if isinstance(value, str) else (value, out)
    keys = [F.col(group), *order] if group else order
    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    names = df.columns
    at = [names.index(v) for v in values]
    gi = names.index(group) if group else None
    runs = [f"_run{n}" for n in range(len(values))]
    schema = T.StructType([*df.schema.fields, T.StructField("_task", T.IntegerType()), *[T.StructField(r, T.LongType()) for r in runs]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        task, totals, last = TaskContext.get().partitionId(), [0] * len(at), ()
        for b in batches:
            if not b.num_rows:
                continue
            starts = None
            if gi is not None:
                g = b.column(gi).to_numpy(zero_copy_only=False)
                starts = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1))
            sums = []
            for n, vi in enumerate(at):
                v = b.column(vi).to_numpy(zero_copy_only=False).astype(np.int64)
                before = np.cumsum(v) - v
                if starts is None:
                    before += totals[n]
                else:
                    base = before[starts].copy()
                    if last == (g[0],):
                        base[0] -= totals[n]
                    before = before - np.repeat(base, np.diff(np.append(starts, len(g))))
                totals[n] = int(before[-1] + v[-1])
                sums.append(pa.array(before))
            last = () if gi is None else (g[-1],)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, task, np.int32)), *sums], names=[*b.schema.names, "_task", *runs])

    table = materialise(map_arrow(ranged, run, schema), name)
    by = [group] if group else []
    totals = table.groupBy(*by, "_task").agg(*[F.sum(v).alias(f"_sum{n}") for n, v in enumerate(values)])
    # one row per task (and group)
    w = "OVER (" + (f"PARTITION BY `{group}` " if group else "") + "ORDER BY _task ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = totals.select(*[F.col(c).alias("_of") for c in by], F.col("_task").alias("_at"), *[F.expr(f"coalesce(sum(_sum{n}) {w}, 0)").alias(f"_off{n}") for n in range(len(values))])
    same = F.col("_task") == F.col("_at")
    if group:  # as many rows as groups and tasks: the planner knows best
        joined = table.join(offsets, same & F.col(group).eqNullSafe(F.col("_of")))
    else:
        joined = table.join(F.broadcast(offsets), same)
    return joined.select(*names, *[(F.col(f"_off{n}") + F.col(r)).alias(o) for n, (r, o) in enumerate(zip(runs, outs, strict=True))])
