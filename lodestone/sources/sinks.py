"""Writers: sorted bundles, idempotent appends, rewrites."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import exists

CSV = {"header": True, "nullValue": "\\N", "escape": '"'}


def write_bundle(df: DataFrame, path: str, order: list[str], by: list[str] | None = None, fmt: str = "parquet") -> None:
    """Overwrite a table, rows sorted within each file; files by partition columns."""
    rows = (df.repartition(*by) if by else df).sortWithinPartitions(*(by or []), *order)
    writer = rows.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_sorted(df: DataFrame, path: str, order: list[str], fmt: str = "parquet") -> None:
    """Overwrite a table whose files follow each other in the global order: rows are dealt
    by range and sorted within, so no task sorts the whole."""
    df.orderBy(*order).write.mode("overwrite").format(fmt).save(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A table as CSV with a header, in global order; null is written as \\N, so that it is
    no empty text, and line breaks and quotes in texts survive."""
    df.orderBy(*order).write.mode("overwrite").options(**CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**CSV, multiLine=True).csv(path)


def latex_table(df: DataFrame, order: list[str], most: int = 1000) -> str:
    """A report as a LaTeX tabular; for tables of at most ``most`` rows, more are an error."""
    rows = df.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"} | {c: f"\\{c}" for c in "&%$#_{}"}

    def cell(value: object) -> str:
        return "--" if value is None else "".join(special.get(c, c) for c in str(value))

    head = "".join("l" if kind == "string" else "r" for _, kind in df.dtypes)
    lines = [" & ".join(map(cell, row)) + r" \\" for row in ([*df.columns], *rows)]
    return "\n".join([f"\\begin{{tabular}}{{{head}}}", r"\hline", lines[0], r"\hline", *lines[1:], r"\hline", r"\end{tabular}"])


def json_bundle(rows: DataFrame, by: list[str], order: list[str], lines: bool = True) -> DataFrame:
    """(by, content): a group's rows as JSON lines, or as one JSON array, in a fixed order
    and with null fields written, so equal rows give equal bytes. A group is one file."""
    one = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in by]), {"ignoreNullFields": "false"})
    packed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_{n}") for n, c in enumerate(order)], one.alias("_json"))))
    texts = F.transform(packed, lambda r: r["_json"])
    content = F.concat(F.array_join(texts, "\n"), F.lit("\n")) if lines else F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    return rows.groupBy(*by).agg(content.alias("content"))


@contextmanager
def _aside(path: str, made: set[str]) -> Iterator[pa.NativeFile]:
    """A new file beside ``path``, moved there at the end; ``made``: folders known to be there."""
    system, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    folder = at.rpartition("/")[0]
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)
    aside = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(aside, compression=None) as out:
        yield out
    system.move(aside, at)


def write_lines(rows: DataFrame, path: Column, by: list[str], order: list[str]) -> DataFrame:
    """Write rows as JSON lines, all columns but ``by``, to the folder ``path`` of their group, as files that
    follow one another in ``order``; return (path, size) of the files. Rows are dealt by range over group and
    order and go from batch to file, so no group is gathered, however large."""
    one = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in by]), {"ignoreNullFields": "false"})
    sorted_rows = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, made, at, out, size = f"part-{TaskContext.get().partitionId():05d}", set(), None, ExitStack(), 0
        for b in batches:
            ends = pc.run_end_encode(b.column(0))
            first = 0
            for folder, last in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                if folder != at:
                    out.close()
                    if at is not None:
                        yield pa.RecordBatch.from_pydict({"path": [f"{at}/{name}"], "size": [size]})
                    at, size = folder, 0
                    stream = out.enter_context(_aside(f"{at}/{name}", made))
                text = ("\n".join(b.column(1).slice(first, last - first).to_pylist()) + "\n").encode()
                stream.write(text)
                size, first = size + len(text), last
        out.close()
        if at is not None:
            yield pa.RecordBatch.from_pydict({"path": [f"{at}/{name}"], "size": [size]})

    return sorted_rows.select(path.alias("path"), one.alias("line")).mapInArrow(run, "path string, size bigint")


def write_files(files: DataFrame) -> DataFrame:
    """Write each row's ``content`` to the file ``path`` and return (path, size). A file is
    written aside and moved, so a task that runs again leaves the same file. Any file
    system that Arrow knows by its scheme."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_buffer()  # no copy of it
                with _aside(path, made) as out:
                    out.write(raw)
                sizes.append(raw.size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return files.select("path", "content").mapInArrow(run, "path string, size bigint")


def cascade(parents: DataFrame, gone: DataFrame, key: list[str], children: dict[str, tuple[DataFrame, list[str]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without those in ``gone``, and each child table without rows of them;
    ``children``: name to (table, its columns for the parents' key)."""
    left = {}
    for name, (rows, own) in children.items():
        keys = gone.select(*[F.col(k).alias(c) for k, c in zip(key, own, strict=True)]).distinct()
        left[name] = rows.join(keys, own, "left_anti")
    return without(parents, gone, key), left


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 60.0, lasts: float = 3600.0) -> Iterator[None]:
    """One writer of a table at a time: a file beside it that only one of several can create
    (HDFS and local folders keep that promise). One older than ``lasts`` seconds is of a
    writer that is gone. TimeoutError if it is not free within ``wait`` seconds."""
    fs, make = _files(spark, path)
    name, until = f"{path.rstrip('/')}.lock", time.time() + wait
    while not _create(fs, make(name)):
        try:
            age = time.time() - fs.getFileStatus(make(name)).getModificationTime() / 1000
        except Py4JJavaError:  # given back just now
            continue
        if age > lasts:
            fs.delete(make(name), False)
        elif time.time() > until:
            raise TimeoutError(f"{name} is held by another writer")
        else:
            time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(make(name), False)


def _create(fs, at) -> bool:
    """Whether the file is new; among several that try, of one only."""
    if fs.getScheme() == "file":
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(at):
            return False
        raise
    return True


def new_rows(batch: DataFrame, stored: DataFrame | None, key: list[str], position: str) -> DataFrame:
    """Of a batch, the first row of each key that isn't stored yet."""
    w = Window.partitionBy(*key).orderBy(position)
    first = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return first if stored is None else first.join(stored.select(*key), key, "left_anti")


def append_one(spark: SparkSession, row: DataFrame, path: str, key: list[str]) -> bool:
    """Append a single row unless its key is stored; whether it was written."""
    with locked(spark, path):
        stored = spark.read.parquet(path) if exists(spark, path) else None
        fresh = row if stored is None else row.join(stored.select(*key), key, "left_anti")
        given = fresh.limit(2).collect()
        if len(given) > 1:
            raise ValueError("one row at a time")
        if given:
            spark.createDataFrame(given, row.schema).write.mode("append").parquet(path)
        return bool(given)


def append_new(spark: SparkSession, batch: DataFrame, path: str, key: list[str], position: str, scope: str = "experiment_id") -> tuple[int, int]:
    """(written, skipped); an empty batch or one of several scopes is an error. Several
    writers take turns, so none of their rows is lost or doubled."""
    given, scopes = batch.agg(F.count("*"), F.count_distinct(scope)).first()
    if not given:
        raise ValueError("the batch is empty")
    if scopes != 1:
        raise ValueError(f"the batch has several values of {scope}")
    with locked(spark, path):
        stored = spark.read.parquet(path) if exists(spark, path) else None
        fresh = new_rows(batch, stored, key, position).cache()
        written = fresh.count()
        if written:
            fresh.write.mode("append").parquet(path)
        fresh.unpersist()
    return written, given - written


def upserted(stored: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows without a new version, and the updates."""
    return stored.join(updates.select(*key), key, "left_anti").unionByName(updates, allowMissingColumns=True)


def without(stored: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return stored.join(gone.select(*key), key, "left_anti")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def restore(spark: SparkSession, path: str) -> None:
    """Put back the table that an interrupted :func:`rewrite` had moved aside."""
    fs, make = _files(spark, path)
    kept = make(f"{path.rstrip('/')}.old")
    if fs.exists(kept):
        if fs.exists(make(path)):
            fs.delete(kept, True)  # the new table stands already
        elif not fs.rename(kept, make(path)):
            raise OSError(f"cannot move {kept} back to {path}")


def rewrite(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Replace a table that ``df`` may be read from: written aside, then moved. The old
    table is moved away, not deleted, until the new one stands, so that whatever
    happens :func:`restore` finds one of them whole."""
    restore(spark, path)
    side = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(side)
    fs, make = _files(spark, path)
    old, kept = make(path), make(f"{path.rstrip('/')}.old")
    if fs.exists(old) and not fs.rename(old, kept):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(make(side), old):
        raise OSError(f"cannot move {side} to {path}")
    fs.delete(kept, True)


class RunRegistry:
    """Small table of runs: create once, get, list, patch, append an error."""

    SCHEMA = "run_id string, status string, completed bigint, errors array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def all(self) -> DataFrame:
        restore(self.spark, self.path)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], self.SCHEMA)

    def get(self, run_id: str) -> dict | None:
        row = self.all().filter(F.col("run_id") == run_id).first()
        return row.asDict() if row else None

    def _put(self, row: dict) -> None:
        one = self.spark.createDataFrame([tuple(row[c] for c in ("run_id", "status", "completed", "errors"))], self.SCHEMA)
        rewrite(self.spark, upserted(self.all(), one, ["run_id"]), self.path)

    def create(self, run_id: str) -> None:
        with locked(self.spark, self.path):
            if self.get(run_id):
                raise ValueError(f"run {run_id} is there already")
            self._put({"run_id": run_id, "status": "RUNNING", "completed": 0, "errors": []})

    def patch(self, run_id: str, status: str | None = None, completed: int | None = None, increment: int | None = None, error: str | None = None) -> dict:
        """An increment wins over a set number."""
        with locked(self.spark, self.path):
            row = self.get(run_id)
            if row is None:
                raise KeyError(run_id)
            row["status"] = status or row["status"]
            row["completed"] = row["completed"] + increment if increment is not None else row["completed"] if completed is None else completed
            row["errors"] = [*row["errors"], *([error] if error else [])]
            self._put(row)
            return row
