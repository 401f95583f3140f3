"""Readers of artifact trees: fixed schemas, no inference, paths as partition columns."""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

#: Files of a run or a batch, bytes of a batch, tasks of a read of whole files.
FILES, HELD_BYTES, TASKS = 1000, 8 << 20, 10_000
#: root/<test_case>/<opt>/<variant>/<stage>/file
TREE = r".*/([^/]+)/([^/]+)/([^/]+)/[^/]+/[^/]+$"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (or glob) has files, on any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def tree_columns(df: DataFrame) -> DataFrame:
    """Add test_case, opt and variant from each file's path."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, TREE, n + 1).alias(c) for n, c in enumerate(("test_case", "opt", "variant"))])


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One object per file; a missing path gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True) -> DataFrame:
    """One object per line, blank lines skipped; a missing path gives no rows. Strict: a
    bad line fails the job; else bad lines are left out and a warning says how many
    (:func:`tolerant_lines` gives the lines themselves, without a job)."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    parsed = _parsed_lines(spark, path, schema)
    bad = F.col("r._corrupt_record").isNotNull()
    n_bad = parsed.filter(bad).count()
    if n_bad:
        log.warning("%d malformed lines under %s are left out", n_bad, path)
    return parsed.filter(~bad).select("r.*").drop("_corrupt_record")


def _parsed_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """file, value and r (the parsed line, what is malformed in ``_corrupt_record``)."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parse = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    return lines.select("file", "value", parse.alias("r"))


def tolerant_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(rows with their ``file``, bad lines with theirs), two views of one parse."""
    parsed = _parsed_lines(spark, path, schema)
    bad = F.col("r._corrupt_record").isNotNull()
    return parsed.filter(~bad).select("file", "r.*").drop("_corrupt_record"), parsed.filter(bad).select("file", "value")


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The lines that the tolerant reader leaves out."""
    return tolerant_lines(spark, path, schema)[1].select("value")


def numbered_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, pos, fields...) of the well-formed lines; ``pos`` is the line's place in its
    file, which is read whole (a line has no place of its own in a split one)."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("pos", "value"))
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    wide = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = whole.filter(F.trim("value") != "").select("file", "pos", F.from_json("value", wide, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter(F.col("r._corrupt_record").isNull()).select("file", "pos", "r.*").drop("_corrupt_record")


def tagged_lines(lines: DataFrame, defaults: dict[str, Column], tag: str = "_type") -> tuple[DataFrame, DataFrame]:
    """(functions sorted by entry, summaries) of tagged rows; no tag means function. Other
    tags are left to :func:`unknown_tags`."""
    kind = F.coalesce(F.col(tag), F.lit("function"))
    filled = lines.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})
    return filled.filter(kind == "function").drop(tag).orderBy("entry_va"), filled.filter(kind == "summary").drop(tag)


def unknown_tags(lines: DataFrame, by: list[str], tag: str = "_type") -> DataFrame:
    """Rows per tag that is neither a function's nor a summary's: what a reader warns about."""
    return lines.filter(~F.col(tag).isin("function", "summary")).groupBy(*by, tag).agg(F.count("*").alias("n"))


def last_summary(summaries: DataFrame, by: list[str], position: str) -> DataFrame:
    """Of each group's summaries the last one, by the place of its line."""
    fields = [c for c in summaries.columns if c not in (*by, position)]
    return summaries.groupBy(*by).agg(F.max_by(F.struct(*fields), position).alias("s")).select(*by, "s.*")


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, content) of all files below a folder, or of one file, but for those whose name, or whose folder's, begins
    with . or _. The driver lists the folder itself only; folders in it, and runs of its own files, are listed and
    read by tasks, so millions of small files cost a task what they hold and the planner nothing."""
    system, at = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    shown = [f for f in found if f.base_name[:1] not in (".", "_")]
    own = sorted(f.path for f in shown if f.type == fs.FileType.File)
    dealt = [([f.path], True) for f in shown if f.type == fs.FileType.Directory] + [(own[n : n + FILES], False) for n in range(0, len(own), FILES)]

    def below(here: fs.FileSystem, folder: str) -> Iterator[str]:
        for f in here.get_file_info(fs.FileSelector(folder)):
            if f.base_name[:1] not in (".", "_"):
                if f.type == fs.FileType.Directory:
                    yield from below(here, f.path)
                else:
                    yield f.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (here, _), names, contents, held = _system(path), [], [], 0

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(map(len, contents), pa.int64()), pa.array(contents, pa.binary())], names=["file", "size", "content"])

        for b in batches:
            for paths, folder in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for file in below(here, paths[0]) if folder else paths:
                    with here.open_input_stream(file, compression=None) as source:
                        contents.append(source.read())
                    names.append(file.rpartition("/")[2])
                    held += len(contents[-1])
                    if held >= HELD_BYTES or len(names) >= FILES:
                        yield full()
                        names, contents, held = [], [], 0
        if names:
            yield full()

    rows = spark.createDataFrame(dealt, "paths array<string>, folder boolean").repartition(max(1, min(len(dealt), TASKS)))
    return rows.mapInArrow(run, "file string, size bigint, content binary")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(tu, text): whole files, keyed by file name."""
    return whole_files(spark, path).select(F.col("file").alias("tu"), F.col("content").cast("string").alias("text"))


def discover(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the folders under a root."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def require_version(df: DataFrame, least: str, column: str = "schema_version") -> DataFrame:
    """Rows of a schema version too old fail the job; versions compare by number."""
    number = F.transform(F.split(F.coalesce(F.col(column), F.lit("0")), r"\."), lambda x: x.try_cast("int"))
    wanted = F.array(*[F.lit(int(x)) for x in least.split(".")])
    old = F.raise_error(F.concat(F.lit(f"schema version below {least}: "), F.coalesce(F.col(column), F.lit("none")))).cast("boolean")
    return df.filter(F.when(number >= wanted, True).otherwise(old))


def complete_cells(tables: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Cells that all tables have."""
    out = None
    for t in tables.values():
        cells = t.select(*key).distinct()
        out = cells if out is None else out.join(cells, key, "left_semi")
    return out


def sha_mismatches(reports: DataFrame, cells: DataFrame, key: list[str], column: str = "binary_sha256") -> DataFrame:
    """Report rows whose hash isn't that of their cell."""
    said = cells.select(*key, F.col(column).alias("_expected"))
    return reports.join(said, key, "left").filter(~F.col(column).eqNullSafe(F.col("_expected")))


def receipt_builds(receipts: DataFrame) -> DataFrame:
    """One row per build cell of a receipt; a missing artifact leaves nulls."""
    b = receipts.select("job_id", "test_case", F.explode("builds").alias("b"))
    return b.select("job_id", "test_case", F.col("b.opt").alias("opt"), F.col("b.variant").alias("variant"), F.col("b.status").alias("status"), F.col("b.artifact.sha256").alias("sha256"), F.col("b.artifact.size_bytes").alias("size_bytes"), F.coalesce(F.col("b.artifact.has_debug"), F.lit(False)).alias("has_debug"))
