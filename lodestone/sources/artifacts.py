"""Artifact trees: where each document lies, readers of one kind over a whole tree, and
datasets assembled from several kinds.

A tree is ``root/<test_case>/<opt>/<variant>/<place>``; a read names the levels and the
variant in its glob, so folders of others are not even listed. Nothing loops over cells:
each kind is one scan, and cells are matched by joins.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.flatten import flatten_join_report
from .readers import discover, exists

# The place of each document in its cell, and of the receipt in its test case.
RECEIPT = "build_receipt.json"
PLACES = {
    "oracle_report": "oracle/oracle_report.json",
    "oracle_functions": "oracle/oracle_functions.json",
    "alignment_report": "join_dwarf_ts/alignment_report.json",
    "alignment_pairs": "join_dwarf_ts/alignment_pairs.json",
    "ghidra_dir": "ghidra_decompile",
    "ghidra_report": "ghidra_decompile/report.json",
    "ghidra_functions": "ghidra_decompile/functions.jsonl",
    "ghidra_variables": "ghidra_decompile/variables.jsonl",
    "ghidra_cfg": "ghidra_decompile/cfg.jsonl",
    "ghidra_calls": "ghidra_decompile/calls.jsonl",
    "join_dir": "join_oracles_ghidra",
    "joined_functions": "join_oracles_ghidra/joined_functions.jsonl",
    "joined_variables": "join_oracles_ghidra/joined_variables.jsonl",
    "join_report": "join_oracles_ghidra/join_report.json",
}
CELL = ["test_case", "opt"]


def place(root: str, kind: str, test_case: str = "*", opt: str = "*", variant: str = "*") -> str:
    """The path of a document (or of all of its kind, with stars)."""
    base = root.rstrip("/")
    return f"{base}/{test_case}/{RECEIPT}" if kind == "build_receipt" else f"{base}/{test_case}/{opt}/{variant}/{PLACES[kind]}"


def select_cases(spark: SparkSession, root: str, wanted: Sequence[str] | None = None) -> list[str]:
    """The test cases under a root, sorted; of the wanted ones at least one must be there."""
    found = discover(spark, root)
    chosen = [t for t in found if wanted is None or t in wanted]
    if wanted is not None and not chosen:
        raise ValueError(f"none of {sorted(wanted)} under {root}")
    return chosen


def _any(names: Sequence[str]) -> str:
    return f"{{{','.join(names)}}}" if len(names) != 1 else names[0]


def scan(spark: SparkSession, root: str, kind: str, schema: str, cases: Sequence[str], opts: Sequence[str], variant: str) -> DataFrame:
    """All documents (or lines, for .jsonl) of a kind with test_case and opt; cells without
    the file give no rows."""
    path = place(root, kind, _any(cases), _any(opts), variant)
    full = f"test_case string, opt string, {schema}"
    if not cases or not exists(spark, path):
        return spark.createDataFrame([], full)
    reader = spark.read.schema(schema)
    rows = (reader.option("mode", "FAILFAST") if path.endswith(".jsonl") else reader.option("multiLine", True)).json(path)
    cell = f"/([^/]+)/([^/]+)/{re.escape(variant)}/{re.escape(PLACES[kind])}(?:/[^/]+)?$"
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, cell, 1).alias("test_case"), F.regexp_extract(file, cell, 2).alias("opt"), *rows.columns)


ORACLE_REPORT = "schema_version string, verdict string, binary_sha256 string, function_counts struct<total: bigint, accept: bigint, warn: bigint, reject: bigint>"
ALIGNMENT_REPORT = "schema_version string, pair_counts struct<match: bigint, ambiguous: bigint, no_match: bigint, non_target: bigint>, reason_counts map<string, bigint>, thresholds map<string, double>"
_IDENTITY = "decl_file: string, decl_line: bigint, decl_column: bigint, comp_dir: string"
ALIGNMENT_PAIRS = (
    "binary_sha256 string, pairs array<struct<dwarf_function_id: string, dwarf_function_name: string, dwarf_verdict: string, verdict: string, overlap_ratio: double, overlap_count: bigint, total_count: bigint, gap_count: bigint, "
    "reasons: array<string>, candidates: array<struct<ts_func_id: string, tu_path: string, function_name: string, context_hash: string, overlap_count: bigint, overlap_ratio: double, gap_count: bigint>>, "
    f"best_tu_path: string, best_ts_func_id: string, best_ts_function_name: string, {_IDENTITY}>>, "
    f"non_targets array<struct<dwarf_function_id: string, name: string, dwarf_verdict: string, dwarf_reasons: array<string>, {_IDENTITY}>>"
)
BUILD_RECEIPT = (
    "job struct<job_id: string, name: string, status: string>, builds array<struct<optimization: string, variant: string, status: string, artifact: struct<path_rel: string, sha256: string, size_bytes: bigint, "
    "elf: struct<build_id: string>, debug_presence: struct<has_debug_sections: boolean>>>>"
)


@dataclass
class Dataset:
    """Alignment results of a tree."""

    pairs: DataFrame
    non_targets: DataFrame
    reports: DataFrame
    builds: DataFrame
    test_cases: list[str]
    opts: list[str]


@dataclass
class JoinDataset:
    """Joined functions of a tree, and the reports there are."""

    functions: DataFrame
    reports: DataFrame
    test_cases: list[str]
    opts: list[str]


def _shown(name: str, rows: str) -> Column:
    return F.coalesce(F.col(f"{rows}.{name}"), F.concat(F.lit("<anon@"), F.col(f"{rows}.dwarf_function_id"), F.lit(">")))


def receipts(spark: SparkSession, root: str, cases: Sequence[str]) -> DataFrame:
    """test_case, job, builds of each receipt; one without a job or builds fails the job."""
    path = place(root, "build_receipt", _any(cases))
    if not cases or not exists(spark, path):
        return spark.createDataFrame([], f"test_case string, {BUILD_RECEIPT}")
    rows = spark.read.schema(BUILD_RECEIPT).option("multiLine", True).json(path)
    case = F.regexp_extract("_metadata.file_path", f"/([^/]+)/{re.escape(RECEIPT)}(?:/[^/]+)?$", 1)
    rows = rows.select(case.alias("test_case"), "job", "builds")
    broken = F.raise_error(F.concat(F.lit("receipt without job or builds: "), F.col("test_case"))).cast("boolean")
    return rows.filter(F.when(F.col("job").isNotNull() & F.col("builds").isNotNull(), True).otherwise(broken))


def build_rows(receipt_rows: DataFrame) -> DataFrame:
    """One row per build; a missing artifact leaves nulls, and has_debug is false then."""
    b = receipt_rows.select("test_case", F.posexplode("builds").alias("pos", "b"))
    a = F.col("b.artifact")
    return b.select(
        "test_case", "pos", F.col("b.optimization").alias("opt"), F.col("b.variant").alias("variant"), F.col("b.status").alias("status"), a["sha256"].alias("sha256"), a["size_bytes"].alias("binary_size"),
        F.coalesce(a["debug_presence"]["has_debug_sections"], F.lit(False)).alias("has_debug"), a["elf"]["build_id"].alias("build_id"),
    )


def resolve_builds(wanted: DataFrame, builds: DataFrame) -> DataFrame:
    """For each wanted (test_case, binary_sha256) the first build whose artifact has that
    hash; none is an error."""
    first = builds.filter("sha256 IS NOT NULL").groupBy("test_case", "sha256").agg(F.min_by(F.struct("opt", "variant", "status", "binary_size"), "pos").alias("b"))
    joined = wanted.join(first, (wanted["test_case"] == first["test_case"]) & (F.col("binary_sha256") == F.col("sha256")), "left")
    none = F.raise_error(F.concat(F.lit("no build with the hash "), F.coalesce("binary_sha256", F.lit("null")))).cast("string")
    opt = F.when(F.col("b").isNotNull(), F.col("b.opt")).otherwise(none)
    return joined.select(wanted["test_case"], "binary_sha256", opt.alias("opt"), "b.variant", "b.status", "b.binary_size")


def load_dataset(spark: SparkSession, root: str, reasons: Sequence[str] = (), thresholds: Sequence[str] = (), test_cases: Sequence[str] | None = None, opts: Sequence[str] = ("O0", "O1"), variant: str = "debug") -> Dataset:
    """Pairs, non-targets and reports of the cells that have all three documents, and the
    builds of all chosen test cases. ``reasons`` and ``thresholds`` name the map keys that
    become report columns (0 where a report lacks one), so the schema doesn't depend on
    the data."""
    cases = select_cases(spark, root, test_cases)
    of = lambda kind, schema: scan(spark, root, kind, schema, cases, opts, variant)
    alignment, oracle, pairs = of("alignment_report", ALIGNMENT_REPORT), of("oracle_report", ORACLE_REPORT), of("alignment_pairs", ALIGNMENT_PAIRS)
    both = alignment.drop("schema_version").join(oracle.select(*CELL, "function_counts"), CELL)
    whole = both.join(pairs.select(*CELL), CELL, "left_semi")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    counts = [zero(F.col(f"pair_counts.{c}")).alias(c) for c in ("match", "ambiguous", "no_match", "non_target")]
    counts += [zero(F.col(f"function_counts.{c}")).alias(f"oracle_{c}") for c in ("accept", "reject", "warn", "total")]
    counts += [zero(F.col("reason_counts")[k]).alias(f"reason_{k}") for k in reasons] + [F.coalesce(F.col("thresholds")[k], F.lit(0.0)).alias(f"threshold_{k}") for k in thresholds]
    kept = pairs.join(both.select(*CELL), CELL, "left_semi")
    p = kept.select(*CELL, F.explode("pairs").alias("p"))
    empty = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit("")).alias(c)
    plain = ["dwarf_function_id", "dwarf_function_name", "dwarf_verdict", "verdict", "overlap_ratio", "overlap_count", "total_count", "gap_count", "reasons", "candidates", "decl_file", "decl_line", "decl_column", "comp_dir"]
    p = p.select(*CELL, *[F.col(f"p.{c}") for c in plain], _shown("dwarf_function_name", "p").alias("dwarf_function_name_norm"), *[empty(c) for c in ("best_tu_path", "best_ts_func_id", "best_ts_function_name")])
    t = kept.select(*CELL, F.explode("non_targets").alias("t"))
    t = t.select(*CELL, F.col("t.*"), _shown("name", "t").alias("name_norm"))
    return Dataset(p, t, whole.select(*CELL, *counts), build_rows(receipts(spark, root, cases)), cases, list(opts))


def load_join_dataset(spark: SparkSession, root: str, functions: str, report: str, test_cases: Sequence[str] | None = None, opts: Sequence[str] = ("O0", "O1", "O2", "O3"), variant: str = "stripped", **flat: Sequence[str]) -> JoinDataset:
    """Joined functions of all chosen cells, also of those without a report, and flat
    reports of the cells that have one. ``functions`` and ``report`` are schemas."""
    cases = select_cases(spark, root, test_cases)
    rows = scan(spark, root, "joined_functions", functions, cases, opts, variant)
    reports = scan(spark, root, "join_report", report, cases, opts, variant)
    return JoinDataset(rows, flatten_join_report(reports, CELL, **flat), cases, list(opts))


def load_decompiled(spark: SparkSession, root: str, schemas: dict[str, str], test_cases: Sequence[str] | None = None, opts: Sequence[str] = ("O0", "O1", "O2", "O3"), variant: str = "stripped") -> dict[str, DataFrame]:
    """A decompile bundle over the tree: report, functions, variables, cfg and calls, each
    one scan; ``schemas`` by those names."""
    cases = select_cases(spark, root, test_cases)
    return {kind: scan(spark, root, f"ghidra_{kind}", schema, cases, opts, variant) for kind, schema in schemas.items()}


def hash_errors(cells: DataFrame) -> DataFrame:
    """Cells (oracle, alignment, decompiled, oracle_receipt, decompiled_receipt; the last
    null: same variant) whose hashes disagree: test_case, opt and the ``sides`` that do."""
    other = F.coalesce("decompiled_receipt", "oracle_receipt")
    wrong = F.array_compact(F.array(*[F.when(~F.col(side).eqNullSafe(said), F.lit(side)) for side, said in (("oracle", F.col("oracle_receipt")), ("alignment", F.col("oracle_receipt")), ("decompiled", other))]))
    return cells.select(*CELL, wrong.alias("sides")).filter(F.size("sides") > 0)
