"""Joins that attach decompiler output and context to functions, and what may be shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import decompiled, text
from .invariants import forbidden_columns

# Columns that tell the answer, by name and by prefix, and what a mode hides.
FORBIDDEN = (
    "dwarf_function_name", "dwarf_function_name_norm", "test_case", "variant", "decl_file", "decl_line", "decl_column", "comp_dir", "confidence_tier", "quality_weight", "is_high_confidence", "eligible_for_gold",
    "ghidra_match_kind", "overlap_ratio", "gap_count", "verdict", "reasons", "candidates", "dwarf_verdict", "best_tu_path", "best_ts_func_id", "best_ts_function_name", "overlap_count", "total_count",
)
FORBIDDEN_PREFIXES = ("dwarf_function_name", "decl_", "confidence_", "quality_", "eligible_", "is_high_", "best_ts_", "best_tu_")
HIDDEN = {"STRICT": ("arch", "opt"), "ANALYST": ("opt",), "ANALYST_FULL": ()}


def with_decompiled(functions: DataFrame, dec: DataFrame, body: str = "body_id") -> DataFrame:
    """Functions with their body's output; bodies that repeat count once."""
    one = dec.dropDuplicates([body])
    return functions.join(one, body, "left").withColumn("decompile_status", F.coalesce("decompile_status", F.lit("MISSING")))


def grouped(rows: DataFrame, key: str, fields: list[str], out: str, order: str) -> DataFrame:
    """One array of structs per key, in source order. A key is one function's rows."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *fields)))
    return rows.groupBy(key).agg(F.transform(packed, lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out))


def variable_stats(variables: DataFrame, key: str = "body_id") -> DataFrame:
    """Per function: variables, temporaries, undefined types and their rate."""
    out = variables.groupBy(key).agg(F.count("*").alias("n_vars"), F.count_if(F.col("var_kind") == "TEMP").alias("n_temps"), F.count_if(decompiled.is_undefined_type(F.col("type_str"))).alias("n_undefined"))
    return out.withColumn("placeholder_rate", F.col("n_undefined") / F.greatest("n_vars", F.lit(1)))


def with_context(functions: DataFrame, level: str, calls: DataFrame, cfg: DataFrame, variables: DataFrame, key: str = "body_id") -> DataFrame:
    """Prompt text by level: L0 code alone, L1 with calls, L2 with blocks and variables."""
    none = F.lit(None).cast("string")
    if level == "L0":
        return functions.withColumns({"calls": none, "cfg_summary": none, "variables": none})
    out = functions.join(calls.select(key, "calls_list"), key, "left").withColumn("calls", text.calls_text(F.col("calls_list"))).drop("calls_list")
    if level == "L1":
        return out.withColumns({"cfg_summary": none, "variables": none})
    out = out.join(cfg.select(key, "cfg"), key, "left").withColumn("cfg_summary", text.cfg_text(F.col("cfg"))).drop("cfg")
    return out.join(variables.select(key, "variables_list"), key, "left").withColumn("variables", text.variables_text(F.col("variables_list"))).drop("variables_list")


def shown(rows: DataFrame, allowed: list[str], mode: str) -> DataFrame:
    """Allowed columns only, those that the mode hides as null; an answer among them is
    an error."""
    bad = forbidden_columns(allowed, FORBIDDEN, FORBIDDEN_PREFIXES)
    if bad:
        raise ValueError(f"columns tell the answer: {bad}")
    return rows.select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) if c in HIDDEN[mode] else F.col(c) for c in allowed])


def leak_audit(rows: DataFrame) -> dict[str, int]:
    """Forbidden columns of a frame and the number of rows that carry them."""
    bad = forbidden_columns(rows.columns, FORBIDDEN, FORBIDDEN_PREFIXES)
    if not bad:
        return {}
    row = rows.agg(*[F.count(F.col(c)).alias(c) for c in bad]).first()
    return {c: row[c] for c in bad if row[c]}


def resume(functions: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Functions without a stored result, on the whole key."""
    return functions.join(done.select(*key), key, "left_anti")


def page(rows: DataFrame, order: list[str], offset: int, limit: int, most: int = 10_000) -> DataFrame:
    """Rows of a total order from ``offset`` on; a limit below 1 or over ``most`` and an
    offset below 0 are errors."""
    if not 1 <= limit <= most or offset < 0:
        raise ValueError(f"limit must be in 1..{most} and offset not negative")
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_of_lines(lines: DataFrame, line: str, position: str, offset: int, limit: int, most: int = 10_000) -> DataFrame:
    """Like :func:`page` over the lines of a file: blank ones count towards the offset, but
    are neither returned nor counted towards the limit."""
    return page(lines.filter(F.col(position) >= offset).filter(F.trim(line) != ""), [position], 0, limit, most)


def binary_counters(functions: DataFrame, by: str) -> DataFrame:
    """Per binary: functions, failures, mean and median blocks."""
    return functions.groupBy(by).agg(
        F.count("*").alias("n"), F.count_if(F.col("decompile_status") == "FAIL").alias("n_fail"), F.bround(F.avg("bb_count"), 2).alias("mean_blocks"), F.median("bb_count").alias("median_blocks"), F.count_if(F.startswith("return_type", F.lit("undefined"))).alias("n_undefined")
    )
