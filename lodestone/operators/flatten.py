"""Nested documents as flat tables, and tables attached to each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names, parse


def map_columns(rows: DataFrame, column: str, keys: list[str], prefix: str) -> DataFrame:
    """One column per key of a map, 0 where a row lacks it. The keys are given, so the
    schema doesn't depend on the data."""
    return rows.select("*", *[F.coalesce(F.col(column)[k], F.lit(0)).alias(f"{prefix}{k}") for k in keys]).drop(column)


def found_columns(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """One column per key that any row's JSON map in ``column`` has, 0 where a row lacks it: the
    keys are found by one aggregation of the variants' schemas."""
    parsed = rows.withColumn(column, F.try_parse_json(column))
    schema = parsed.agg(F.schema_of_variant_agg(column)).first()[0] or ""
    keys = sorted(T.StructType.fromDDL(schema[len("OBJECT<") : -1]).names) if schema.startswith("OBJECT<") else []
    at = lambda k: "$['" + k.replace("'", "\\'") + "']"
    return parsed.select("*", *[F.coalesce(F.try_variant_get(column, at(k), "bigint"), F.lit(0)).alias(f"{prefix}{k}") for k in keys]).drop(column)


def flatten_pairs(rows: DataFrame) -> DataFrame:
    """One row per candidate of a pair, or one without; missing names are shown by id."""
    name = names.display_or_anonymous(F.col("name"), F.col("function_id"))
    return rows.select("function_id", name.alias("name"), F.posexplode_outer("candidates").alias("pos", "c")).select("function_id", "name", "pos", F.col("c.ts_id").alias("ts_id"), F.coalesce("c.score", F.lit(0)).alias("score"))


def with_alignment(functions: DataFrame, pairs: DataFrame, non_targets: DataFrame) -> DataFrame:
    """Functions with their alignment; a pair wins over an entry among the non-targets."""
    p = pairs.select("function_id", F.col("verdict").alias("_p"), F.lit(True).alias("_in_p"))
    n = non_targets.select("function_id", F.lit(True).alias("_in_n"))
    rows = functions.join(p, "function_id", "left").join(n, "function_id", "left")
    only_n = F.col("_in_p").isNull() & F.col("_in_n").isNotNull()
    return rows.withColumn("align_verdict", F.when(F.col("_in_p"), F.col("_p")).when(only_n, "NON_TARGET")).withColumn("is_non_target", only_n & F.col("has_range")).drop("_p", "_in_p", "_in_n")


def decompiled_table(functions: DataFrame, cfg: DataFrame, stats: DataFrame, key: str = "body_id") -> DataFrame:
    """Decompiled functions with block and variable summaries; none count as 0."""
    rows = functions.join(cfg, key, "left").join(stats, key, "left")
    return rows.na.fill(0, [c for c, kind in rows.dtypes if kind in ("int", "bigint", "double") and c not in functions.columns])


def identity_rows(rows: DataFrame, columns: list[str], tier: str | None = None) -> DataFrame:
    """The given columns, of one tier if there is one to filter by."""
    return (rows.filter(F.col("tier") == tier) if tier else rows).select(*columns)


def needs_repair(predicted: Column) -> Column:
    return F.startswith(F.ltrim(predicted), F.lit("{")) | F.contains(predicted, F.lit('"predictions"'))


def repaired(rows: DataFrame) -> DataFrame:
    """Rows whose prediction is raw JSON get the first name parsed from the answer; only
    those rows go through Python."""
    bad = F.coalesce(needs_repair(F.col("predicted")), F.lit(False))
    fixed = rows.filter(bad).withColumn("_a", parse.parse_answers(F.coalesce(F.nullif("response", F.lit("")), F.col("predicted"))))
    fixed = fixed.withColumn("predicted", F.col("_a.predictions")[0]["name"]).withColumn("parse_ok", F.col("_a.parse_ok")).drop("_a")
    return rows.filter(~bad).withColumn("parse_ok", F.lit(None).cast("boolean")).unionByName(fixed)


def crosstab_shares(rows: DataFrame, a: str, b: str, labels: list[str]) -> DataFrame:
    """Row-normalised counts of b's labels per value of a."""
    wide = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).pivot(b, labels).agg(F.count(F.lit(1))).na.fill(0)
    total = sum((F.col(x) for x in labels[1:]), F.col(labels[0]))
    return wide.select(a, *[(F.col(x) / F.greatest(total, F.lit(1))).alias(x) for x in labels])


def gate_steps(funnel: DataFrame, counters: list[str]) -> DataFrame:
    """Per neighbouring counters of a funnel over all its rows: the sums before and
    after, and whether the gate ever binds."""
    pairs = [F.struct(F.lit(z).alias("gate"), F.col(a).alias("before"), F.col(z).alias("after")) for a, z in zip(counters, counters[1:], strict=False)]
    steps = funnel.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    return steps.groupBy("gate").agg(F.sum("before").alias("before"), F.sum("after").alias("after"), F.bool_or(F.col("before") != F.col("after")).alias("binds"))


# Parts of a join report.
EXCLUSIONS = ("n_total_dwarf", "n_no_range", "n_non_target", "n_noise_aux", "n_oracle_reject", "n_eligible_for_join", "n_eligible_for_gold")
DISTRIBUTIONS = ("cyclomatic", "insn_to_c_ratio", "asm_insn_count", "placeholder_type_rate", "goto_density")
PERCENTILES = ("p25", "p50", "p75", "p90")
COMPLETENESS = ("HIGH", "MEDIUM", "LOW")


def flatten_join_report(reports: DataFrame, cell: list[str], yields: Sequence[str] = (), funnel: Sequence[str] = (), warnings: Sequence[str] = (), join_warnings: Sequence[str] = ()) -> DataFrame:
    """A nested report as one flat row per cell. Its open maps become columns by the keys
    given: yield counts by their own names, the funnel as funnel_*, decompiler warnings as
    dec_warn_*, join warnings as jw_*; whatever a report lacks is 0."""
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    share = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    c = F.col
    out = [whole(c("yield_counts")[k]).alias(k) for k in yields]
    out += [whole(c("high_confidence.total")).alias("hc_total"), whole(c("high_confidence.high_confidence_count")).alias("hc_count"), share(c("high_confidence.yield_rate")).alias("hc_yield_rate")]
    out += [whole(c("exclusion_summary")[k]).alias(f"excl_{k}") for k in EXCLUSIONS]
    out += [whole(c("confidence_funnel")[k]).alias(f"funnel_{k}") for k in funnel]
    out += [share(c("decompiler.cfg_completeness_fractions")[k]).alias(f"cfg_frac_{k}") for k in COMPLETENESS]
    out += [whole(c("decompiler.warning_prevalence")[k]).alias(f"dec_warn_{k}") for k in warnings]
    out += [share(c(f"decompiler.{m}_percentiles")[p]).alias(f"dec_{m}_{p}") for m in DISTRIBUTIONS for p in PERCENTILES]
    out += [whole(c("decompiler.n_fat_functions")).alias("dec_n_fat_functions"), whole(c("decompiler.n_has_indirect_jumps")).alias("dec_n_indirect_jumps")]
    out += [whole(c("join_warning_histogram")[k]).alias(f"jw_{k}") for k in join_warnings]
    out += [whole(c(f"quality_weight_audit.n_quality_weight_{k}")).alias(f"qa_n_qw_{k}") for k in ("gt_1", "lt_0")]
    out += [whole(c("collision_summary.max_dwarf_per_ghidra")).alias("collision_max_dwarf_per_ghidra"), whole(c("collision_summary.n_ghidra_funcs_with_multi_dwarf")).alias("collision_n_multi_dwarf")]
    return reports.select(*cell, *out, whole(F.size("invariant_violations")).alias("n_invariant_violations"))


JOIN_REPORT = (
    "yield_counts map<string, bigint>, high_confidence struct<total: bigint, high_confidence_count: bigint, yield_rate: double>, exclusion_summary map<string, bigint>, confidence_funnel map<string, bigint>, "
    "decompiler struct<cfg_completeness_fractions: map<string, double>, warning_prevalence: map<string, bigint>, "
    + ", ".join(f"{m}_percentiles: map<string, double>" for m in DISTRIBUTIONS)
    + ", n_fat_functions: bigint, n_has_indirect_jumps: bigint>, join_warning_histogram map<string, bigint>, quality_weight_audit struct<n_quality_weight_gt_1: bigint, n_quality_weight_lt_0: bigint>, "
    "collision_summary struct<max_dwarf_per_ghidra: bigint, n_ghidra_funcs_with_multi_dwarf: bigint>, invariant_violations array<string>"
)
