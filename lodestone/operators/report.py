"""Reports over joined functions: yields, exclusions, funnel, collisions, histograms.

All counters of a report come from one pass of conditional aggregates; histograms share
one shuffle by unpivoting (dimension, value) pairs before a single aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bins, policy


def classify(rows: DataFrame, p: policy.Profile = policy.PROFILE) -> DataFrame:
    """Add eligibility, noise, weight, reject reason, high confidence, tier, collapse and
    quality flags to joined functions."""
    rows = rows.withColumn("_e", policy.eligibility(F.col("has_range"), F.col("is_non_target"), F.col("oracle_verdict"), F.col("name")))
    rows = rows.withColumns(
        {
            "eligible_for_join": F.col("_e.for_join"),
            "eligible_for_gold": F.col("_e.for_gold"),
            "exclusion_reason": F.col("_e.exclusion"),
            "is_aux": policy.is_aux(F.col("name")),
            "is_import_proxy": F.col("is_thunk") | F.col("is_plt"),
            "quality_weight": policy.table_weight(F.col("align_verdict"), F.col("overlap_ratio"), F.col("n_candidates")),
            "match_kind": policy.match_kind(F.col("pc_ratio"), F.col("n_near_ties"), F.col("has_range"), p),
        }
    ).drop("_e")
    rows = rows.withColumn("reject_reason", policy.reject_reason(p)).withColumn("is_high_confidence", F.col("reject_reason").isNull())
    return rows.withColumns(
        {
            "tier": policy.confidence_tier(F.col("is_high_confidence"), F.col("match_kind"), F.col("eligible_for_gold")),
            "upstream_collapse": policy.upstream_collapse(F.col("has_range"), F.col("is_non_target"), F.col("oracle_verdict"), F.col("align_verdict")),
            "quality_flags": policy.quality_flags(F.col("cfg_completeness"), F.col("warning_tags"), F.col("goto_count"), F.col("c_lines"), F.col("placeholder_rate"), p),
        }
    )


def yield_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    kinds = ("JOINED_STRONG", "JOINED_WEAK", "MULTI_MATCH", "NO_MATCH", "NO_RANGE")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(F.col("match_kind") == k).alias(k.lower()) for k in kinds])


def exclusion_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_total"),
        F.count_if("eligible_for_join").alias("n_eligible_join"),
        F.count_if("eligible_for_gold").alias("n_eligible_gold"),
        F.count_if(F.col("exclusion_reason") == "NO_RANGE").alias("n_no_range"),
        F.count_if(F.col("exclusion_reason") == "NON_TARGET").alias("n_non_target"),
    )


def high_confidence_rates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of high confidence among the rows fit for gold (none: of 1)."""
    gold, high = F.count_if("eligible_for_gold"), F.count_if(F.col("eligible_for_gold") & F.col("is_high_confidence"))
    return rows.groupBy(*by).agg(gold.alias("n_gold"), high.alias("n_high")).withColumn("rate", F.col("n_high") / F.greatest("n_gold", F.lit(1)))


def funnel(rows: DataFrame, by: list[str], p: policy.Profile = policy.PROFILE) -> DataFrame:
    """Rows fit for gold that pass all gates up to each one, in one pass."""
    passed, out = F.col("eligible_for_gold"), [F.count_if("eligible_for_gold").alias("n_eligible_for_gold")]
    for ok, (_, counter) in zip(policy.gate_conditions(p), policy.GATES, strict=True):
        passed = passed & ok
        out.append(F.count_if(passed).alias(counter))
    return rows.groupBy(*by).agg(*out, F.count_if(passed).alias("n_high_confidence"))


def collisions(rows: DataFrame, body: str = "body_id") -> DataFrame:
    """One row: bodies matched, those matched more than once, the most per body."""
    per = rows.filter(F.col(body).isNotNull()).groupBy(body).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_matched"), F.count_if(F.col("n") >= 2).alias("n_multi"), F.coalesce(F.max("n"), F.lit(0)).alias("max_per_body"))


def top_collisions(rows: DataFrame, body: str = "body_id", top_n: int = 5) -> DataFrame:
    """The bodies with most functions (two at least); equal ones by id. ``n`` counts all their
    functions, ``ids`` lists all their ids; :func:`members` gives them as rows."""
    top = rows.filter(F.col(body).isNotNull()).groupBy(body).agg(F.count("*").alias("n")).filter("n >= 2").orderBy(F.desc("n"), body).limit(top_n)
    mine = members(rows, top, body)  # of at most top_n bodies
    return mine.groupBy(body, "n").agg(F.array_join(F.array_sort(F.collect_list(F.col("function_id"))).cast("array<string>"), ",").alias("ids"))


def members(rows: DataFrame, top: DataFrame, body: str = "body_id") -> DataFrame:
    """(body, n, function_id): a row for each function of the bodies in ``top``, a few rows."""
    return rows.join(F.broadcast(top), body).select(body, "n", "function_id")


def histograms(rows: DataFrame, dims: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) for all dimensions, by one aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), c.cast("string").alias("value")) for d, c in dims.items()]))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


def standard_dimensions() -> dict[str, Column]:
    c = F.col
    return {
        "align_verdict": F.when(c("exclusion_reason").isNotNull(), F.concat(F.lit("EXCLUDED_"), c("exclusion_reason"))).otherwise(F.coalesce("align_verdict", F.lit("NONE"))),
        "n_candidates": bins.candidate_bin(c("n_candidates")),
        "quality_weight": bins.weight_bin_detailed(c("quality_weight"), c("has_range"), c("align_verdict")),
        "overlap_ratio": bins.unit_bin(c("overlap_ratio")),
        "opt": c("opt"),
        "match_kind": c("match_kind"),
    }


def tag_histogram(rows: DataFrame, tags: str) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def weight_audit(rows: DataFrame, weight: str = "quality_weight") -> DataFrame:
    w = F.col(weight)
    return rows.agg(F.count_if(w > 1.0).alias("n_over"), F.count_if(w < 0.0).alias("n_under"), F.bround(F.greatest(F.coalesce(F.max(w), F.lit(0.0)), F.lit(0.0)), 9).alias("max_weight"))


def tier_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    tier = F.when(F.coalesce("tier", F.lit("")) == "", "NONE").otherwise(F.col("tier"))
    return rows.withColumn("_t", tier).groupBy(*by).pivot("_t", ["GOLD", "SILVER", "BRONZE", "NONE"]).agg(F.count(F.lit(1))).na.fill(0)


def with_total(rows: DataFrame, by: str, sums: list[str], label: str = "TOTAL") -> DataFrame:
    """Sums per group and over all groups."""
    rolled = rows.rollup(by).agg(*[F.sum(c).alias(c) for c in sums], F.grouping(by).alias("_g"))
    return rolled.select(F.when(F.col("_g") == 1, label).otherwise(F.col(by)).alias(by), *sums)


def shares(rows: DataFrame, by: str, n: str = "n") -> DataFrame:
    return rows.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(by)))


def complete_grid(rows: DataFrame, axes: dict[str, list[str]], n: str = "n") -> DataFrame:
    """Counts over the full grid of the given labels; empty cells have 0."""
    spark, grid = rows.sparkSession, None
    for name, labels in axes.items():
        axis = spark.createDataFrame([(x,) for x in labels], f"`{name}` string").coalesce(1)
        grid = axis if grid is None else grid.crossJoin(F.broadcast(axis))  # a handful of labels
    counts = rows.groupBy(*axes).agg(F.count("*").alias(n))
    return F.broadcast(grid).join(counts, list(axes), "left").withColumn(n, F.coalesce(n, F.lit(0)))
