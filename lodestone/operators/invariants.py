"""Checks that joined rows and reports must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import GATES, PROFILE, Profile

TOLERANCE = 1e-6
KIND_TOLERANCE = 1e-3


def row_checks(p: Profile = PROFILE) -> dict[str, Column]:
    """Name of each check and when a row breaks it."""
    c = F.col
    expected = F.when((c("align_verdict") == "MATCH") & (c("n_candidates") > 0), c("overlap_ratio") / F.greatest("n_candidates", F.lit(1))).otherwise(0.0)
    return {
        "high_confidence_implies_gold": c("is_high_confidence") & ~c("eligible_for_gold"),
        "ratio_in_unit_interval": (c("pc_ratio") < 0) | (c("pc_ratio") > 1.0001),
        "no_range_has_no_body": (c("match_kind") == "NO_RANGE") & c("body_id").isNotNull(),
        "ineligible_has_reason": ~c("eligible_for_join") & c("exclusion_reason").isNull(),
        "weight_formula": F.abs(c("quality_weight") - expected) > TOLERANCE,
        "kind_fits_ratio": ((c("match_kind") == "JOINED_STRONG") & (c("pc_ratio") < p.strong - KIND_TOLERANCE)) | ((c("match_kind") == "JOINED_WEAK") & ((c("pc_ratio") < p.weak - KIND_TOLERANCE) | (c("pc_ratio") >= p.strong + KIND_TOLERANCE))),
    }


def violations(rows: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """(check, n, first_id) of the broken checks, in one pass over the rows."""
    checks = checks or row_checks()
    broken = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks.items()]))
    return rows.select("function_id", F.explode(broken).alias("check")).groupBy("check").agg(F.count("*").alias("n"), F.min("function_id").alias("first_id"))


def report_checks() -> dict[str, Column]:
    """Over a report row of exclusion counts and funnel counters."""
    counters = ["n_eligible_for_gold", *[name for _, name in GATES], "n_high_confidence"]
    rising = F.lit(False)
    for a, b in zip(counters, counters[1:], strict=False):
        rising = rising | (F.col(b) > F.col(a))
    return {"exclusion_partition": F.col("n_eligible_join") + F.col("n_no_range") + F.col("n_non_target") != F.col("n_total"), "funnel_monotone": rising, "gold_within_join": F.col("n_eligible_gold") > F.col("n_eligible_join")}


def clamp_weight(weight: Column, slack: float = 1e-9) -> Column:
    """A weight outside 0..1 by more than the slack is an error; within it is clamped."""
    bad = (weight < -slack) | (weight > 1 + slack)
    return F.when(bad, F.raise_error(F.lit("quality weight out of range")).cast("double")).otherwise(F.least(F.greatest(weight, F.lit(0.0)), F.lit(1.0)))


def count_errors(reports: DataFrame) -> DataFrame:
    """Reports whose total isn't the sum of accept, warn and reject."""
    return reports.filter(~F.col("total").eqNullSafe(F.col("accept") + F.col("warn") + F.col("reject")))


def uplift_errors(rows: DataFrame, uplift: str = "uplift", slack: float = 1e-9) -> DataFrame:
    """One row: rows with an uplift, those below 0 and those above 1, beyond the slack."""
    u = F.col(uplift)
    return rows.filter(u.isNotNull()).agg(F.count("*").alias("n"), F.count_if(u < -slack).alias("n_negative"), F.count_if(u > 1 + slack).alias("n_over"))


def unstable_truths(rows: DataFrame, key: str, truth: str = "ground_truth") -> DataFrame:
    """Keys with more than one ground truth; null and empty keys and sentinels don't count."""
    keyed = rows.filter((F.coalesce(key, F.lit("")) != "") & ~F.startswith(key, F.lit("_unstable")))
    return keyed.groupBy(key).agg(F.count_distinct(truth).alias("n_truths")).filter("n_truths > 1")


def duplicate_ids(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def forbidden_columns(columns: list[str], names: tuple[str, ...], prefixes: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c in names or c.startswith(prefixes)]
