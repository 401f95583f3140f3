"""Rates of verdicts and the shift of reasons between two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, policy


def percent(part: Column, whole: Column) -> Column:
    """100 x part / whole, a whole of 0 counting as 1; not rounded."""
    return F.lit(100.0) * part / F.when(whole == 0, 1).otherwise(whole)


def rounded(rate: Column, digits: int = 2) -> Column:
    return F.bround(rate, digits)


def verdict_rates(reports: DataFrame) -> DataFrame:
    """Add the rates of oracle verdicts (accept, warn, reject) and of alignment verdicts
    (match, ambiguous, no_match, non_target) in percent."""
    oracle = F.col("accept") + F.col("warn") + F.col("reject")
    aligned = F.col("match") + F.col("ambiguous") + F.col("no_match") + F.col("non_target")
    out = {f"{c}_rate": percent(F.col(c), oracle) for c in ("accept", "warn", "reject")}
    return reports.withColumns(out | {f"{c}_rate": percent(F.col(c), aligned) for c in ("match", "ambiguous", "no_match", "non_target")})


def enrich_pairs(pairs: DataFrame) -> DataFrame:
    """Add gap_rate (null without evidence) and quality_weight."""
    gap = F.when(F.col("total_count") > 0, F.least(F.greatest(F.col("gap_count") / F.greatest("total_count", F.lit(1)), F.lit(0.0)), F.lit(1.0)))
    return pairs.withColumn("gap_rate", gap).withColumn("quality_weight", policy.quality_weight(F.col("align_verdict"), F.col("overlap_ratio"), F.col("n_candidates")))


def reason_shift(reasons: DataFrame, pairs: DataFrame, a: str, b: str, top_k: int | None = None, averaging: str = "micro") -> DataFrame:
    """Per reason: counts and shares (percent of pairs that have it) at levels a and b,
    and the change in points, taken from the shares rounded to two digits.

    reasons: test_case, opt, reason, n; pairs: test_case, opt, n. ``macro`` averages the
    shares of the test cases. Beyond ``top_k`` reasons by the larger share, the rest is
    summed up as Other. Both inputs are small after aggregation."""
    if averaging not in ("micro", "macro"):
        raise ValueError("averaging is micro or macro")
    both = F.col("opt").isin(a, b)
    counts = reasons.filter(both).groupBy("opt", "reason").agg(F.sum("n").alias("count"))
    if averaging == "micro":
        whole = pairs.filter(both).groupBy("opt").agg(F.sum("n").alias("whole"))
        shares = counts.join(whole, "opt").withColumn("share", percent(F.col("count"), F.col("whole")))
    else:
        per = pairs.filter(both).groupBy("test_case", "opt").agg(F.sum("n").alias("whole"))
        mine = reasons.filter(both).groupBy("test_case", "opt", "reason").agg(F.sum("n").alias("count"))
        cells = per.groupBy("opt").agg(F.count("*").alias("cells"))
        # a test case without the reason adds 0 to the mean
        sums = mine.join(per, ["test_case", "opt"]).groupBy("opt", "reason").agg(F.sum(percent(F.col("count"), F.col("whole"))).alias("s"))
        shares = counts.join(sums, ["opt", "reason"]).join(cells, "opt").withColumn("share", F.col("s") / F.col("cells"))
    side = lambda o, s: [F.coalesce(F.sum(F.when(F.col("opt") == o, F.col("count"))), F.lit(0)).alias(f"count_{s}"), rounded(F.coalesce(F.sum(F.when(F.col("opt") == o, F.col("share"))), F.lit(0.0))).alias(f"share_{s}")]
    wide = shares.groupBy("reason").agg(*side(a, "a"), *side(b, "b")).filter("count_a > 0 OR count_b > 0")
    wide = wide.withColumn("delta_pp", rounded(F.col("share_b") - F.col("share_a")))
    if top_k is not None:
        w = Window.orderBy(F.desc(F.greatest("share_a", "share_b")), "reason")
        wide = wide.withColumn("reason", F.when(F.row_number().over(w) > top_k, "OTHER").otherwise(F.col("reason")))
        wide = wide.groupBy("reason").agg(*[F.sum(c).alias(c) for c in ("count_a", "count_b")], *[rounded(F.sum(c)).alias(c) for c in ("share_a", "share_b", "delta_pp")])
    return wide.withColumn("label", names.title_case(F.col("reason")))
