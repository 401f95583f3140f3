"""Scores of predicted names, best of k, and reports by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bins, names

SCORER_VERSION = "1"


def score(rows: DataFrame, predicted: str = "predicted", truth: str = "ground_truth") -> DataFrame:
    """Add exact_match, token precision/recall/F1, trivial flag and tokens."""
    p, g = F.col(predicted), F.col(truth)
    # tokens in a projection of their own: split once a row, whatever is made of them
    rows = rows.withColumns({"predicted_tokens": names.tokens(p), "truth_tokens": names.tokens(g)})
    # and their sets and sizes too, so that every score is arithmetic on three numbers
    rows = rows.withColumns({"_p": F.array_distinct("predicted_tokens"), "_g": F.array_distinct("truth_tokens")})
    rows = rows.select(*[c for c in rows.columns if c not in ("_p", "_g")], F.size(F.array_intersect("_p", "_g")).alias("_both"), F.size("_p").alias("_n_p"), F.size("_g").alias("_n_g"))
    precision, recall, f1 = names.set_scores(F.col("_both"), F.col("_n_p"), F.col("_n_g"))
    scored = rows.withColumns(
        {
            "exact_match": names.exact_match(p, g),
            "token_precision": precision,
            "token_recall": recall,
            "token_f1": f1,
            "is_trivial": names.is_trivial(p),
            "scorer_version": F.lit(SCORER_VERSION),
        }
    )
    return scored.drop("_both", "_n_p", "_n_g")


def token_differences(rows: DataFrame) -> DataFrame:
    """Add the matched, missed and extra tokens of a scored row."""
    p, g = F.col("predicted_tokens"), F.col("truth_tokens")
    return rows.withColumns({"matched": F.array_intersect(g, p), "missed": F.array_except(g, p), "extra": F.array_except(p, g)})


def best_of_k(rows: DataFrame, candidates: str = "candidates", truth: str = "ground_truth") -> DataFrame:
    """Add the best F1 of the ranked names, where it first is (0-based), whether any name
    is exact, and the gain over the first name."""
    # sets, then sizes, then scores: each lambda evaluates its set operations once
    split = rows.withColumns({"_truth": F.array_distinct(names.tokens(F.col(truth))), "_each": F.transform(F.col(candidates), lambda c: F.array_distinct(names.tokens(c)))})
    split = split.withColumn("_n", F.transform("_each", lambda t: F.struct(F.size(F.array_intersect(t, F.col("_truth"))).alias("both"), F.size(t).alias("p"))))
    rows = split.withColumn("_f1s", F.transform("_n", lambda n: names.set_scores(n["both"], n["p"], F.size("_truth"))[2])).withColumn("f1_topk", F.coalesce(F.array_max("_f1s"), F.lit(0.0)))
    best = F.col("f1_topk")
    return rows.withColumns(
        {
            "exact_topk": F.exists(F.col(candidates), lambda c: names.exact_match(c, F.col(truth))),
            "best_index": F.greatest(F.array_position("_f1s", best) - 1, F.lit(0)),
            "uplift": best - F.coalesce(F.get("_f1s", F.lit(0)), F.lit(0.0)),
        }
    ).drop("_f1s", "_n", "_each", "_truth")


def rollup_columns() -> list[Column]:
    return [
        F.count("*").alias("n"),
        F.avg(F.col("exact_match").cast("int")).alias("exact_rate"),
        F.avg("token_precision").alias("mean_precision"),
        F.avg("token_recall").alias("mean_recall"),
        F.avg("token_f1").alias("mean_f1"),
        F.avg(F.col("is_trivial").cast("int")).alias("trivial_rate"),
    ]


def stratified_report(scored: DataFrame, strata: list[str]) -> DataFrame:
    """Overall and by each stratum in one pass: (stratum, value, n, rates, means).

    Missing values count as UNKNOWN. GROUPING SETS expand each row once per stratum
    before one partial aggregation; only groups are shuffled."""
    keyed = scored.select(*[F.coalesce(F.col(s).cast("string"), F.lit("UNKNOWN")).alias(s) for s in strata], "exact_match", "token_precision", "token_recall", "token_f1", "is_trivial")
    sets = [[], *[[F.col(s)] for s in strata]]
    grouped = keyed.groupingSets(sets, *[F.col(s) for s in strata]).agg(*rollup_columns(), F.grouping_id(*strata).alias("_g"))
    full = (1 << len(strata)) - 1
    label, value = F.lit("overall"), F.lit("all")
    for n, s in enumerate(strata):
        of = full & ~(1 << (len(strata) - 1 - n))
        label, value = F.when(F.col("_g") == of, s).otherwise(label), F.when(F.col("_g") == of, F.col(s)).otherwise(value)
    return grouped.select(label.alias("stratum"), value.alias("value"), "n", "exact_rate", "mean_precision", "mean_recall", "mean_f1", "trivial_rate")


def with_weight_bin(rows: DataFrame, weight: str = "quality_weight") -> DataFrame:
    return rows.withColumn("weight_bin", bins.unit_bin(F.col(weight)))


def attach_strata(rows: DataFrame, meta: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Columns of ``meta`` where the row has none of its own, else UNKNOWN."""
    renamed = meta.select(*key, *[F.col(c).alias(f"_m_{c}") for c in columns])
    joined = rows.join(renamed, key, "left")
    for c in columns:
        own = [F.col(c).cast("string")] if c in rows.columns else []
        joined = joined.withColumn(c, F.coalesce(*own, F.col(f"_m_{c}").cast("string"), F.lit("UNKNOWN")))
    return joined.drop(*[f"_m_{c}" for c in columns])


def fill_truth(rows: DataFrame, functions: DataFrame, key: list[str]) -> DataFrame:
    """The function's name where a row has no ground truth; matched on the whole key."""
    names_ = functions.select(*key, F.col("name").alias("_name"))
    return rows.join(names_, key, "left").withColumn("ground_truth", F.coalesce(F.nullif(F.col("ground_truth"), F.lit("")), F.col("_name"), F.lit(""))).drop("_name")
