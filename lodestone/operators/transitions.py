"""The same function at two levels: full outer join on a stable key, and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, policy

TARGETABLE = ("MATCH", "AMBIGUOUS", "NO_MATCH")
KEYS = ["test_case", "name", "decl_file", "decl_line", "decl_column"]


def stable_key() -> tuple[Column, Column]:
    """(key, quality): HIGH with a column, MEDIUM without, null and UNRESOLVED without a
    place in a file."""
    placed = F.col("decl_file").isNotNull() & F.col("decl_line").isNotNull()
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.when(placed, F.concat_ws("|", said("test_case"), said("decl_file"), said("decl_line"), said("decl_column"), names.normalised(F.coalesce("name", F.lit("")))))
    return key, F.when(~placed, "UNRESOLVED").when(F.col("decl_column").isNull(), "MEDIUM").otherwise("HIGH")


def transitions(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row per function seen at level ``a`` or ``b``: verdicts (ABSENT where it isn't),
    overlaps, their change, whether it is dropped, and the transition's label.

    Functions without a stable key match nothing. Of several rows of one identity the
    worst overlap stays; ids break ties."""
    key, quality = stable_key()
    sides = []
    for opt, s in ((a, "a"), (b, "b")):
        side = rows.filter(F.col("opt") == opt).withColumn("_mk", key).select(
            F.coalesce("_mk", F.concat(F.lit(f"_unresolved_{s}_"), F.col("function_id").cast("string"))).alias("_mk"),
            *[F.col(k).alias(f"{k}_{s}") for k in KEYS], F.col("verdict").alias(f"verdict_{s}"), F.col("overlap").alias(f"overlap_{s}"), F.col("gap").alias(f"gap_{s}"), F.col("function_id").alias(f"id_{s}"),
        )
        sides.append(side)
    joined = sides[0].join(sides[1], "_mk", "full_outer")
    ident = {k: F.coalesce(f"{k}_a", f"{k}_b") for k in KEYS}
    merged = joined.select(*[c.alias(k) for k, c in ident.items()], *[F.coalesce(f"verdict_{s}", F.lit("ABSENT")).alias(f"verdict_{s}") for s in "ab"], "overlap_a", "overlap_b", "gap_a", "gap_b", "id_a", "id_b")
    w = Window.partitionBy(*KEYS).orderBy(F.col("overlap_a").asc_nulls_first(), F.col("overlap_b").asc_nulls_first(), F.col("id_a").asc_nulls_first(), F.col("id_b").asc_nulls_first())
    one = merged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    gone = ~F.col("verdict_b").isin(*TARGETABLE)
    return one.withColumns(
        {
            "key_quality": quality,
            "delta_overlap": F.col("overlap_b") - F.col("overlap_a"),
            "delta_gap": F.col("gap_b") - F.col("gap_a"),
            "dropped": F.col("verdict_a").isin(*TARGETABLE) & gone,
            "transition": F.concat("verdict_a", F.lit("→"), "verdict_b"),
        }
    )


def transition_matrix(t: DataFrame, verdicts: list[str]) -> DataFrame:
    """Counts of verdict_a (rows) by verdict_b (columns); rows without any are absent."""
    return t.groupBy("verdict_a").pivot("verdict_b", verdicts).agg(F.count(F.lit(1))).na.fill(0)


def with_fragility(t: DataFrame) -> DataFrame:
    appeared = (F.col("verdict_a") == "ABSENT") & F.col("delta_overlap").isNull()
    score = F.when(F.col("delta_overlap").isNotNull(), F.col("delta_overlap")).when(F.col("dropped") | appeared, policy.fragility(F.col("dropped"), appeared, F.col("overlap_a"), F.col("overlap_b")))
    return t.withColumn("fragility", score).withColumn("severity", F.when(F.col("dropped"), "dropped").otherwise(policy.severity(F.col("fragility"))))
