"""The four kinds of quantile; they differ, so none stands in for another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan


def _counted(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, _upto, _n): distinct values with how many rows are at most theirs, and the
    group's rows. Rows are counted by value first; counts are summed by stretches, so a group
    may have any number of values."""
    counts = scan.dealt(rows.groupBy(*by, value).agg(F.count("*").alias("_c")), by, [value])
    upto = scan.running(counts, by, [value], {"_upto": ("sum", F.col("_c"))})
    return group_totals(upto, counts, by, F.sum("_c").alias("_n")).select(*by, value, "_upto", "_n")


def group_totals(rows: DataFrame, of: DataFrame, by: list[str], *totals: Column) -> DataFrame:
    """``rows`` with totals of their groups; null is a group of its own."""
    names = [f"_key_{k}" for k in by]
    sums = of.groupBy(*[F.col(k).alias(n) for k, n in zip(by, names, strict=True)]).agg(*totals)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names, strict=True)]
    return rows.join(sums, same).drop(*names)


def nearest_rank(rows: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Element floor(q n), at most n - 1, of the sorted values (0-based); columns
    p25-like per q: the least value with more rows up to it than that."""
    counted = _counted(rows.filter(F.col(value).isNotNull()), by, value)
    at = lambda q: F.least(F.floor(F.lit(q) * F.col("_n")), F.col("_n") - 1)
    return counted.groupBy(*by).agg(*[F.coalesce(F.min(F.when(F.col("_upto") > at(q), F.col(value))), F.lit(0)).cast("double").alias(f"p{round(q * 100)}") for q in qs])


def linear(value: Column, q: float) -> Column:
    """Linear interpolation between the neighbours of (n - 1) q."""
    return F.percentile(value, q)


def exclusive_p90(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, p90): interpolation at 0.9 (n + 1), clamped to the ends; one value: itself;
    none: 0."""
    counted = _counted(rows.filter(F.col(value) > 0), by, value)
    # in tenths: 9 (n + 1) = 10 j + rest; elements j and j + 1, from 1 on
    j = F.greatest(F.lit(1), F.least(F.expr("9 * (_n + 1) div 10"), F.col("_n") - 1))
    rest = 9 * (F.col("_n") + 1) - 10 * j
    element = lambda i: F.min(F.when(F.col("_upto") >= i, F.col(value)))
    parts = counted.groupBy(*by).agg(F.max("_n").alias("_n"), element(j).alias("_a"), element(j + 1).alias("_b"))
    found = parts.select(*by, F.when(F.col("_n") == 1, F.col("_a").cast("double")).otherwise((F.col("_a") * (10 - rest) + F.col("_b") * rest) / 10).alias("p90"))
    return rows.select(*by).distinct().join(found, by, "left").withColumn("p90", F.coalesce("p90", F.lit(0.0)))


def median(value: Column) -> Column:
    return F.median(value)
