"""Statistics over scores. Ranks and sums are DataFrame work over counts of distinct
values; only tail probabilities, of one row per group, run in Python.

scipy isn't needed: tails come from the error function and the incomplete gamma
function. Signed-rank and rank-sum p-values are normal approximations with tie
correction (signed-rank without ties and n up to 25 is exact).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def average_ranks(rows: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Add the rank within the group, ties sharing their mean rank. For groups of rows that
    stay small; :func:`value_ranks` is for hot ones."""
    w = Window.partitionBy(*by)
    return rows.withColumn(out, F.rank().over(w.orderBy(value)) + (F.count("*").over(w.partitionBy(*by, value)) - 1) / 2)


def value_ranks(rows: DataFrame, by: list[str], value: str, *sums: Column) -> DataFrame:
    """One row per group and distinct value: ``ties`` (rows that have it), ``rank`` (their
    mean rank) and the given aggregates. Rows are counted before any window, so a group's
    window sees its distinct values only, however many rows it has."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("ties"), *sums)
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rank", F.coalesce(F.sum("ties").over(w), F.lit(0)) + (F.col("ties") + 1) / 2)


def _tie_term() -> Column:
    t = F.col("ties").cast("double")
    return F.sum(t * t * t - t)


def signed_ranks(rows: DataFrame, by: list[str], diff: str) -> DataFrame:
    """(by, n, w_plus, w_minus, tie_term) of the non-zero differences."""
    d = rows.filter((F.col(diff) != 0) & F.col(diff).isNotNull() & ~F.isnan(F.col(diff).cast("double"))).withColumn("_abs", F.abs(F.col(diff)))
    ranked = value_ranks(d, by, "_abs", F.count_if(F.col(diff) > 0).alias("_up"))
    plus, minus = F.col("_up") * F.col("rank"), (F.col("ties") - F.col("_up")) * F.col("rank")
    return ranked.groupBy(*by).agg(F.sum("ties").alias("n"), F.sum(plus).alias("w_plus"), F.sum(minus).alias("w_minus"), _tie_term().alias("tie_term"))


def rank_biserial(rows: DataFrame, by: list[str], diff: str) -> DataFrame:
    """(by, n, w_plus, w_minus, r) of the non-zero differences."""
    return signed_ranks(rows, by, diff).drop("tie_term").withColumn("r", (F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus")))


def holm(rows: DataFrame, by: list[str], p: str, out: str = "p_adjusted") -> DataFrame:
    """Step-down adjusted p-values: running maximum of (m - i + 1) p, at most 1."""
    w = Window.partitionBy(*by)
    i, m = F.row_number().over(w.orderBy(p)), F.count("*").over(w)
    stepped = rows.withColumn("_s", (m - i + 1) * F.col(p))
    return stepped.withColumn(out, F.least(F.lit(1.0), F.max("_s").over(w.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def kendall_w(rows: DataFrame, judge: str, item: str, value: str) -> DataFrame:
    """One row: judges, items and the coefficient of concordance of their ranks."""
    ranked = average_ranks(rows, [judge], value)
    sums = ranked.groupBy(item).agg(F.sum("rank").alias("s"), F.count("*").alias("m"))
    total = sums.agg(F.max("m").alias("judges"), F.count("*").alias("items"), F.sum("s").alias("a"), F.sum(F.col("s") * F.col("s")).alias("q"))
    s = F.col("q") - F.col("a") * F.col("a") / F.col("items")
    return total.select("judges", "items", (12 * s / (F.col("judges") * F.col("judges") * (F.col("items") * F.col("items") * F.col("items") - F.col("items")))).alias("w"))


def rank_sum(rows: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """(by, n1, n2, u, r): Mann-Whitney U of the flagged rows and 1 - 2U / (n1 n2)."""
    ranked = value_ranks(rows, by, value, F.count_if(F.col(flag)).alias("_in"), F.count_if(~F.col(flag)).alias("_out"))
    sums = ranked.groupBy(*by).agg(F.sum("_in").alias("n1"), F.sum("_out").alias("n2"), F.sum(F.col("_in") * F.col("rank")).alias("_r"))
    u = F.col("_r") - F.col("n1") * (F.col("n1") + 1) / 2
    return sums.withColumn("u", u).withColumn("r", 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))).drop("_r")


def slope(y: Column, x: Column) -> Column:
    return F.regr_slope(y, x)


def cohens_d(diff: Column) -> Column:
    """Mean over spread as IEEE divides them: infinite, or NaN for a mean of 0, without spread."""
    mean, spread = F.avg(diff), F.stddev_samp(diff)
    return F.when(spread == 0, mean * float("inf")).otherwise(F.try_divide(mean, spread))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function by its series."""
    if x <= 0:
        return 1.0
    term = total = 1.0 / a
    n = a
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_tail(x: float, df: int) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def signed_rank_tail(n: int, w: float, tie_term: float, greater: bool = True, exact: bool = True) -> float:
    """One-sided p of a signed-rank sum: by all signs for few ranks without ties, if ``exact``, else by the normal distribution."""
    if not n:
        return math.nan
    if exact and n <= 25 and not tie_term:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] += ways[:-k].copy()
        at = int(round(w))
        p = ways[at:].sum() if greater else ways[: at + 1].sum()
        return float(p / 2.0**n)
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
    z = (w - n * (n + 1) / 4) / sd if sd else 0.0
    return normal_tail(z if greater else -z)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) or a != a else chi2_tail(float(a), int(d)) for a, d in zip(x, df, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return pd.Series([2 * normal_tail(abs(float(v))) for v in z], dtype=float)


def wilcoxon_test(rows: DataFrame, by: list[str], diff: str, greater: bool = True, exact: bool = True) -> DataFrame:
    """(by, n, w_plus, z, p): one-sided; z is null where ties make no spread. Without ``exact``, p is always that of z."""

    @F.pandas_udf(T.DoubleType())
    def tail(n: pd.Series, w: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([signed_rank_tail(int(a), float(b), float(c), greater, exact) for a, b, c in zip(n, w, t, strict=True)], dtype=float)

    sums = rows.select(*by).distinct().join(signed_ranks(rows, by, diff), by, "left").na.fill(0, ["n", "tie_term"])
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    z = F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread)
    return sums.select(*by, "n", "w_plus", z.alias("z"), tail("n", F.coalesce("w_plus", F.lit(0.0)), "tie_term").alias("p"))


def friedman_test(rows: DataFrame, by: list[str], block: str, treatment: str, value: str) -> DataFrame:
    """(by, n, chi2, p, w): chi-square over complete blocks (those with all treatments of the
    group; several values of a cell count by their mean), its p and Kendall's W."""
    cells = rows.groupBy(*by, block, treatment).agg(F.avg(value).alias("_v")).filter("_v IS NOT NULL")
    k = cells.groupBy(*by).agg(F.count_distinct(treatment).alias("_k"))
    own = Window.partitionBy(*by, block)
    full = cells.join(k, by).withColumn("_m", F.count("*").over(own)).filter("_m = _k")
    ranked = average_ranks(full, [*by, block], "_v").withColumn("_t", F.count("*").over(Window.partitionBy(*by, block, "_v")))
    # a value that t of a block have adds t^3 - t to the ties, t rows of t^2 - 1
    parts = ranked.groupBy(*by, treatment).agg(F.sum("rank").alias("_s"), F.sum(F.col("_t") * F.col("_t") - 1).alias("_ties"), F.count("*").alias("_n"), F.max("_k").alias("_k"))
    sums = parts.groupBy(*by).agg(F.max("_n").alias("n"), F.max("_k").alias("k"), F.sum(F.col("_s") * F.col("_s")).alias("_q"), F.sum("_ties").cast("double").alias("_ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    fair = 1 - F.col("_ties") / (n * k * (k * k - 1))
    chi2 = F.when((n >= 2) & (k >= 2) & (fair != 0), (12 / (n * k * (k + 1)) * F.col("_q") - 3 * n * (k + 1)) / fair)
    out = rows.select(*by).distinct().join(sums.withColumn("chi2", chi2), by, "left")
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "chi2", chi2_p("chi2", F.coalesce("k", F.lit(2)) - 1).alias("p"), (F.col("chi2") / (n * (k - 1))).alias("w"))


def _group_ranks(rows: DataFrame, by: list[str], group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rank sums per (by, group), and (by, _n, _groups, _ties) over the whole, from counts of
    the distinct values."""
    counts = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("_c"))
    ties = counts.groupBy(*by, value).agg(F.sum("_c").alias("ties"))
    w = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = ties.withColumn("rank", F.coalesce(F.sum("ties").over(w), F.lit(0)) + (F.col("ties") + 1) / 2)
    parts = counts.join(ranks, [*by, value]).groupBy(*by, group).agg(F.sum(F.col("_c") * F.col("rank")).alias("_s"), F.sum("_c").alias("_m"))
    whole = ranks.groupBy(*by).agg(F.sum("ties").cast("double").alias("_n"), _tie_term().alias("_ties"))
    return parts, whole


def kruskal_test(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, n, h, p, epsilon2): H with tie correction, its p and epsilon squared."""
    parts, whole = _group_ranks(rows, by, group, value)
    sums = parts.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("_q"), F.count("*").alias("_k")).join(whole, by)
    n = F.col("_n")
    fair = 1 - F.col("_ties") / (n * n * n - n)
    h = F.when((n >= 3) & (F.col("_k") >= 2) & (fair != 0), (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / fair)
    out = rows.select(*by).distinct().join(sums.withColumn("h", h), by, "left")
    return out.select(*by, F.coalesce(n, F.lit(0)).cast("long").alias("n"), "h", chi2_p("h", F.coalesce("_k", F.lit(2)) - 1).alias("p"), (F.col("h") / (n - 1)).alias("epsilon2"))


def dunn_test(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """(by, group_a, group_b, z, p): pairs of groups after a Kruskal-Wallis test, p two-sided
    and not adjusted. Pairs are of a group's few rank sums."""
    parts, whole = _group_ranks(rows, by, group, value)
    mean = parts.select(*by, F.col(group).cast("string").alias("g"), (F.col("_s") / F.col("_m")).alias("mean"), F.col("_m").alias("m"))
    a, b = (mean.select(*by, *[F.col(c).alias(f"{c}_{x}") for c in ("g", "mean", "m")]) for x in "ab")
    pairs = a.join(b, by).filter("g_a < g_b").join(whole, by)
    n = F.col("_n")
    spread = n * (n + 1) / 12 - F.col("_ties") / (12 * F.greatest(n - 1, F.lit(1.0)))
    sd = F.sqrt(spread * (1 / F.col("m_a") + 1 / F.col("m_b")))
    pairs = pairs.withColumn("z", F.when(sd > 0, (F.col("mean_a") - F.col("mean_b")) / sd).otherwise(0.0))
    return pairs.select(*by, F.col("g_a").alias("group_a"), F.col("g_b").alias("group_b"), "z", two_sided_p("z").alias("p"))
