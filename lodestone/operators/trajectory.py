"""Functions followed over the ordered levels O0..O3: cohorts, hops, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantile, scan

OPTS = ["O0", "O1", "O2", "O3"]
TIER_RANK = {"GOLD": 3, "SILVER": 2, "BRONZE": 1}
ABSENT = "—"


def paired_cohort(rows: DataFrame, by: list[str], key: str, opts: list[str] = OPTS) -> DataFrame:
    """Rows whose key occurs at all levels, per group: one aggregation and a semi join
    instead of a chain of intersections."""
    mine = rows.filter(F.col("opt").isin(*opts))
    full = mine.groupBy(*by, key).agg(F.count_distinct("opt").alias("_n")).filter(F.col("_n") == len(opts))
    return mine.join(full, [*by, key], "left_semi")


def wide_by_opt(rows: DataFrame, keys: list[str], value: str, opts: list[str] = OPTS) -> DataFrame:
    """One column per level with the mean of the value."""
    return rows.groupBy(*keys).pivot("opt", opts).agg(F.avg(value))


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a stable key: none that is null, empty or a sentinel."""
    return rows.filter((F.coalesce(key, F.lit("")) != "") & ~F.startswith(key, F.lit("_unstable")))


def cohort_coverage(rows: DataFrame, by: list[str], key: str, opts: list[str] = OPTS) -> DataFrame:
    """Per group: keys, those at all levels, those at all levels but the first, and both
    shares. Levels of a key are counted once, then keys: two aggregations."""
    has = [F.max((F.col("opt") == o).cast("int")).alias(f"_{o}") for o in opts]
    per = _keyed(rows, key).groupBy(*by, key).agg(*has)
    late = sum((F.col(f"_{o}") for o in opts[1:]), F.lit(0)) == len(opts) - 1
    full = late & (F.col(f"_{opts[0]}") == 1)
    out = per.groupBy(*by).agg(F.count("*").alias("total_keys"), F.count_if(full).alias("full_cohort"), F.count_if(late).alias("late_cohort"))
    return out.withColumns({"full_coverage": F.col("full_cohort") / F.col("total_keys"), "late_coverage": F.col("late_cohort") / F.col("total_keys")})


def tier_hopping(rows: DataFrame, key: str) -> DataFrame:
    """One row: stable keys, and those that have more than one tier."""
    per = _keyed(rows, key).groupBy(key).agg(F.count_distinct("tier").alias("n"))
    return per.agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_multi_tier"))


def tier_cohort(rows: DataFrame, by: list[str], key: str, value: str, tier: str = "BRONZE", opts: tuple[str, ...] = ("O1", "O2", "O3"), least: int = 3) -> DataFrame:
    """Per group: keys of the tier at the first level, those of them at all levels, whether
    they are enough, how many have another tier at the last level, and the mean change of
    the value from the first to the last. Groups without such a key are left out."""
    first, last = opts[0], opts[-1]
    at = lambda o: F.col("opt") == o
    tier_at = lambda o: F.min(F.when(at(o), F.col("tier")))
    per = _keyed(rows, key).groupBy(*by, key).agg(
        F.max((at(first) & (F.col("tier") == tier)).cast("int")).alias("_in"), F.count_distinct(F.when(F.col("opt").isin(*opts), F.col("opt"))).alias("_levels"),
        (tier_at(first) != tier_at(last)).alias("_hopped"), (F.avg(F.when(at(first), F.col(value))) - F.avg(F.when(at(last), F.col(value)))).alias("_delta"),
    )
    paired = (F.col("_in") == 1) & (F.col("_levels") == len(opts))
    out = per.groupBy(*by).agg(F.count_if(F.col("_in") == 1).alias("n_tier"), F.count_if(paired).alias("n_paired"), F.count_if(paired & F.coalesce("_hopped", F.lit(False))).alias("n_hopped"), F.avg(F.when(paired, F.col("_delta"))).alias("mean_delta"))
    return out.filter("n_tier > 0").withColumn("enough", F.col("n_paired") >= least)


def majority_tiers(rows: DataFrame, key: str, opts: list[str] = OPTS) -> DataFrame:
    """(key, tier_O0, ...): the most frequent tier of a key at each level, the smallest of
    equally frequent ones; null where the key has none. Tiers are counted before they are
    compared, so a hot key is a few counts."""
    counts = rows.filter(F.col("tier").isNotNull()).groupBy(key, "opt", "tier").agg(F.count("*").alias("n"))
    best = counts.groupBy(key, "opt").agg(F.min_by("tier", F.struct(-F.col("n"), F.col("tier"))).alias("tier"))
    wide = best.groupBy(key).pivot("opt", opts).agg(F.first("tier"))
    return wide.select(key, *[F.col(o).alias(f"tier_{o}") for o in opts])


def trajectories(rows: DataFrame, key: str, models: list[str], value: str, opts: list[str] = OPTS) -> DataFrame:
    """Majority tiers of each key, its tier changes, and every model's value by level
    (f1_<model>_<opt>): one pivot over (model, level) and one left join."""
    tiers = majority_tiers(rows, key, opts)
    mean = rows.filter(F.col("model").isin(*models)).groupBy(key, "model", "opt").agg(F.avg(value).alias("v"))
    cells = [F.max(F.when((F.col("model") == m) & (F.col("opt") == o), F.col("v"))).alias(f"f1_{m}_{o}") for m in models for o in opts]
    wide = mean.groupBy(key).agg(*cells)
    held = F.array_compact(F.array(*[F.col(f"tier_{o}") for o in opts]))
    steps = F.aggregate(F.sequence(F.lit(1), F.lit(len(opts))), F.lit(0), lambda n, i: n + F.coalesce((F.try_element_at(held, i) != F.try_element_at(held, i + 1)).cast("int"), F.lit(0)))
    ever = F.exists(held, lambda t: t == "BRONZE")
    return tiers.withColumns({"n_opts_present": F.size(held), "tier_changes": steps, "ever_bronze": ever}).join(wide, key, "left")


def failure_rates(rows: DataFrame, models: str, trivial: str, ok: str, opts: list[str] = OPTS) -> DataFrame:
    """Per model and for each level, percent of trivial predictions and of answers that
    could not be parsed; null where the model has no row."""
    cells = []
    for o in opts:
        at = F.col("opt") == o
        cells += [(100 * F.avg(F.when(at, F.col(trivial).cast("int")))).alias(f"trivial_{o}"), (100 * F.avg(F.when(at, (~F.col(ok)).cast("int")))).alias(f"parse_failure_{o}")]
    return rows.groupBy(models).agg(*cells)


def one_per_level(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each (key, level) in the given order."""
    w = Window.partitionBy(key, "opt").orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def tier_changes(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_levels, n_changes) between neighbouring levels that have a tier."""
    w = Window.partitionBy(key).orderBy("opt")
    before = F.lag("tier").over(w)
    steps = rows.filter(F.col("tier").isNotNull()).withColumn("_c", (before.isNotNull() & (before != F.col("tier"))).cast("int"))
    return steps.groupBy(key).agg(F.count("*").alias("n_levels"), F.sum("_c").alias("n_changes"))


def signatures(rows: DataFrame, key: str, opts: list[str] = OPTS) -> DataFrame:
    """(key, signature): tiers over the levels, with a dash where there is none."""
    wide = rows.groupBy(key).pivot("opt", opts).agg(F.max("tier"))
    return wide.select(key, F.concat_ws(" → ", *[F.coalesce(F.nullif(F.col(o), F.lit("")), F.lit(ABSENT)) for o in opts]).alias("signature"))


def signature_coverage(sigs: DataFrame, top: int) -> DataFrame:
    """The most frequent signatures with their cumulative share in percent."""
    counts = sigs.groupBy("signature").agg(F.count("*").alias("n"))
    first = counts.orderBy(F.desc("n"), "signature").limit(top)
    w = Window.orderBy(F.desc("n"), "signature")  # over the first ones only
    run = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.broadcast(counts.agg(F.sum("n").alias("_all")))  # one row
    return first.withColumns({"place": F.row_number().over(w), "_run": run}).crossJoin(total).withColumn("coverage", F.lit(100.0) * F.col("_run") / F.col("_all")).drop("_run", "_all")


def transition_types(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Steps to the next level of a key: stable, up or down by tier, and the change."""
    rank = F.coalesce(*[F.when(F.col("tier") == t, F.lit(r)) for t, r in TIER_RANK.items()], F.lit(0))
    w = Window.partitionBy(key).orderBy("opt")
    steps = rows.withColumn("_r", rank).withColumns({"next_opt": F.lead("opt").over(w), "_next": F.lead("_r").over(w), "delta": F.lead(value).over(w) - F.col(value)}).filter("next_opt IS NOT NULL")
    kind = F.when(F.col("_next") == F.col("_r"), "stable").when(F.col("_next") < F.col("_r"), "down").otherwise("up")
    return steps.select(key, "opt", "next_opt", kind.alias("kind"), "delta")


def tier_matrix(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(tier_a, tier_b, n, percent of tier_a) over all tiers and absent: the mode of a
    key's tiers per level, the smallest of equals."""
    labels = ["GOLD", "SILVER", "BRONZE", "absent"]
    mode = rows.filter(F.col("opt").isin(a, b) & (F.coalesce("tier", F.lit("")) != "")).groupBy(key, "opt").agg(F.mode("tier", True).alias("tier"))
    wide = mode.groupBy(key).pivot("opt", [a, b]).agg(F.first("tier")).select(F.coalesce(F.col(a), F.lit("absent")).alias("tier_a"), F.coalesce(F.col(b), F.lit("absent")).alias("tier_b"))
    spark = rows.sparkSession
    grid = spark.createDataFrame([(x, y) for x in labels for y in labels], "tier_a string, tier_b string")
    counts = F.broadcast(grid).join(wide.groupBy("tier_a", "tier_b").agg(F.count("*").alias("n")), ["tier_a", "tier_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("tier_a"))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / F.greatest(total, F.lit(1)))


def consensus(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation and their ratio over the models of a key, two at least."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).filter("n >= 2")
    return out.withColumn("cv", F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")))


def ecdf(rows: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Add i / n, ties of a value in the order of ``tie``; a group is run over in stretches."""
    order = [value, tie]
    table = scan.dealt(rows, by, order)
    placed = scan.running(table, by, order, {"_i": ("sum", F.lit(1))})
    return quantile.group_totals(placed, table, by, F.count("*").alias("_n")).withColumn("ecdf", F.col("_i") / F.col("_n")).drop("_i", "_n", scan.PART)


def direction_counts(wide: DataFrame, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """Zero-inflation and direction: keys with no score at all, and of the others those
    degraded, improved and unchanged."""
    zero = F.greatest(F.col(a), F.col(b)) <= eps
    d = F.col(b) - F.col(a)
    return wide.agg(F.count("*").alias("n"), F.count_if(zero).alias("n_zero"), F.count_if(~zero & (d < 0)).alias("n_degraded"), F.count_if(~zero & (d > 0)).alias("n_improved"), F.count_if(~zero & (d == 0)).alias("n_unchanged"))
