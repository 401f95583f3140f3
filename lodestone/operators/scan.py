"""Running values over ordered groups of any size.

Rows are dealt by range over (group, order), so a group that holds all rows still spreads
over all tasks. Each task runs over its own stretch of a group; one total for each
stretch is carried over to the stretches behind it. Only these totals, as many as a group
has stretches, meet in a window.

Any associative operation works so; there are sums, running maxima and the last value that
is not null. ``order`` should tell all rows of a group apart: rows that tie in it are
taken in any order, and they are not split over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

PART = "_part"
#: Groups are counted by buckets of their hashes; those of a bucket with more than MOST rows do not meet in one task.
BUCKETS, MOST = 65_536, 100_000
_AGGREGATES = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}


def bucket(by: list[str]) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(BUCKETS)).cast("int")


def apart(rows: DataFrame, by: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups that a task can hold, and those of buckets with more than ``most`` rows, if there are any."""
    counted = rows.groupBy(bucket(by).alias("_b")).count().filter(F.col("count") > most)
    full = [r["_b"] for r in counted.collect()]  # at most BUCKETS
    return (rows.filter(~bucket(by).isin(full)), rows.filter(bucket(by).isin(full))) if full else (rows, None)


def dealt(rows: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with the number of their stretch, ``_part``. They are written to the shared
    folder, so that every use sees the same stretches."""
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch(spark, "scan")
    rows.repartitionByRange(n, *by, *order).withColumn(PART, F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def running(rows: DataFrame, by: list[str], order: list[str], values: dict[str, tuple[str, Column]], before: bool = False) -> DataFrame:
    """Add running values to rows that :func:`dealt` has dealt: {name: (operation, value)},
    over a group's rows up to each one, or ``before`` it. ``_part`` stays for further runs."""
    inside = Window.partitionBy(PART, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = rows.withColumns({name: _AGGREGATES[op](value).over(inside) for name, (op, value) in values.items()})
    # "last" needs a stretch's order in its total, too
    total = lambda op, value: F.max_by(value, F.when(value.isNotNull(), F.struct(*order))) if op == "last" else _AGGREGATES[op](value)
    totals = rows.groupBy(*by, PART).agg(*[total(op, value).alias(f"_{name}") for name, (op, value) in values.items()])
    ahead = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, PART]
    offsets = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[_AGGREGATES[op](f"_{name}").over(ahead).alias(f"_{name}") for name, (op, _) in values.items()])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    joined = local.join(offsets, same)
    both = {
        "sum": lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(b, a),
    }
    return joined.withColumns({name: both[op](F.col(f"_{name}"), F.col(name)) for name, (op, _) in values.items()}).select(*rows.columns, *values)


def merge_ranges(rows: DataFrame, by: list[str], lo: str = "lo", hi: str = "hi", most: int = MOST) -> DataFrame:
    """(by, lo, hi): half-open ranges of a group joined where they overlap or touch; empty ones
    are left out. Groups that a task can hold are dealt by group, once; the others run by stretches."""
    order = [lo, hi]
    small, large = apart(rows.filter(F.col(hi) > F.col(lo)).select(*by, lo, hi), by, most)
    w = Window.partitionBy(*by).orderBy(*order)
    reached = small.withColumn("_reached", F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("_reached").isNull() | (F.col(lo) > F.col("_reached"))
    starts = reached.withColumn("_from", F.last(F.when(fresh, F.col(lo)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if large is not None:
        table = dealt(large.distinct(), by, order)
        reached = running(table, by, order, {"_reached": ("max", F.col(hi))}, before=True)
        far = running(reached.withColumn("_start", F.when(fresh, F.col(lo))), by, order, {"_from": ("last", F.col("_start"))})
    merged = lambda runs: runs.groupBy(*by, "_from").agg(F.max(hi).alias(hi))
    joined = merged(starts) if large is None else merged(starts).unionByName(merged(far))
    return joined.withColumnRenamed("_from", lo).select(*by, lo, hi)
