"""Connected components of a graph whose links are a distributed table.

Large-star and small-star steps alternate until nothing changes (Kiveris et al.,
"Connected Components in MapReduce and Beyond", 2014). Each step's links are
written to the shared folder, so lineage stays short; only two numbers per step
reach the driver. A hub's links are dealt to ``SALTS`` groups, and the minimum
goes to each group by a join on (node, salt): no task needs all links of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise

SALTS = 16


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with ``m``, the least of u and of the v of u."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.least(F.min("m"), F.col("u")).alias("m"), F.collect_set("s").alias("s"))
    return salted.join(least.select("u", "m", F.explode("s").alias("s")), ["u", "s"])


def with_least(rows: DataFrame, group: str, value: str, out: str, by: str) -> DataFrame:
    """Add ``out``, the least ``value`` of a row's group. A group's rows are dealt to SALTS
    tasks by ``by``; no task needs all of them."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(group, "_s").agg(F.min(value).alias("_m"))
    least = parts.groupBy(group).agg(F.min("_m").alias(out), F.collect_set("_s").alias("_s"))
    return salted.join(least.select(group, out, F.explode("_s").alias("_s")), [group, "_s"]).drop("_s")


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable, for every node with a link."""
    pairs = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct()
    current = materialise(pairs, "links")
    state = None
    while True:  # each round that changes anything lowers a label, so it ends
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _with_least(large)
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = materialise(new, "links")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(current)
        current = new
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
