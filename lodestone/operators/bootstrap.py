"""Bootstrap intervals whose draws any engine can repeat.

Draw i of resample r is the element at a position that a counter-based mix of (seed, r, i)
gives: no generator's state, so resamples and groups can be dealt to tasks at will and SQL
can draw the same. A group's sorted distinct values are cut into blocks by position, its
resamples into chunks; a task makes the draws of one chunk and sums up those that fall into
its block. It holds one block and ``PIECE`` draws, however large the group is. Running
counts come from a segmented scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import address, quantile, scan

SEED = 42
RESAMPLES = 10_000
#: Positions of a block, draws of a chunk, and draws held at once.
BLOCK, CHUNK, PIECE = 1 << 20, 200_000_000, 1 << 20
#: Constants of the mix: a prime modulus, two multipliers, two offsets and their step.
PRIME, FIRST, SECOND, STEP, OFFSET = (1 << 31) - 1, 1540483477, 1597334677, 7919, 104729


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> 15)) * FIRST % PRIME
    x = (x ^ (x >> 13)) * SECOND % PRIME
    return x ^ (x >> 16)


def mix_sql(x: str) -> str:
    """The mix of an integer expression as SQL."""
    once = f"(xor({x}, ({x}) >> 15) * {FIRST} % {PRIME})"
    return f"list_reduce([{once}, 13, 16], lambda a, s: CASE WHEN s = 13 THEN xor(a, a >> 13) * {SECOND} % {PRIME} ELSE xor(a, a >> 16) END)"


def positions(n: int, resample: int, first: int, last: int, seed: int = SEED) -> np.ndarray:
    """The places, from 0, of draws [first, last) of a resample of n elements."""
    s = int(_mix(np.array([(seed + resample * STEP + 1) % PRIME], np.int64))[0])
    t = _mix((np.arange(first, last, dtype=np.int64) + OFFSET) % PRIME)
    return _mix((s * (t | 1) + t) % PRIME) * n >> 31


def _pieces(n: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, PIECE):
        yield a, min(n, a + PIECE)


def _chunks(totals: DataFrame, resamples: int) -> DataFrame:
    """Each group's resamples in chunks: r_first, r_last."""
    size = F.greatest(F.lit(1), F.floor(F.lit(CHUNK) / F.greatest(F.col("_n"), F.lit(1)))).cast("int")
    sized = totals.withColumn("_size", F.least(size, F.lit(-(-resamples // 8))))  # eight tasks a group at least
    return sized.withColumn("r_first", F.explode(F.expr(f"sequence(0, {resamples - 1}, _size)"))).withColumn("r_last", F.least(F.col("r_first") + F.col("_size"), F.lit(resamples))).drop("_size")


def bootstrap_ci(rows: DataFrame, by: list[str], value: str, statistic: str = "mean", resamples: int = RESAMPLES, level: float = 0.95, seed: int = SEED) -> DataFrame:
    """(by, n, estimate, low, high): percentile interval of the mean or median of the values
    that are not null; null without any, and no interval below two. Groups have fewer than
    2^31 rows."""
    if statistic not in ("mean", "median"):
        raise ValueError(statistic)
    head = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    table = scan.dealt(counted, by, ["_v"])
    placed = scan.running(table, by, ["_v"], {"_upto": ("sum", F.col("_c"))}).withColumn("lo", F.col("_upto") - F.col("_c"))
    totals = table.groupBy(*by).agg(F.sum("_c").alias("_n"))
    chunks = _chunks(totals.filter("_n > 1"), resamples)

    if statistic == "mean":

        def draw(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("lo")
            starts, values = block["lo"].to_numpy(), block["_v"].to_numpy()
            low, high, n = starts[0], starts[-1] + block["_c"].iloc[-1], int(block["_n"].iloc[0])
            out = []
            for r in range(int(block["r_first"].iloc[0]), int(block["r_last"].iloc[0])):
                total = 0.0
                for a, z in _pieces(n):
                    at = positions(n, r, a, z, seed)
                    at = at[(at >= low) & (at < high)]
                    total += values[np.searchsorted(starts, at, "right") - 1].sum()
                out.append((*key[: len(by)], r, total))
            return pd.DataFrame(out, columns=[*by, "r", "s"])

        blocks = quantile.group_totals(placed, chunks, by, F.first("_n").alias("_n"), F.collect_list(F.struct("r_first", "r_last")).alias("_r"))
        blocks = blocks.withColumn("_block", F.floor(F.col("lo") / BLOCK)).withColumn("_r", F.explode("_r")).select(*by, "_block", "_v", "_c", "lo", "_n", "_r.*")
        drawn = blocks.groupBy(*by, "_block", "r_first").applyInPandas(lambda key, frame: draw((*key[: len(by)],), frame), f"{head}, r int, s double")
        found = quantile.group_totals(drawn.groupBy(*by, "r").agg(F.sum("s").alias("s")), totals, by, F.first("_n").alias("_n")).withColumn("x", F.col("s") / F.col("_n"))
        estimates = placed.groupBy(*by).agg((F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("estimate"))
    else:

        def middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for row in b.to_dict("records"):
                    n, out = int(row["_n"]), []
                    for r in range(int(row["r_first"]), int(row["r_last"])):
                        at = np.sort(np.concatenate([positions(n, r, a, z, seed) for a, z in _pieces(n)]))
                        out += [(*(row[k] for k in by), r, int(at[k])) for k in ((n - 1) // 2, n // 2)]
                    yield pd.DataFrame(out, columns=[*by, "r", "lo"])

        at = chunks.repartition(*by, "r_first").mapInPandas(middle, f"{head}, r int, lo bigint").withColumn("hi", F.col("lo") + 1)
        spans = placed.select(*by, "lo", F.col("_upto").alias("hi"), "_v")
        found = address.pairs(at, spans, by).groupBy(*by, "r").agg(F.avg("_v").alias("x"))
        estimates = rows.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.median(value).cast("double").alias("estimate"))

    ends = [50 * (1 - level) / 100, 50 * (1 + level) / 100]
    interval = found.groupBy(*by).agg(*[F.percentile("x", q).alias(name) for q, name in zip(ends, ("low", "high"), strict=True)])
    groups = rows.select(*by).distinct()
    for part in (totals.withColumnRenamed("_n", "n"), estimates, interval):
        named = part.withColumnsRenamed({k: f"_of_{k}" for k in by})
        same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by]
        groups = groups.join(named, same, "left").drop(*[f"_of_{k}" for k in by])
    return groups.select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "estimate", "low", "high")
