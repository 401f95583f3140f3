"""Alignment of compiled functions with source functions by shared line evidence.

An inverted index instead of a nested loop: source spans are expanded to lines and
mapped to their origins once, then joined with the evidence on (file, line).

Spans with the same origins are one class, and so are functions with the same evidence: a
header's function that many units include is one row in the join, however many copies of it
meet. Pairs are formed of classes; candidates, near ties and repeated contexts are counted by
class sizes, so all counts are those of all pairs. Lines that more than ``split`` rows of a
side share are dealt to several tasks.

Evidence is shuffled by function, by its digest, by line and, once joined, by class again, as
plain numbers: a class of functions goes by its smallest id, and a class of spans by its place
in the order of ranking, so that pairs carry nothing else of their spans. Names and contexts are
joined to a function's best class and its near ties only.

All joins but those with hot lines are hinted as sort-merge joins: each side grows with the input,
and the planner takes packed columns of small files for tables that the driver could broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.policy import PROFILE, Profile
from ..sources.scratch import kept
from . import scan
from .address import join_dealt

SPLIT = 100_000


class Classes(NamedTuple):
    """functions: function_id, fkey, total; spans: ts_id, ckey, tu, start_byte, span, context_hash; best:
    ckey, n, ts_id, tu, context_hash of a class's first span; pairs: fkey, ckey, n, overlap, total, of all
    classes that share a line. ckey follows the order of first spans."""

    functions: DataFrame
    spans: DataFrame
    best: DataFrame
    pairs: DataFrame


def evidence(line_rows: DataFrame) -> DataFrame:
    """The multiset of (file, line) per function."""
    return line_rows.groupBy("function_id", "file", "line").agg(F.sum("cnt").alias("cnt"))


def span_origins(spans: DataFrame, origins: DataFrame) -> DataFrame:
    """(ts_id, file, line), distinct: the origins of a source function's lines."""
    lines = spans.select("ts_id", "tu", F.explode(F.sequence("start_line", "end_line")).alias("i_line"))
    return lines.join(origins.hint("merge"), ["tu", "i_line"]).select("ts_id", "file", "line").distinct()


def _digest(rows: str) -> Column:
    return F.unhex(F.sha2(F.to_json(rows), 256))


def _listed(rows: DataFrame, of: str, columns: list[str], *more: Column) -> DataFrame:
    """(of, _rows, _digest, *more): the rows of each one. One function's or span's rows meet in a list, never those of several."""
    return rows.repartition(of).groupBy(of).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_rows"), *more).withColumn("_digest", _digest("_rows"))


def classes(ev: DataFrame, spans: DataFrame, origins: DataFrame, split: int = SPLIT) -> Classes:
    # a class's rows stay with its smallest id
    listed = _listed(ev.filter("cnt > 0 AND function_id IS NOT NULL"), "function_id", ["file", "line", "cnt"], F.sum("cnt").alias("total"))
    least = listed.withColumn("fkey", F.min("function_id").over(Window.partitionBy("_digest")))
    functions = kept(least.select("function_id", "fkey", "total", F.when(F.col("function_id") == F.col("fkey"), F.col("_rows")).alias("_rows")), "functions")
    firsts = functions.filter("_rows IS NOT NULL")
    lines = firsts.select("fkey", F.inline("_rows"))

    member = ["span", "tu", "start_byte", "ts_id", "context_hash"]
    meta = spans.select("ts_id", "tu", "start_byte", (F.col("end_byte") - F.col("start_byte")).alias("span"), "context_hash")
    placed = kept(meta.join(_listed(span_origins(spans, origins), "ts_id", ["file", "line"]).hint("merge"), "ts_id"), "spans")
    first = placed.groupBy("_digest").agg(F.count("*").alias("n"), F.min(F.struct(*member)).alias("m"), F.first("_rows").alias("_rows")).select("_digest", "n", "m.*", "_rows")
    best = scan.running(scan.dealt(first, [], member[:4]), [], member[:4], {"ckey": ("sum", F.lit(1))})
    places = best.select("ckey", "n", F.inline("_rows"))

    # a function's pairs meet in one task, for their sums, the totals and the ranking
    shared = join_dealt(lines, places, ["file", "line"], split).select("fkey", "ckey", "n", "cnt").repartition("fkey").groupBy("fkey", "ckey", "n").agg(F.sum("cnt").alias("overlap"))
    pairs = shared.join(firsts.select("fkey", "total").hint("merge"), "fkey")
    return Classes(functions.drop("_rows"), placed.join(best.select("_digest", "ckey").hint("merge"), "_digest").drop("_digest", "_rows"), best.select("ckey", "n", "ts_id", "tu", "context_hash"), pairs)


def _measured(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("ratio", F.bround(F.col("overlap") / F.col("total"), 6)).withColumn("gap", F.col("total") - F.col("overlap"))


def candidates(c: Classes) -> DataFrame:
    """(function_id, ts_id, overlap, total, ratio, ...) of all pairs that share a line: as many
    rows as there are pairs. What follows works on classes."""
    pairs = c.pairs.drop("n", "total").join(c.functions.hint("merge"), "fkey").drop("fkey")
    return _measured(pairs.join(c.spans.hint("merge"), "ckey").drop("ckey"))


def rank(c: Classes, p: Profile = PROFILE) -> DataFrame:
    """Best candidate per function: higher ratio, more evidence, shorter span, then unit
    and place. With the function's total, n_candidates, n_ties (within the tolerance of the best
    ratio) and whether a tie repeats the best one's context in another unit."""
    w = Window.partitionBy("fkey").orderBy(F.desc("ratio"), F.desc("overlap"), "ckey")
    ranked = _measured(c.pairs).withColumn("b", F.first(F.struct("ckey", "overlap", "ratio", "gap")).over(w))
    tie = F.abs(F.col("ratio") - F.col("b.ratio")) <= p.tie_epsilon
    other = tie & ((F.col("ckey") != F.col("b.ckey")) | (F.col("n") > 1))
    tops = ranked.groupBy("fkey").agg(
        F.first("b").alias("b"), F.sum("n").alias("n_candidates"), (F.sum(F.when(tie, F.col("n")).otherwise(0)) - 1).alias("n_ties"), F.collect_list(F.when(other, F.col("ckey"))).alias("_ties")
    )
    tops = kept(tops.select("fkey", F.col("b.ckey").alias("_best"), "b.overlap", "b.ratio", "b.gap", "n_candidates", "n_ties", "_ties"), "tops")
    # whether a class repeats the best one's context depends on the two classes only
    ties = tops.select("fkey", "_best", F.explode("_ties").alias("ckey"))
    copies = c.spans.groupBy("ckey", "context_hash").agg(F.min("tu").alias("_low"), F.max("tu").alias("_high"))
    own = c.best.select(F.col("ckey").alias("_best"), F.col("tu").alias("_tu"), "context_hash")
    met = ties.select("_best", "ckey").distinct().join(own.hint("merge"), "_best").join(copies.hint("merge"), ["ckey", "context_hash"])
    copied = met.filter("_low <> _tu OR _high <> _tu").select("_best", "ckey")
    replicated = ties.join(copied.hint("merge"), ["_best", "ckey"]).select("fkey").distinct().withColumn("replicated", F.lit(True))
    named = tops.drop("_ties").join(c.best.select(F.col("ckey").alias("_best"), "ts_id", "tu").hint("merge"), "_best")
    rows = c.functions.join(named.hint("merge"), "fkey").join(replicated.hint("merge"), "fkey", "left")
    return rows.select("function_id", "total", F.struct("ts_id", "tu", "overlap", "ratio", "gap").alias("b"), "n_candidates", "n_ties", F.coalesce("replicated", F.lit(False)).alias("replicated"))


def align(targets: DataFrame, ev: DataFrame, spans: DataFrame, origins: DataFrame, p: Profile = PROFILE) -> DataFrame:
    """Verdict and reasons for each target (function_id, multi_file); one row each."""
    c = classes(ev, spans, origins)
    totals = c.functions.select("function_id", F.col("total").alias("_total"))
    best = rank(c, p).drop("total")
    rows = targets.join(totals.hint("merge"), "function_id", "left").join(best.hint("merge"), "function_id", "left")
    found = F.coalesce(F.col("b.overlap") >= p.min_overlap_lines, F.lit(False))
    low = found & (F.col("b.ratio") < p.overlap_threshold)
    ties = found & (F.col("n_ties") > 0)
    copies = found & F.coalesce("replicated", F.lit(False))
    gap = F.when(found, F.col("b.gap")).otherwise(F.coalesce("_total", F.lit(0)))
    reason = lambda c, code: F.when(c, F.lit(code))
    reasons = F.array_compact(
        F.array(
            reason(~found, "NO_CANDIDATES"), reason(low, "LOW_OVERLAP_RATIO"), reason(ties, "NEAR_TIE"), reason(found & ~ties & ~low, "UNIQUE_BEST"), reason(found & (gap > 0), "PC_LINE_GAP"),
            reason(F.col("multi_file"), "MULTI_FILE_RANGE_PROPAGATED"), reason(copies, "HEADER_REPLICATION_COLLISION"),
        )
    )
    verdict = F.when(~found, "NO_MATCH").when(copies | (ties & ~low), "AMBIGUOUS").when(low, "NO_MATCH").otherwise("MATCH")
    return rows.select(
        *[c for c in targets.columns if c != "multi_file"],
        verdict.alias("align_verdict"),
        reasons.alias("reasons"),
        F.when(found, F.col("b.ts_id")).alias("best_ts_id"),
        F.when(found, F.col("b.overlap")).otherwise(0).alias("overlap_count"),
        F.coalesce("_total", F.lit(0)).alias("total_count"),
        gap.alias("gap_count"),
        F.when(found, F.col("b.ratio")).otherwise(0.0).alias("overlap_ratio"),
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
    )


def report(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Verdict counts per group."""
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.count_if(F.col("align_verdict") == v).alias(v.lower()) for v in ("MATCH", "AMBIGUOUS", "NO_MATCH")]
    )


def reason_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.select(*by, F.explode("reasons").alias("reason")).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def line_span(line_rows: DataFrame) -> DataFrame:
    """Per function: the file with most rows (the first seen of equals), its share, its
    first and last line, and the number of rows. ``pos`` orders rows as they were seen."""
    files = line_rows.groupBy("function_id", "file").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.min("line").alias("lo"), F.max("line").alias("hi"))
    top = files.groupBy("function_id").agg(F.min_by(F.struct("file", "n", "lo", "hi"), F.struct(-F.col("n"), F.col("first"))).alias("t"), F.sum("n").alias("n_rows"), F.count("*").alias("n_files"))
    return top.select("function_id", F.col("t.file").alias("dominant_file"), F.bround(F.col("t.n") / F.col("n_rows"), 4).alias("dominant_ratio"), F.col("t.lo").alias("line_min"), F.col("t.hi").alias("line_max"), "n_rows", "n_files")
