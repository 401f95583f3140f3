"""Bins of ratios and candidate counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels in display order.
UNIT_BINS = ("==1.0", "[0.95,1.0)", "[0.8,0.95)", "[0.5,0.8)", "[0,0.5)", "none")
CANDIDATE_BINS = ("none", "1", "2-3", "4+")


def unit_bin(v: Column) -> Column:
    out = F.lit(UNIT_BINS[4])
    for edge, label in ((0.5, UNIT_BINS[3]), (0.8, UNIT_BINS[2]), (0.95, UNIT_BINS[1]), (1.0, UNIT_BINS[0])):
        out = F.when(v >= edge, label).otherwise(out)
    return F.when(v.isNull(), UNIT_BINS[5]).otherwise(out)


def weight_bin_detailed(weight: Column, has_range: Column, verdict: Column) -> Column:
    """Like :func:`unit_bin`, with the reason why there is no weight."""
    known = weight.isNotNull() & F.coalesce(verdict == "MATCH", F.lit(False))
    return F.when(known, unit_bin(weight)).when(~has_range, "none_no_range").otherwise("none_not_match")


def candidate_bin(n: Column) -> Column:
    """0 counts with 2-3, as everything up to 3 but 1."""
    return F.when(n.isNull(), "none").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")
