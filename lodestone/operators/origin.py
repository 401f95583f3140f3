"""Where lines of preprocessed units come from: the last line marker carried forward.

A unit's lines are run over in stretches, so a unit of any length spreads over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

# A line marker, and origins that are no source of their own.
MARKER = r'^#(?:\s*line)?\s+(\d+)\s+"((?:[^"\\]|\\.)*)"(?:\s+([\d\s]*))?$'
EXCLUDED_PREFIXES = ("/usr/include", "/usr/lib/gcc", "<built-in>", "<command-line>")
SYSTEM_FLAG = "3"


def unit_lines(texts: DataFrame, tu: str = "tu", text: str = "text") -> DataFrame:
    """(tu, i_line, raw), lines from 0 on."""
    return texts.select(F.col(tu).alias("tu"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("i_line", "raw"))


def origin_map(lines: DataFrame, excluded: tuple[str, ...] = EXCLUDED_PREFIXES) -> DataFrame:
    """(tu, i_line, file, line) of the lines that have an origin."""
    raw = F.regexp_replace("raw", r"\s+$", "")
    is_marker = raw.rlike(MARKER)
    path = F.regexp_replace(F.regexp_extract(raw, MARKER, 2), r"\\(.)", "$1")
    skip = F.array_contains(F.split(F.trim(F.regexp_extract(raw, MARKER, 3)), r"\s+"), SYSTEM_FLAG) | (F.startswith(path, F.lit("<")) & F.endswith(path, F.lit(">")))
    for prefix in excluded:
        skip = skip | F.startswith(path, F.lit(prefix))
    mark = F.when(is_marker, F.struct(F.col("i_line").alias("at"), F.regexp_extract(raw, MARKER, 1).cast("bigint").alias("n"), path.alias("path"), skip.alias("skip")))
    table = scan.dealt(lines.select("tu", "i_line", is_marker.alias("_marker"), mark.alias("_mark")), ["tu"], ["i_line"])
    carried = scan.running(table, ["tu"], ["i_line"], {"m": ("last", F.col("_mark"))})
    return carried.filter(~F.col("_marker") & F.col("m").isNotNull() & ~F.col("m.skip")).select("tu", "i_line", F.col("m.path").alias("file"), (F.col("m.n") + F.col("i_line") - F.col("m.at") - 1).alias("line"))


def origin_available(lines: DataFrame) -> DataFrame:
    """Per unit, whether it has any line marker."""
    return lines.groupBy("tu").agg(F.bool_or(F.regexp_replace("raw", r"\s+$", "").rlike(MARKER)).alias("origin_available"))


def reconcile_units(spans: DataFrame, known: DataFrame) -> DataFrame:
    """(tu, key): the known unit with the same path, else of those with the same file name
    the last one. ``known`` has tu and ``pos``, the order in which units were given."""
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    by_name = known.groupBy(base(F.col("tu")).alias("_base")).agg(F.max_by("tu", "pos").alias("_named"))
    exact = known.select(F.col("tu"), F.col("tu").alias("_exact")).distinct()
    units = spans.select("tu").distinct().withColumn("_base", base(F.col("tu")))
    return units.join(exact, "tu", "left").join(by_name, "_base", "left").select("tu", F.coalesce("_exact", "_named").alias("key"))
