"""Expressions over tabled debug information and syntax nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node types that make up a function's structure.
STRUCTURAL_NODES = ("compound_statement", "if_statement", "for_statement", "while_statement", "do_statement", "switch_statement", "return_statement", "goto_statement", "labeled_statement")


def file_path(index: Column, version: Column, files: Column, dirs: Column, comp_dir: Column) -> Column:
    """Path of a line table's file. files: array<struct<name, dir>>; tables before
    version 5 count files and folders from 1, later ones from 0; folder 0 adds none."""
    shift = F.when(version >= 5, 0).otherwise(1)
    at = index - shift
    entry = F.get(files, at)
    folder = F.when(entry["dir"] > 0, F.get(dirs, entry["dir"] - shift))
    join = lambda a, b: F.when(F.startswith(b, F.lit("/")) | (F.coalesce(a, F.lit("")) == ""), b).otherwise(F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), b))
    known = (at >= 0) & (at < F.size(files))
    return F.when(F.coalesce(known, F.lit(False)), join(comp_dir, join(folder, entry["name"]))).otherwise(F.concat(F.lit("<unknown file "), index.cast("string"), F.lit(">")))


def pc_range(low: Column, high: Column, form: Column) -> Column:
    """struct<lo, hi> of an absolute end or a size; null if empty."""
    end = F.when(form == "DW_FORM_addr", high).otherwise(low + high)
    return F.when(end > low, F.struct(low.alias("lo"), end.alias("hi")))


def structural(nodes: Column, deep: int = 8) -> Column:
    """Of array<struct<node_type, depth>>: the structural ones, with a flag for depth."""
    mine = F.filter(nodes, lambda n: n["node_type"].isin(*STRUCTURAL_NODES))
    return F.transform(mine, lambda n: F.struct(n["node_type"].alias("node_type"), n["depth"].alias("depth"), (n["depth"] >= deep).alias("is_deep")))
