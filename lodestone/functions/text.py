"""Text of prompts and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip

# What stands where there is nothing to tell.
NO_CALLS, NO_CFG, NO_VARIABLES = "(no outgoing calls)", "(no CFG data)", "(no variable data)"
MISSING = {"calls": "(no call data available)", "cfg_summary": "(no CFG data available)", "variables": "(no variable data available)"}
LEAK_LENGTH = 4


def calls_text(calls: Column) -> Column:
    """Of array<struct<callee_name, call_kind, is_external_target>>."""
    line = lambda c: F.concat(
        F.lit("  - "), F.coalesce(F.nullif(c["callee_name"], F.lit("")), F.lit("<indirect call>")), F.lit(" ("), F.coalesce(c["call_kind"], F.lit("UNKNOWN")), F.when(c["is_external_target"], ", external").otherwise(""), F.lit(")")
    )
    return F.when(F.coalesce(F.size(calls), F.lit(0)) <= 0, NO_CALLS).otherwise(F.concat(F.lit("This function calls:\n"), F.array_join(F.transform(calls, line), "\n")))


def cfg_text(cfg: Column) -> Column:
    """Of struct<bb_count, edge_count, cyclomatic, has_indirect_jumps, cfg_completeness>."""
    said = lambda f: F.coalesce(cfg[f].cast("string"), F.lit("?"))
    body = F.concat(
        F.lit("Control-flow summary:\n  - Basic blocks: "), said("bb_count"), F.lit("\n  - Edges: "), said("edge_count"), F.lit("\n  - Cyclomatic complexity: "), said("cyclomatic"),
        F.lit("\n  - Has indirect jumps: "), F.when(cfg["has_indirect_jumps"], "yes").otherwise("no"), F.lit("\n  - CFG completeness: "), said("cfg_completeness"),
    )
    return F.when(cfg.isNull(), NO_CFG).otherwise(body)


def variables_text(variables: Column) -> Column:
    """Of array<struct<name, type_str, var_kind, storage_class>>."""
    said = lambda v, f: F.coalesce(v[f], F.lit("?"))
    line = lambda v: F.concat(F.lit("  - "), said(v, "name"), F.lit(": "), said(v, "type_str"), F.lit(" ("), said(v, "var_kind"), F.lit(", "), said(v, "storage_class"), F.lit(")"))
    return F.when(F.coalesce(F.size(variables), F.lit(0)) <= 0, NO_VARIABLES).otherwise(F.concat(F.lit("Variables:\n"), F.array_join(F.transform(variables, line), "\n")))


def render_prompt(template: Column, c_text: Column, calls: Column, cfg: Column, variables: Column) -> Column:
    out = F.replace(template, F.lit("{{ c_raw }}"), c_text)
    for name, value in (("calls", calls), ("cfg_summary", cfg), ("variables", variables)):
        out = F.replace(out, F.lit(f"{{{{ {name} }}}}"), F.coalesce(value, F.lit(MISSING[name])))
    return out


def leaks_truth(c_text: Column, truth: Column) -> Column:
    """The true name, if longer than LEAK_LENGTH, stands in the text in any case."""
    return F.coalesce((F.length(truth) > LEAK_LENGTH) & F.contains(F.lower(c_text), F.lower(truth)), F.lit(False))


def without_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def normalised_source(text: Column) -> Column:
    """C text without comments, white space collapsed."""
    bare = F.regexp_replace(text, r"(?s)/\*.*?\*/|//[^\n]*", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def source_hash(text: Column) -> Column:
    return F.sha2(normalised_source(text), 256)


def file_role(path: Column) -> Column:
    """By the file name's suffix, in any case; a leading dot makes no suffix."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(base.rlike(r"^.+\.c$"), "C_UNIT").when(base.rlike(r"^.+\.h$"), "HEADER").otherwise("OTHER")
