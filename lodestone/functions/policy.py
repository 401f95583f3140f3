"""Verdict ladders as expressions: the first rule that holds decides, reasons add up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip, without_version

# Names of code that tools insert, and warning groups.
INIT_FINI_NAMES = ("_init", "_fini", "_DT_INIT", "_DT_FINI", "_INIT_0", "_FINI_0")
COMPILER_NAMES = (
    "frame_dummy", "register_tm_clones", "deregister_tm_clones", "__do_global_dtors_aux", "__libc_csu_init", "__libc_csu_fini", "__cxa_finalize", "__cxa_atexit", "__stack_chk_fail",
    "__gmon_start__", "_start", "__libc_start_main", "_dl_relocate_static_pie", "__x86.get_pc_thunk.bx", "__x86.get_pc_thunk.ax", "_ITM_registerTMCloneTable", "_ITM_deregisterTMCloneTable",
)
AUX_NAMES = INIT_FINI_NAMES + COMPILER_NAMES
PLT_PREFIX = ".plt"
STRUCTURING_WARNINGS = (
    "UNREACHABLE_BLOCKS_REMOVED", "TRUNCATED_CONTROL_FLOW", "UNRESOLVED_INDIRECT_JUMP", "SWITCH_RECOVERY_FAILED", "NON_RETURNING_CALL_MISMODELED", "UNKNOWN_CALLING_CONVENTION",
    "PARAM_STORAGE_LOCKED", "DECOMPILER_INTERNAL_WARNING", "INLINE_LIKELY",
)
CFG_LOW_WARNINGS = ("UNRESOLVED_INDIRECT_JUMP", "TRUNCATED_CONTROL_FLOW", "BAD_INSTRUCTION_DATA")
CFG_MEDIUM_WARNINGS = ("UNREACHABLE_BLOCKS_REMOVED", "SWITCH_RECOVERY_FAILED")
SUPPORTED_MACHINES = ("EM_X86_64", "EM_386")


@dataclass(frozen=True)
class Profile:
    """Thresholds; the defaults are fixed values of the data model."""

    min_overlap_lines: int = 1
    overlap_threshold: float = 0.7
    tie_epsilon: float = 0.02
    pc_tie_epsilon: float = 0.05
    strong: float = 0.9
    weak: float = 0.3
    gold_ratio: float = 0.95
    fail_rate: float = 0.20
    fat_blocks: int = 50
    fat_temps: int = 20
    fat_ratio: float = 5.0
    inline_temps: int = 15
    inline_blocks: int = 30
    goto_density: float = 0.1
    placeholder_rate: float = 0.3
    dominant_ratio: float = 0.7
    fragments: int = 2
    nesting: int = 8
    image_base: int = 0x400000
    fatal_warnings: tuple[str, ...] = ("DECOMPILE_TIMEOUT", "UNRESOLVED_INDIRECT_JUMP")


PROFILE = Profile()


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _codes(*pairs: tuple[Column, str]) -> Column:
    """The codes whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(_true(c), F.lit(code)) for c, code in pairs]))


def _pair(verdict: str, reasons: Column | None = None) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), (F.array().cast("array<string>") if reasons is None else reasons).alias("reasons"))


def _any_of(tags: Column, codes: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.array(*[F.lit(c) for c in codes])), F.lit(False))


def noise_flags(name: Column, section: Column, external: Column, is_import: Column) -> Column:
    base = without_version(strip(F.coalesce(name, F.lit(""))))
    plt, init, comp = _true(F.startswith(section, F.lit(PLT_PREFIX))), base.isin(*INIT_FINI_NAMES), base.isin(*COMPILER_NAMES)
    return F.struct(plt.alias("is_plt_or_stub"), init.alias("is_init_fini_aux"), comp.alias("is_compiler_aux"), (external | is_import | plt | init | comp).alias("is_library_like"))


def is_aux(name: Column) -> Column:
    return without_version(strip(F.coalesce(name, F.lit("")))).isin(*AUX_NAMES)


def judge_decompiled(status: Column, warnings: Column, start: Column, end: Column, noise: Column) -> Column:
    """struct<verdict, reasons>: failures first, else warnings, else OK."""
    has = lambda w: F.array_contains(warnings, w)
    fails = _codes((status == "FAIL", "DECOMPILE_FAIL"), (has("BAD_INSTRUCTION_DATA"), "BAD_INSTRUCTION_DATA"), (has("DECOMPILE_TIMEOUT"), "DECOMPILE_TIMEOUT"), (start.isNull() | end.isNull(), "NO_BODY_RANGE"))
    warns = F.concat(F.filter(warnings, lambda w: w.isin(*STRUCTURING_WARNINGS)), _codes((noise, "NOISE_FUNCTION")))
    return F.when(F.size(fails) > 0, _pair("FAIL", fails)).when(F.size(warns) > 0, _pair("WARN", warns)).otherwise(_pair("OK"))


def gate_decompiled_binary(is_elf: Column, machine: Column, exit_code: Column, error: Column, total: Column, failed: Column, p: Profile = PROFILE) -> Column:
    said = F.lower(F.coalesce(error, F.lit("")))
    kind = F.when(F.contains(said, F.lit("timeout")), "ANALYSIS_TIMEOUT").when(F.contains(said, F.lit("project")), "PROJECT_DB_ERROR").when(F.contains(said, F.lit("script")), "SCRIPT_EXCEPTION").otherwise("GHIDRA_HEADLESS_FAILED")
    rejects = F.array_compact(
        F.array(F.when(~is_elf, "NOT_ELF"), F.when(_true((machine != "") & ~machine.isin(*SUPPORTED_MACHINES)), "UNSUPPORTED_ARCH"), F.when(_true(exit_code != 0), kind))
    )
    warns = _codes(((total > 0) & (failed / F.greatest(total, F.lit(1)) > p.fail_rate), "HIGH_DECOMPILE_FAIL_RATE"))
    return _ladder(rejects, warns)


def _ladder(rejects: Column, warns: Column) -> Column:
    return F.when(F.size(rejects) > 0, _pair("REJECT", rejects)).when(F.size(warns) > 0, _pair("WARN", warns)).otherwise(_pair("ACCEPT"))


def judge_debug_function(name: Column, is_declaration: Column, n_ranges: Column, n_line_rows: Column, dominant_ratio: Column, system_header: Column, p: Profile = PROFILE) -> Column:
    """A function of the debug information: a declaration also lacks its range."""
    no_range = is_declaration | (n_ranges == 0)
    rejects = _codes((is_declaration, "DECLARATION_ONLY"), (no_range, "MISSING_RANGE"), (~no_range & (n_line_rows == 0), "NO_LINE_ROWS_IN_RANGE"))
    warns = _codes((name.isNull(), "NAME_MISSING"), (dominant_ratio < p.dominant_ratio, "MULTI_FILE_RANGE"), (system_header, "SYSTEM_HEADER_DOMINANT"), (n_ranges > p.fragments, "RANGES_FRAGMENTED"))
    return _ladder(rejects, warns)


def judge_source_function(span_ok: Column, name: Column, duplicate: Column, depth: Column, anonymous: Column, nonstandard: Column, p: Profile = PROFILE) -> Column:
    """A function of the parsed source: the first reject stands alone."""
    reject = F.array_compact(F.array(F.when(~span_ok, "INVALID_SPAN").when(name.isNull(), "MISSING_FUNCTION_NAME")))
    warns = _codes((duplicate, "DUPLICATE_FUNCTION_NAME"), (depth >= p.nesting, "DEEP_NESTING"), (anonymous, "ANONYMOUS_AGGREGATE_PRESENT"), (nonstandard, "NONSTANDARD_EXTENSION_PATTERN"))
    return _ladder(reject, warns)


def eligibility(has_range: Column, non_target: Column, oracle_verdict: Column, name: Column) -> Column:
    """struct<for_join, for_gold, exclusion>; being unfit for gold is no exclusion."""
    join = has_range & ~non_target
    gold = join & _true(oracle_verdict == "ACCEPT") & ~is_aux(name)
    return F.struct(join.alias("for_join"), gold.alias("for_gold"), F.when(~has_range, "NO_RANGE").when(non_target, "NON_TARGET").alias("exclusion"))


def match_kind(pc_ratio: Column, near_ties: Column, has_range: Column, p: Profile = PROFILE) -> Column:
    return F.when(~has_range, "NO_RANGE").when(pc_ratio <= 0, "NO_MATCH").when(near_ties >= 1, "MULTI_MATCH").when(pc_ratio >= p.strong, "JOINED_STRONG").when(pc_ratio >= p.weak, "JOINED_WEAK").otherwise("NO_MATCH")


#: The gates of high confidence in order: (reject reason, funnel counter).
GATES = (
    ("ORACLE_NOT_ACCEPT", "n_pass_oracle_accept"), ("ALIGN_NOT_MATCH", "n_pass_align_match"), ("ALIGN_NOT_UNIQUE", "n_pass_align_unique"), ("ALIGN_RATIO_LOW", "n_pass_align_ratio"),
    ("NOT_JOINED_STRONG", "n_pass_joined_strong"), ("IS_NOISE_FUNCTION", "n_pass_not_noise"), ("CFG_LOW", "n_pass_cfg_not_low"), ("FATAL_WARNING", "n_pass_no_fatal_warnings"),
)


def gate_conditions(p: Profile = PROFILE) -> list[Column]:
    """Over the columns of joined functions: what must hold at each gate."""
    c = F.col
    return [
        _true(c("oracle_verdict") == "ACCEPT"),
        _true(c("align_verdict") == "MATCH"),
        _true(c("n_candidates") == 1),
        _true(c("overlap_ratio") >= p.gold_ratio),
        _true(c("match_kind") == "JOINED_STRONG"),
        ~(c("is_external") | c("is_thunk") | c("is_aux") | c("is_import_proxy")),
        ~_true(c("cfg_completeness") == "LOW"),
        ~_any_of(c("warning_tags"), p.fatal_warnings),
    ]


def reject_reason(p: Profile = PROFILE) -> Column:
    """The first gate that fails; null for high confidence."""
    return F.coalesce(*[F.when(~ok, F.lit(reason)) for ok, (reason, _) in zip(gate_conditions(p), GATES, strict=True)])


def confidence_tier(high: Column, kind: Column, for_gold: Column) -> Column:
    return F.when(high, "GOLD").when((kind == "JOINED_STRONG") & for_gold, "SILVER").when(kind.isin("JOINED_STRONG", "JOINED_WEAK"), "BRONZE").otherwise("")


def upstream_collapse(has_range: Column, non_target: Column, oracle_verdict: Column, align_verdict: Column) -> Column:
    return F.when(~has_range, "NO_DWARF_RANGE").when(non_target, "ALIGNMENT_NON_TARGET").when(oracle_verdict == "REJECT", "DWARF_ORACLE_REJECT").when(align_verdict == "DISAPPEAR", "ALIGNMENT_DISAPPEAR")


def quality_flags(cfg: Column, warnings: Column, gotos: Column, lines: Column, placeholder: Column, p: Profile = PROFILE) -> Column:
    return _codes((cfg == "LOW", "CFG_LOW"), (_any_of(warnings, p.fatal_warnings), "FATAL_WARNING"), (gotos / F.greatest(lines, F.lit(1)) > p.goto_density, "HIGH_GOTO_DENSITY"), (placeholder > p.placeholder_rate, "HIGH_PLACEHOLDER_TYPES"))


def quality_weight(verdict: Column, ratio: Column, n_candidates: Column) -> Column:
    """ratio / candidates for a match (no candidates: 1), clipped to 0..1; else 0."""
    raw = ratio / F.when(n_candidates == 0, 1).otherwise(n_candidates)
    return F.when(_true(verdict == "MATCH"), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def table_weight(verdict: Column, ratio: Column, n_candidates: Column) -> Column:
    """As stored with the function table: no candidates give 0."""
    return F.when(_true(verdict == "MATCH") & (n_candidates > 0), ratio / F.greatest(n_candidates, F.lit(1))).otherwise(F.lit(0.0))


def cfg_completeness(warnings: Column) -> Column:
    return F.when(_any_of(warnings, CFG_LOW_WARNINGS), "LOW").when(_any_of(warnings, CFG_MEDIUM_WARNINGS), "MEDIUM").otherwise("HIGH")


def is_fat(size: Column, blocks: Column, temps: Column, ratio: Column, p90: Column, p: Profile = PROFILE) -> Column:
    return _true(size > p90) | (blocks > p.fat_blocks) | (temps > p.fat_temps) | (ratio > p.fat_ratio)


def inline_likely(fat: Column, temps: Column, blocks: Column, p: Profile = PROFILE) -> Column:
    return fat & (temps >= p.inline_temps) & (blocks >= p.inline_blocks)


def fragility(dropped: Column, appeared: Column, overlap_a: Column, overlap_b: Column) -> Column:
    """How much a function loses (below 0) or gains from one level to the other."""
    return F.when(dropped, -F.coalesce(overlap_a, F.lit(0.0))).when(appeared, F.coalesce(overlap_b, F.lit(0.0))).otherwise(overlap_b - overlap_a)


def severity(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < -0.1, "severe").when(score < -0.01, "mild").when(score <= 0.01, "stable").otherwise("improved")


def rebase(address: Column, base: Column, p: Profile = PROFILE) -> Column:
    """Addresses of a relocated image start at 0; a fixed image keeps its own."""
    return F.when(base == p.image_base, address).otherwise(address - base)
