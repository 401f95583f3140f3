"""Expressions over decompiler output: addresses, warnings, metrics, blocks, variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import strip
from .policy import cfg_completeness

# Message patterns, the first that matches names the code; words that
# make a comment a warning; names of temporaries; undefined types.
WARNING_PATTERNS = (
    (r"unknown.*calling.*convention", "UNKNOWN_CALLING_CONVENTION"),
    (r"param.*storage.*lock", "PARAM_STORAGE_LOCKED"),
    (r"unreachable.*block", "UNREACHABLE_BLOCKS_REMOVED"),
    (r"bad\s+(instruction|data)", "BAD_INSTRUCTION_DATA"),
    (r"truncat.*control.*flow", "TRUNCATED_CONTROL_FLOW"),
    (r"unresolved.*indirect.*jump", "UNRESOLVED_INDIRECT_JUMP"),
    (r"non[_\-\s]*return", "NON_RETURNING_CALL_MISMODELED"),
    (r"switch.*recov", "SWITCH_RECOVERY_FAILED"),
    (r"timed?\s*out|timeout|time.out", "DECOMPILE_TIMEOUT"),
    (r"could not recover", "SWITCH_RECOVERY_FAILED"),
    (r"indirect.*jump", "UNRESOLVED_INDIRECT_JUMP"),
    (r"unreachable", "UNREACHABLE_BLOCKS_REMOVED"),
)
COMMENT_HINTS = ("warning", "could not", "unresolved", "unreachable", "bad instruction", "truncat")
TEMP_NAME = r"^(uVar|iVar|bVar|cVar|lVar|sVar|fVar|dVar|ppVar|pVar|auVar|abVar|aiVar)\d+$"
UNDEFINED_TYPE = r"(?i)^undefined\d*$"
HEADER_LINES = 10


def address(text: Column) -> Column:
    """struct<va, hex> of a hex address with or without 0x."""
    digits = F.regexp_replace(F.lower(strip(text)), "^0x", "")
    va = F.conv(digits, 16, 10).cast("bigint")
    return F.struct(va.alias("va"), F.concat(F.lit("0x"), F.lower(F.hex(va))).alias("hex"))


def parse_ranges(ranges: Column) -> Column:
    """Of array<struct<low, high>> in hex, the parsed ones with high > low."""
    parsed = F.transform(ranges, lambda r: F.struct(address(r["low"])["va"].alias("lo"), address(r["high"])["va"].alias("hi")))
    return F.filter(parsed, lambda r: r["hi"] > r["lo"])


def merge_ranges(ranges: Column) -> Column:
    """Union of half-open ranges array<struct<lo, hi>>; touching ones join."""
    kind = "array<struct<lo:bigint,hi:bigint>>"

    def step(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], r["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (r["lo"] <= last["hi"]), joined).otherwise(F.concat(done, F.array(r)))

    guarded = F.filter(ranges, lambda r: r["hi"] > r["lo"])
    return F.aggregate(F.slice(F.array_sort(guarded), 2, 1 << 30), F.slice(F.array_sort(guarded), 1, 1).cast(kind), step)


def warning_code(message: Column) -> Column:
    """The code of a raw message; null for a blank one that no pattern knows."""
    out = F.when(strip(message) != "", F.lit("DECOMPILER_INTERNAL_WARNING"))
    for pattern, code in reversed(WARNING_PATTERNS):
        out = F.when(message.rlike(f"(?i){pattern}"), F.lit(code)).otherwise(out)
    return out


def map_warnings(messages: Column, c_text: Column) -> Column:
    """Codes of the messages and of warning comments in the header, each once, in order."""
    header = F.slice(F.split(F.coalesce(c_text, F.lit("")), "\n", -1), 1, HEADER_LINES)
    lines = F.transform(header, strip)

    def hinted(line: Column) -> Column:
        said = F.lit(False)
        for w in COMMENT_HINTS:
            said = said | F.contains(F.lower(line), F.lit(w))
        return (F.startswith(line, F.lit("/*")) | F.startswith(line, F.lit("//"))) & said

    raw = F.concat(F.coalesce(messages, F.array().cast("array<string>")), F.filter(lines, hinted))
    return F.array_distinct(F.array_compact(F.transform(raw, warning_code)))


def c_lines(c_text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c_text, F.lit("")), "\n", -1), lambda x: strip(x) != ""))


def instruction_ratio(instructions: Column, lines: Column) -> Column:
    return F.when(lines > 0, F.bround(instructions / F.greatest(lines, F.lit(1)), 4)).otherwise(F.lit(0.0))


def word_count(text: Column, word: str) -> Column:
    """How often a word of ASCII letters, digits or underscores occurs; other characters bound it."""
    return F.regexp_count(text, F.lit(f"(?<![0-9A-Za-z_]){word}(?![0-9A-Za-z_])"))


def goto_count(c_text: Column) -> Column:
    return word_count(F.coalesce(c_text, F.lit("")), "goto")


def is_undefined_type(kind: Column) -> Column:
    return F.coalesce(kind.rlike(UNDEFINED_TYPE), F.lit(False))


def cfg_summary(blocks: Column, warnings: Column) -> Column:
    """Of array<struct<block_id, start_va, succ_va>>: counts, cyclomatic number,
    completeness, and the blocks with successors resolved to block ids."""
    n = F.size(blocks)
    # of blocks with one start the last one is meant
    succ = F.transform(blocks, lambda b: F.struct(b["block_id"].alias("block_id"), F.filter(F.transform(b["succ_va"], lambda v: F.try_element_at(F.transform(F.filter(blocks, lambda o: o["start_va"] == v), lambda o: o["block_id"]), F.lit(-1))), lambda x: x.isNotNull()).alias("succ")))
    edges = F.aggregate(F.transform(succ, lambda b: F.size(b["succ"])), F.lit(0), lambda a, x: a + x)
    state = cfg_completeness(warnings)
    return F.struct(
        n.alias("bb_count"),
        edges.alias("edge_count"),
        F.when(n > 0, F.greatest(F.lit(0), edges - n + 2)).otherwise(0).alias("cyclomatic"),
        F.array_contains(warnings, "UNRESOLVED_INDIRECT_JUMP").alias("has_indirect_jumps"),
        F.when((n == 0) & (state == "HIGH"), "LOW").otherwise(state).alias("cfg_completeness"),
        succ.alias("blocks"),
    )


def variable_kind(is_param: Column, storage: Column, name: Column, va: Column) -> Column:
    return F.when(is_param, "PARAM").when((storage == "MEMORY") & va.isNotNull(), "GLOBAL_REF").when((storage == "UNIQUE") | name.rlike(TEMP_NAME), "TEMP").otherwise("LOCAL")


def storage_key(storage: Column, offset: Column, register: Column, va: Column, name: Column) -> Column:
    hexa = lambda c: F.concat(F.lit("0x"), F.lower(F.hex(c)))
    return (
        F.when((storage == "STACK") & offset.isNotNull(), F.concat(F.lit("stack:off:"), F.when(offset >= 0, "+").otherwise("-"), hexa(F.abs(offset))))
        .when((storage == "REGISTER") & (F.coalesce(register, F.lit("")) != ""), F.concat(F.lit("reg:"), register))
        .when((storage == "MEMORY") & va.isNotNull(), F.concat(F.lit("mem:"), hexa(va)))
        .when(storage == "UNIQUE", F.concat(F.lit("uniq:"), name))
        .otherwise(F.concat(F.lit("unk:"), name))
    )


def access_signature(sites: Column, key: Column) -> Column:
    joined = F.array_join(F.transform(F.array_sort(sites), lambda s: s.cast("string")), ",")
    return F.substring(F.sha2(F.when(F.size(sites) > 0, joined).otherwise(key), 256), 1, 16)


def variable_id(function_id: Column, kind: Column, key: Column, signature: Column) -> Column:
    return F.concat_ws(":", function_id.cast("string"), kind, key, signature)
