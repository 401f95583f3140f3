"""Semantic cases of the operators, small and by hand or against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import bins, decompiled, names, parse, policy, text
from lodestone.operators import address, align, bootstrap, invariants, lookups, matrix, origin, quantile, rates, report, scoring, stats, trajectory, transitions
from lodestone.sources import readers, sinks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def lit(v):
    return F.lit(v)


# -- functions ----------------------------------------------------------------


@pytest.mark.parametrize(
    "name,want",
    [("parseHeader", ["parse", "header"]), ("calc2sum", ["calc", "2", "sum"]), ("__my_func__", ["my", "func"]), ("ABCDef", ["abc", "def"]), ("a-b__C", ["a", "b", "c"]), ("", []), ("X1Y2", ["x", "1", "y", "2"])],
)
def test_tokens(spark, name, want):
    assert one(spark, names.tokens(lit(name))) == want


def test_scores(spark):
    p, r, f1 = (one(spark, c) for c in names.overlap_scores(lit("get_user_name"), lit("userName")))
    assert (p, r) == (2 / 3, 1.0) and f1 == pytest.approx(0.8)
    assert [one(spark, c) for c in names.overlap_scores(lit(""), lit("x"))] == [0.0, 0.0, 0.0]
    assert one(spark, names.exact_match(lit("Parse_Header"), lit("parseHeader")))
    assert one(spark, names.exact_match(lit(""), lit("_")))


@pytest.mark.parametrize("name,want", [("FUN_00401000", True), ("sub_4a", True), ("0xAB", True), ("__func_1__", True), (" handler ", True), (None, True), ("parse_header", False), ("subway", False)])
def test_trivial(spark, name, want):
    assert one(spark, names.is_trivial(F.lit(name).cast("string"))) is want


@pytest.mark.parametrize("v,want", [(1.0, "==1.0"), (0.95, "[0.95,1.0)"), (0.9499, "[0.8,0.95)"), (0.5, "[0.5,0.8)"), (0.0, "[0,0.5)"), (None, "none"), (1.2, "==1.0")])
def test_unit_bins(spark, v, want):
    assert one(spark, bins.unit_bin(F.lit(v).cast("double"))) == want


def test_candidate_bin_of_zero(spark):
    assert [one(spark, bins.candidate_bin(F.lit(n).cast("int"))) for n in (None, 0, 1, 3, 4)] == ["none", "2-3", "1", "2-3", "4+"]


def test_match_kind_ladder(spark):
    kind = lambda r, t, h: one(spark, policy.match_kind(lit(r), lit(t), lit(h)))
    assert [kind(1.0, 0, False), kind(0.0, 1, True), kind(0.5, 1, True), kind(0.9, 0, True), kind(0.3, 0, True), kind(0.29, 0, True)] == ["NO_RANGE", "NO_MATCH", "MULTI_MATCH", "JOINED_STRONG", "JOINED_WEAK", "NO_MATCH"]


def test_eligibility(spark):
    e = lambda h, n, v, name: tuple(one(spark, policy.eligibility(lit(h), lit(n), lit(v), lit(name))))
    assert e(False, True, "ACCEPT", "f") == (False, False, "NO_RANGE")
    assert e(True, True, "ACCEPT", "f") == (False, False, "NON_TARGET")
    assert e(True, False, "WARN", "f") == (True, False, None)
    assert e(True, False, "ACCEPT", " __cxa_finalize@@GLIBC_2.17") == (True, False, None)
    assert e(True, False, "ACCEPT", "f") == (True, True, None)


def test_judgements(spark):
    tags = F.array(lit("SWITCH_RECOVERY_FAILED"), lit("X"))
    assert tuple(one(spark, policy.judge_decompiled(lit("OK"), tags, lit(1), lit(2), lit(True)))) == ("WARN", ["SWITCH_RECOVERY_FAILED", "NOISE_FUNCTION"])
    assert tuple(one(spark, policy.judge_decompiled(lit("FAIL"), tags, F.lit(None), lit(2), lit(True)))) == ("FAIL", ["DECOMPILE_FAIL", "NO_BODY_RANGE"])
    assert tuple(one(spark, policy.judge_debug_function(lit("f"), lit(True), lit(0), lit(0), lit(1.0), lit(False)))) == ("REJECT", ["DECLARATION_ONLY", "MISSING_RANGE"])


def test_warnings_are_mapped_once_in_order(spark):
    got = one(spark, decompiled.map_warnings(F.array(lit("odd"), lit("Unreachable block"), lit("unreachable"), lit(" ")), lit("\n/* WARNING: bad instruction data */\nint x; // timeout")))
    assert got == ["DECOMPILER_INTERNAL_WARNING", "UNREACHABLE_BLOCKS_REMOVED", "BAD_INSTRUCTION_DATA"]


def test_merge_ranges_against_brute_force(spark):
    rng = random.Random(1)
    for _ in range(15):
        r = [(a := rng.randint(0, 40), a + rng.randint(-1, 6)) for _ in range(rng.randint(0, 9))]
        df = spark.createDataFrame([(r,)], "r array<struct<lo:bigint,hi:bigint>>")
        got = [tuple(x) for x in df.select(decompiled.merge_ranges(F.col("r"))).first()[0]]
        covered = {p for lo, hi in r for p in range(lo, hi)}
        assert {p for lo, hi in got for p in range(lo, hi)} == covered
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))


def test_variables(spark):
    assert one(spark, decompiled.storage_key(lit("STACK"), lit(-16), F.lit(None).cast("string"), F.lit(None).cast("bigint"), lit("v"))) == "stack:off:-0x10"
    assert one(spark, decompiled.storage_key(lit("REGISTER"), F.lit(None), lit(""), F.lit(None).cast("bigint"), lit("v"))) == "unk:v"
    assert one(spark, decompiled.variable_kind(lit(False), lit("STACK"), lit("uVar3"), F.lit(None))) == "TEMP"
    a = one(spark, decompiled.access_signature(F.array(lit(10), lit(9)), lit("k")))
    assert a == one(spark, decompiled.access_signature(F.array(lit(9), lit(10)), lit("z")))


def test_texts(spark):
    none = F.lit(None).cast("array<struct<callee_name:string,call_kind:string,is_external_target:boolean>>")
    assert one(spark, text.calls_text(none)) == "(no outgoing calls)"
    assert one(spark, text.leaks_truth(lit("int Parse_it()"), lit("parse"))) and not one(spark, text.leaks_truth(lit("main"), lit("main")))
    assert one(spark, text.normalised_source(lit("int /* a\nb */ f() { // c\n }"))) == "int f() { }"
    assert one(spark, text.without_thinking(lit(" <THINK>a\nb</think> name\n"))) == "name"


@pytest.mark.parametrize(
    "answer,name,ok",
    [
        ('{"predictions": [{"name": "a"}, {"name": ""}, {"name": "b", "confidence": -3}]}', "a", True),
        ("```json\n[{\"name\": \"x.\"}]\n```", "x", True),
        ('text {"name": "q}{", "confidence": "no"} tail}', "q}{", True),
        ('{"a":1}{', '{"a":1}{', False),
        ("The function name is: `do_it`.", "do_it`", False),
        ("", "", False),
        ('{"predictions": []}', '{"predictions":', False),
    ],
)
def test_answers(answer, name, ok):
    got = parse.parse_answer(answer)
    assert got["parse_ok"] is ok
    if ok or not answer or answer.startswith("The"):
        assert got["predictions"][0]["name"].rstrip("`") == name.rstrip("`")
    assert all(0 <= p["confidence"] <= 1 for p in got["predictions"]) and len(got["predictions"]) <= 3


# -- origin map -----------------------------------------------------------------


def machine(lines):
    """Line by line, as the window does it at once."""
    import re

    at, out = None, []
    for i, raw in enumerate(lines):
        m = re.match(origin.MARKER, raw.rstrip())
        if m:
            path = re.sub(r"\\(.)", r"\1", m[2])
            bad = path.startswith(origin.EXCLUDED_PREFIXES) or (path[:1] == "<" and path[-1:] == ">") or "3" in (m[3] or "").split()
            at = (path, int(m[1]), bad)
        elif at:
            if not at[2]:
                out.append((i, at[0], at[1]))
            at = (at[0], at[1] + 1, at[2])
    return out


def test_origin_map_equals_the_state_machine(spark):
    rng = random.Random(6)
    pieces = ["int x;", "", '# 5 "a.c"', '# 9 "b\\"q.h" 1', '#line 3 "c.c"  ', '# 1 "<built-in>"', '# 2 "/usr/include/x.h"', '# 7 "d.h" 1 3', "#define A 1", '# x "no"']
    units = {f"u{n}": [rng.choice(pieces) for _ in range(rng.randint(0, 40))] for n in range(25)}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in units.items()], "tu string, text string")
    got = {}
    for r in origin.origin_map(origin.unit_lines(df)).collect():
        got.setdefault(r.tu, []).append((r.i_line, r.file, r.line))
    for k, v in units.items():
        assert sorted(got.get(k, [])) == machine("\n".join(v).split("\n")), v


# -- alignment and addresses ----------------------------------------------------------


def test_alignment_cases(spark):
    spans = spark.createDataFrame(
        [("s1", 1, 1, 4, 0, 10, "h1"), ("s2", 1, 5, 8, 20, 40, "h2"), ("s3", 2, 1, 4, 0, 10, "h1")], "ts_id string, tu int, start_line int, end_line int, start_byte int, end_byte int, context_hash string"
    )
    origins = spark.createDataFrame([(1, i, "a", i) for i in range(1, 9)] + [(2, i, "h" if i < 3 else "a", i) for i in range(1, 5)], "tu int, i_line int, file string, line int")
    ev = spark.createDataFrame([(1, "a", 6, 5), (2, "a", 3, 4), (2, "a", 4, 4), (3, "zz", 1, 3), (4, "a", 5, 1), (4, "zz", 9, 9)], "function_id int, file string, line int, cnt int")
    targets = spark.createDataFrame([(n, n == 1) for n in range(1, 6)], "function_id int, multi_file boolean")
    got = {r.function_id: r for r in align.align(targets, ev, spans, origins).collect()}
    assert (got[1].align_verdict, got[1].reasons, got[1].best_ts_id) == ("MATCH", ["UNIQUE_BEST", "MULTI_FILE_RANGE_PROPAGATED"], "s2")
    assert (got[2].align_verdict, got[2].reasons) == ("AMBIGUOUS", ["NEAR_TIE", "HEADER_REPLICATION_COLLISION"])
    assert (got[3].align_verdict, got[3].reasons, got[3].gap_count) == ("NO_MATCH", ["NO_CANDIDATES"], 3)
    assert (got[4].align_verdict, got[4].reasons) == ("NO_MATCH", ["LOW_OVERLAP_RATIO", "PC_LINE_GAP"])
    assert (got[5].align_verdict, got[5].total_count) == ("NO_MATCH", 0)


def test_overlaps_against_brute_force(spark):
    rng = random.Random(8)
    ranges = [(n, rng.randint(0, 1), a := rng.randint(0, 300), a + rng.randint(0, 90)) for n in range(40) for _ in range(rng.randint(1, 2))]
    bodies = [(f"b{n}", rng.randint(0, 1), a := rng.randint(0, 300), a + rng.randint(0, 70), a, False, False) for n in range(50)]
    want = {}
    for f, b, lo, hi in ranges:
        for i, c, s, e, *_ in bodies:
            if b == c and (n := min(hi, e) - max(lo, s)) > 0:
                want[f, i] = want.get((f, i), 0) + n
    left = spark.createDataFrame(ranges, "function_id int, bin int, lo bigint, hi bigint")
    right = spark.createDataFrame(bodies, "body_id string, bin int, start bigint, end bigint, entry bigint, is_thunk boolean, is_external boolean")
    for split in (1, 16, address.SPLIT):
        assert {(r.function_id, r.body_id): r.bytes for r in address.overlaps(left, right, split).collect()} == want


def test_best_body_prefers_code_and_counts_relative_ties(spark):
    bodies = spark.createDataFrame([("a", 0, 0, 100, 0, True, False), ("b", 0, 0, 100, 0, False, False), ("c", 0, 4, 100, 4, False, False), ("d", 0, 50, 100, 50, False, False)], "body_id string, bin int, start bigint, end bigint, entry bigint, is_thunk boolean, is_external boolean")
    r = address.best_bodies(spark.createDataFrame([(1, 0), (2, 0)], "function_id int, low_pc bigint"), spark.createDataFrame([(1, 0, 0, 100), (2, 0, 7, 7)], "function_id int, bin int, lo bigint, hi bigint"), bodies)
    got = {x.function_id: x for x in r.collect()}
    assert (got[1].body_id, got[1].n_near_ties, got[1].match_kind, got[1].warnings) == ("b", 1, "MULTI_MATCH", ["NEAR_TIE_CANDIDATES"])
    assert (got[2].match_kind, got[2].warnings, got[2].body_id) == ("NO_RANGE", ["DWARF_RANGE_MISSING"], None)


# -- transitions and rates ----------------------------------------------------------------

FN = "function_id int, test_case string, opt string, name string, decl_file string, decl_line int, decl_column int, verdict string, overlap double, gap int"


def test_transitions(spark):
    rows = [
        (1, "t", "O0", "f", "a.c", 1, 2, "MATCH", 0.9, 1), (2, "t", "O1", "F ", "a.c", 1, 2, "NO_MATCH", 0.5, 4), (3, "t", "O0", "g", "a.c", 5, None, "MATCH", 1.0, 0),
        (4, "t", "O1", "h", None, None, None, "MATCH", 1.0, 0), (5, "t", "O0", "h", None, None, None, "MATCH", 1.0, 0), (6, "t", "O0", "d", "a.c", 9, 1, "MATCH", 0.8, 0), (7, "t", "O0", "d", "a.c", 9, 1, "MATCH", 0.3, 0),
    ]
    got = {r.id_a or -r.id_b: r for r in transitions.transitions(spark.createDataFrame(rows, FN), "O0", "O1").collect()}
    assert (got[1].transition, got[1].key_quality, round(got[1].delta_overlap, 6), got[1].delta_gap) == ("MATCH→NO_MATCH", "HIGH", -0.4, 3)
    assert (got[3].transition, got[3].dropped, got[3].key_quality) == ("MATCH→ABSENT", True, "MEDIUM")
    assert 7 in got and 6 not in got  # the worst overlap of one identity stays
    assert got.get(5) is None and got[-4].verdict_a == "ABSENT"  # unresolved rows of one name collapse


def test_reason_shift(spark):
    reasons = spark.createDataFrame([("t1", "O0", "NEAR_TIE", 5), ("t2", "O0", "NEAR_TIE", 1), ("t1", "O1", "NEAR_TIE", 8), ("t1", "O1", "PC_LINE_GAP", 10), ("t1", "O1", "RARE", 1)], "test_case string, opt string, reason string, n int")
    pairs = spark.createDataFrame([("t1", "O0", 10), ("t2", "O0", 2), ("t1", "O1", 10)], "test_case string, opt string, n int")
    micro = {r.reason: r for r in rates.reason_shift(reasons, pairs, "O0", "O1").collect()}
    assert (micro["NEAR_TIE"].share_a, micro["NEAR_TIE"].delta_pp, micro["NEAR_TIE"].label) == (50.0, 30.0, "Near Tie")
    macro = {r.reason: r for r in rates.reason_shift(reasons, pairs, "O0", "O1", averaging="macro").collect()}
    assert macro["NEAR_TIE"].share_a == 50.0 and macro["PC_LINE_GAP"].share_b == 100.0
    top = {r.reason: r for r in rates.reason_shift(reasons, pairs, "O0", "O1", top_k=1).collect()}
    assert set(top) == {"PC_LINE_GAP", "OTHER"} and top["OTHER"].count_b == 9
    with pytest.raises(ValueError):
        rates.reason_shift(reasons, pairs, "O0", "O1", averaging="no")


def test_quantiles(spark):
    rng = random.Random(3)
    values = [("a", rng.randint(1, 99)) for _ in range(37)] + [("b", 7), ("c", 0), ("d", 3), ("d", 9)]
    df = spark.createDataFrame(values, "g string, x int")
    near = {r.g: r for r in quantile.nearest_rank(df, ["g"], "x", [0.25, 0.9]).collect()}
    s = sorted(x for g, x in values if g == "a")
    assert (near["a"].p25, near["a"].p90) == (s[int(0.25 * 37)], s[min(int(0.9 * 37), 36)])
    import statistics

    p90 = {r.g: r.p90 for r in quantile.exclusive_p90(df, ["g"], "x").collect()}
    assert p90["a"] == pytest.approx(statistics.quantiles(s, n=10)[8]) and (p90["b"], p90["c"]) == (7, 0)
    assert p90["d"] == pytest.approx(statistics.quantiles([3, 9], n=10)[8])
    lin = {r.g: r.q for r in df.groupBy("g").agg(quantile.linear(F.col("x"), 0.75).alias("q")).collect()}
    assert lin["a"] == pytest.approx(np.percentile(s, 75))


# -- reports and checks ------------------------------------------------------------------------


def test_funnel_is_monotone_and_histograms_partition(spark):
    from lodestone.plans.queries_report import classified
    from lodestone.plans.views import Catalog

    rows = classified(Catalog(spark, "/root/testdata/sf0.001")).cache()
    f = report.funnel(rows, []).first()
    assert list(f) == sorted(f, reverse=True)
    n = rows.count()
    assert {r.s for r in report.histograms(rows, report.standard_dimensions()).groupBy("dimension").agg(F.sum("n").alias("s")).collect()} == {n}
    assert report.funnel(rows.repartition(5), []).first() == f
    clean = rows.filter("(match_kind <> 'NO_RANGE' OR body_id IS NULL) AND (eligible_for_gold OR NOT is_high_confidence)")
    assert invariants.violations(clean).count() == 0


def test_weight_out_of_range_fails(spark):
    assert one(spark, invariants.clamp_weight(lit(1 + 1e-10))) == 1.0
    with pytest.raises(Exception, match="out of range"):
        one(spark, invariants.clamp_weight(F.rand() + 1.5))


def test_forbidden_columns(spark):
    df = spark.createDataFrame([(1, "x", None)], "id int, decl_file string, quality_weight double")
    assert lookups.leak_audit(df) == {"decl_file": 1}
    with pytest.raises(ValueError, match="answer"):
        lookups.shown(df, ["id", "decl_file"], "STRICT")


def test_context_levels(spark):
    f = spark.createDataFrame([("b1",), ("b2",)], "body_id string")
    calls = spark.createDataFrame([("b1", [("puts", "DIRECT", True), (None, None, False)])], "body_id string, calls_list array<struct<callee_name:string,call_kind:string,is_external_target:boolean>>")
    cfg = spark.createDataFrame([("b1", (1, 2, None, True, "LOW"))], "body_id string, cfg struct<bb_count:int,edge_count:int,cyclomatic:int,has_indirect_jumps:boolean,cfg_completeness:string>")
    var = spark.createDataFrame([("b1", [("a", None, "LOCAL", "STACK")])], "body_id string, variables_list array<struct<name:string,type_str:string,var_kind:string,storage_class:string>>")
    got = {r.body_id: r for r in lookups.with_context(f, "L2", calls, cfg, var).collect()}
    assert got["b1"].calls == "This function calls:\n  - puts (DIRECT, external)\n  - <indirect call> (UNKNOWN)"
    assert got["b1"].cfg_summary.endswith("Cyclomatic complexity: ?\n  - Has indirect jumps: yes\n  - CFG completeness: LOW")
    assert got["b1"].variables == "Variables:\n  - a: ? (LOCAL, STACK)"
    assert (got["b2"].calls, got["b2"].cfg_summary, got["b2"].variables) == ("(no outgoing calls)", "(no CFG data)", "(no variable data)")
    assert lookups.with_context(f, "L0", calls, cfg, var).first().calls is None


# -- statistics -----------------------------------------------------------------------------------


def test_tails():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(7.814727903251179, 3) == pytest.approx(0.05, abs=1e-9)
    assert stats.normal_tail(1.959963984540054) == pytest.approx(0.025, abs=1e-12)


def test_wilcoxon_exact_and_by_brute_force(spark):
    from itertools import product

    d = np.array([0.5, -1.5, 2.5, 3.5, -0.25, 4.5, 0.0])
    got = stats.wilcoxon_test(spark.createDataFrame([("m", float(x)) for x in d] + [("none", 0.0)], "model string, d double"), ["model"], "d").collect()
    n, w, p = next((r.n, r.w_plus, r.p) for r in got if r.model == "m")
    ranks = np.array([2.0, 3, 4, 5, 1, 6])
    all_w = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in product([0, 1], repeat=6)]
    assert (n, w) == (6, float(ranks[d[:6] > 0].sum()))
    assert p == pytest.approx(sum(x >= w for x in all_w) / 64)
    assert next((r.n, r.p) for r in got if r.model == "none") == (0, None)


def test_group_tests(spark):
    rng = np.random.default_rng(0)
    rows = [("m", f"k{i}", f"O{o}", float(rng.normal(o * 0.5, 1))) for i in range(30) for o in range(4)]
    df = spark.createDataFrame(rows, "model string, key string, opt string, x double")
    f = stats.friedman_test(df, ["model"], "key", "opt", "x").first()
    wide = np.array([[r[3] for r in rows if r[1] == f"k{i}"] for i in range(30)])
    ranks = wide.argsort(axis=1).argsort(axis=1) + 1
    chi2 = 12 / (30 * 4 * 5) * (ranks.sum(axis=0) ** 2).sum() - 3 * 30 * 5
    assert f.chi2 == pytest.approx(chi2) and f.w == pytest.approx(chi2 / 90) and 0 <= f.p <= 1
    k = stats.kruskal_test(df, ["model"], "opt", "x").first()
    flat = np.array([r[3] for r in rows]).argsort().argsort() + 1
    h = 12 / (120 * 121) * sum(flat[[i for i, r in enumerate(rows) if r[2] == f"O{o}"]].sum() ** 2 / 30 for o in range(4)) - 3 * 121
    assert k.h == pytest.approx(h) and k.epsilon2 == pytest.approx(h / 119)
    assert stats.dunn_test(df, ["model"], "opt", "x").count() == 6
    x = np.array([r[3] for r in rows])
    for statistic in ("mean", "median"):
        b = bootstrap.bootstrap_ci(df, ["model"], "x", statistic, resamples=2000).first()
        again = bootstrap.bootstrap_ci(df.repartition(3), ["model"], "x", statistic, resamples=2000).first()
        assert b.low < b.estimate < b.high and tuple(b)[1:] == pytest.approx(tuple(again)[1:])
        drawn = getattr(np, statistic)(x[rng.integers(0, len(x), (2000, len(x)))], axis=1)
        assert b.estimate == pytest.approx(getattr(np, statistic)(x)) and (b.low, b.high) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5])), abs=0.08)
        shifted = [bootstrap.positions(120, r, 0, 120) for r in range(2000)]
        exact = np.percentile(getattr(np, statistic)(np.sort(x)[np.array(shifted)], axis=1), [2.5, 97.5])
        assert (b.low, b.high) == pytest.approx(tuple(exact))
    lone = bootstrap.bootstrap_ci(df.limit(1), ["model"], "x").first()
    assert lone.low is None and lone.n == 1


def test_draws_are_even_and_apart():
    """Chi-square of places, and no two resamples alike or shifted."""
    n = 1000
    drawn = np.array([bootstrap.positions(n, r, 0, n) for r in range(200)])
    assert drawn.min() >= 0 and drawn.max() < n
    counts = np.bincount(drawn.ravel(), minlength=n)
    assert abs(((counts - 200) ** 2 / 200).sum() - n) < 6 * (2 * n) ** 0.5
    for k in range(-3, 4):
        assert np.mean(drawn[:-1] == np.roll(drawn[1:], k, axis=1)) < 0.003
    assert np.array_equal(np.concatenate([bootstrap.positions(n, 7, 0, 300), bootstrap.positions(n, 7, 300, n)]), drawn[7])
    distinct = [len(set(d)) / n for d in drawn]
    assert np.mean(distinct) == pytest.approx(1 - np.exp(-1), abs=0.01)


def test_bootstrap_of_many_blocks(spark, monkeypatch):
    """A group cut into blocks and chunks gives what it gives whole."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([("g", float(v)) for v in rng.normal(size=3000)] + [("h", 1.0), (None, 2.0), (None, 4.0), ("e", None)], "g string, x double")
    whole = {r.g: tuple(r) for r in bootstrap.bootstrap_ci(df, ["g"], "x", resamples=200).collect()}
    monkeypatch.setattr(bootstrap, "BLOCK", 256)
    monkeypatch.setattr(bootstrap, "CHUNK", 60_000)
    monkeypatch.setattr(bootstrap, "PIECE", 1000)
    parts = {r.g: tuple(r) for r in bootstrap.bootstrap_ci(df.repartition(5), ["g"], "x", resamples=200).collect()}
    assert all(a == b or a == pytest.approx(b) for a, b in zip(parts["g"], whole["g"], strict=True))
    assert parts["h"] == ("h", 1, 1.0, None, None) and parts["e"] == ("e", 0, None, None, None)
    assert parts[None][:3] == (None, 2, 3.0) and parts[None][3:] == (2.0, 4.0)


def test_holm_and_kendall(spark):
    df = spark.createDataFrame([("g", 0.01), ("g", 0.04), ("g", 0.03), ("g", 0.9)], "g string, p double")
    got = {r.p: r.p_adjusted for r in stats.holm(df, ["g"], "p").collect()}
    assert got == pytest.approx({0.01: 0.04, 0.03: 0.09, 0.04: 0.09, 0.9: 0.9})
    same = spark.createDataFrame([(j, i, float(i)) for j in range(3) for i in range(5)], "j int, i int, x double")
    assert stats.kendall_w(same, "j", "i", "x").first().w == pytest.approx(1.0)


def test_trajectories(spark):
    df = spark.createDataFrame([("a", "O0", "GOLD", 1.0), ("a", "O1", "SILVER", 0.5), ("a", "O3", "GOLD", 0.5), ("b", "O0", None, 0.0)], "k string, opt string, tier string, x double")
    assert {r.k: r.signature for r in trajectory.signatures(df, "k").collect()} == {"a": "GOLD → SILVER → — → GOLD", "b": "— → — → — → —"}
    assert [(r.opt, r.next_opt, r.kind, r.delta) for r in trajectory.transition_types(df, "k", "x").orderBy("opt").collect()] == [("O0", "O1", "down", -0.5), ("O1", "O3", "up", 0.0)]
    assert trajectory.tier_changes(df, "k").first().n_changes == 2


def test_best_of_k(spark):
    df = spark.createDataFrame([(["a_b", "x_y", "y_x"], "x_y"), ([], "x")], "candidates array<string>, ground_truth string")
    a, b = scoring.best_of_k(df).collect()
    assert (a.f1_topk, a.best_index, a.exact_topk, a.uplift) == (1.0, 1, True, 1.0)
    assert (b.f1_topk, b.best_index, b.exact_topk, b.uplift) == (0.0, 0, False, 0.0)


def test_matrix(spark):
    m = matrix.build_matrix(spark, {"a": "x/a", "b": "y/b"}, ["GOLD", "SILVER"], ["O0", "O1"], ["L2"], 3)
    assert m.count() == m.select("experiment_id").distinct().count() == 8
    cost = matrix.estimate_cost(m, [(0.5, ["x/"])], 10.0, 100, 1000).groupBy("model").agg(F.sum("cost").alias("c")).collect()
    assert {r.model: round(r.c, 6) for r in cost} == {"x/a": 0.2, "y/b": 4.0}
    reg = spark.createDataFrame([(1, "naming", "READY", ["p", "q"]), (2, "naming", "DONE", ["q"])], "id int, task string, status string, tags array<string>")
    assert [r.id for r in matrix.find(reg, "naming", tag="p").collect()] == [1] and matrix.find(reg).count() == 2


# -- sources, sinks, streams -----------------------------------------------------------------------


def test_readers(spark, tmp_path):
    cell = tmp_path / "t1" / "O0" / "debug" / "oracle"
    cell.mkdir(parents=True)
    (cell / "f.jsonl").write_text('{"a": 1, "zz": 2}\n\nnot json\n{"a": 3}\n')
    (cell / "good.json").write_text('{\n "a": 5\n}')
    schema = readers.T.StructType([readers.T.StructField("a", readers.T.LongType())])
    path = str(cell / "f.jsonl")
    assert sorted(r.a for r in readers.json_lines(spark, path, schema, strict=False).collect()) == [1, 3]
    assert readers.bad_lines(spark, path, schema).collect()[0].value == "not json"
    with pytest.raises(Exception):  # noqa: B017
        readers.json_lines(spark, path, schema).collect()
    assert readers.json_documents(spark, str(tmp_path / "none"), schema).count() == 0
    row = readers.tree_columns(readers.json_documents(spark, str(cell / "good.json"), schema)).first()
    assert (row.a, row.test_case, row.opt, row.variant) == (5, "t1", "O0", "debug")
    assert readers.discover(spark, str(tmp_path)) == ["t1"] and readers.discover(spark, str(tmp_path / "none")) == []
    assert readers.texts(spark, str(cell / "good.json")).first().tu == "good.json"


def test_tagged_lines_and_versions(spark):
    df = spark.createDataFrame([(None, 9, None), ("function", 3, "n"), ("summary", None, None)], "_type string, entry_va int, name string")
    functions, summaries = readers.tagged_lines(df, {"name": F.lit("?")})
    assert [(r.entry_va, r.name) for r in functions.collect()] == [(3, "n"), (9, "?")] and summaries.count() == 1
    versions = spark.createDataFrame([("0.10",), ("0.2",)], "schema_version string")
    assert readers.require_version(versions, "0.2").count() == 2
    with pytest.raises(Exception, match="schema version"):
        readers.require_version(versions, "0.3").collect()


def test_cells_and_hashes(spark):
    a = spark.createDataFrame([("t", "O0", "x"), ("t", "O1", "y")], "test_case string, opt string, binary_sha256 string")
    assert readers.complete_cells({"a": a, "b": a.filter("opt = 'O1'")}, ["test_case", "opt"]).collect()[0].opt == "O1"
    assert readers.sha_mismatches(a, a.withColumn("binary_sha256", F.lit("x")), ["test_case", "opt"]).collect()[0].opt == "O1"
    receipt = spark.createDataFrame([("j", "t", [("O0", "debug", "OK", ("s", 5, None)), ("O1", "debug", "FAIL", None)])], "job_id string, test_case string, builds array<struct<opt:string,variant:string,status:string,artifact:struct<sha256:string,size_bytes:int,has_debug:boolean>>>")
    assert [(r.opt, r.sha256, r.has_debug) for r in readers.receipt_builds(receipt).collect()] == [("O0", "s", False), ("O1", None, False)]


def test_idempotent_append(spark, tmp_path):
    path = str(tmp_path / "results")
    batch = spark.createDataFrame([("e", "j1", 1), ("e", "j1", 2), ("e", "j2", 3)], "experiment_id string, job_id string, pos int")
    assert sinks.append_new(spark, batch, path, ["job_id"], "pos") == (2, 1)
    assert sinks.append_new(spark, batch, path, ["job_id"], "pos") == (0, 3)
    assert {(r.job_id, r.pos) for r in spark.read.parquet(path).collect()} == {("j1", 1), ("j2", 3)}
    with pytest.raises(ValueError):
        sinks.append_new(spark, batch.limit(0), path, ["job_id"], "pos")
    with pytest.raises(ValueError):
        sinks.append_new(spark, batch.withColumn("experiment_id", F.col("job_id")), path, ["job_id"], "pos")


def test_rewrite_and_registry(spark, tmp_path):
    path = str(tmp_path / "table")
    spark.range(5).write.parquet(path)
    sinks.rewrite(spark, spark.read.parquet(path).filter("id > 2"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [3, 4]
    sinks.write_bundle(spark.range(6).withColumn("k", F.col("id") % 2), str(tmp_path / "bundle"), ["id"], ["k"])
    assert spark.read.parquet(str(tmp_path / "bundle")).filter("k = 1").count() == 3
    runs = sinks.RunRegistry(spark, str(tmp_path / "runs"))
    runs.create("r")
    with pytest.raises(ValueError):
        runs.create("r")
    runs.patch("r", completed=7, increment=2, error="e")
    assert runs.get("r") == {"run_id": "r", "status": "RUNNING", "completed": 2, "errors": ["e"]}
    with pytest.raises(KeyError):
        runs.patch("x")


def test_streams(spark, tmp_path):
    from lodestone.streaming import results

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "event_type", "user_id", "ts")
    source = str(tmp_path / "in")
    events.repartition(3).write.parquet(source)
    schema = "event_id bigint, event_type string, user_id bigint, ts timestamp"
    out = str(tmp_path / "out")
    for n in range(2):  # a second stream over the same files adds nothing
        q = results.append_stream(results.read_stream(spark, source, schema, 1), out, str(tmp_path / f"cp{n}"), ["event_type", "user_id"], "event_type")
        q.awaitTermination()
    assert spark.read.parquet(out).count() == events.select("event_type", "user_id").distinct().count()
    counts = results.windowed_counts(results.once(results.read_stream(spark, source, schema), ["event_id"], "ts"), "ts", ["event_type"], "1 day")
    q = counts.writeStream.outputMode("append").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").schema.fieldNames() == ["window_start", "event_type", "n"]


# -- sources and sinks ------------------------------------------------------------------


def test_receipts_and_datasets_refuse_what_is_wrong(spark, tmp_path):
    from lodestone.sources import artifacts

    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "build_receipt.json").write_text('{"job": {"job_id": "j"}}')
    with pytest.raises(Exception, match="receipt without job or builds"):
        artifacts.receipts(spark, str(tmp_path), ["t1"]).collect()
    with pytest.raises(ValueError, match="none of"):
        artifacts.select_cases(spark, str(tmp_path), ["t9"])
    wanted = spark.createDataFrame([("t1", "x")], "test_case string, binary_sha256 string")
    (tmp_path / "t1" / "build_receipt.json").write_text('{"job": {"job_id": "j"}, "builds": [{"optimization": "O0"}]}')
    builds = artifacts.build_rows(artifacts.receipts(spark, str(tmp_path), ["t1"]))
    assert builds.first().has_debug is False and builds.first().sha256 is None
    with pytest.raises(Exception, match="no build with the hash"):
        artifacts.resolve_builds(wanted, builds).collect()
    empty = artifacts.load_dataset(spark, str(tmp_path), ["A"])
    assert empty.pairs.count() == empty.reports.count() == 0 and empty.builds.count() == 1


def test_unit_texts_replace_bad_bytes(spark, tmp_path):
    from lodestone.sources import readers

    (tmp_path / "a.i").write_bytes(b"x\xff\ny")
    assert [tuple(r) for r in readers.texts(spark, str(tmp_path)).collect()] == [("a.i", "x�\ny")]


def test_rewrite_survives_an_interruption(spark, tmp_path):
    from lodestone.sources import sinks

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # as if the second rename had not come
    sinks.restore(spark, path)
    assert spark.read.parquet(path).count() == 3
    sinks.rewrite(spark, spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_page_bounds(spark):
    rows = spark.range(5)
    assert [r.id for r in lookups.page(rows, ["id"], 1, 2).collect()] == [1, 2]
    for offset, limit in ((0, 0), (0, 10_001), (-1, 5)):
        with pytest.raises(ValueError, match="limit"):
            lookups.page(rows, ["id"], offset, limit)


def test_csv_keeps_nulls_empty_texts_and_breaks(spark, tmp_path):
    from lodestone.sources import sinks

    given = [(1, None), (2, ""), (3, 'a "b"\nc, d'), (4, "\\N")]
    sinks.write_csv(spark.createDataFrame(given[:3], "id bigint, s string"), str(tmp_path / "c"), ["id"])
    assert sorted(tuple(r) for r in sinks.read_csv(spark, str(tmp_path / "c"), "id bigint, s string").collect()) == given[:3]


def test_quantiles_over_counts_equal_sorted_lists(spark):
    import math
    import random

    rng = random.Random(8)
    groups = {"a": [rng.randint(1, 5) for _ in range(37)], "b": [3], "c": [rng.randint(1, 900) for _ in range(200)], "d": [0, 7, 7]}
    df = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v], "g string, x bigint")
    nearest = {r.g: r for r in quantile.nearest_rank(df, ["g"], "x", [0.25, 0.5, 0.9, 1.0]).collect()}
    p90 = {r.g: r.p90 for r in quantile.exclusive_p90(df, ["g"], "x").collect()}
    for g, v in groups.items():
        v = sorted(v)
        assert [nearest[g][f"p{q}"] for q in (25, 50, 90, 100)] == [v[min(int(q * len(v)), len(v) - 1)] for q in (0.25, 0.5, 0.9, 1.0)]
        up = [x for x in v if x > 0]
        place = 0.9 * (len(up) + 1)
        j = min(max(1, math.floor(place + 1e-9)), len(up) - 1)
        want = up[0] if len(up) == 1 else up[j - 1] + (up[j] - up[j - 1]) * (place - j)
        assert p90[g] == pytest.approx(want)


def test_elf_files(spark, tmp_path):
    import struct
    import sys

    from lodestone.sources import binaries

    own = binaries.parse_elf(open(sys.executable, "rb").read())
    assert own["type"] in ("EXEC", "DYN") and (not own["sections"] or ".text" in own["sections"])
    note = struct.pack("<III", 4, 3, 3) + b"GNU\0" + b"\x01\x02\xff"
    names = b"\0.shstrtab\0.note.gnu.build-id\0.debug_info\0"
    body = names + note
    heads = [(0, 0, 0), (1, 64, len(names)), (11, 64 + len(names), len(note)), (names.index(b".debug"), 64, 0)]
    table = b"".join(struct.pack("<II16xQQ24x", n, 1, at, size) for n, at, size in heads)
    head = b"\x7fELF\x02\x01\x01" + bytes(9) + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 0, 64 + len(body), 0, 64, 0, 0, 64, 4, 1)
    elf = head + body + table
    assert binaries.parse_elf(elf) == {"type": "DYN", "arch": "x86_64", "sections": [".debug_info", ".note.gnu.build-id", ".shstrtab"], "build_id": "0102ff", "has_debug": True}
    assert binaries.parse_elf(b"MZ") is None and binaries.parse_elf(elf[:80])["sections"] == []
    (tmp_path / "x").write_bytes(elf)
    (tmp_path / "y").write_bytes(b"MZ")
    assert {r.file: r.elf and r.elf.build_id for r in binaries.scan_binaries(spark, str(tmp_path)).collect()} == {"x": "0102ff", "y": None}


def test_latex_table(spark):
    from lodestone.sources import sinks

    df = spark.createDataFrame([("b_1", 2), ("a&\\", None)], "name string, n bigint")
    assert sinks.latex_table(df, ["name"]).split("\n") == [r"\begin{tabular}{lr}", r"\hline", r"name & n \\", r"\hline", r"a\&\textbackslash{} & -- \\", r"b\_1 & 2 \\", r"\hline", r"\end{tabular}"]
    with pytest.raises(ValueError, match="no report"):
        sinks.latex_table(df, ["name"], 1)
