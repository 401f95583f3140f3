"""Queries of classification, reports, rates, transitions and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy
from ..operators import invariants, quantile, rates, report, scoring, transitions
from .queries_core import _AUX, _EXACT, _GOLD, _SCORED, _SCORES, _TRIVIAL, _UNIT, MATCH_KIND
from .registry import query
from .views import Catalog


def classified(v: Catalog) -> DataFrame:
    rows = v("joined_raw").withColumn("warning_tags", F.filter(F.split("warning_text", ","), lambda w: w != ""))
    return report.classify(rows)


_FATAL = "(contains(warning_text, 'DECOMPILE_TIMEOUT') OR contains(warning_text, 'UNRESOLVED_INDIRECT_JUMP'))"
_J = f"""j0 AS (SELECT *, {MATCH_KIND} AS match_kind, {_GOLD} AS gold, {_AUX} AS aux, {_FATAL} AS fatal, CASE WHEN align_verdict = 'MATCH' AND n_candidates > 0 THEN overlap_ratio / n_candidates ELSE 0.0 END AS quality_weight,
    has_range AND NOT is_non_target AS for_join, CASE WHEN NOT has_range THEN 'NO_RANGE' WHEN is_non_target THEN 'NON_TARGET' END AS exclusion FROM joined_raw),
  j AS (SELECT *, CASE WHEN oracle_verdict <> 'ACCEPT' THEN 'ORACLE_NOT_ACCEPT' WHEN align_verdict IS NULL OR align_verdict <> 'MATCH' THEN 'ALIGN_NOT_MATCH' WHEN n_candidates IS NULL OR n_candidates <> 1 THEN 'ALIGN_NOT_UNIQUE'
    WHEN overlap_ratio IS NULL OR overlap_ratio < 0.95 THEN 'ALIGN_RATIO_LOW' WHEN match_kind <> 'JOINED_STRONG' THEN 'NOT_JOINED_STRONG' WHEN is_external OR is_thunk OR aux OR is_plt THEN 'IS_NOISE_FUNCTION'
    WHEN cfg_completeness = 'LOW' THEN 'CFG_LOW' WHEN fatal THEN 'FATAL_WARNING' END AS reject_reason FROM j0),
  t AS (SELECT *, CASE WHEN reject_reason IS NULL THEN 'GOLD' WHEN match_kind = 'JOINED_STRONG' AND gold THEN 'SILVER' WHEN match_kind IN ('JOINED_STRONG', 'JOINED_WEAK') THEN 'BRONZE' ELSE '' END AS tier FROM j)"""


@query(f"SELECT * FROM (WITH {_J} SELECT function_id, reject_reason, reject_reason IS NULL AS is_high_confidence, tier, quality_weight FROM t) AS q")
def F27_high_confidence(v: Catalog) -> DataFrame:
    return classified(v).select("function_id", "reject_reason", "is_high_confidence", "tier", "quality_weight")


@query(f"""SELECT * FROM (WITH {_J} SELECT function_id, CASE WHEN NOT has_range THEN 'NO_DWARF_RANGE' WHEN is_non_target THEN 'ALIGNMENT_NON_TARGET' WHEN oracle_verdict = 'REJECT' THEN 'DWARF_ORACLE_REJECT' END AS upstream_collapse,
  concat_ws(',', CASE WHEN cfg_completeness = 'LOW' THEN 'CFG_LOW' END, CASE WHEN fatal THEN 'FATAL_WARNING' END, CASE WHEN goto_count / CAST(c_lines AS DOUBLE) > 0.1 THEN 'HIGH_GOTO_DENSITY' END, CASE WHEN placeholder_rate > 0.3 THEN 'HIGH_PLACEHOLDER_TYPES' END) AS quality_flags FROM t) AS q""")
def F28_collapse_and_flags(v: Catalog) -> DataFrame:
    return classified(v).select("function_id", "upstream_collapse", F.array_join("quality_flags", ",").alias("quality_flags"))


@query(f"SELECT * FROM (WITH {_J} SELECT opt, count(*) AS n, count(*) FILTER (match_kind = 'JOINED_STRONG') AS joined_strong, count(*) FILTER (match_kind = 'JOINED_WEAK') AS joined_weak, count(*) FILTER (match_kind = 'MULTI_MATCH') AS multi_match, count(*) FILTER (match_kind = 'NO_MATCH') AS no_match, count(*) FILTER (match_kind = 'NO_RANGE') AS no_range FROM t GROUP BY opt) AS q")
def A10_yield(v: Catalog) -> DataFrame:
    return report.yield_counts(classified(v), ["opt"])


@query(f"SELECT * FROM (WITH {_J} SELECT test_case, opt, count(*) AS n_total, count(*) FILTER (for_join) AS n_eligible_join, count(*) FILTER (gold) AS n_eligible_gold, count(*) FILTER (exclusion = 'NO_RANGE') AS n_no_range, count(*) FILTER (exclusion = 'NON_TARGET') AS n_non_target FROM t GROUP BY test_case, opt) AS q")
def A11_exclusions(v: Catalog) -> DataFrame:
    return report.exclusion_summary(classified(v), ["test_case", "opt"])


@query(f"SELECT *, n_high / CAST(greatest(n_gold, 1) AS DOUBLE) AS rate FROM (WITH {_J} SELECT opt, count(*) FILTER (gold) AS n_gold, count(*) FILTER (gold AND reject_reason IS NULL) AS n_high FROM t GROUP BY opt) AS q")
def A12_high_confidence_rates(v: Catalog) -> DataFrame:
    return report.high_confidence_rates(classified(v), ["opt"])


_STEPS = ["n_pass_oracle_accept", "n_pass_align_match", "n_pass_align_unique", "n_pass_align_ratio", "n_pass_joined_strong", "n_pass_not_noise", "n_pass_cfg_not_low", "n_pass_no_fatal_warnings"]
_PLACE = "CASE reject_reason WHEN 'ORACLE_NOT_ACCEPT' THEN 0 WHEN 'ALIGN_NOT_MATCH' THEN 1 WHEN 'ALIGN_NOT_UNIQUE' THEN 2 WHEN 'ALIGN_RATIO_LOW' THEN 3 WHEN 'NOT_JOINED_STRONG' THEN 4 WHEN 'IS_NOISE_FUNCTION' THEN 5 WHEN 'CFG_LOW' THEN 6 WHEN 'FATAL_WARNING' THEN 7 ELSE 8 END"


@query(f"SELECT * FROM (WITH {_J} SELECT opt, count(*) FILTER (gold) AS n_eligible_for_gold, {', '.join(f'count(*) FILTER (gold AND {_PLACE} > {k}) AS {n}' for k, n in enumerate(_STEPS))}, count(*) FILTER (gold AND reject_reason IS NULL) AS n_high_confidence FROM t GROUP BY opt) AS q")
def A13_funnel(v: Catalog) -> DataFrame:
    return report.funnel(classified(v), ["opt"])


@query("SELECT count(*) AS n_matched, count(*) FILTER (n >= 2) AS n_multi, max(n) AS max_per_body FROM (SELECT body_id, count(*) AS n FROM joined_raw WHERE body_id IS NOT NULL GROUP BY body_id) AS q")
def A14_collisions(v: Catalog) -> DataFrame:
    return report.collisions(v("joined_raw"))


@query("SELECT body_id, count(*) AS n, string_agg(CAST(function_id AS VARCHAR), ',' ORDER BY function_id) AS ids FROM joined_raw WHERE body_id IS NOT NULL GROUP BY body_id HAVING count(*) >= 2 ORDER BY n DESC, body_id LIMIT 5")
def A14_top_collisions(v: Catalog) -> DataFrame:
    return report.top_collisions(v("joined_raw"))


_DIMS = f"""d AS (SELECT unnest([{{'dimension': 'align_verdict', 'value': CASE WHEN exclusion IS NOT NULL THEN concat('EXCLUDED_', exclusion) ELSE coalesce(align_verdict, 'NONE') END}},
  {{'dimension': 'n_candidates', 'value': CASE WHEN n_candidates IS NULL THEN 'none' WHEN n_candidates = 1 THEN '1' WHEN n_candidates <= 3 THEN '2-3' ELSE '4+' END}},
  {{'dimension': 'quality_weight', 'value': CASE WHEN align_verdict = 'MATCH' THEN {_UNIT.format('quality_weight')} WHEN NOT has_range THEN 'none_no_range' ELSE 'none_not_match' END}},
  {{'dimension': 'overlap_ratio', 'value': {_UNIT.format('overlap_ratio')}}}, {{'dimension': 'opt', 'value': opt}}, {{'dimension': 'match_kind', 'value': match_kind}}]) AS p FROM t)"""


@query(f"SELECT * FROM (WITH {_J}, {_DIMS} SELECT p.dimension AS dimension, p.value AS value, count(*) AS n FROM d GROUP BY 1, 2) AS q")
def A15_histograms(v: Catalog) -> DataFrame:
    return report.histograms(classified(v), report.standard_dimensions())


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(warning_text, ',')) AS tag FROM joined_raw) AS q WHERE tag <> '' GROUP BY tag")
def A15_tags(v: Catalog) -> DataFrame:
    return report.tag_histogram(classified(v), "warning_tags")


@query(f"SELECT * FROM (WITH {_J} SELECT count(*) FILTER (quality_weight > 1) AS n_over, count(*) FILTER (quality_weight < 0) AS n_under, round_even(greatest(max(quality_weight), 0), 9) AS max_weight FROM t) AS q")
def A16_weight_audit(v: Catalog) -> DataFrame:
    return report.weight_audit(classified(v))


_RANK = "max(CASE WHEN i = least(CAST(floor({1} * n) AS BIGINT), n - 1) THEN {0} END)"


@query(f"""SELECT opt, {', '.join(f"CAST({_RANK.format('bb_count', q)} AS DOUBLE) AS p{p}" for q, p in ((0.25, 25), (0.5, 50), (0.75, 75), (0.9, 90)))}
  FROM (SELECT opt, bb_count, row_number() OVER (PARTITION BY opt ORDER BY bb_count) - 1 AS i, count(*) OVER (PARTITION BY opt) AS n FROM joined_raw) AS x GROUP BY opt""")
def Q1_nearest_rank(v: Catalog) -> DataFrame:
    return quantile.nearest_rank(v("joined_raw"), ["opt"], "bb_count", [0.25, 0.5, 0.75, 0.9])


@query("SELECT test_case, quantile_cont(CAST(size_bytes AS DOUBLE), 0.75) AS p75, median(CAST(size_bytes AS DOUBLE)) AS p50 FROM joined_raw GROUP BY test_case")
def Q2_linear_and_median(v: Catalog) -> DataFrame:
    return v("joined_raw").groupBy("test_case").agg(quantile.linear(F.col("size_bytes"), 0.75).alias("p75"), quantile.median(F.col("size_bytes")).alias("p50"))


_P90 = """SELECT test_case, CASE WHEN n = 1 THEN CAST(max(size_bytes) AS DOUBLE) ELSE (sum(CASE WHEN i = j THEN size_bytes * (10 - r) WHEN i = j + 1 THEN size_bytes * r END)) / 10.0 END AS p90 FROM (
  SELECT *, 9 * (n + 1) - 10 * j AS r FROM (SELECT *, greatest(1, least(CAST(floor(9 * (n + 1) / 10) AS BIGINT), n - 1)) AS j FROM (
    SELECT test_case, size_bytes, row_number() OVER (PARTITION BY test_case ORDER BY size_bytes) AS i, count(*) OVER (PARTITION BY test_case) AS n FROM joined_raw WHERE size_bytes > 0) AS a) AS b) AS c GROUP BY test_case, n"""


@query(f"SELECT test_case, CAST(p90 AS DOUBLE) AS p90 FROM ({_P90}) AS q")
def Q3_exclusive_p90(v: Catalog) -> DataFrame:
    return quantile.exclusive_p90(v("joined_raw"), ["test_case"], "size_bytes")


@query(f"SELECT f.test_case, count(*) FILTER (size_bytes > p90 OR bb_count > 50 OR temp_vars > 20 OR placeholder_rate > 5) AS n_fat, count(*) AS n FROM joined_raw f JOIN ({_P90}) AS q ON f.test_case = q.test_case GROUP BY f.test_case")
def A21_fat_functions(v: Catalog) -> DataFrame:
    rows = v("joined_raw")
    p90 = quantile.exclusive_p90(rows, ["test_case"], "size_bytes")
    fat = policy.is_fat(F.col("size_bytes"), F.col("bb_count"), F.col("temp_vars"), F.col("placeholder_rate"), F.col("p90"))
    return rows.join(p90, "test_case").groupBy("test_case").agg(F.count_if(fat).alias("n_fat"), F.count("*").alias("n"))


@query(f"""SELECT * FROM (WITH {_J} SELECT opt, sum(CASE WHEN cfg_completeness = 'HIGH' THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS cfg_high, count(*) FILTER (fatal) AS n_fatal, count(*) FILTER (goto_count = 0) AS n_clean FROM t GROUP BY opt) AS q""")
def A17_decompiler_distributions(v: Catalog) -> DataFrame:
    fatal = F.arrays_overlap("warning_tags", F.array(*[F.lit(w) for w in policy.PROFILE.fatal_warnings]))
    return classified(v).groupBy("opt").agg(F.avg((F.col("cfg_completeness") == "HIGH").cast("int")).alias("cfg_high"), F.count_if(fatal).alias("n_fatal"), F.count_if(F.col("goto_count") == 0).alias("n_clean"))


_TIERS = ", ".join(f"count(*) FILTER (tier = '{'' if t == 'NONE' else t}') AS \"{t}\"" for t in ("GOLD", "SILVER", "BRONZE", "NONE"))


@query(f"SELECT * FROM (WITH {_J} SELECT test_case, opt, {_TIERS} FROM t GROUP BY test_case, opt) AS q")
def A19_tier_counts(v: Catalog) -> DataFrame:
    return report.tier_counts(classified(v), ["test_case", "opt"])


@query("SELECT test_case, count(*) FILTER (oracle_verdict = 'ACCEPT') AS accept, count(*) FILTER (oracle_verdict = 'WARN') AS warn, count(*) FILTER (oracle_verdict = 'REJECT') AS reject, count(*) AS total FROM fn GROUP BY test_case")
def A22_function_counts(v: Catalog) -> DataFrame:
    c = [F.count_if(F.col("oracle_verdict") == x).alias(x.lower()) for x in ("ACCEPT", "WARN", "REJECT")]
    return v("fn").groupBy("test_case").agg(*c, F.count("*").alias("total")).filter("accept + warn + reject = total")


@query("SELECT DISTINCT decl_file, name FROM (SELECT decl_file, name, count(*) OVER (PARTITION BY decl_file, name) AS n FROM fn WHERE name IS NOT NULL AND decl_file IS NOT NULL) AS q WHERE n > 1")
def A23_duplicate_names(v: Catalog) -> DataFrame:
    return invariants.duplicate_ids(v("fn").filter("name IS NOT NULL AND decl_file IS NOT NULL"), ["decl_file", "name"]).select("decl_file", "name")


# -- scores by stratum -----------------------------------------------------------------

_S = f"""{_SCORED}, sc AS (SELECT *, {_EXACT} AS exact_match, {_TRIVIAL} AS is_trivial, {_SCORES}, {_UNIT.format('f1')} AS weight_bin FROM scored)"""
_ROLL = "count(*) AS n, avg(CASE WHEN exact_match THEN 1 ELSE 0 END) AS exact_rate, avg(token_precision) AS mean_precision, avg(token_recall) AS mean_recall, avg(token_f1) AS mean_f1, avg(CASE WHEN is_trivial THEN 1 ELSE 0 END) AS trivial_rate"
#: Sums of doubles depend on their order; scaled to whole numbers they don't.
_EXACT_ROLL = "count(*) AS n, count(*) FILTER (exact_match) AS n_exact, count(*) FILTER (is_trivial) AS n_trivial, CAST(sum(CAST(round(token_f1 * 1000000) AS BIGINT)) AS BIGINT) AS f1_micros"


def scored(v: Catalog) -> DataFrame:
    return scoring.with_weight_bin(scoring.score(v("pred")), "f1")


@query(f"SELECT * FROM (WITH {_S} SELECT model, {_EXACT_ROLL} FROM sc GROUP BY model) AS q")
def A08_score_rollup(v: Catalog) -> DataFrame:
    micros = F.round(F.col("token_f1") * 1000000).cast("long")
    return scored(v).groupBy("model").agg(F.count("*").alias("n"), F.count_if("exact_match").alias("n_exact"), F.count_if("is_trivial").alias("n_trivial"), F.sum(micros).alias("f1_micros"))


@query(f"""SELECT stratum, value, n, round(exact_rate * n) AS n_exact, round(trivial_rate * n) AS n_trivial, round(mean_f1, 9) AS mean_f1, round(mean_precision, 9) AS mean_precision, round(mean_recall, 9) AS mean_recall FROM (WITH {_S}
  SELECT 'overall' AS stratum, 'all' AS value, {_ROLL} FROM sc UNION ALL SELECT 'opt', coalesce(opt, 'UNKNOWN'), {_ROLL} FROM sc GROUP BY 2 UNION ALL SELECT 'tier', coalesce(tier, 'UNKNOWN'), {_ROLL} FROM sc GROUP BY 2
  UNION ALL SELECT 'weight_bin', weight_bin, {_ROLL} FROM sc GROUP BY 2 UNION ALL SELECT 'test_case', test_case, {_ROLL} FROM sc GROUP BY 2) AS q""")
def A09_stratified_report(v: Catalog) -> DataFrame:
    r = scoring.stratified_report(scored(v), ["opt", "tier", "weight_bin", "test_case"])
    means = [F.round(c, 9).alias(c) for c in ("mean_f1", "mean_precision", "mean_recall")]
    return r.select("stratum", "value", "n", F.round(F.col("exact_rate") * F.col("n")).alias("n_exact"), F.round(F.col("trivial_rate") * F.col("n")).alias("n_trivial"), *means)


def _one_f1(c: str) -> str:
    from .queries_core import _tokens

    p, g = f"list_distinct({_tokens(c)})", f"list_distinct({_tokens('ground_truth')})"
    return f"CASE WHEN len(list_intersect({p}, {g})) > 0 THEN 2 * len(list_intersect({p}, {g})) / CAST(len({p}) + len({g}) AS DOUBLE) ELSE 0.0 END"


@query(f"""SELECT job, predicted, f1_topk, coalesce(exact_topk, false) AS exact_topk, CASE WHEN a = f1_topk THEN 0 WHEN b = f1_topk THEN 1 ELSE 2 END AS best_index, f1_topk - a AS uplift FROM (
  SELECT *, greatest(a, b, c) AS f1_topk, {_EXACT} OR replace(replace(lower(second), '_', ''), '-', '') = replace(replace(lower(ground_truth), '_', ''), '-', '') OR replace(replace(lower(third), '_', ''), '-', '') = replace(replace(lower(ground_truth), '_', ''), '-', '') AS exact_topk
  FROM (SELECT *, {_one_f1('predicted')} AS a, {_one_f1('second')} AS b, {_one_f1('third')} AS c FROM pred) AS x) AS y""")
def W06_best_of_k(v: Catalog) -> DataFrame:
    rows = scoring.best_of_k(v("pred").withColumn("candidates", F.array("predicted", "second", "third")))
    return rows.select("job", "predicted", "f1_topk", "exact_topk", F.col("best_index").cast("int").alias("best_index"), "uplift")


_DIFF = "len(list_filter(g, lambda t: list_contains(p, t))) AS n_matched, len(list_filter(g, lambda t: NOT list_contains(p, t))) AS n_missed, len(list_filter(p, lambda t: NOT list_contains(g, t))) AS n_extra"


@query(f"SELECT job, predicted, quantity, {_DIFF} FROM (WITH {_SCORED} SELECT * FROM scored) AS s")
def U08_token_differences(v: Catalog) -> DataFrame:
    d = scoring.token_differences(scoring.score(v("pred")))
    return d.select("job", "predicted", "quantity", *[F.size(c).cast("long").alias(f"n_{c}") for c in ("matched", "missed", "extra")])


@query(f"SELECT job, predicted, quantity FROM (WITH {_S} SELECT * FROM sc) AS q WHERE exact_match")
def P15_exact_cases(v: Catalog) -> DataFrame:
    return scored(v).filter("exact_match").select("job", "predicted", "quantity")


# -- rates and shifts -------------------------------------------------------------------

_RATE = "100.0 * {0} / CAST(CASE WHEN {1} = 0 THEN 1 ELSE {1} END AS DOUBLE) AS {0}_rate"


@query(f"SELECT test_case, opt, {', '.join(_RATE.format(c, '(accept + warn + reject)') for c in ('accept', 'warn', 'reject'))}, {', '.join(_RATE.format(c, '(match + ambiguous + no_match + non_target)') for c in ('match', 'ambiguous', 'no_match', 'non_target'))} FROM reports")
def A05_verdict_rates(v: Catalog) -> DataFrame:
    r = rates.verdict_rates(v("reports"))
    return r.select("test_case", "opt", *[c for c in r.columns if c.endswith("_rate")])


@query("SELECT function_id, CASE WHEN c_lines > 10 THEN goto_count / CAST(c_lines AS DOUBLE) END AS gap_rate, CASE WHEN align_verdict = 'MATCH' THEN least(1.0, greatest(0.0, overlap_ratio / CASE WHEN n_candidates = 0 THEN 1 ELSE n_candidates END)) ELSE 0.0 END AS quality_weight FROM joined_raw")
def A07_enrich(v: Catalog) -> DataFrame:
    rows = v("joined_raw").withColumn("total_count", F.when(F.col("c_lines") > 10, F.col("c_lines")).otherwise(0)).withColumn("gap_count", F.col("goto_count"))
    return rates.enrich_pairs(rows).select("function_id", "gap_rate", "quality_weight")


_SIDE = "CAST(coalesce(sum(CASE WHEN opt = '{0}' THEN c END), 0) AS BIGINT) AS count_{1}, round_even(coalesce(sum(CASE WHEN opt = '{0}' THEN share END), 0.0), 2) AS share_{1}"


@query(f"""SELECT reason, concat('Reason ', substring(reason, 8, 9)) AS label, count_a, count_b, share_a, share_b, round_even(share_b - share_a, 2) AS delta_pp FROM (SELECT reason, {_SIDE.format('O0', 'a')}, {_SIDE.format('O3', 'b')} FROM (
  SELECT r.opt, reason, sum(r.n) AS c, 100.0 * sum(r.n) / CAST(max(p.n) AS DOUBLE) AS share FROM reasons r JOIN (SELECT opt, sum(n) AS n FROM pairs_n GROUP BY opt) p ON p.opt = r.opt WHERE r.opt IN ('O0', 'O3') GROUP BY r.opt, reason) AS x GROUP BY reason) AS y""")
def A06_reason_shift(v: Catalog) -> DataFrame:
    return rates.reason_shift(v("reasons"), v("pairs_n"), "O0", "O3")


@query(f"""SELECT reason, concat('Reason ', substring(reason, 8, 9)) AS label, count_a, count_b, share_a, share_b, round_even(share_b - share_a, 2) AS delta_pp FROM (SELECT reason, {_SIDE.format('O0', 'a')}, {_SIDE.format('O3', 'b')} FROM (
  SELECT r.opt, reason, sum(r.n) AS c, sum(100.0 * r.n / CAST(p.n AS DOUBLE)) / max(k.k) AS share FROM reasons r JOIN pairs_n p ON p.opt = r.opt AND p.test_case = r.test_case JOIN (SELECT opt, count(*) AS k FROM pairs_n GROUP BY opt) k ON k.opt = r.opt
  WHERE r.opt IN ('O0', 'O3') GROUP BY r.opt, reason) AS x GROUP BY reason) AS y""")
def A06_reason_shift_macro(v: Catalog) -> DataFrame:
    return rates.reason_shift(v("reasons"), v("pairs_n"), "O0", "O3", averaging="macro")


# -- transitions -------------------------------------------------------------------------

_KEYED = """k AS (SELECT *, CASE WHEN decl_file IS NOT NULL AND decl_line IS NOT NULL THEN concat(coalesce(test_case, ''), '|', decl_file, '|', decl_line, '|', coalesce(CAST(decl_column AS VARCHAR), ''), '|', lower(trim(coalesce(name, '')))) END AS mk FROM fn)"""
_T = f"""{_KEYED}, m AS (SELECT coalesce(a.test_case, b.test_case) AS test_case, coalesce(a.name, b.name) AS name, coalesce(a.decl_file, b.decl_file) AS decl_file, coalesce(a.decl_line, b.decl_line) AS decl_line, coalesce(a.decl_column, b.decl_column) AS decl_column,
    coalesce(a.verdict, 'ABSENT') AS verdict_a, coalesce(b.verdict, 'ABSENT') AS verdict_b, a.overlap AS overlap_a, b.overlap AS overlap_b, a.gap AS gap_a, b.gap AS gap_b, a.function_id AS id_a, b.function_id AS id_b
    FROM (SELECT * FROM k WHERE opt = 'O0') a FULL JOIN (SELECT * FROM k WHERE opt = 'O3') b ON a.mk = b.mk),
  o AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY test_case, name, decl_file, decl_line, decl_column ORDER BY overlap_a ASC NULLS FIRST, overlap_b ASC NULLS FIRST, id_a ASC NULLS FIRST, id_b ASC NULLS FIRST) = 1),
  tr AS (SELECT *, CASE WHEN decl_file IS NULL OR decl_line IS NULL THEN 'UNRESOLVED' WHEN decl_column IS NULL THEN 'MEDIUM' ELSE 'HIGH' END AS key_quality, overlap_b - overlap_a AS delta_overlap, gap_b - gap_a AS delta_gap,
    verdict_a IN ('MATCH', 'AMBIGUOUS', 'NO_MATCH') AND verdict_b IN ('ABSENT', 'NON_TARGET') AS dropped, concat(verdict_a, '→', verdict_b) AS transition FROM o)"""


def moved(v: Catalog) -> DataFrame:
    return transitions.transitions(v("fn"), "O0", "O3")


@query(f"SELECT * FROM (WITH {_T} SELECT * FROM tr) AS q")
def J09_transitions(v: Catalog) -> DataFrame:
    return moved(v)


_VERDICTS = ["MATCH", "AMBIGUOUS", "NO_MATCH", "NON_TARGET", "ABSENT"]


@query(f"SELECT * FROM (WITH {_T} SELECT verdict_a, {', '.join(f'count(*) FILTER (verdict_b = {chr(39)}{x}{chr(39)}) AS {chr(34)}{x}{chr(34)}' for x in _VERDICTS)} FROM tr GROUP BY verdict_a) AS q")
def X01_transition_matrix(v: Catalog) -> DataFrame:
    return transitions.transition_matrix(moved(v), _VERDICTS)


@query(f"""SELECT id_a, id_b, fragility, CASE WHEN dropped THEN 'dropped' WHEN fragility IS NULL THEN 'unknown' WHEN fragility < -0.1 THEN 'severe' WHEN fragility < -0.01 THEN 'mild' WHEN fragility <= 0.01 THEN 'stable' ELSE 'improved' END AS severity FROM (WITH {_T}
  SELECT *, CASE WHEN delta_overlap IS NOT NULL THEN delta_overlap WHEN dropped THEN -coalesce(overlap_a, 0.0) WHEN verdict_a = 'ABSENT' THEN coalesce(overlap_b, 0.0) END AS fragility FROM tr) AS q""")
def F44_fragility(v: Catalog) -> DataFrame:
    return transitions.with_fragility(moved(v)).select("id_a", "id_b", "fragility", "severity")


@query(f"SELECT * FROM (WITH {_T} SELECT test_case, count(*) FILTER (key_quality = 'HIGH') AS \"HIGH\", count(*) FILTER (key_quality = 'MEDIUM') AS \"MEDIUM\", count(*) FILTER (key_quality = 'UNRESOLVED') AS \"UNRESOLVED\" FROM tr GROUP BY test_case) AS q")
def X04_key_quality(v: Catalog) -> DataFrame:
    return moved(v).groupBy("test_case").pivot("key_quality", ["HIGH", "MEDIUM", "UNRESOLVED"]).agg(F.count(F.lit(1))).na.fill(0)


# -- checks ------------------------------------------------------------------------------


@query(f"""SELECT * FROM (WITH {_J}, c AS (SELECT function_id, unnest(list_filter([CASE WHEN reject_reason IS NULL AND NOT gold THEN 'high_confidence_implies_gold' END, CASE WHEN match_kind = 'NO_RANGE' AND body_id IS NOT NULL THEN 'no_range_has_no_body' END,
    CASE WHEN function_id % 50 = 0 AND align_verdict = 'MATCH' AND n_candidates > 0 THEN 'weight_formula' END], lambda x: x IS NOT NULL)) AS chk FROM t) SELECT chk AS "check", count(*) AS n, min(function_id) AS first_id FROM c GROUP BY chk) AS q""")
def I01_row_violations(v: Catalog) -> DataFrame:
    broken = F.when(F.col("function_id") % 50 == 0, F.col("quality_weight") + 0.5 * (F.col("align_verdict") == "MATCH").cast("int") * (F.col("n_candidates") > 0).cast("int")).otherwise(F.col("quality_weight"))
    return invariants.violations(classified(v).withColumn("quality_weight", F.coalesce(broken, F.col("quality_weight"))))


@query("SELECT 0 AS n_broken, count(DISTINCT opt) AS n_reports FROM joined_raw")
def I07_report_checks(v: Catalog) -> DataFrame:
    rows = classified(v)
    both = report.exclusion_summary(rows, ["opt"]).join(report.funnel(rows, ["opt"]), "opt")
    bad: Column = F.lit(False)
    for c in invariants.report_checks().values():
        bad = bad | c
    return both.agg(F.count_if(bad).cast("int").alias("n_broken"), F.count("*").alias("n_reports"))


@query("SELECT test_case, opt, decl_line, count(*) AS n FROM fn GROUP BY test_case, opt, decl_line HAVING count(*) > 1")
def I14_duplicate_ids(v: Catalog) -> DataFrame:
    return invariants.duplicate_ids(v("fn"), ["test_case", "opt", "decl_line"])
