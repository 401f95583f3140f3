"""Queries of flattening, attaching, crosstabs and debug information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import debuginfo, policy, text
from ..operators import flatten, report, trajectory, transitions
from ..sources import readers
from .queries_report import _J, _PLACE, _STEPS, classified
from .registry import query
from .views import Catalog

_KEYS = [f"REASON_{k}" for k in range(6)]


@query("SELECT test_case, opt, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (reason = '{k}'), 0) AS BIGINT) AS reason_{k}" for k in _KEYS) + " FROM reasons GROUP BY test_case, opt")
def P02_reason_columns(v: Catalog) -> DataFrame:
    maps = v("reasons").groupBy("test_case", "opt").agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("m"))
    return flatten.map_columns(maps, "m", _KEYS, "reason_")


@query("SELECT test_case, opt, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (reason = '{k}'), 0) AS BIGINT) AS reason_{k}" for k in _KEYS) + " FROM reasons GROUP BY test_case, opt")
def P02_found_columns(v: Catalog) -> DataFrame:
    """The same out of JSON whose keys are not known before."""
    maps = v("reasons").groupBy("test_case", "opt").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("reason", "n")))).alias("m"))
    return flatten.found_columns(maps, "m", "reason_")


@query("SELECT o_custkey AS job_id, CAST(o_orderkey AS VARCHAR) AS opt, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderkey % 97 AS BIGINT) END AS size_bytes, CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 2 = 0 ELSE false END AS has_debug FROM orders")
def P01_receipt_builds(v: Catalog) -> DataFrame:
    artifact = F.when(F.col("o_orderstatus") != "F", F.struct(F.md5(F.col("o_orderkey").cast("string")).alias("sha256"), (F.col("o_orderkey") % 97).alias("size_bytes"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0).alias("has_debug")))
    build = F.struct(F.col("o_orderkey").cast("string").alias("opt"), F.lit("debug").alias("variant"), F.col("o_orderstatus").alias("status"), artifact.alias("artifact"))
    receipts = v.table("orders").groupBy(F.col("o_custkey").alias("job_id"), (F.col("o_custkey") % 15).alias("test_case")).agg(F.collect_list(build).alias("builds"))
    return readers.receipt_builds(receipts).select("job_id", "opt", "size_bytes", "has_debug")


@query("""SELECT f.function_id, coalesce(f.name, concat('<anon@', f.function_id, '>')) AS name, e.line AS ts_id, CAST(coalesce(e.n, 0) AS BIGINT) AS score FROM fn f LEFT JOIN (SELECT function_id, line, sum(cnt) AS n FROM ev_rows GROUP BY function_id, line) e ON e.function_id = f.function_id""")
def P03_flatten_pairs(v: Catalog) -> DataFrame:
    c = v("ev_rows").groupBy("function_id", "line").agg(F.sum("cnt").alias("n")).groupBy("function_id").agg(F.collect_list(F.struct(F.col("line").alias("ts_id"), F.col("n").alias("score"))).alias("candidates"))
    return flatten.flatten_pairs(v("fn").join(c, "function_id", "left")).drop("pos")


@query("""SELECT function_id, CASE WHEN function_id % 3 = 0 THEN verdict WHEN function_id % 2 = 0 THEN 'NON_TARGET' END AS align_verdict, function_id % 3 <> 0 AND function_id % 2 = 0 AND function_id % 23 <> 0 AS is_non_target FROM fn""")
def J07_with_alignment(v: Catalog) -> DataFrame:
    f = v("fn")
    rows = f.select("function_id", (F.col("function_id") % 23 != 0).alias("has_range"))
    return flatten.with_alignment(rows, f.filter("function_id % 3 = 0"), f.filter("function_id % 2 = 0")).drop("has_range")


@query("SELECT f.function_id AS body_id, f.gap, CAST(coalesce(c.n, 0) AS BIGINT) AS bb_count, CAST(coalesce(s.q, 0) AS BIGINT) AS n_vars FROM fn f LEFT JOIN (SELECT function_id, count(*) AS n FROM vars WHERE pos < 4 GROUP BY function_id) c ON c.function_id = f.function_id LEFT JOIN (SELECT function_id, sum(site_a) AS q FROM vars WHERE pos > 5 GROUP BY function_id) s ON s.function_id = f.function_id")
def J08_decompiled_table(v: Catalog) -> DataFrame:
    cfg = v("vars").filter("pos < 4").groupBy(F.col("function_id").alias("body_id")).agg(F.count("*").alias("bb_count"))
    stats = v("vars").filter("pos > 5").groupBy(F.col("function_id").alias("body_id")).agg(F.sum("site_a").alias("n_vars"))
    return flatten.decompiled_table(v("fn").select(F.col("function_id").alias("body_id"), "gap"), cfg, stats)


@query(f"SELECT * FROM (WITH {_J} SELECT function_id, name, tier FROM t WHERE tier = 'SILVER') AS q")
def P05_identity_of_tier(v: Catalog) -> DataFrame:
    return flatten.identity_rows(classified(v), ["function_id", "name", "tier"], "SILVER")


@query("SELECT p.job, p.predicted, p.quantity, CASE WHEN f.decl_file IS NOT NULL THEN concat(f.test_case, '|', f.decl_file, '|', f.decl_line, '|', coalesce(CAST(f.decl_column AS VARCHAR), ''), '|', lower(coalesce(f.name, ''))) END AS stable_key FROM pred p LEFT JOIN fn f ON f.function_id = CAST(floor(p.job / 8) AS BIGINT)")
def J11_stable_keys(v: Catalog) -> DataFrame:
    keyed = v("fn").select("function_id", transitions.stable_key()[0].alias("stable_key"))
    rows = v("pred").select("job", "predicted", "quantity", F.floor(F.col("job") / 8).alias("function_id"))
    return rows.join(keyed, "function_id", "left").drop("function_id")


@query("SELECT p.test_case, p.opt, p.n AS pairs, coalesce(k.n, 0) AS non_targets FROM pairs_n p LEFT JOIN (SELECT test_case, opt, count(*) AS n FROM fn WHERE verdict = 'NON_TARGET' AND gap > 30 GROUP BY test_case, opt) k ON k.test_case = p.test_case AND k.opt = p.opt")
def J13_pair_summary(v: Catalog) -> DataFrame:
    k = v("fn").filter("verdict = 'NON_TARGET' AND gap > 30").groupBy("test_case", "opt").agg(F.count("*").alias("non_targets"))
    return v("pairs_n").withColumnRenamed("n", "pairs").join(k, ["test_case", "opt"], "left").withColumn("non_targets", F.coalesce("non_targets", F.lit(0)))


@query("SELECT test_case, opt, count(*) AS n, count(*) FILTER (verdict = 'MATCH') AS n_match, median(gap) AS median_gap, avg(gap) AS mean_gap, count(*) FILTER (verdict = 'MATCH') / CAST(count(*) AS DOUBLE) AS yield FROM fn WHERE verdict <> 'NON_TARGET' GROUP BY test_case, opt")
def A28_pair_statistics(v: Catalog) -> DataFrame:
    match = F.count_if(F.col("verdict") == "MATCH")
    return v("fn").filter("verdict <> 'NON_TARGET'").groupBy("test_case", "opt").agg(F.count("*").alias("n"), match.alias("n_match"), F.median("gap").alias("median_gap"), F.avg("gap").alias("mean_gap"), (match / F.count("*")).alias("yield"))


@query(f"SELECT * FROM (WITH {_J}, b AS (SELECT *, CASE WHEN quality_weight >= 1 THEN '==1.0' WHEN quality_weight >= 0.5 THEN 'upper' ELSE 'lower' END AS bin FROM t) SELECT l.x AS bin, count(b.function_id) AS n, count(*) FILTER (b.is_thunk) AS n_thunk, count(*) FILTER (b.fatal) AS n_fatal FROM (SELECT unnest(['==1.0', 'upper', 'lower', 'none']) AS x) l LEFT JOIN b ON b.bin = l.x GROUP BY l.x) AS q")
def A31_bin_signals(v: Catalog) -> DataFrame:
    w = F.col("quality_weight")
    rows = classified(v).withColumn("bin", F.when(w >= 1, "==1.0").when(w >= 0.5, "upper").otherwise("lower"))
    fatal = F.arrays_overlap("warning_tags", F.array(*[F.lit(x) for x in policy.PROFILE.fatal_warnings]))
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("is_thunk").alias("n_thunk"), F.count_if(fatal).alias("n_fatal"))
    order = v.spark.createDataFrame([(x,) for x in ("==1.0", "upper", "lower", "none")], "bin string")
    return order.join(counts, "bin", "left").na.fill(0)


@query("SELECT opt, 100.0 * count(*) FILTER (n_candidates = 1) / CAST(count(*) AS DOUBLE) AS unique_pct, 100.0 * count(*) FILTER (n_candidates > 1 AND contains(warning_text, 'UNREACHABLE')) / CAST(count(*) AS DOUBLE) AS header_pct, 100.0 * count(*) FILTER (n_candidates <> 1 AND NOT (n_candidates > 1 AND contains(warning_text, 'UNREACHABLE'))) / CAST(count(*) AS DOUBLE) AS other_pct FROM joined_raw WHERE n_candidates IS NOT NULL GROUP BY opt")
def A32_ambiguity(v: Catalog) -> DataFrame:
    rows = classified(v).filter("n_candidates IS NOT NULL")
    header = (F.col("n_candidates") > 1) & F.array_contains("warning_tags", "UNREACHABLE_BLOCKS_REMOVED")
    pct = lambda c: F.lit(100.0) * F.count_if(c) / F.count("*")
    return rows.groupBy("opt").agg(pct(F.col("n_candidates") == 1).alias("unique_pct"), pct(header).alias("header_pct"), pct((F.col("n_candidates") != 1) & ~header).alias("other_pct"))


@query("SELECT test_case, count(*) AS n, count(DISTINCT fkey) AS n_functions, median(quantity) AS median_q, count(*) FILTER (quantity < 5) / CAST(count(*) AS DOUBLE) AS low_rate FROM pred GROUP BY test_case")
def A34_scoreboard(v: Catalog) -> DataFrame:
    return v("pred").groupBy("test_case").agg(F.count("*").alias("n"), F.count_distinct("fkey").alias("n_functions"), F.median("quantity").alias("median_q"), (F.count_if(F.col("quantity") < 5) / F.count("*")).alias("low_rate"))


@query("SELECT opt, round(avg(100.0 * accept / CAST(accept + warn + reject AS DOUBLE)), 9) AS accept_rate FROM reports GROUP BY opt")
def A35_macro_rates(v: Catalog) -> DataFrame:
    from ..operators import rates

    return rates.verdict_rates(v("reports")).groupBy("opt").agg(F.round(F.avg("accept_rate"), 9).alias("accept_rate"))


@query("SELECT gate, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after, bool_or(a <> b) AS binds FROM (" + " UNION ALL ".join(
    f"SELECT '{n}' AS gate, b, a FROM (SELECT opt, count(*) FILTER (gold AND place >= {k}) AS b, count(*) FILTER (gold AND place > {k}) AS a FROM g GROUP BY opt) AS x{k}" for k, n in enumerate(_STEPS)) .replace("FROM g GROUP", f"FROM (WITH {_J} SELECT opt, gold, {_PLACE} AS place FROM t) AS g GROUP") + ") AS q GROUP BY gate")
def A36_gate_steps(v: Catalog) -> DataFrame:
    return flatten.gate_steps(report.funnel(classified(v), ["opt"]), ["n_eligible_for_gold", *_STEPS])


_LEVELS = ["HIGH", "MEDIUM", "LOW"]


@query("SELECT opt, " + ", ".join(f"count(*) FILTER (cfg_completeness = '{x}') / CAST(count(*) AS DOUBLE) AS \"{x}\"" for x in _LEVELS) + " FROM joined_raw GROUP BY opt")
def X02_crosstab_shares(v: Catalog) -> DataFrame:
    return flatten.crosstab_shares(v("joined_raw"), "opt", "cfg_completeness", _LEVELS)


@query("SELECT model, tier, " + ", ".join(f"count(*) FILTER (opt = '{o}') AS \"{o}\"" for o in trajectory.OPTS) + " FROM pred GROUP BY model, tier")
def X06_completeness(v: Catalog) -> DataFrame:
    return v("pred").groupBy("model", "tier").pivot("opt", trajectory.OPTS).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT model, " + ", ".join(f"avg(f1) FILTER (opt = '{o}') AS \"{o}\"" for o in trajectory.OPTS) + " FROM pred GROUP BY model")
def X07_heatmap(v: Catalog) -> DataFrame:
    return trajectory.wide_by_opt(v("pred"), ["model"], "f1")


@query("SELECT b, count(*) FILTER (n_candidates = 1) AS \"1\", count(*) FILTER (n_candidates <> 1 AND n_candidates <= 3) AS \"2-3\", count(*) FILTER (n_candidates > 3) AS \"4+\" FROM (SELECT CASE WHEN overlap_ratio >= 1 THEN 'full' ELSE 'part' END AS b, n_candidates FROM joined_raw WHERE overlap_ratio IS NOT NULL) AS x GROUP BY b")
def X08_overlap_by_candidates(v: Catalog) -> DataFrame:
    from ..functions import bins

    rows = v("joined_raw").filter("overlap_ratio IS NOT NULL").select(F.when(F.col("overlap_ratio") >= 1, "full").otherwise("part").alias("b"), bins.candidate_bin(F.col("n_candidates")).alias("c"))
    return rows.groupBy("b").pivot("c", ["1", "2-3", "4+"]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT fkey, count(DISTINCT predicted) AS n_predictions FROM pred WHERE predicted IS NOT NULL GROUP BY fkey")
def X11_distinct_predictions(v: Catalog) -> DataFrame:
    wide = v("pred").groupBy("fkey").agg(F.collect_set("predicted").alias("p"))
    return wide.filter(F.size("p") > 0).select("fkey", F.size("p").cast("long").alias("n_predictions"))


@query("SELECT function_id, CASE WHEN i < 0 OR i >= 3 THEN concat('<unknown file ', part % 5, '>') ELSE CASE i WHEN 0 THEN '/w/main.c' WHEN 1 THEN '/inc/a.h' ELSE '/w/sub/b.h' END END AS path, part, site_a, site_b FROM (SELECT *, part % 5 - CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS i FROM vars) AS x")
def F33_file_paths(v: Catalog) -> DataFrame:
    new = F.col("pos") % 2 == 0
    shift = F.when(new, 0).otherwise(1)
    entry = lambda n, d: F.struct(F.lit(n).alias("name"), (F.lit(d) + (shift if d else 0)).cast("int").alias("dir"))
    # folder 1 of the later tables is folder 2 of the earlier ones
    files = F.array(entry("main.c", 0), entry("a.h", 1), entry("b.h", 2))
    dirs = F.array(F.lit("/zero"), F.lit("/inc"), F.lit("sub"))
    return v("vars").select("function_id", debuginfo.file_path((F.col("part") % 5).cast("int"), F.when(new, 5).otherwise(4), files, dirs, F.lit("/w/")).alias("path"), "part", "site_a", "site_b")


@query("SELECT function_id, part, site_a, site_b AS lo, CASE WHEN pos % 2 = 0 THEN site_a ELSE site_b + site_a END AS hi FROM vars WHERE CASE WHEN pos % 2 = 0 THEN site_a ELSE site_b + site_a END > site_b")
def F34_pc_ranges(v: Catalog) -> DataFrame:
    form = F.when(F.col("pos") % 2 == 0, "DW_FORM_addr").otherwise("DW_FORM_data8")
    return v("vars").select("function_id", "part", "site_a", debuginfo.pc_range(F.col("site_b"), F.col("site_a"), form).alias("r")).filter("r IS NOT NULL").select("function_id", "part", "site_a", "r.lo", "r.hi")


@query("SELECT function_id, count(*) FILTER (part % 2 = 0) AS n_nodes, count(*) FILTER (part % 2 = 0 AND pos >= 5) AS n_deep FROM vars GROUP BY function_id")
def F37_structural_nodes(v: Catalog) -> DataFrame:
    node = F.struct(F.when(F.col("part") % 2 == 0, "if_statement").otherwise("expression").alias("node_type"), (F.col("pos") + 3).alias("depth"))
    rows = v("vars").groupBy("function_id").agg(debuginfo.structural(F.collect_list(node)).alias("n"))
    return rows.select("function_id", F.size("n").cast("long").alias("n_nodes"), F.size(F.filter("n", lambda x: x["is_deep"])).cast("long").alias("n_deep"))


@query("SELECT role, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'C_UNIT' WHEN 1 THEN 'HEADER' ELSE 'OTHER' END AS role FROM part) AS x GROUP BY role")
def F43_file_roles(v: Catalog) -> DataFrame:
    k = F.col("p_size") % 4
    path = F.concat(F.lit("src/"), F.when(k == 3, ".c").otherwise(F.concat("p_name", F.when(k == 0, ".C").when(k == 1, ".h").otherwise(".cc"))))
    return v.table("part").groupBy(text.file_role(path).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT job, quantity, CASE quantity % 4 WHEN 0 THEN concat('n', quantity) WHEN 1 THEN concat('r', quantity) ELSE predicted END AS predicted, CASE WHEN quantity % 4 < 2 THEN true END AS parse_ok FROM pred")
def K05_repair(v: Catalog) -> DataFrame:
    k, q = F.col("quantity") % 4, F.col("quantity").cast("string")
    raw = F.when(k == 0, F.concat(F.lit(' {"name": "n'), q, F.lit('"}'))).when(k == 1, F.lit('x "predictions" y')).otherwise(F.col("predicted"))
    response = F.when(k == 1, F.concat(F.lit('[{"name": "r'), q, F.lit('"}]')))
    return flatten.repaired(v("pred").select("job", "quantity", raw.alias("predicted"), response.alias("response"))).select("job", "quantity", "predicted", "parse_ok")


@query("SELECT l.function_id, l.part, l.site_a, r.part AS to_part FROM vars l JOIN vars r ON r.function_id = l.function_id AND r.pos = l.site_a % 8")
def J20_block_successors(v: Catalog) -> DataFrame:
    to = v("vars").select("function_id", F.col("pos").alias("_to"), F.col("part").alias("to_part"))
    return v("vars").withColumn("_to", F.col("site_a") % 8).join(to, ["function_id", "_to"]).select("function_id", "part", "site_a", "to_part")
