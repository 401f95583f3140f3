"""Queries of sources and sinks, cohorts and trajectories. A source's query writes a tree
of documents made from the supplied tables to the shared scratch folder and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import decompiled, names
from ..operators import flatten, invariants, lookups, matrix, rates, trajectory
from ..operators.flatten import DISTRIBUTIONS, EXCLUSIONS, PERCENTILES
from ..sources import artifacts, binaries, pages, readers, remote, sinks
from ..sources.scratch import scratch
from ..streaming import keyed, results
from . import served
from .registry import query
from .views import Catalog

_CELL = ["test_case", "opt"]
#: Function ids of a document of pairs.
_PIECE = 100_000


def _at(root: str, kind: str, variant: str) -> Column:
    return F.concat(F.lit(f"{root}/"), F.col("test_case"), F.lit("/"), F.col("opt"), F.lit(f"/{variant}/{artifacts.PLACES[kind]}"))


def _put(v: Catalog, rows: DataFrame, root: str, kind: str, variant: str = "debug") -> None:
    """Write (test_case, opt, content) rows to their places."""
    sinks.write_files(rows.select(_at(root, kind, variant).alias("path"), "content")).count()


def _put_lines(rows: DataFrame, order: list[str], root: str, kind: str, variant: str) -> None:
    """Write rows as lines to their cells' places, each a folder of files that follow one another."""
    sinks.write_lines(rows, _at(root, kind, variant), _CELL, order).count()


def _document(cells: DataFrame, *fields: Column) -> DataFrame:
    return cells.select(*_CELL, F.to_json(F.struct(*fields)).alias("content"))


def _lines(rows: DataFrame, order: list[str]) -> DataFrame:
    return sinks.json_bundle(rows, _CELL, order)


def _oracle_reports(v: Catalog, root: str, cells: DataFrame) -> None:
    total = (F.col("accept") + F.col("warn") + F.col("reject")).alias("total")
    _put(v, _document(cells, F.lit("0.2").alias("schema_version"), F.concat_ws("/", *_CELL).alias("verdict"), F.md5(F.concat_ws("/", *_CELL)).alias("binary_sha256"), F.struct(total, "accept", "warn", "reject").alias("function_counts")), root, "oracle_report")


# -- scans --------------------------------------------------------------------------


@query("SELECT concat(test_case, '/', opt) AS cell, CAST(accept AS BIGINT) AS accept, CAST(accept + warn + reject AS BIGINT) AS total FROM reports")
def S01_json_documents(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    _oracle_reports(v, root, v("reports"))
    docs = readers.json_documents(v.spark, artifacts.place(root, "oracle_report"), artifacts.ORACLE_REPORT)
    none = readers.json_documents(v.spark, artifacts.place(root, "join_report"), artifacts.ORACLE_REPORT)
    return docs.unionByName(none).select(F.col("verdict").alias("cell"), "function_counts.accept", "function_counts.total")


@query("SELECT function_id, name FROM fn")
def S02_json_lines(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    spaced = _lines(v("fn").select(*_CELL, "function_id", "name"), ["function_id"]).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n  \n")))
    _put(v, spaced, root, "ghidra_functions")
    return readers.json_lines(v.spark, artifacts.place(root, "ghidra_functions"), "function_id bigint, name string")


@query("SELECT test_case, count(*) AS n_rows, CAST(sum(function_id) AS BIGINT) AS ids, 2 * count(DISTINCT opt) AS n_bad FROM fn GROUP BY test_case")
def S03_tolerant_lines(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    broken = _lines(v("fn").select(*_CELL, "function_id"), ["function_id"]).withColumn("content", F.concat(F.lit('{"function_id": 1\n'), "content", F.lit("\nno json\n")))
    _put(v, broken, root, "ghidra_functions")
    good, bad = readers.tolerant_lines(v.spark, artifacts.place(root, "ghidra_functions"), "function_id bigint")
    case = F.regexp_extract("file", r"/([^/]+)/[^/]+/debug/", 1).alias("test_case")
    rows = good.groupBy(case).agg(F.count("*").alias("n_rows"), F.sum("function_id").alias("ids"))
    return rows.join(bad.groupBy(case).agg(F.count("*").alias("n_bad")), "test_case")


@query("SELECT test_case, opt, count(*) FILTER (function_id % 3 <> 2) AS n_functions, count(*) FILTER (function_id % 3 = 2) AS n_unknown, CAST(sum(CASE WHEN function_id % 3 <> 2 THEN coalesce(gap, 7) END) AS BIGINT) AS gaps, 'last' AS program FROM (SELECT test_case, opt, function_id, CASE WHEN gap % 2 = 0 THEN gap END AS gap FROM fn) AS q GROUP BY test_case, opt")
def S04_tagged_lines(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    kind = F.when(F.col("function_id") % 3 == 1, "function").when(F.col("function_id") % 3 == 2, "note").alias("_type")
    body = _lines(v("fn").select(*_CELL, kind, F.col("function_id").alias("entry_va"), F.when(F.col("gap") % 2 == 0, F.col("gap")).alias("gap")), ["entry_va"])
    summary = lambda program: F.lit(f'{{"_type": "summary", "program": "{program}"}}\n')
    _put(v, body.withColumn("content", F.concat(summary("first"), "content", summary("last"))), root, "ghidra_functions")
    lines = readers.numbered_lines(v.spark, artifacts.place(root, "ghidra_functions"), "_type string, entry_va bigint, gap bigint, program string")
    lines = lines.select(F.regexp_extract("file", r"/([^/]+)/[^/]+/debug/", 1).alias("test_case"), F.regexp_extract("file", r"/([^/]+)/debug/", 1).alias("opt"), "pos", "_type", "entry_va", "gap", "program")
    functions, summaries = readers.tagged_lines(lines, {"gap": F.lit(7)})
    counts = functions.groupBy(*_CELL).agg(F.count("*").alias("n_functions"), F.sum("gap").alias("gaps"))
    unknown = readers.unknown_tags(lines, _CELL).select(*_CELL, F.col("n").alias("n_unknown"))
    last = readers.last_summary(summaries.select(*_CELL, "pos", "program"), _CELL, "pos")
    return counts.join(last, _CELL).join(unknown, _CELL, "left").withColumn("n_unknown", F.coalesce("n_unknown", F.lit(0)))


@query("SELECT place, test_case FROM (SELECT row_number() OVER (ORDER BY test_case) AS place, test_case FROM (SELECT DISTINCT test_case FROM fn) AS q) AS r")
def S05_discover(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    _oracle_reports(v, root, v("reports"))
    return v.spark.createDataFrame(list(enumerate(readers.discover(v.spark, root), 1)), "place bigint, test_case string")


_KINDS = {
    "build_receipt": "t1/build_receipt.json", "oracle_report": "t1/O2/debug/oracle/oracle_report.json", "oracle_functions": "t1/O2/debug/oracle/oracle_functions.json",
    "alignment_report": "t1/O2/debug/join_dwarf_ts/alignment_report.json", "alignment_pairs": "t1/O2/debug/join_dwarf_ts/alignment_pairs.json", "ghidra_dir": "t1/O2/debug/ghidra_decompile",
    "ghidra_report": "t1/O2/debug/ghidra_decompile/report.json", "ghidra_functions": "t1/O2/debug/ghidra_decompile/functions.jsonl", "ghidra_variables": "t1/O2/debug/ghidra_decompile/variables.jsonl",
    "ghidra_cfg": "t1/O2/debug/ghidra_decompile/cfg.jsonl", "ghidra_calls": "t1/O2/debug/ghidra_decompile/calls.jsonl", "join_dir": "t1/O2/debug/join_oracles_ghidra",
    "joined_functions": "t1/O2/debug/join_oracles_ghidra/joined_functions.jsonl", "joined_variables": "t1/O2/debug/join_oracles_ghidra/joined_variables.jsonl", "join_report": "t1/O2/debug/join_oracles_ghidra/join_report.json",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, '/root/{p}' AS path" for k, p in _KINDS.items()))
def S06_places(v: Catalog) -> DataFrame:
    kinds = ["build_receipt", *artifacts.PLACES]
    return v.spark.createDataFrame([(k, artifacts.place("/root/", k, "t1", "O2", "debug")) for k in kinds], "kind string, path string")


def _dataset(v: Catalog) -> artifacts.Dataset:
    """A tree whose cell t3/O1 lacks its oracle report and t5/O0 its alignment report."""
    root = scratch(v.spark, "tree")
    reports, f = v("reports"), v("fn")
    _oracle_reports(v, root, reports.filter("NOT (test_case = 't3' AND opt = 'O1')"))
    reasons = v("reasons").groupBy(*_CELL).agg(F.map_from_entries(F.collect_list(F.struct("reason", "n"))).alias("reason_counts"))
    cells = reports.filter("NOT (test_case = 't5' AND opt = 'O0')").join(reasons, _CELL, "left")
    _put(v, _document(cells, F.struct("match", "ambiguous", "no_match", "non_target").alias("pair_counts"), "reason_counts", F.create_map(F.lit("overlap"), F.lit(0.7)).alias("thresholds")), root, "alignment_report")
    identity = [F.col("function_id").cast("string").alias("dwarf_function_id"), "decl_file", "decl_line", "decl_column"]
    pair = F.struct(*identity, F.col("name").alias("dwarf_function_name"), F.col("oracle_verdict").alias("dwarf_verdict"), "verdict", F.col("overlap").alias("overlap_ratio"), F.col("gap").alias("gap_count"), F.when(F.col("gap") % 2 == 0, F.concat(F.lit("f"), "gap")).alias("best_ts_func_id"))
    other = F.struct(*identity, "name", F.col("oracle_verdict").alias("dwarf_verdict"))
    out = F.col("verdict") == "NON_TARGET"
    # a cell's pairs are a folder of documents, each of a run of functions, so that no document grows with the table
    packed = f.groupBy(*_CELL, F.floor(F.col("function_id") / _PIECE).alias("piece")).agg(F.collect_list(F.when(~out, pair)).alias("pairs"), F.collect_list(F.when(out, other)).alias("non_targets"))
    content = F.to_json(F.struct("pairs", "non_targets")).alias("content")
    sinks.write_files(packed.select(F.concat(_at(root, "alignment_pairs", "debug"), F.lit("/"), "piece", F.lit(".json")).alias("path"), content)).count()
    build = F.struct(F.col("opt").alias("optimization"), F.lit("debug").alias("variant"), F.lit("SUCCESS").alias("status"), F.when(F.col("match") % 2 == 0, F.struct(F.md5(F.concat_ws("/", *_CELL)).alias("sha256"), F.col("match").alias("size_bytes"))).alias("artifact"))
    receipt = reports.groupBy("test_case").agg(F.to_json(F.struct(F.struct(F.first("test_case").alias("job_id")).alias("job"), F.array_sort(F.collect_list(build)).alias("builds"))).alias("content"))
    sinks.write_files(receipt.select(F.concat(F.lit(f"{root}/"), "test_case", F.lit("/build_receipt.json")).alias("path"), "content")).count()
    return artifacts.load_dataset(v.spark, root, [f"REASON_{k}" for k in range(6)], ["overlap"])


_WHOLE = "opt IN ('O0', 'O1') AND NOT (test_case = 't3' AND opt = 'O1') AND NOT (test_case = 't5' AND opt = 'O0')"


@query(
    "SELECT r.test_case, r.opt, CAST(match AS BIGINT) AS match, CAST(ambiguous AS BIGINT) AS ambiguous, CAST(no_match AS BIGINT) AS no_match, CAST(non_target AS BIGINT) AS non_target, CAST(accept AS BIGINT) AS oracle_accept, CAST(reject AS BIGINT) AS oracle_reject, CAST(warn AS BIGINT) AS oracle_warn, CAST(accept + warn + reject AS BIGINT) AS oracle_total, "
    + ", ".join(f"CAST(coalesce((SELECT n FROM reasons s WHERE s.test_case = r.test_case AND s.opt = r.opt AND s.reason = 'REASON_{k}'), 0) AS BIGINT) AS reason_REASON_{k}" for k in range(6))
    + ", CASE WHEN true THEN CAST(0.7 AS DOUBLE) END AS threshold_overlap FROM reports r WHERE "
    + _WHOLE.replace("opt", "r.opt").replace("test_case", "r.test_case")
)
def S07_dataset_reports(v: Catalog) -> DataFrame:
    return _dataset(v).reports


@query(f"SELECT test_case, opt, CAST(function_id AS VARCHAR) AS id, verdict = 'NON_TARGET' AS non_target, coalesce(name, concat('<anon@', function_id, '>')) AS shown, CASE WHEN verdict <> 'NON_TARGET' THEN CASE WHEN gap % 2 = 0 THEN concat('f', gap) ELSE '' END END AS best, CASE WHEN verdict <> 'NON_TARGET' THEN overlap END AS overlap, decl_line FROM fn WHERE {_WHOLE}")
def S07_dataset_pairs(v: Catalog) -> DataFrame:
    d = _dataset(v)
    own = d.pairs.select(*_CELL, F.col("dwarf_function_id").alias("id"), F.lit(False).alias("non_target"), F.col("dwarf_function_name_norm").alias("shown"), F.col("best_ts_func_id").alias("best"), F.col("overlap_ratio").alias("overlap"), "decl_line")
    return own.unionByName(d.non_targets.select(*_CELL, F.col("dwarf_function_id").alias("id"), F.lit(True).alias("non_target"), F.col("name_norm").alias("shown"), "decl_line"), allowMissingColumns=True)


@query("SELECT test_case, opt, 'debug' AS variant, 'SUCCESS' AS status, CAST(CASE WHEN match % 2 = 0 THEN match END AS BIGINT) AS binary_size, false AS has_debug FROM reports")
def S07_dataset_builds(v: Catalog) -> DataFrame:
    return _dataset(v).builds.select("test_case", "opt", "variant", "status", "binary_size", "has_debug")


_FUNNEL, _JOIN_WARNINGS, _WARNINGS, _YIELDS = ["n_eligible_for_gold", "n_high_confidence"], ["NEAR_TIE_CANDIDATES"], ["INLINE_LIKELY"], ["n_dwarf_funcs", "n_no_range"]


def _join_dataset(v: Catalog) -> artifacts.JoinDataset:
    """Joined functions of all cells; reports of all but t2's."""
    root, rows = scratch(v.spark, "tree"), v("joined_raw")
    _put_lines(rows.select(*_CELL, "function_id", "name", "bb_count"), ["function_id"], root, "joined_functions", "stripped")
    n, c = F.count("*"), F.col
    of = lambda **m: F.map_from_entries(F.array(*[F.struct(F.lit(k), x) for k, x in m.items()]))
    match, gold, ties, bb = F.count_if(c("align_verdict") == "MATCH"), F.count_if(c("oracle_verdict") == "ACCEPT"), F.count_if(c("n_near_ties") > 0), F.max("bb_count").cast("double")
    high, low = F.count_if(c("cfg_completeness") == "HIGH") / n, F.count_if(c("cfg_completeness") == "LOW") / n
    report = F.struct(
        of(n_dwarf_funcs=n, n_no_range=F.count_if(~c("has_range"))).alias("yield_counts"),
        F.struct(n.alias("total"), match.alias("high_confidence_count"), (match / n).alias("yield_rate")).alias("high_confidence"),
        of(n_total_dwarf=n, n_non_target=F.count_if("is_non_target")).alias("exclusion_summary"),
        of(n_eligible_for_gold=gold, n_high_confidence=match).alias("confidence_funnel"),
        F.struct(of(HIGH=high, LOW=low).alias("cfg_completeness_fractions"), of(INLINE_LIKELY=F.count_if(F.contains("warning_text", F.lit("INLINE")))).alias("warning_prevalence"), of(p25=F.min("bb_count").cast("double"), p90=bb).alias("cyclomatic_percentiles"), F.count_if(c("bb_count") > 80).alias("n_fat_functions")).alias("decompiler"),
        of(NEAR_TIE_CANDIDATES=ties).alias("join_warning_histogram"),
        F.struct(F.count_if(c("pc_ratio") >= 1).alias("n_quality_weight_gt_1")).alias("quality_weight_audit"),
        F.struct(F.max("n_candidates").alias("max_dwarf_per_ghidra"), ties.alias("n_ghidra_funcs_with_multi_dwarf")).alias("collision_summary"),
        F.when(n % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("invariant_violations"),
    )
    reports = rows.filter("test_case <> 't2'").groupBy(*_CELL).agg(F.to_json(report).alias("content"))
    _put(v, reports, root, "join_report", "stripped")
    return artifacts.load_join_dataset(v.spark, root, "function_id bigint, name string, bb_count bigint", flatten.JOIN_REPORT, yields=_YIELDS, funnel=_FUNNEL, warnings=_WARNINGS, join_warnings=_JOIN_WARNINGS)


@query("SELECT test_case, opt, count(*) AS n, CAST(sum(bb_count) AS BIGINT) AS blocks, count(name) AS n_named, test_case <> 't2' AS has_report FROM joined_raw GROUP BY test_case, opt")
def S08_join_dataset(v: Catalog) -> DataFrame:
    d = _join_dataset(v)
    counts = d.functions.groupBy(*_CELL).agg(F.count("*").alias("n"), F.sum("bb_count").alias("blocks"), F.count("name").alias("n_named"))
    return counts.join(d.reports.select(*_CELL, F.lit(True).alias("has_report")), _CELL, "left").withColumn("has_report", F.coalesce("has_report", F.lit(False)))


def _p04_sql() -> str:
    some = {
        "n_dwarf_funcs": "count(*)", "n_no_range": "count(*) FILTER (NOT has_range)", "hc_total": "count(*)", "hc_count": "count(*) FILTER (align_verdict = 'MATCH')", "excl_n_total_dwarf": "count(*)", "excl_n_non_target": "count(*) FILTER (is_non_target)",
        "funnel_n_eligible_for_gold": "count(*) FILTER (oracle_verdict = 'ACCEPT')", "funnel_n_high_confidence": "count(*) FILTER (align_verdict = 'MATCH')", "dec_warn_INLINE_LIKELY": "count(*) FILTER (contains(warning_text, 'INLINE'))", "dec_n_fat_functions": "count(*) FILTER (bb_count > 80)",
        "jw_NEAR_TIE_CANDIDATES": "count(*) FILTER (n_near_ties > 0)", "qa_n_qw_gt_1": "count(*) FILTER (pc_ratio >= 1)", "collision_max_dwarf_per_ghidra": "coalesce(max(n_candidates), 0)", "collision_n_multi_dwarf": "count(*) FILTER (n_near_ties > 0)", "n_invariant_violations": "CASE WHEN count(*) % 2 = 0 THEN 2 ELSE 0 END",
    }
    real = {"hc_yield_rate": "count(*) FILTER (align_verdict = 'MATCH') / CAST(count(*) AS DOUBLE)", "cfg_frac_HIGH": "count(*) FILTER (cfg_completeness = 'HIGH') / CAST(count(*) AS DOUBLE)", "cfg_frac_LOW": "count(*) FILTER (cfg_completeness = 'LOW') / CAST(count(*) AS DOUBLE)", "dec_cyclomatic_p25": "CAST(min(bb_count) AS DOUBLE)", "dec_cyclomatic_p90": "CAST(max(bb_count) AS DOUBLE)"}
    zero = [f"excl_{k}" for k in EXCLUSIONS if f"excl_{k}" not in some] + ["dec_n_indirect_jumps", "qa_n_qw_lt_0"]
    none = ["cfg_frac_MEDIUM", *[c for m in DISTRIBUTIONS for p in PERCENTILES if (c := f"dec_{m}_{p}") not in real]]
    columns = [f"CAST({x} AS BIGINT) AS {k}" for k, x in some.items()] + [f"{x} AS {k}" for k, x in real.items()] + [f"CAST(0 AS BIGINT) AS {k}" for k in zero] + [f"CAST(0 AS DOUBLE) AS {k}" for k in none]
    return f"SELECT test_case, opt, {', '.join(columns)} FROM joined_raw WHERE test_case <> 't2' GROUP BY test_case, opt"


@query(_p04_sql())
def P04_join_reports(v: Catalog) -> DataFrame:
    return _join_dataset(v).reports


@query("SELECT concat('d', doc_id, '.i') AS tu, sha256(coalesce(text, '')) AS hash FROM documents")
def S09_unit_texts(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "units")
    files = v.table("documents").select(F.concat(F.lit(f"{root}/"), F.floor(F.col("doc_id") / 1000), F.lit("/d"), "doc_id", F.lit(".i")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    sinks.write_files(files).count()
    return readers.texts(v.spark, root).select("tu", F.sha2("text", 256).alias("hash"))


@query("SELECT o_orderkey AS id, concat('0.', 2 + o_orderkey % 11) AS version FROM orders")
def S10_version_gate(v: Catalog) -> DataFrame:
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("0."), 2 + F.col("o_orderkey") % 11).alias("version"))
    return readers.require_version(rows, "0.2", "version")


@query("SELECT test_case, md5(concat(test_case, '/', opt)) AS binary_sha256, opt, 'debug' AS variant, CAST(match AS BIGINT) AS binary_size FROM reports WHERE match % 2 = 0")
def S11_resolve_builds(v: Catalog) -> DataFrame:
    wanted = v("reports").filter("match % 2 = 0").select("test_case", F.md5(F.concat_ws("/", *_CELL)).alias("binary_sha256"))
    return artifacts.resolve_builds(wanted, _dataset(v).builds).select("test_case", "binary_sha256", "opt", "variant", "binary_size")


@query("""SELECT test_case, opt, 'functions' AS kind, count(*) AS n, CAST(sum(function_id) AS BIGINT) AS ids FROM fn GROUP BY test_case, opt
  UNION ALL SELECT f.test_case, f.opt, k.kind, count(*), CAST(sum(function_id) AS BIGINT) FROM (SELECT fn.test_case, fn.opt, vars.function_id, vars.pos FROM fn JOIN vars ON vars.function_id = fn.function_id) f JOIN (SELECT 'variables' AS kind, 0 AS least UNION ALL SELECT 'cfg', 3 UNION ALL SELECT 'calls', 5) k ON f.pos > k.least GROUP BY f.test_case, f.opt, k.kind
  UNION ALL SELECT test_case, opt, 'report', 1, CAST(accept AS BIGINT) FROM reports""")
def S12_decompile_bundle(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    f = v("fn")
    _put_lines(f.select(*_CELL, "function_id"), ["function_id"], root, "ghidra_functions", "stripped")
    inner = v("vars").join(f.select(*_CELL, "function_id"), "function_id")
    for kind, least in (("variables", 0), ("cfg", 3), ("calls", 5)):
        _put_lines(inner.filter(F.col("pos") > least).select(*_CELL, "function_id", "pos", "part"), ["function_id", "pos", "part"], root, f"ghidra_{kind}", "stripped")
    _put(v, _document(v("reports"), F.col("accept").alias("function_id")), root, "ghidra_report", "stripped")
    bundle = artifacts.load_decompiled(v.spark, root, dict.fromkeys(("report", "functions", "variables", "cfg", "calls"), "function_id bigint"))
    out = None
    for kind, rows in bundle.items():
        counts = rows.groupBy(*_CELL).agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("function_id").alias("ids"))
        out = counts if out is None else out.unionByName(counts)
    return out


@query("SELECT * FROM (SELECT test_case, opt, concat_ws(',', CASE WHEN match % 3 = 0 THEN 'oracle' END, CASE WHEN match % 4 = 0 THEN 'alignment' END, CASE WHEN match % 5 = 0 OR match % 7 = 0 THEN 'decompiled' END) AS sides FROM reports) AS q WHERE sides <> ''")
def S13_hash_errors(v: Catalog) -> DataFrame:
    said, m = F.concat_ws("/", *_CELL), F.col("match")
    wrong = lambda bad, like: F.when(bad, "x").otherwise(like)
    cells = v("reports").select(*_CELL, wrong(m % 3 == 0, said).alias("oracle"), wrong(m % 4 == 0, said).alias("alignment"), wrong((m % 5 == 0) | (m % 7 == 0), F.when(m % 2 == 0, "stripped").otherwise(said)).alias("decompiled"), said.alias("oracle_receipt"), F.when(m % 2 == 0, "stripped").alias("decompiled_receipt"))
    return artifacts.hash_errors(cells).withColumn("sides", F.array_join("sides", ","))


@query("SELECT job, predicted, model, CASE WHEN CAST(substring(model, 2) AS INTEGER) % 2 = 0 THEN 'acme' ELSE 'globex' END AS provider FROM pred")
def S14_scored_rows(v: Catalog) -> DataFrame:
    """Stored results with their experiment's registry entry; results of none are left out."""
    path = scratch(v.spark, "scored")
    v("pred").select("job", "predicted", "model").write.json(path, compression="gzip")
    number = F.substring("model", 2, 9).cast("int")
    registry = v("pred").select("model").distinct().withColumn("provider", F.when(number % 2 == 0, "acme").otherwise("globex"))
    return readers.json_lines(v.spark, path, "job bigint, predicted string, model string").join(registry, "model")


def _served(v: Catalog, model: str | None) -> DataFrame:
    """Scored rows by way of a local endpoint."""
    rows = v("pred").select("job", "model", "predicted", "f1")
    path = scratch(v.spark, "served")
    served.store(rows if model is None else rows.filter(F.col("model") == model), path, ["job"])
    server = served.serve(v.spark, {model: path})
    host, port = server.server_address
    got = remote.read_pages(v.spark, f"http://{host}:{port}/results", "job bigint, model string, predicted string, f1 double", 4000)
    kept = scratch(v.spark, "received")
    (got if model is None else got.filter(F.col("model") == model)).write.parquet(kept)
    server.shutdown()
    server.server_close()
    return v.spark.read.schema(got.schema).parquet(kept)


@query("SELECT job, model, predicted, f1 FROM pred")
def S14_remote_rows(v: Catalog) -> DataFrame:
    return _served(v, None)


@query("SELECT job, model, predicted, f1 FROM pred WHERE model = 'm3'")
def S14_remote_model(v: Catalog) -> DataFrame:
    """The filter goes to the endpoint, which has this model's table only under its name."""
    return _served(v, "m3")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET (SELECT count(*) - 70 FROM lineitem)")
def P11_page_by_index(v: Catalog) -> DataFrame:
    path = scratch(v.spark, "pages")
    pages.write_pages(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), path, ["l_orderkey", "l_linenumber", "l_quantity"])
    return pages.page(v.spark, path, pages.n_rows(v.spark, path) - 70, 50).drop("row_number")


_ELF = "concat('7F454C46', CASE WHEN p_size % 2 = 0 THEN '0201' ELSE '0102' END, '01', repeat('00', 9), CASE WHEN p_size % 2 = 0 THEN '02003E00' ELSE '00030028' END, repeat('00', 44))"


@query(f"SELECT concat('b', p_partkey) AS file, CAST(64 AS BIGINT) AS size, sha256(unhex({_ELF})) AS sha256, CASE WHEN p_size % 2 = 0 THEN 'EXEC' ELSE 'DYN' END AS type, CASE WHEN p_size % 2 = 0 THEN 'x86_64' ELSE 'arm' END AS arch, false AS has_debug FROM part")
def S15_binaries(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "binaries")
    files = v.table("part").select(F.concat(F.lit(f"{root}/"), F.floor(F.col("p_partkey") / 1000), F.lit("/b"), "p_partkey").alias("path"), F.unhex(F.expr(_ELF)).alias("content"))
    sinks.write_files(files.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "path")).count()
    return binaries.scan_binaries(v.spark, root).select("file", "size", "sha256", "elf.type", "elf.arch", "elf.has_debug")


# -- sinks ---------------------------------------------------------------------------


@query("SELECT test_case, opt, sha256(concat(string_agg(concat('{\"function_id\":', function_id, ',\"name\":', CASE WHEN name IS NULL THEN 'null' ELSE concat('\"', name, '\"') END, ',\"gap\":', gap, '}'), chr(10) ORDER BY function_id), chr(10))) AS hash FROM fn GROUP BY test_case, opt")
def K01_json_bundle(v: Catalog) -> DataFrame:
    root = scratch(v.spark, "tree")
    _put(v, _lines(v("fn").select(*_CELL, "function_id", "name", "gap"), ["function_id"]), root, "joined_functions")
    files = v.spark.read.text(artifacts.place(root, "joined_functions"), wholetext=True)
    cell = F.col("_metadata.file_path")
    return files.select(F.regexp_extract(cell, r"/([^/]+)/[^/]+/debug/", 1).alias("test_case"), F.regexp_extract(cell, r"/([^/]+)/debug/", 1).alias("opt"), F.sha2("value", 256).alias("hash"))


@query("SELECT * FROM (SELECT 'a' AS job_id, CAST(1 AS BIGINT) AS n, true AS written UNION ALL SELECT 'b', 2, true UNION ALL SELECT 'a', 1, false) AS q")
def K02_append_one(v: Catalog) -> DataFrame:
    path = scratch(v.spark, "rows")
    given = [("a", 1), ("b", 2), ("a", 3)]
    written = [sinks.append_one(v.spark, v.spark.createDataFrame([row], "job_id string, n bigint"), path, ["job_id"]) for row in given]
    said = v.spark.createDataFrame([(job, ok, at) for at, ((job, _), ok) in enumerate(zip(given, written, strict=True))], "job_id string, written boolean, at int")
    return said.join(v.spark.read.parquet(path), "job_id").select("job_id", "n", "written")


@query("SELECT p_partkey AS id, p_name AS name, p_size * 2 AS score FROM part")
def K04_rewrite(v: Catalog) -> DataFrame:
    path = scratch(v.spark, "derived")
    v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("score")).write.parquet(path)
    for _ in range(2):  # from the table itself, twice with one result
        stored = v.spark.read.parquet(path)
        sinks.rewrite(v.spark, v.table("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("score")).join(stored.drop("score"), "id"), path)
    return v.spark.read.schema("id bigint, name string, score int").parquet(path)


@query("SELECT * FROM (SELECT 'r1' AS run_id, 'DONE' AS status, CAST(7 AS BIGINT) AS completed, 'late' AS errors, false AS again UNION ALL SELECT 'r2', 'RUNNING', 3, '', true) AS q")
def K07_run_registry(v: Catalog) -> DataFrame:
    runs = sinks.RunRegistry(v.spark, scratch(v.spark, "runs"))
    runs.create("r1")
    runs.create("r2")
    runs.patch("r1", completed=5)
    runs.patch("r1", status="DONE", completed=90, increment=2, error="late")
    runs.patch("r2", completed=3)
    try:
        runs.create("r2")
        again = False
    except ValueError:
        again = True
    return runs.all().select("run_id", "status", "completed", F.array_join("errors", ",").alias("errors"), ((F.col("run_id") == "r2") & F.lit(again)).alias("again"))


@query("SELECT function_id, name, decl_file, overlap FROM fn")
def K08_csv(v: Catalog) -> DataFrame:
    path = scratch(v.spark, "csv")
    sinks.write_csv(v("fn").select("function_id", "name", "decl_file", "overlap"), path, ["function_id"])
    return sinks.read_csv(v.spark, path, "function_id bigint, name string, decl_file string, overlap double")


@query("""SELECT 'customer' AS kind, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_custkey % 7 <> 0
  UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0)""")
def K09_cascade(v: Catalog) -> DataFrame:
    customers = v.table("customer")
    left, children = sinks.cascade(customers, customers.filter("c_custkey % 7 = 0"), ["c_custkey"], {"orders": (v.table("orders"), ["o_custkey"])})
    count = lambda kind, rows, key: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum(key).alias("ids"))
    return count("customer", left, "c_custkey").unionByName(count("orders", children["orders"], "o_orderkey"))


@query("SELECT row_number() OVER (ORDER BY quantity, job) AS place, job, quantity FROM pred")
def W15_sorted_output(v: Catalog) -> DataFrame:
    """Files follow each other in the order: the place counts rows of the files before, and those before in its file."""
    path = scratch(v.spark, "sorted")
    sinks.write_sorted(v("pred").select("job", "quantity"), path, ["quantity", "job"])
    rows = v.spark.read.parquet(path).select("job", "quantity", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"))
    files = rows.groupBy("file").agg(F.count("*").alias("n"), F.min(F.struct("quantity", "job")).alias("first"), F.max(F.struct("quantity", "job")).alias("last"))
    from pyspark.sql import Window

    w = Window.orderBy("file")  # one row a file
    before = files.select("file", (F.sum("n").over(w) - F.col("n")).alias("before"), F.coalesce(F.lag("last").over(w) < F.col("first"), F.lit(True)).alias("follows"))
    placed = rows.join(F.broadcast(before), "file")
    return placed.select(F.when(F.col("follows"), F.col("before") + F.col("i") + 1).alias("place"), "job", "quantity")


@query("SELECT i, line FROM (SELECT i, lines[CAST(i AS BIGINT) + 1] AS line FROM (SELECT string_split(string_agg(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE concat('row', o_orderkey) END, chr(10) ORDER BY o_orderkey), chr(10)) AS lines, unnest(range(0, count(*))) AS i FROM orders) AS q) AS r WHERE i >= 10 AND trim(line) <> '' ORDER BY i LIMIT 40")
def W16_page_of_lines(v: Catalog) -> DataFrame:
    lines = v.table("orders").select(F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.concat(F.lit("row"), "o_orderkey")).alias("line"))
    return lookups.page_of_lines(lines, "line", "i", 10, 40)


# -- streams -------------------------------------------------------------------------


@query("SELECT event_type, user_id, min(event_id) AS event_id FROM events GROUP BY event_type, user_id")
def T01_stream_append(v: Catalog) -> DataFrame:
    """Each job of an experiment once, though the files are streamed twice."""
    source, out = scratch(v.spark, "stream"), scratch(v.spark, "stream-out")
    v.table("events").select("event_type", "user_id", "event_id").repartitionByRange(6, "event_id").sortWithinPartitions("event_id").write.parquet(source)
    for _ in range(2):
        stream = results.read_stream(v.spark, source, "event_type string, user_id bigint, event_id bigint", 1000)
        results.append_stream(stream, out, scratch(v.spark, "stream-state"), ["user_id"], "event_type", "event_id").awaitTermination()
    return v.spark.read.schema("event_type string, user_id bigint, event_id bigint").parquet(out)


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def T02_windowed_counts(v: Catalog) -> DataFrame:
    """A stream's counts per day; a window is written once the watermark has passed it, which
    one event in a later file, far behind all others, makes it do."""
    source, out = scratch(v.spark, "stream"), scratch(v.spark, "stream-out")
    events = v.table("events").select("event_type", "ts")
    events.write.parquet(source)
    events.agg((F.max("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts")).select(F.lit("end").alias("event_type"), "ts").write.mode("append").parquet(source)
    counts = results.windowed_counts(results.read_stream(v.spark, source, "event_type string, ts timestamp", 1), "ts", ["event_type"], "1 day", "400 days")
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", scratch(v.spark, "stream-state"))
    writer.trigger(availableNow=True).start().awaitTermination()
    written = v.spark.read.schema("window_start timestamp, event_type string, n bigint").parquet(out)
    return written.select("event_type", F.floor(F.unix_seconds("window_start") / 86400).alias("day"), "n")


def _disordered(v: Catalog, source: str, columns: str) -> None:
    """Events in six files, about by time: within a file in no order, with rows of up to two days
    before the files so far, a third of all rows twice, and one row far behind at the end."""
    events = v.table("events").select(*columns.split()).withColumn("ts", F.col("ts").cast("timestamp"))
    late = events.withColumn("_at", F.unix_seconds("ts") - F.col("event_id") % 49 * 3600)
    first, last = late.agg(F.min("_at"), F.max("_at")).first()
    cut = late.withColumn("_file", F.least(F.lit(5), F.floor((F.col("_at") - first) * 6 / (last - first + 1))))
    rows = cut.unionByName(cut.filter("event_id % 3 = 0")).orderBy(F.xxhash64("event_id"))
    for n in range(6):  # files are read in the order in which they are written
        rows.filter(F.col("_file") == n).drop("_at", "_file").coalesce(2).write.mode("append").parquet(source)
    end = events.orderBy(F.desc("ts")).limit(1).withColumns({"ts": F.col("ts") + F.expr("INTERVAL 1000 DAYS"), "user_id": F.lit(-1).cast(events.schema["user_id"].dataType)})
    end.write.mode("append").parquet(source)


def _run(stream: DataFrame, out: str, state: str) -> None:
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


@query("SELECT event_type, user_id, min_by(event_id, epoch_us(ts)::HUGEINT * 1000000000 + event_id) AS event_id, min(epoch_us(ts)) AS micros FROM events GROUP BY event_type, user_id")
def T03_first_rows(v: Catalog) -> DataFrame:
    """Each key's first row by event time, out of files in disorder and with repeats."""
    source, out = scratch(v.spark, "stream"), scratch(v.spark, "stream-out")
    _disordered(v, source, "event_type user_id event_id ts")
    stream = results.read_stream(v.spark, source, "event_type string, user_id bigint, event_id bigint, ts timestamp", 2)
    first = keyed.first_rows(stream, ["event_type", "user_id"], "ts", "event_id", "3 days")
    _run(first, out, scratch(v.spark, "stream-state"))
    return v.spark.read.schema(first.schema).parquet(out).filter("user_id >= 0").select("event_type", "user_id", "event_id", F.unix_micros("ts").alias("micros"))


@query("""SELECT user_id, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS stop, count(*) AS n, count(*) FILTER (good) AS n_good, CASE WHEN bool_and(good) THEN 'SUCCESS' WHEN bool_or(good) THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id, c ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT user_id, ts, event_id, c, event_id % 3 > 0 AS good, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id, c)) <= 14400000000 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT *, 0 AS c FROM events UNION ALL SELECT *, 1 FROM events WHERE event_id % 3 = 0) AS e) AS a) AS b GROUP BY user_id, g""")
def T04_job_status(v: Catalog) -> DataFrame:
    """A user's runs of events without a pause of more than four hours, and how each one ended."""
    source, out = scratch(v.spark, "stream"), scratch(v.spark, "stream-out")
    _disordered(v, source, "user_id event_id ts")
    stream = results.read_stream(v.spark, source, "user_id bigint, event_id bigint, ts timestamp", 2)
    runs = keyed.job_status(stream.withColumn("good", F.col("event_id") % 3 > 0), ["user_id"], "ts", "good", 4 * 3_600_000, "3 days")
    _run(runs, out, scratch(v.spark, "stream-state"))
    times = {c: F.unix_micros(c) for c in ("start", "stop")}
    return v.spark.read.schema(runs.schema).parquet(out).filter("user_id >= 0").withColumns(times)


# -- contracts, registries, invariants ------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT '{c}' AS name" for c in ("overlap_ratio", "decl_hint", "confidence_x", "test_case", "best_ts_thing", "quality_weight")))
def P07_forbidden_names(v: Catalog) -> DataFrame:
    columns = ["function_id", "c_raw", "overlap_ratio", "decl_hint", "confidence_x", "test_case", "best_ts_thing", "quality_weight", "declared", "verdicts"]
    bad = invariants.forbidden_columns(columns, lookups.FORBIDDEN, lookups.FORBIDDEN_PREFIXES)
    return v.spark.createDataFrame([(c,) for c in bad], "name string")


@query("SELECT 'test_case' AS name, count(*) AS n FROM fn UNION ALL SELECT 'decl_file', count(decl_file) FROM fn UNION ALL SELECT 'decl_line', count(decl_line) FROM fn UNION ALL SELECT 'decl_column', count(decl_column) FROM fn UNION ALL SELECT 'verdict', count(verdict) FROM fn")
def P08_leak_audit(v: Catalog) -> DataFrame:
    return v.spark.createDataFrame(list(lookups.leak_audit(v("fn")).items()), "name string, n bigint")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 3 = 1 AND p_brand IS NOT NULL AND p_partkey % 4 = 2")
def P12_find_experiments(v: Catalog) -> DataFrame:
    tags = F.array(F.concat(F.lit("s"), F.col("p_size") % 3), F.lit("all"))
    registry = v.table("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("task"), F.col("p_partkey") % 2).alias("task"), F.when(F.col("p_partkey") % 4 == 2, "ready").otherwise("draft").alias("status"), tags.alias("tags"))
    return matrix.find(registry, "task0", "ready", "s1").select("id")


@query("SELECT test_case, opt FROM reports WHERE accept % 3 = 0")
def I12_count_errors(v: Catalog) -> DataFrame:
    total = F.col("accept") + F.col("warn") + F.col("reject") + F.when(F.col("accept") % 3 == 0, 1).otherwise(0)
    return invariants.count_errors(v("reports").withColumn("total", total)).select(*_CELL)


@query("SELECT job, least(greatest(f1 * 64 / 50, 0.0), 1.0) AS weight FROM (SELECT job, f1 + CASE WHEN quantity = 50 THEN 1e-12 ELSE 0.0 END AS f1 FROM pred) AS q")
def I13_clamped_weights(v: Catalog) -> DataFrame:
    f1 = F.col("f1") + F.when(F.col("quantity") == 50, 1e-12).otherwise(0.0)
    return v("pred").select("job", invariants.clamp_weight(f1 * 64 / 50).alias("weight"))


@query("SELECT count(*) AS n, count(*) FILTER (quantity < 10) AS n_negative, count(*) FILTER (quantity > 42) AS n_over FROM pred WHERE quantity <> 20")
def B14_uplift_bounds(v: Catalog) -> DataFrame:
    u = (F.col("quantity") - 10) / 32
    return invariants.uplift_errors(v("pred").withColumn("uplift", F.when(F.col("quantity") != 20, u)))


@query("SELECT key, count(DISTINCT ground_truth) AS n_truths FROM (SELECT concat('q', quantity) AS key, ground_truth FROM pred WHERE quantity % 9 > 1) AS q GROUP BY key HAVING count(DISTINCT ground_truth) > 1")
def B14_unstable_truths(v: Catalog) -> DataFrame:
    key = F.when(F.col("quantity") % 9 == 0, "").when(F.col("quantity") % 9 == 1, "_unstable:q").otherwise(F.concat(F.lit("q"), "quantity"))
    return invariants.unstable_truths(v("pred").withColumn("key", key), "key")


# -- cohorts and trajectories -----------------------------------------------------------------


@query("""SELECT model, tier, count(*) AS total_keys, count(*) FILTER (n = 4) AS full_cohort, count(*) FILTER (late = 3) AS late_cohort, count(*) FILTER (n = 4) / CAST(count(*) AS DOUBLE) AS full_coverage, count(*) FILTER (late = 3) / CAST(count(*) AS DOUBLE) AS late_coverage
  FROM (SELECT model, tier, fkey, count(DISTINCT opt) AS n, count(DISTINCT CASE WHEN opt <> 'O0' THEN opt END) AS late FROM pred WHERE fkey <> 'k7' GROUP BY model, tier, fkey) AS q GROUP BY model, tier""")
def B13_cohort_coverage(v: Catalog) -> DataFrame:
    rows = v("pred").withColumn("fkey", F.when(F.col("fkey") == "k7", "_unstable:7").otherwise(F.col("fkey")))
    return trajectory.cohort_coverage(rows, ["model", "tier"], "fkey")


@query("SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_multi_tier FROM (SELECT fkey, count(DISTINCT tier) AS n FROM pred GROUP BY fkey) AS q")
def B13_tier_hopping(v: Catalog) -> DataFrame:
    return trajectory.tier_hopping(v("pred"), "fkey")


@query("""SELECT model, count(*) FILTER (b) AS n_tier, count(*) FILTER (b AND k = 3) AS n_paired, count(*) FILTER (b AND k = 3 AND coalesce(t1 <> t3, false)) AS n_hopped, round(avg(CASE WHEN b AND k = 3 THEN a1 - a3 END), 9) AS mean_delta, count(*) FILTER (b AND k = 3) >= 3 AS enough FROM (
  SELECT model, fkey, bool_or(coalesce(opt = 'O1' AND tier = 'BRONZE', false)) AS b, count(DISTINCT CASE WHEN opt <> 'O0' THEN opt END) AS k, min(tier) FILTER (opt = 'O1') AS t1, min(tier) FILTER (opt = 'O3') AS t3, avg(f1) FILTER (opt = 'O1') AS a1, avg(f1) FILTER (opt = 'O3') AS a3 FROM pred GROUP BY model, fkey) AS q GROUP BY model HAVING count(*) FILTER (b) > 0""")
def B13_bronze_cohort(v: Catalog) -> DataFrame:
    return trajectory.tier_cohort(v("pred"), ["model"], "fkey", "f1").withColumn("mean_delta", F.round("mean_delta", 9))


_OPTS = trajectory.OPTS
_MAJORITY = "mt AS (SELECT fkey, opt, tier FROM (SELECT fkey, opt, tier, row_number() OVER (PARTITION BY fkey, opt ORDER BY count(*) DESC, tier) AS rn FROM pred WHERE tier IS NOT NULL GROUP BY fkey, opt, tier) AS q WHERE rn = 1)"
_WIDE = "mw AS (SELECT fkey, " + ", ".join(f"max(tier) FILTER (opt = '{o}') AS tier_{o}" for o in _OPTS) + " FROM mt GROUP BY fkey)"


@query(f"SELECT * FROM (WITH {_MAJORITY}, {_WIDE} SELECT * FROM mw) AS q")
def X10_majority_tiers(v: Catalog) -> DataFrame:
    return trajectory.majority_tiers(v("pred"), "fkey")


_MODELS = [f"m{k}" for k in range(7)]


@query(
    f"SELECT * FROM (WITH {_MAJORITY}, {_WIDE}, f AS (SELECT fkey, " + ", ".join(f"avg(f1) FILTER (model = '{m}' AND opt = '{o}') AS f1_{m}_{o}" for m in _MODELS for o in _OPTS) + " FROM pred GROUP BY fkey)"
    ", h AS (SELECT *, list_filter([tier_O0, tier_O1, tier_O2, tier_O3], lambda t: t IS NOT NULL) AS held FROM mw)"
    " SELECT h.fkey, tier_O0, tier_O1, tier_O2, tier_O3, CAST(len(held) AS INTEGER) AS n_opts_present, CAST(coalesce(held[1] <> held[2], false) AS INTEGER) + CAST(coalesce(held[2] <> held[3], false) AS INTEGER) + CAST(coalesce(held[3] <> held[4], false) AS INTEGER) AS tier_changes, list_contains(held, 'BRONZE') AS ever_bronze, "
    + ", ".join(f"f1_{m}_{o}" for m in _MODELS for o in _OPTS) + " FROM h LEFT JOIN f ON h.fkey = f.fkey) AS q"
)
def J17_trajectories(v: Catalog) -> DataFrame:
    return trajectory.trajectories(v("pred"), "fkey", _MODELS, "f1")


@query("SELECT model, " + ", ".join(f"round(100 * avg(CASE WHEN opt = '{o}' THEN CASE WHEN predicted IS NULL OR predicted = 'FUN_00401000' THEN 1.0 ELSE 0.0 END END), 9) AS trivial_{o}, round(100 * avg(CASE WHEN opt = '{o}' THEN CASE WHEN quantity % 6 = 0 THEN 1.0 ELSE 0.0 END END), 9) AS parse_failure_{o}" for o in _OPTS) + " FROM pred GROUP BY model")
def X09_failure_rates(v: Catalog) -> DataFrame:
    rows = v("pred").withColumns({"is_trivial": names.is_trivial(F.col("predicted")), "parse_ok": F.col("quantity") % 6 != 0})
    t = trajectory.failure_rates(rows, "model", "is_trivial", "parse_ok")
    return t.select("model", *[F.round(c, 9).alias(c) for c in t.columns[1:]])


@query("""SELECT reason, CAST(count_a AS BIGINT) AS count_a, CAST(count_b AS BIGINT) AS count_b FROM (WITH c AS (SELECT reason, coalesce(sum(n) FILTER (opt = 'O0'), 0) AS count_a, coalesce(sum(n) FILTER (opt = 'O3'), 0) AS count_b FROM reasons GROUP BY reason),
  w AS (SELECT sum(n) FILTER (opt = 'O0') AS a, sum(n) FILTER (opt = 'O3') AS b FROM pairs_n),
  r AS (SELECT *, row_number() OVER (ORDER BY greatest(round_even(100.0 * count_a / a, 2), round_even(100.0 * count_b / b, 2)) DESC, reason) AS place FROM c, w)
  SELECT CASE WHEN place <= 3 THEN reason ELSE 'OTHER' END AS reason, sum(count_a) AS count_a, sum(count_b) AS count_b FROM r GROUP BY 1) AS q""")
def U07_other_row(v: Catalog) -> DataFrame:
    return rates.reason_shift(v("reasons"), v("pairs_n"), "O0", "O3", top_k=3).select("reason", "count_a", "count_b")


@query("""SELECT page_id, len(regexp_extract_all(html, '\\bdiv\\b')) AS n_goto, len(list_filter(string_split(html, chr(10)), lambda l: regexp_replace(l, '\\s+', '', 'g') <> '')) AS n_lines, round(CASE WHEN len(list_filter(string_split(html, chr(10)), lambda l: regexp_replace(l, '\\s+', '', 'g') <> '')) > 0 THEN len(regexp_extract_all(html, '\\bdiv\\b')) / CAST(len(list_filter(string_split(html, chr(10)), lambda l: regexp_replace(l, '\\s+', '', 'g') <> '')) AS DOUBLE) ELSE 0.0 END, 9) AS density, page_id % 5 < 2 AS placeholder FROM pages""")
def F23_goto_density(v: Catalog) -> DataFrame:
    code = F.regexp_replace("html", r"\bdiv\b", "goto")
    kind = F.when(F.col("page_id") % 5 == 0, "undefined8").when(F.col("page_id") % 5 == 1, "undefined").when(F.col("page_id") % 5 == 2, "undefinedx").otherwise("int")
    n, lines = decompiled.goto_count(code), decompiled.c_lines(code)
    return v.table("pages").select("page_id", n.cast("long").alias("n_goto"), lines.cast("long").alias("n_lines"), F.round(F.when(lines > 0, n / lines).otherwise(0.0), 9).alias("density"), decompiled.is_undefined_type(kind).alias("placeholder"))
