"""The data model's tables, projected from the supplied ones by integer arithmetic.

Each projection is SQL that Spark and other engines read alike; ``{orders}`` and the
like stand for the supplied tables, other names for the projections before.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # functions of the debug information, four levels
    "fn": """
        SELECT CAST(o_orderkey AS BIGINT) AS function_id, concat('t', CAST(o_custkey % 15 AS STRING)) AS test_case,
          concat('O', CAST(o_orderkey % 4 AS STRING)) AS opt,
          CASE WHEN o_custkey % 23 = 0 THEN NULL ELSE concat('src', CAST(o_custkey % 40 AS STRING), '.c') END AS decl_file,
          CAST(o_custkey AS BIGINT) AS decl_line, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(o_custkey % 9 AS BIGINT) END AS decl_column,
          CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_custkey % 41 = 1 THEN 'frame_dummy' WHEN o_custkey % 41 = 2 THEN '__cxa_finalize@@GLIBC_2.17'
            ELSE concat('Fn_', CAST(o_custkey AS STRING)) END AS name,
          CASE o_orderstatus WHEN 'O' THEN 'ACCEPT' WHEN 'F' THEN 'WARN' ELSE 'REJECT' END AS oracle_verdict,
          CASE CAST(o_orderkey + o_custkey AS BIGINT) % 5 WHEN 0 THEN 'MATCH' WHEN 1 THEN 'MATCH' WHEN 2 THEN 'AMBIGUOUS' WHEN 3 THEN 'NO_MATCH' ELSE 'NON_TARGET' END AS verdict,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DOUBLE) / 128 END AS overlap, CAST(o_orderkey % 37 AS BIGINT) AS gap
        FROM {orders}""",
    # evidence, source functions and origins: 25 parts a unit, two units a source file, 375 orders a file
    "ev_rows": """
        SELECT CAST(l_orderkey AS BIGINT) AS function_id, CAST(floor(l_orderkey / 375) AS BIGINT) AS file,
          CAST(l_orderkey % 25 * 4 + l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS cnt
        FROM {lineitem}""",
    "ts": """
        SELECT concat('f', CAST(p_partkey AS STRING)) AS ts_id, CAST(floor(p_partkey / 25) AS BIGINT) AS tu, CAST(p_partkey % 25 AS BIGINT) * 4 + 1 AS start_line,
          CAST(p_partkey % 25 AS BIGINT) * 4 + 4 + p_size % 4 AS end_line, CAST(p_partkey * 100 AS BIGINT) AS start_byte, CAST(p_partkey * 100 + p_size AS BIGINT) AS end_byte,
          CASE WHEN p_size % 2 = 0 THEN concat('k', CAST(p_partkey % 25 AS STRING)) ELSE concat('u', CAST(p_partkey AS STRING)) END AS context_hash
        FROM {part}""",
    "org": " UNION ALL ".join(f"""
        SELECT CAST(floor(p_partkey / 25) AS BIGINT) AS tu, CAST(p_partkey % 25 * 4 + {n} AS BIGINT) AS i_line, CAST(floor(p_partkey / 50) AS BIGINT) AS file, CAST(p_partkey % 25 * 4 + {n} AS BIGINT) AS line
        FROM {{part}}""" for n in range(1, 5)),
    # ranges and bodies: 3,750 orders and 500 parts a binary; every seventh body leaves a gap
    "ranges": """
        SELECT CAST(l_orderkey AS BIGINT) AS function_id, CAST(floor(l_orderkey / 3750) AS BIGINT) AS bin, CAST(l_partkey % 500 * 16 + l_linenumber AS BIGINT) AS lo,
          CAST(l_partkey % 500 * 16 + l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) % 24 + 1 AS hi
        FROM {lineitem}""",
    "bodies": """
        SELECT concat('b', CAST(p_partkey AS STRING)) AS body_id, CAST(floor(p_partkey / 500) AS BIGINT) AS bin, CAST(p_partkey % 500 * 16 AS BIGINT) AS start,
          CAST(p_partkey % 500 * 16 + CASE WHEN p_partkey % 7 = 0 THEN 4 ELSE 16 + p_size % 4 END AS BIGINT) AS "end", CAST(p_partkey % 500 * 16 AS BIGINT) AS entry, p_size % 19 = 0 AS is_thunk, p_size % 23 = 0 AS is_external
        FROM {part}""",
    # skewed ones: a header line that all functions have and every unit includes; one binary with ranges of all lengths
    "ev_hot": "SELECT * FROM ev_rows UNION ALL SELECT CAST(o_orderkey AS BIGINT) AS function_id, CAST(-1 AS BIGINT) AS file, CAST(7 AS BIGINT) AS line, CAST(o_orderkey % 60 + 1 AS BIGINT) AS cnt FROM {orders}",
    "ts_hot": """
        SELECT * FROM ts UNION ALL SELECT DISTINCT concat('h', CAST(CAST(floor(p_partkey / 25) AS BIGINT) AS STRING)) AS ts_id, CAST(floor(p_partkey / 25) AS BIGINT) AS tu, CAST(900 AS BIGINT) AS start_line, CAST(900 AS BIGINT) AS end_line, CAST(9000 AS BIGINT) AS start_byte,
          CAST(9010 AS BIGINT) AS end_byte, concat('k', CAST(CAST(floor(p_partkey / 100) AS BIGINT) AS STRING)) AS context_hash FROM {part}""",
    "org_hot": "SELECT * FROM org UNION ALL SELECT DISTINCT CAST(floor(p_partkey / 25) AS BIGINT) AS tu, CAST(900 AS BIGINT) AS i_line, CAST(-1 AS BIGINT) AS file, CAST(7 AS BIGINT) AS line FROM {part}",
    "ranges_hot": """
        SELECT CAST(l_orderkey AS BIGINT) AS function_id, CAST(0 AS BIGINT) AS bin, CAST(l_partkey * 64 + l_linenumber * 3 AS BIGINT) AS lo, CAST(l_partkey * 64 + l_linenumber * 3 AS BIGINT) +
          CASE WHEN l_orderkey % 4000 = 1 AND l_linenumber = 1 THEN CAST(1099511627776 AS BIGINT) WHEN l_linenumber = 2 THEN CAST(1000 AS BIGINT) WHEN l_linenumber = 3 THEN CAST(1 AS BIGINT) WHEN l_linenumber = 4 THEN CAST(8 AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END AS hi
        FROM {lineitem}""",
    "bodies_hot": """
        SELECT concat('b', CAST(p_partkey AS STRING)) AS body_id, CAST(0 AS BIGINT) AS bin, CAST(p_partkey * 64 AS BIGINT) AS start, CAST(p_partkey * 64 + CASE WHEN p_partkey % 97 = 0 THEN 65536 WHEN p_partkey % 7 = 0 THEN 4 ELSE 50 + p_size % 14 END AS BIGINT) AS "end",
          CAST(p_partkey * 64 AS BIGINT) AS entry, p_size % 19 = 0 AS is_thunk, p_size % 23 = 0 AS is_external
        FROM {part}""",
    "fn_pc": "SELECT f.function_id, f.test_case, f.opt, coalesce(r.lo, 0) AS low_pc FROM fn f LEFT JOIN (SELECT function_id, min(lo) AS lo FROM ranges GROUP BY function_id) r ON f.function_id = r.function_id",
    # functions after both joins
    "joined_raw": """
        SELECT function_id, test_case, opt, name, oracle_verdict, function_id % 23 <> 0 AS has_range, function_id % 19 = 0 AS is_non_target,
          CASE WHEN decl_line % 7 < 4 THEN 'MATCH' WHEN decl_line % 7 = 4 THEN 'AMBIGUOUS' WHEN decl_line % 7 = 5 THEN 'NO_MATCH' END AS align_verdict,
          CASE WHEN decl_line % 7 = 6 THEN NULL WHEN decl_line % 3 = 0 THEN decl_line % 6 ELSE 1 END AS n_candidates,
          CASE WHEN decl_line % 7 = 6 THEN NULL ELSE CAST(least(128, 90 + function_id % 60) AS DOUBLE) / 128 END AS overlap_ratio,
          CAST(least(64, function_id * 7 % 101) AS DOUBLE) / 64 AS pc_ratio, CASE WHEN decl_line % 11 = 0 THEN 1 ELSE 0 END AS n_near_ties,
          decl_line % 29 = 0 AS is_thunk, decl_line % 31 = 0 AS is_plt, decl_line % 37 = 0 AS is_external,
          CASE WHEN decl_line % 6 = 0 THEN 'LOW' WHEN decl_line % 6 < 3 THEN 'MEDIUM' ELSE 'HIGH' END AS cfg_completeness,
          CASE function_id % 9 WHEN 0 THEN 'UNRESOLVED_INDIRECT_JUMP' WHEN 1 THEN 'UNREACHABLE_BLOCKS_REMOVED,SWITCH_RECOVERY_FAILED' WHEN 2 THEN 'DECOMPILE_TIMEOUT,INLINE_LIKELY' ELSE '' END AS warning_text,
          CASE WHEN function_id % 23 <> 0 AND function_id % 5 > 0 THEN concat('d', CAST(decl_line % 700 AS STRING)) END AS body_id,
          CAST(function_id % 90 AS BIGINT) AS bb_count, CAST(1 + function_id % 64 AS BIGINT) AS c_lines, CAST(function_id % 11 AS BIGINT) AS goto_count,
          CAST(function_id % 16 AS DOUBLE) / 16 AS placeholder_rate, CAST(function_id % 400 AS BIGINT) AS size_bytes, CAST(function_id % 30 AS BIGINT) AS temp_vars
        FROM fn""",
    # predictions and their truth
    "pred": """
        SELECT CAST(l.l_orderkey * 8 + l.l_linenumber AS BIGINT) AS job, concat('t', CAST(l.l_suppkey % 15 AS STRING)) AS test_case, concat('O', CAST(l.l_orderkey % 4 AS STRING)) AS opt,
          concat('m', CAST(l.l_suppkey % 7 AS STRING)) AS model, CASE l.l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN 'GOLD' WHEN 2 THEN 'SILVER' ELSE 'BRONZE' END AS tier,
          CASE l.l_linenumber WHEN 1 THEN replace(p.p_name, ' ', '_') WHEN 2 THEN upper(replace(p.p_name, ' ', '-')) WHEN 3 THEN concat('get', upper(substring(p.p_name, 1, 1)), substring(replace(p.p_name, ' ', '2'), 2, 99))
            WHEN 4 THEN 'FUN_00401000' WHEN 5 THEN concat('XML', upper(substring(p.p_name, 1, 1)), substring(replace(p.p_name, ' ', 'Ring7'), 2, 99)) WHEN 6 THEN NULL ELSE concat(replace(p.p_name, ' ', '__'), '_') END AS predicted,
          replace(g.p_name, ' ', '_') AS ground_truth, replace(p.p_name, ' ', '_') AS second, replace(g.p_name, ' ', '-') AS third, CAST(l.l_quantity AS BIGINT) AS quantity,
          CAST(l.l_quantity AS DOUBLE) / 64 AS f1, concat('k', CAST(l.l_partkey % 300 AS STRING)) AS fkey
        FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey JOIN {part} g ON g.p_partkey = l.l_partkey - l.l_partkey % 3""",
    "reports": """
        SELECT test_case, opt, sum(CASE WHEN oracle_verdict = 'ACCEPT' THEN 1 ELSE 0 END) AS accept, sum(CASE WHEN oracle_verdict = 'WARN' THEN 1 ELSE 0 END) AS warn,
          sum(CASE WHEN oracle_verdict = 'REJECT' THEN 1 ELSE 0 END) AS reject, sum(CASE WHEN verdict = 'MATCH' THEN 1 ELSE 0 END) AS match, sum(CASE WHEN verdict = 'AMBIGUOUS' THEN 1 ELSE 0 END) AS ambiguous,
          sum(CASE WHEN verdict = 'NO_MATCH' THEN 1 ELSE 0 END) AS no_match, sum(CASE WHEN verdict = 'NON_TARGET' THEN 1 ELSE 0 END) AS non_target
        FROM fn GROUP BY test_case, opt""",
    "reasons": """
        SELECT test_case, opt, concat('REASON_', CAST(gap % 6 AS STRING)) AS reason, count(*) AS n FROM fn WHERE verdict <> 'NON_TARGET' AND NOT (opt = 'O0' AND gap % 6 = 5) GROUP BY test_case, opt, concat('REASON_', CAST(gap % 6 AS STRING))""",
    "pairs_n": "SELECT test_case, opt, count(*) AS n FROM fn WHERE verdict <> 'NON_TARGET' GROUP BY test_case, opt",
    # decompiled variables, blocks and calls, one function per order
    "vars": """
        SELECT CAST(l_orderkey AS BIGINT) AS function_id, CAST(l_linenumber AS BIGINT) AS pos, CAST(l_partkey AS BIGINT) AS part, l_linenumber = 1 AS is_param,
          CASE l_suppkey % 5 WHEN 0 THEN 'STACK' WHEN 1 THEN 'REGISTER' WHEN 2 THEN 'MEMORY' WHEN 3 THEN 'UNIQUE' ELSE 'UNKNOWN' END AS storage_class,
          CASE WHEN l_partkey % 4 = 0 THEN concat('uVar', CAST(l_partkey AS STRING)) ELSE concat('local_', CAST(l_partkey AS STRING)) END AS name,
          CASE WHEN l_partkey % 3 = 0 THEN 'undefined8' WHEN l_partkey % 3 = 1 THEN 'int' ELSE 'undefinedx' END AS type_str,
          CASE WHEN l_partkey % 6 <> 0 THEN CAST(l_quantity AS BIGINT) - 25 END AS stack_offset, CASE WHEN l_partkey % 5 <> 0 THEN concat('R', CAST(l_partkey % 16 AS STRING)) END AS register_name,
          CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey * 16 AS BIGINT) END AS addr_va, CAST(l_quantity AS BIGINT) AS site_a, CAST(l_suppkey AS BIGINT) AS site_b
        FROM {lineitem}""",
}


def sql_for(name: str, tables: dict[str, str], body: str | None = None) -> str:
    """``body`` (or all of a projection) with the projections that it needs in front."""
    body = body or f"SELECT * FROM {name}"
    needed: list[str] = []

    def visit(text: str) -> None:
        for view in VIEWS:
            if re.search(rf"(?<![\w.'{{]){view}(?![\w'])", text) and view not in needed:
                visit(VIEWS[view])
                if view not in needed:
                    needed.append(view)

    visit(body)
    text = (f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in needed)}\n" if needed else "") + body
    for t, said in tables.items():
        text = text.replace(f"{{{t}}}", said)
    return text


class Catalog:
    """The projections over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, body: str, name: str = "") -> DataFrame:
        text = sql_for(name, {}, body)
        used = [t for t in TABLES if f"{{{t}}}" in text]
        for t in used:
            self.table(t).createOrReplaceTempView(f"lodestone_{t}")
        text = text.replace('"end"', "`end`")
        for t in used:
            text = text.replace(f"{{{t}}}", f"lodestone_{t}")
        return self.spark.sql(text)

    def __call__(self, view: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {view}", view)
