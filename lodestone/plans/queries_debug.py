"""Queries of binaries' debug information and of source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import source_spans
from ..sources import debug, sinks
from ..sources.scratch import scratch
from .made_binaries import FILE, UNIT, binaries_of
from .registry import query
from .views import Catalog

# What made_binaries writes, said in SQL: every fifth unit is broken.
_PARTS = f"""p AS (SELECT CAST(p_partkey AS BIGINT) AS key, replace(p_name, ' ', '_') AS name, CAST(p_size AS BIGINT) AS size, concat('b', CAST(floor(p_partkey / {FILE}) AS BIGINT)) AS file,
    CAST(floor(p_partkey / {UNIT}) AS BIGINT) AS unit, 4194304 + p_partkey % {FILE} * 64 AS low, CASE WHEN p_size % 11 = 0 THEN 3 ELSE p_size % 3 END AS kind FROM part),
  q AS (SELECT *, 2 + unit % 4 AS version, CASE WHEN unit % 4 = 3 THEN '/five/' ELSE '/home/' END AS home, unit % 5 = 4 AS broken FROM p)"""
_PATH = "concat(home, CASE WHEN size % 2 = 0 THEN 'main.c' WHEN version = 5 THEN 'part.h' ELSE 'inc/part.h' END)"


def _debug(v: Catalog, table: str) -> DataFrame:
    root = scratch(v.spark, "debug")
    sinks.write_files(binaries_of(v.table("part")).select(F.concat(F.lit(f"{root}/b"), "bin").alias("path"), "content")).count()
    v.spark.dataSource.register(debug.DebugInfo)
    return v.spark.read.format("debug_info").option("table", table).option("sliceBytes", 4096).load(root)


@query(f"""SELECT * FROM (WITH {_PARTS} SELECT file, CASE WHEN NOT broken THEN concat('unit', unit, '.c') END AS name, CASE WHEN NOT broken THEN rtrim(home, '/') END AS comp_dir, CASE WHEN NOT broken THEN CAST(version AS INT) END AS version,
  CASE WHEN NOT broken THEN 12 END AS language, CASE WHEN NOT broken THEN count(*) END AS n_functions, CASE WHEN NOT broken THEN CAST(sum(size % 4 + 1) AS BIGINT) END AS n_lines FROM q GROUP BY file, unit, version, home, broken) AS x""")
def S15_debug_units(v: Catalog) -> DataFrame:
    return _debug(v, "units").drop("unit_offset")


@query(f"SELECT * FROM (WITH {_PARTS} SELECT file, low + 4 * i AS address, {_PATH} AS path, size + i AS line, true AS is_stmt FROM q, LATERAL (SELECT unnest(range(size % 4 + 1)) AS i) WHERE NOT broken) AS x")
def F33_debug_lines(v: Catalog) -> DataFrame:
    return _debug(v, "lines").drop("unit_offset")


@query(f"""SELECT * FROM (WITH {_PARTS}, r AS (SELECT key, CASE kind WHEN 0 THEN [low, low + 8 + size] WHEN 1 THEN [low, low + size] WHEN 2 THEN [low, low + 16] END AS r FROM q
    UNION ALL SELECT key, [low + 24, low + 24 + size % 8] FROM q WHERE kind = 2 AND size % 8 > 0)
  SELECT file, name, CASE WHEN kind = 1 THEN concat('_Z', q.key) END AS linkage_name, kind = 3 AS is_declaration, kind = 0 AS is_external, {_PATH} AS decl_file, size AS decl_line, r[1] AS lo, r[2] AS hi
  FROM q JOIN r ON q.key = r.key WHERE NOT broken) AS x""")
def F34_debug_functions(v: Catalog) -> DataFrame:
    rows = _debug(v, "functions").select("file", "name", "linkage_name", "is_declaration", "is_external", "decl_file", "decl_line", F.explode_outer("ranges").alias("r"))
    return rows.select("*", "r.lo", "r.hi").drop("r")


# A unit of source for each document: its text as a comment, and one to three functions.
_HEAD = "concat('/* ', replace(coalesce(text, ''), '*/', ''), ' */', chr(10), '# 1 \"unit.c\"', chr(10))"
_SIGN = "concat('int f', doc_id, '_', k, '(int a)', chr(10))"
_BODY = "concat('{ for (int i = 0; i < a; i++) { if (a == ', chr(39), '}', chr(39), ') { switch (a) { case 1: return 2; default: goto out; } } else while (a--) ; } do { a = \"{\"[0]; } while (a); out: return ', doc_id, '; }')"


def source_units(v: Catalog) -> DataFrame:
    each = v.table("documents").withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 3 + 1).cast("int"))))
    one: Column = F.concat(F.expr(_SIGN), F.expr(_BODY), F.lit("\n"))
    parts = each.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "").alias("functions"))
    return v.table("documents").join(parts, "doc_id").select("doc_id", F.concat(F.expr(_HEAD), "functions").alias("text"))


@query(f"""SELECT doc_id, concat('f', doc_id, '_', k) AS name, 2 + len(text) - len(replace(text, chr(10), '')) + 2 * (k - 1) AS start_line, CAST(strlen(head) + (k - 1) * (strlen(sign) + strlen(body) + 1) AS BIGINT) AS start_byte,
    CAST(strlen(head) + (k - 1) * (strlen(sign) + strlen(body) + 1) + strlen(sign) AS BIGINT) AS body_byte, CAST(strlen(head) + k * (strlen(sign) + strlen(body) + 1) - 1 AS BIGINT) AS end_byte, 14 AS n_nodes, 2 AS n_deep
  FROM (SELECT doc_id, k, replace(coalesce(text, ''), '*/', '') AS text, {_HEAD} AS head, {_SIGN} AS sign, {_BODY} AS body FROM documents, LATERAL (SELECT unnest(range(1, doc_id % 3 + 2)) AS k)) AS x""")
def F37_source_functions(v: Catalog) -> DataFrame:
    rows = source_spans.with_functions(source_units(v)).select("doc_id", F.explode("functions").alias("f"))
    return rows.select("doc_id", "f.name", "f.start_line", "f.start_byte", "f.body_byte", "f.end_byte", F.size("f.nodes").alias("n_nodes"), F.size(F.filter("f.nodes", lambda n: n["depth"] >= 8)).alias("n_deep"))


# The places of the structures in a body, and their depths.
_KINDS = [("compound_statement", "{ for", 1), ("for_statement", "for (", 2), ("compound_statement", "{ if", 3), ("if_statement", "if (", 4), ("compound_statement", "{ switch", 5), ("switch_statement", "switch", 6), ("compound_statement", "{ case", 7), ("return_statement", "return 2", 9), ("goto_statement", "goto", 9), ("while_statement", "while (a--", 6), ("do_statement", "do {", 2), ("compound_statement", "{ a =", 3), ("labeled_statement", "out: return", 2), ("return_statement", "out: return", 3)]


@query(" UNION ALL ".join(f"""SELECT doc_id, '{kind}' AS node_type, {depth} AS depth, CAST(strlen(concat({_HEAD}, {_SIGN})) + instr({_BODY}, '{text}') - 1 + {5 if (kind, text[:3]) == ("return_statement", "out") else 0} AS BIGINT) AS start_byte
  FROM (SELECT doc_id, text, 1 AS k FROM documents) AS x""" for kind, text, depth in _KINDS))
def F37_source_nodes(v: Catalog) -> DataFrame:
    first = source_spans.with_functions(source_units(v)).select("doc_id", F.element_at("functions", 1).alias("f"))
    return first.select("doc_id", F.explode("f.nodes").alias("n")).select("doc_id", "n.node_type", "n.depth", "n.start_byte")
