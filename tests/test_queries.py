"""Every query that has SQL gives the same rows as that SQL run by DuckDB."""

import decimal
import re

import duckdb
import pytest

from lodestone.plans import registry
from lodestone.plans.views import TABLES

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, decimal.Decimal | float):
        return float(f"{float(v):.12g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    assert rows
    if name in SQL:
        rel = duck.sql(SQL[name])
        at = [rel.columns.index(c) for c in columns]
        assert sorted(rel.columns) == columns
        assert rows == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def plan_of(spark, name):
    return registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["J01_line_overlap", "W01_rank_candidates", "F29_align", "J03_address_overlap", "J04_best_body", "J19_points_in_ranges", "J09_transitions", "B07_dunn"])
def test_no_nested_loop_joins(spark, name):
    plan = plan_of(spark, name)
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_queries_read_only_what_they_need(spark):
    plan = plan_of(spark, "A01_evidence")
    assert set(re.findall(r"l_\w+", re.search(r"ReadSchema: struct<([^>]*)>", plan)[1])) == {"l_orderkey", "l_linenumber", "l_quantity"}
    assert "GreaterThanOrEqual(o_orderkey,10)" in plan_of(spark, "W16_page_of_lines")


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
