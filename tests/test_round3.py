"""Cases of the third round's findings, each small."""

import json
import math
import random

import duckdb
from pyspark.sql import functions as F

from lodestone.functions import decompiled
from lodestone.operators import address, report, stats
from lodestone.plans import registry
from lodestone.plans.views import TABLES
from lodestone.sources import binaries, debug, readers, sinks
from lodestone.streaming import keyed, results

SF = "/root/testdata/sf0.001"


def both(spark, folder, name):
    """Rows of a query and of its SQL, over the tables in ``folder``."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.queries()[name](spark, str(folder))
    said = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in said.description].index(c) for c in df.columns]
    return sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in at)) for r in said.fetchall())


def linked(folder, **changed):
    """The smallest tables in ``folder``, but for those given as SQL over the old ones."""
    for t in TABLES:
        if t in changed:
            duckdb.connect().execute(f"COPY ({changed[t].format(t=f"'{SF}/{t}.parquet'")}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return folder


def test_effect_size_without_spread(spark):
    rows = spark.createDataFrame([("zero", 0), ("zero", 0), ("up", 2), ("up", 2), ("down", -1), ("down", -1), ("one", 3), ("both", 1), ("both", 3)], "g string, d long")
    got = {r.g: r.d for r in rows.groupBy("g").agg(stats.cohens_d(F.col("d")).alias("d")).collect()}
    assert math.isnan(got.pop("zero"))
    assert got == {"up": math.inf, "down": -math.inf, "one": None, "both": 2 / math.sqrt(2)}


def test_wilcoxon_without_differences(spark, tmp_path):
    # every quantity is one, so no difference is left
    got, want = both(spark, linked(tmp_path, lineitem="SELECT * REPLACE (1.0 AS l_quantity) FROM {t}"), "B02_wilcoxon")
    assert got == want == []


def test_top_collisions_list_all_ids(spark):
    rows = spark.range(100).select(F.when(F.col("id") < 70, "a").when(F.col("id") < 98, "b").alias("body_id"), F.col("id").alias("function_id"))
    got = {r.body_id: (r.n, r.ids) for r in report.top_collisions(rows).collect()}
    assert got == {"a": (70, ",".join(map(str, range(70)))), "b": (28, ",".join(map(str, range(70, 98))))}


def test_words_and_lines_of_odd_texts(spark, tmp_path):
    texts = "SELECT i AS doc_id, ['cède de', 'goto de goto', chr(9) || chr(10) || '  ' || chr(10) || 'de', NULL, '', 'deé _de de'][i] AS text, 'fr' AS lang, 'web' AS source, 1 AS n_chars FROM range(1, 7) AS r(i)"
    got, want = both(spark, linked(tmp_path, documents=texts), "F16_line_counts")
    assert got == want
    assert [r.n for r in spark.createDataFrame([("gotoé goto _goto",)], "t string").select(decompiled.goto_count(F.col("t")).alias("n")).collect()] == [2]


def test_pages_tell_all_rows_apart(spark, tmp_path):
    # lines with one key at the edge of the page: quantities decide, whatever the order of the file
    folder = linked(tmp_path, lineitem="SELECT * REPLACE (CAST(1 AS BIGINT) AS l_orderkey, 1 AS l_linenumber, CAST(hash(l_partkey, l_suppkey) % 997 AS DOUBLE) AS l_quantity) FROM {t}")
    got = sorted(r.l_quantity for r in registry.queries()["P11_page_by_index"](spark, str(folder)).collect())
    sizes = sorted(r[0] for r in duckdb.connect().execute(f"SELECT l_quantity FROM '{folder}/lineitem.parquet'").fetchall())
    assert got == sizes[-70:-20]


def test_alignment_broadcasts_nothing_that_grows(spark):
    # by file sizes all of these tables pass for small; only joins with hot lines, at most two a query, are left to the planner
    for name in ("F29_align", "W01_hot_line", "J01_line_overlap", "P14_align_report", "W18_reason_counts"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastExchange") <= 2, name


def test_sharing_counts_functions_without_pairs(spark):
    rnd = random.Random(5)
    spans = lambda n, most: [(rnd.randrange(200), rnd.choice([0, 1, 2, 5, 30, most])) for _ in range(n)]
    ranges = [(rnd.randrange(25), rnd.randrange(2), a, a + n) for a, n in spans(300, 1 << 40)]
    bodies = [(f"b{i}", rnd.randrange(3), a, a + n) for i, (a, n) in enumerate(spans(120, 150))]
    want = {b: len({f for f, k, lo, hi in ranges if k == at and lo < hi and start < end and lo < end and hi > start}) for b, at, start, end in bodies}
    r, b = spark.createDataFrame(ranges, "function_id long, bin long, lo long, hi long"), spark.createDataFrame(bodies, "body_id string, bin long, start long, end long")
    for split in (address.SPLIT, 3):
        assert {x.body_id: x.n_sharing for x in address.sharing(r, b, split).collect()} == {k: n for k, n in want.items() if n}
    # the plan forms no pairs of ranges and bodies: a thousand endless ranges over a thousand bodies
    r, b = spark.range(1000).selectExpr("id AS function_id", "0L AS bin", "id AS lo", "id + 1099511627776 AS hi"), spark.range(1000).selectExpr("concat('b', id) AS body_id", "0L AS bin", "2000 + id * 4 AS start", "2004 + id * 4 AS end")
    assert {x.n_sharing for x in address.sharing(r, b).collect()} == {1000}


def test_runs_need_no_call_for_each_key(spark, tmp_path):
    spark.createDataFrame([(1, None)], "user_id bigint, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = results.read_stream(spark, str(tmp_path / "in"), "user_id bigint, ts timestamp")
    runs = keyed.job_status(stream.withColumn("good", F.col("user_id") > 0), ["user_id"], "ts", "good", 1000, "1 day")
    plan = runs._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan


def test_a_key_has_one_value_of_state():
    # a batch asks once for what a key has, and writes only for a new first row
    asked = []

    class Held:
        value = None

        def get(self):
            asked.append("get")
            return self.value

        def update(self, new):
            asked.append("update")
            self.value = new

    class Handle:
        def getValueState(self, name, schema):
            return Held()

        def registerTimer(self, at):
            asked.append(at)

        def deleteTimer(self, at):
            asked.append(-at)

    first = keyed.FirstRow(["_at", "_place", "field0"], ["bigint", "bigint", "string"], None)
    first.init(Handle())
    for rows, want in (([(5001, 2, "b"), (5001, 1, "a")], ["get", "update", 6]), ([(5001, 3, "c")], ["get"]), ([(4000, 9, "d")], ["get", -6, "update", 4])):
        asked.clear()
        assert list(first.handleInputRows(("k",), iter(rows), None)) == []
        assert asked == want
    assert [tuple(r) for r in first.handleExpiredTimer(("k",), None, None)] == [(4000, 9, "d")]


def test_small_files_are_read_by_the_folder(spark, tmp_path):
    for n in range(2500):
        folder = tmp_path / str(n % 4)
        folder.mkdir(exist_ok=True)
        (folder / f"f{n}").write_bytes(b"x" * (n % 3))
    (tmp_path / "own").write_bytes(b"\xff")
    (tmp_path / ".hidden").write_bytes(b"h")
    (tmp_path / "0" / "_aside").write_bytes(b"h")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        got = readers.whole_files(spark, path)
        assert got.rdd.getNumPartitions() <= 5  # four folders and one run of own files
        assert sorted((r.file, r.size, bytes(r.content)) for r in got.collect()) == sorted([(f"f{n}", n % 3, b"x" * (n % 3)) for n in range(2500)] + [("own", 1, b"\xff")])
    assert binaries.scan_binaries(spark, str(tmp_path)).count() == sum(n % 3 > 0 for n in range(2500)) + 1


def test_debug_slices_share_tasks(tmp_path, monkeypatch):
    for n, size in enumerate((0, 1, 10, 95, 40)):
        (tmp_path / f"b{n}").write_bytes(b"x" * size)
    cut = {(f"b{n}", at) for n, size in enumerate((0, 1, 10, 95, 40)) for at in range(0, max(size, 1), 10)}
    for most in (1, 2, 3, 7, 100):
        monkeypatch.setattr(debug, "PARTITIONS", most)
        parts = debug.DebugReader({"path": str(tmp_path), "sliceBytes": "10"}).partitions()
        assert len(parts) <= most
        held = [(s.name, at) for p in parts for s in p.slices for at in range(s.first, s.last, 10)]
        assert len(held) == len(cut) and set(held) == cut


def test_lines_are_written_without_gathering_a_group(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") < 2900, "a").otherwise("b").alias("g"), "id", F.when(F.col("id") % 2 == 0, "x\ny").alias("t"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this table is small
    files = sinks.write_lines(rows.repartition(3), F.concat(F.lit(f"{tmp_path}/"), "g"), ["g"], ["id"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.path.startswith(f"{tmp_path}/a/") for r in files) > 1
    read = []
    for r in sorted(files, key=lambda r: r.path):
        text = open(r.path, "rb").read()
        assert len(text) == r.size
        read += [json.loads(line) for line in text.decode().splitlines()]
    assert read == [{"id": n, "t": "x\ny" if n % 2 == 0 else None} for n in range(3000)]


def test_sorted_output_has_no_window_over_a_files_rows(spark):
    plan = registry.queries()["W15_sorted_output"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
