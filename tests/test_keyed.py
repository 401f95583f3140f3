"""Keyed state in a stream: what is written, when, and after a restart."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import keyed, results

SCHEMA = "job string, place bigint, ts timestamp, ok boolean"
START = datetime(2024, 1, 1)


def at(hours):
    return START + timedelta(hours=hours)


def put(spark, path, rows):
    spark.createDataFrame([(j, p, at(h), ok) for j, p, h, ok in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, make):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = make(results.read_stream(spark, source, SCHEMA, 1))
    q = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), q


def test_first_rows_over_a_restart(spark, tmp_path):
    source = str(tmp_path / "in")
    make = lambda s: keyed.first_rows(s, ["job"], "ts", "place", "10 hours")
    put(spark, source, [("a", 2, 5, True), ("a", 1, 5, False), ("b", 3, 8, True)])
    put(spark, source, [("a", 9, 3, True), ("b", 4, 9, True), ("c", 5, 9, True)])  # earlier than what came before
    got, _ = run(spark, tmp_path, make)
    assert got.count() == 0  # the watermark has passed none
    put(spark, source, [("z", 6, 100, True)])
    got, _ = run(spark, tmp_path, make)  # goes on from the checkpoint
    assert sorted((r.job, r.place) for r in got.collect()) == [("a", 9), ("b", 3), ("c", 5)]
    put(spark, source, [("a", 7, 120, True), ("b", 8, 20, True), ("y", 1, 300, True)])  # known, late and known, new
    got, _ = run(spark, tmp_path, make)
    assert sorted((r.job, r.place) for r in got.collect()) == [("a", 9), ("b", 3), ("c", 5), ("z", 6)]


def test_remembered_for_a_time_only(spark, tmp_path):
    source = str(tmp_path / "in")
    make = lambda s: keyed.first_rows(s, ["job"], "ts", "place", "1 hour", keep_days=2)
    for rows in ([("a", 1, 0, True)], [("x", 2, 30, True)], [("a", 3, 31, True)], [("x", 4, 200, True)], [("a", 5, 210, True)], [("x", 6, 400, True)]):
        put(spark, source, rows)
        got, _ = run(spark, tmp_path, make)
    assert sorted(r.place for r in got.filter("job = 'a'").collect()) == [1, 5]


def test_runs_join_whatever_the_order(spark, tmp_path):
    source = str(tmp_path / "in")
    make = lambda s: keyed.job_status(s, ["job"], "ts", "ok", 2 * 3_600_000, "12 hours")
    put(spark, source, [("a", 1, 0, True), ("a", 2, 4, True), ("b", 3, 1, False)])
    put(spark, source, [("a", 4, 2, False), ("b", 5, 1, False), ("a", 6, 9, True)])  # joins 0 and 4
    put(spark, source, [("z", 7, 100, True)])
    got, _ = run(spark, tmp_path, make)
    want = [("a", at(0), at(4), 3, 2, "PARTIAL"), ("a", at(9), at(9), 1, 1, "SUCCESS"), ("b", at(1), at(1), 2, 0, "FAILED")]
    assert sorted(map(tuple, got.collect())) == want


def test_batches_touch_their_own_keys_only(spark, tmp_path):
    """After many keys a batch of one key updates one row of state."""
    source = str(tmp_path / "in")
    make = lambda s: keyed.first_rows(s, ["job"], "ts", "place", "10 hours")
    put(spark, source, [(f"k{n}", n, n % 7, True) for n in range(500)])
    run(spark, tmp_path, make)
    put(spark, source, [("new", 1, 8, True)])
    _, q = run(spark, tmp_path, make)
    busy = [p for p in q.recentProgress if p["numInputRows"]]
    assert sum(s["numRowsUpdated"] for p in busy for s in p["stateOperators"]) <= 10


@pytest.fixture(autouse=True)
def store(spark):
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert spark.range(1).select(F.lit(1)).count() == 1
