"""Operators where one group, line or binary holds all rows: results as by brute force, and no
task with more than its share."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import address, align, origin, quantile, scan, trajectory

SCAN = "g string, at bigint, v bigint"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    big = [("all", n, rng.choice([None, rng.randint(-50, 50)])) for n in range(20_000)]
    return big + [(rng.choice(["a", "b", None]), n, rng.choice([None, n])) for n in range(500)]


def test_running_values(spark, rows):
    table = scan.dealt(spark.createDataFrame(rows, SCAN).repartition(7), ["g"], ["at"])
    ops = {"total": ("sum", F.col("v")), "top": ("max", F.col("v")), "last": ("last", F.col("v"))}
    for before in (False, True):
        got = {(r.g, r.at): (r.total, r.top, r.last) for r in scan.running(table, ["g"], ["at"], ops, before).collect()}
        seen = defaultdict(list)
        for g, at, v in sorted(rows, key=lambda r: r[1]):
            if not before and v is not None:
                seen[g].append(v)
            want = (sum(seen[g]), max(seen[g]), seen[g][-1]) if seen[g] else (None, None, None)
            assert got[g, at] == want
            if before and v is not None:
                seen[g].append(v)
        assert len(got) == len(rows)


def test_one_group_spreads_over_all_stretches(spark, rows):
    table = scan.dealt(spark.createDataFrame(rows, SCAN), ["g"], ["at"], parts=16)
    sizes = [r["count"] for r in table.filter("g = 'all'").groupBy(scan.PART).count().collect()]
    assert len(sizes) >= 14 and max(sizes) < 3 * np.mean(sizes)


def test_merge_ranges_of_one_group(spark):
    rng = random.Random(4)
    ranges = [("g", a := rng.randint(0, 90_000), a + rng.randint(0, 12)) for _ in range(9000)] + [("g", 100, 900), (None, 5, 7), (None, 7, 9), ("h", 3, 3), ("h", 0, 1 << 40), ("h", 9, 10)]
    want = []
    for g in ("g", "h", None):
        mine = sorted((a, z) for k, a, z in ranges if k == g and z > a)
        for a, z in mine:
            if want and want[-1][0] == g and a <= want[-1][2]:
                want[-1] = (g, want[-1][1], max(want[-1][2], z))
            else:
                want.append((g, a, z))
    got = scan.merge_ranges(spark.createDataFrame(ranges, "g string, lo bigint, hi bigint").repartition(5), ["g"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_quantiles_and_shares_of_one_group(spark):
    values = [random.Random(5).randint(0, 9999) for _ in range(15_000)]
    df = spark.createDataFrame([("g", v, n) for n, v in enumerate(values)], "g string, v bigint, n bigint").repartition(6)
    ordered = sorted(values)
    got = quantile.nearest_rank(df, ["g"], "v", [0.25, 0.9]).first()
    assert (got.p25, got.p90) == (ordered[3750], ordered[13_500])
    places = {r.n: r.ecdf for r in trajectory.ecdf(df, ["g"], "v", "n").collect()}
    for k, (_, n) in enumerate(sorted((v, n) for n, v in enumerate(values)), 1):
        assert places[n] == k / 15_000


def test_origins_of_one_long_unit(spark):
    lines = [("u", 0, '# 1 "a.c"'), *(("u", n, "x") for n in range(1, 9000)), ("u", 9000, '# 50 "b.c"'), *(("u", n, "y") for n in range(9001, 12_000)), ("v", 0, "no marker")]
    got = {r.i_line: (r.file, r.line) for r in origin.origin_map(spark.createDataFrame(lines, "tu string, i_line int, raw string")).collect()}
    assert got == {**{n: ("a.c", n) for n in range(1, 9000)}, **{n: ("b.c", n - 9001 + 50) for n in range(9001, 12_000)}}


def test_intervals_of_all_scales(spark):
    rng = random.Random(6)
    span = lambda: 1 << rng.randint(0, 40) if rng.random() < 0.2 else rng.randint(1, 40)
    left = [(n, 0, a := rng.randint(0, 3000), a + span()) for n in range(300)] + [(900, 0, 5, 5), (901, 1, 0, 10)]
    right = [(f"b{n}", 0, a := rng.randint(0, 3000), a + span(), n) for n in range(200)]
    lf = spark.createDataFrame(left, "function_id int, bin int, lo bigint, hi bigint")
    rf = spark.createDataFrame(right, "body_id string, bin int, lo bigint, hi bigint, extra int")
    want = sorted((f, i) for f, b, lo, hi in left for i, c, s, e, _ in right if b == c and lo < hi and min(hi, e) > max(lo, s))
    for split in (10, address.SPLIT):
        got = address.pairs(lf, rf, ["bin"], split)
        assert sorted((r.function_id, r.body_id) for r in got.collect()) == want  # each pair once
    assert address.pairs(lf, rf.filter("false"), ["bin"]).count() == 0 == address.pairs(lf.filter("false"), rf, ["bin"]).count()


def test_rows_of_long_ranges_grow_by_levels_only(spark):
    """Ranges of 2^40 bytes over bodies of a few bytes: no row per bucket of the address space."""
    left = spark.range(2000).selectExpr("id AS function_id", "0 AS bin", "id AS lo", "id + 1099511627776 AS hi")
    right = spark.range(3).selectExpr("concat('b', id) AS body_id", "0 AS bin", "id * 1000000000 AS lo", "id * 1000000000 + 4 AS hi")
    met = address.pairs(left, right, ["bin"])
    assert met.count() == 2000 * 3 - sum(1 for n in range(2000) if n >= 4)


def test_one_header_line_of_50_000_functions(spark):
    """Every function has one header's line, which 400 units include: 20 million pairs, of which
    none is formed, since the copies of the header's function are one class."""
    n, units = 50_000, 400
    own = spark.range(n).selectExpr("id AS function_id", "id % 400 AS file", "1 + id % 50 AS line", "10L AS cnt")
    ev = own.unionByName(spark.range(n).selectExpr("id AS function_id", "-1L AS file", "7L AS line", "1L AS cnt"))
    spans = spark.range(units).selectExpr("concat('s', id) AS ts_id", "id AS tu", "1L AS start_line", "50L AS end_line", "0L AS start_byte", "90L AS end_byte", "concat('k', id) AS context_hash")
    spans = spans.unionByName(spark.range(units).selectExpr("concat('h', id) AS ts_id", "id AS tu", "900L AS start_line", "900L AS end_line", "100L AS start_byte", "110L AS end_byte", "'header' AS context_hash"))
    org = spark.range(units).selectExpr("id AS tu", "explode(sequence(1L, 50L)) AS i_line").selectExpr("tu", "i_line", "tu AS file", "i_line AS line")
    org = org.unionByName(spark.range(units).selectExpr("id AS tu", "900L AS i_line", "-1L AS file", "7L AS line"))
    classes = align.classes(ev, spans, org, split=5000)
    assert classes.pairs.count() <= 2 * n
    got = align.rank(classes)
    assert got.agg(F.count("*"), F.min("n_candidates"), F.max("n_candidates"), F.sum("n_ties")).first() == (n, units + 1, units + 1, 0)
    assert got.filter("b.ts_id = concat('s', function_id % 400)").count() == n


def test_overlap_pairs_are_not_shuffled(spark, tmp_path):
    """Ranges of 2^40 over all bodies: a result of 400,000 pairs, of which the join hands on each as it
    finds it, from several tasks; only pairs that several ranges make are summed."""
    left = spark.range(200).selectExpr("id AS function_id", "0 AS bin", "id AS lo", "id + 1099511627776 AS hi")
    left = left.unionByName(spark.range(200).selectExpr("id AS function_id", "0 AS bin", "id * 7 + 3 AS lo", "id * 7 + 5 AS hi"))
    right = spark.range(2000).selectExpr("concat('b', id) AS body_id", "0 AS bin", "id * 64 AS start", "id * 64 + 50 AS end")
    got = address.overlaps(left, right, split=100)
    got.write.parquet(str(tmp_path / "pairs"))
    written = spark.read.parquet(str(tmp_path / "pairs"))
    rows = {(r.function_id, r.body_id): r.bytes for r in written.collect()}
    overlap = lambda a, z, n: max(0, min(z, n * 64 + 50) - max(a, n * 64))
    assert rows == {(f, f"b{n}"): b for f in range(200) for n in range(2000) if (b := overlap(f, f + (1 << 40), n) + overlap(f * 7 + 3, f * 7 + 5, n))}
    assert written.count() == len(rows) and len(written.inputFiles()) > 1
    # no aggregation over the pairs that the join of segments makes
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")


def test_overlaps_of_many_ranges_and_bodies_of_several_intervals(spark):
    rng = random.Random(12)
    ranges = [(rng.choice([1, 2, 3, None]), rng.randint(0, 1), a := rng.randint(0, 400), a + rng.choice([0, 1, 5, 90, 1 << 20])) for _ in range(120)]
    bodies = [(f"b{rng.randint(0, 40)}", rng.randint(0, 1), a := rng.randint(0, 400), a + rng.choice([0, 1, 8, 70])) for _ in range(60)]
    want = defaultdict(int)
    for f, b, lo, hi in ranges:
        for i, c, s, e in bodies:
            if b == c and lo < e and s < hi and hi > lo and e > s:
                want[f, i] += min(hi, e) - max(lo, s)
    left = spark.createDataFrame(ranges, "function_id int, bin int, lo bigint, hi bigint")
    right = spark.createDataFrame(bodies, "body_id string, bin int, start bigint, end bigint")
    for split, most in ((3, 1000), (address.SPLIT, 15)):
        got = address.overlaps(left, right, split, most).collect()
        assert {(r.function_id, r.body_id): r.bytes for r in got} == want and len(got) == len(want)


def test_merge_ranges_of_small_groups_deals_rows_once(spark):
    rng = random.Random(14)
    ranges = [(rng.choice(["a", "b", "c", None]), a := rng.randint(0, 900), a + rng.randint(0, 9)) for _ in range(400)] + [("big", a := rng.randint(0, 9000), a + rng.randint(0, 9)) for _ in range(900)]
    rows = spark.createDataFrame(ranges, "g string, lo bigint, hi bigint").repartition(5)
    one, both = scan.merge_ranges(rows, ["g"]), scan.merge_ranges(rows, ["g"], most=500)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(repr, one.collect())) == sorted(map(repr, both.collect()))


def test_shared_bodies_are_worked_out_once(spark):
    """The counts of a body and the rows that they are joined to come from one stored table."""
    bodies = spark.createDataFrame([("a", 0, 0, 100, 0, False, False), ("b", 0, 90, 200, 90, False, False)], "body_id string, bin int, start bigint, end bigint, entry bigint, is_thunk boolean, is_external boolean")
    ranges = spark.createDataFrame([(1, 0, 0, 95), (2, 0, 5, 20), (3, 0, 150, 160), (3, 0, 155, 170), (4, 1, 0, 9)], "function_id int, bin int, lo bigint, hi bigint")
    best = address.best_bodies(spark.createDataFrame([(n, 0) for n in range(1, 5)], "function_id int, low_pc bigint"), ranges, bodies)
    assert {(r.function_id, r.body_id, r.overlap_bytes) for r in best.collect()} == {(1, "a", 95), (2, "a", 15), (3, "b", 25), (4, None, 0)}
    got = address.many_to_one(best.select("function_id", "body_id"))
    assert {(r.function_id, r.n_sharing, r.is_shared) for r in got.collect()} == {(1, 2, True), (2, 2, True), (3, 1, False), (4, None, False)}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
