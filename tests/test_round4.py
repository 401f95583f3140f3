"""Findings of the fourth round."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestone.operators import address, align, stats
from tests.test_round3 import both, linked


@pytest.fixture(scope="module")
def alignment(spark):
    """Functions and spans of a few lines, many of them copies of each other, as frames and rows."""
    rng = random.Random(41)
    ev = {}
    for f in range(150):
        like = rng.randrange(f) if f and rng.random() < 0.3 else None
        ev[f] = ev[like] if like is not None else {(rng.randint(0, 2), rng.randint(1, 9)): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
    spans = [(f"s{n}", u := rng.randint(0, 5), a := rng.randint(1, 9), min(9, a + rng.randint(0, 3)), 10 * n, 10 * n + rng.randint(1, 3), rng.choice(["k1", "k2", f"u{n}", None])) for n in range(60)]
    org = [(u, i, u // 2, i) for u in range(6) for i in range(1, 10)]
    frames = (
        spark.createDataFrame([(f, a, b, c) for f, lines in ev.items() for (a, b), c in lines.items()], "function_id bigint, file bigint, line bigint, cnt bigint"),
        spark.createDataFrame(spans, "ts_id string, tu bigint, start_line bigint, end_line bigint, start_byte bigint, end_byte bigint, context_hash string"),
        spark.createDataFrame(org, "tu bigint, i_line bigint, file bigint, line bigint"),
    )
    return frames, ev, spans


def pairs_of(ev, spans):
    """{function: [(ratio, overlap, span, tu, start_byte, ts_id, context_hash)]}, best first."""
    met = defaultdict(list)
    for f, lines in ev.items():
        for ts, tu, a, z, lo, hi, context in spans:
            if overlap := sum(n for (file, line), n in lines.items() if file == tu // 2 and a <= line <= z):
                met[f].append((-round(overlap / sum(lines.values()), 6), -overlap, hi - lo, tu, lo, ts, context))
        met[f].sort(key=lambda c: c[:6])
    return {f: c for f, c in met.items() if c}


def test_F1_ranks_by_brute_force(spark, alignment):
    frames, ev, spans = alignment
    want = {}
    for f, cands in pairs_of(ev, spans).items():
        near = [c for c in cands[1:] if abs(c[0] - cands[0][0]) <= 0.02]
        want[f] = (cands[0][5], -cands[0][1], len(cands), len(near), any(c[6] is not None and c[6] == cands[0][6] and c[3] != cands[0][3] for c in near))
    for split in (3, align.SPLIT):
        c = align.classes(*frames, split=split)
        assert {r.function_id: (r.b.ts_id, r.b.overlap, r.n_candidates, r.n_ties, r.replicated) for r in align.rank(c).collect()} == want
        every = {(r.function_id, r.ts_id, r.overlap, r.ratio) for r in align.candidates(c).collect()}
        assert every == {(f, c[5], -c[1], -c[0]) for f, cands in pairs_of(ev, spans).items() for c in cands}


def test_F1_pairs_carry_numbers_only(spark, alignment):
    """What is shuffled for each pair are a few numbers: no digest, name or context."""
    frames, _, _ = alignment
    c = align.classes(*frames)
    assert {kind for _, kind in c.pairs.dtypes} == {"bigint"}
    functions = frames[0].select("function_id").distinct().count()
    assert c.functions.select("fkey").distinct().count() < functions == c.functions.count()
    # evidence is shuffled by function and by digest once, and a function's total comes with it
    targets = frames[0].select("function_id").distinct().withColumn("multi_file", F.lit(False))
    plan = align.align(targets, *frames)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(cnt") == 0


def test_F8_wilcoxon_of_one_difference(spark, tmp_path):
    """The SQL's p is that of z for any number of differences; the operator's is exact for few."""
    changed = linked(tmp_path, lineitem="SELECT * REPLACE (CASE WHEN l_orderkey % 4 = 0 AND l_partkey % 300 = 5 THEN 2.0 ELSE 1.0 END AS l_quantity) FROM {t}")
    got, want = both(spark, changed, "B02_wilcoxon")
    assert got == want and got and all(", 1, 1.0, 1.0, 0.158655254" in row for row in got)
    rows = spark.createDataFrame([("g", 1)], "g string, d long")
    assert stats.wilcoxon_test(rows, ["g"], "d").first().p == 0.5


def test_F11_only_rows_that_can_meet_are_shuffled(spark):
    """Ranges of one byte climb to bodies of 64; no body climbs to them, so they are not in cells of their own."""
    left = spark.range(100).selectExpr("id AS lo", "id + 1 AS hi").withColumn("_own", F.expr(address._LEVEL))
    right = spark.range(10).selectExpr("64 * id AS lo", "64 * id + 64 AS hi").withColumn("_own", F.expr(address._LEVEL))
    assert address._cells(left, 1, [6], 0, ">=").count() == 100
    assert address._cells(right, 0, [0], 1, ">").count() == 10
    assert address._cells(left, 1, [], 0, ">=").count() == 0


def test_F11_neighbours_beyond_reach_are_left_out(spark):
    rng = random.Random(43)
    ranges = [(f, 0, a := rng.randint(0, 3000), a + rng.choice([1, 8, 40, 1 << 20])) for f in range(60) for _ in range(4)]
    bodies = [(f"b{n}", 0, a := rng.randint(0, 3000), a + rng.choice([4, 16, 50])) for n in range(150)]
    left = spark.createDataFrame(ranges, "function_id int, bin int, lo bigint, hi bigint")
    cut = address._segments(left)
    near = address._in_reach(cut, 50)
    assert near.count() == cut.count()
    assert near.filter("before <= lo - 50 OR after.lo >= hi + 50").count() == 0
    assert near.filter("before IS NOT NULL").count() < cut.filter("before IS NOT NULL").count()
    want = defaultdict(int)
    for f, _, lo, hi in ranges:
        for body, _, start, end in bodies:
            if lo < end and start < hi:
                want[f, body] += min(hi, end) - max(lo, start)
    got = address.overlaps(left, spark.createDataFrame(bodies, "body_id string, bin int, start bigint, end bigint")).collect()
    assert {(r.function_id, r.body_id): r.bytes for r in got} == want and len(got) == len(want)
