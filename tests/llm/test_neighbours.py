"""Nearest neighbours along curves against comparing all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import neighbours

VECTORS = "vec_id bigint, embedding array<float>, label int, score string, rep int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "s", 1) for i, v in rows], VECTORS)


def brute(rows, every=20, k=20):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if q % every == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in ok if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_curve_visits_neighbouring_cells():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = neighbours.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_exact(spark):
    """Odd rows, ties, equal vectors, several lengths and norms; the window reaches all rows."""
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-2, 3, 4)).tolist()) for i in range(1, 300)]
    rows += [(1000 + i, [1, 0, 0, 0]) for i in range(60)] + [(2000, None), (2020, []), (2040, [0, 0, 0, 0]), (2060, [1, None, 0, 0]), (2080, [float("nan"), 1, 0, 0]), (None, [9, 9, 9, 9])]
    rows += [(3000, [1, 2]), (3001, [5, 5]), (3002, [-1, 0]), (3020, [1, 2, 3]), (40, rows[39][1]), (400, [1e6, 0, 0, 1])]
    rows = [r for n, r in enumerate(rows) if r not in rows[:n]]
    got = found(neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, window=1000))
    want = {q: v for q, v in brute(rows).items() if v}
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)


def test_recall_at_the_shipped_parameters(spark):
    """Clusters, and vectors without any structure, in many blocks; a third of all rows equal."""
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((60, 24))
    x = np.concatenate([centres[rng.integers(0, 60, 4000)] + 0.3 * rng.standard_normal((4000, 24)), rng.standard_normal((2000, 24)), np.tile(centres[0], (3000, 1))])
    rows = list(enumerate(x.tolist()))
    df = table(spark, rows).repartition(6)
    out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=256)
    got, want = found(out), brute(rows)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    assert got[6000] == [(i, got[6000][0][1]) for i in range(6001, 6021)] or [i for i, _ in got[6000]] == [i for i, _ in want[6000]]
    assert neighbours.recall_of(out, df, F.col("vec_id") % 20 == 0) >= 0.9


def test_windows_narrow_where_vectors_cluster(spark):
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((100, 16))
    x = np.repeat(centres, 40, axis=0) + 0.05 * rng.standard_normal((4000, 16))
    df = table(spark, list(enumerate(x.tolist())))
    calls = []
    fit = neighbours.fit_window
    neighbours.fit_window = lambda *a, **k: calls.append(fit(*a, **k)) or calls[-1]
    try:
        out = neighbours.nearest(df, F.col("vec_id") % 20 == 0, block=128)
        got = found(out)
    finally:
        neighbours.fit_window = fit
    assert calls[0] < 400 and len(got) == 200 and all(len(v) == 20 for v in got.values())


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 0.0])], [(1, [1.0]), (2, [2.0])]])
def test_little_or_nothing(spark, rows):
    assert neighbours.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).count() == 0


def test_query_against_comparing_all_pairs(spark):
    from lodestone.llm import registry

    sf = "/root/testdata/sf0.001"
    got = found(registry.op13_neighbours(spark, sf))
    want = brute([(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, v in got.items():
        scores = dict(want[q])
        assert all(abs(s - scores[i]) < 1e-12 for i, s in v if i in scores) and v == sorted(v, key=lambda x: (-x[1], x[0]))
