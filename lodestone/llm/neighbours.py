"""Nearest neighbours by inner product, found along shifted space-filling curves.

Each curve projects all vectors to a few random orthonormal directions, spreads every
coordinate evenly over (0, 1), shifts the point by a random offset of its own, and sorts
all vectors by the point's Hilbert key. Near vectors tend to be near on a curve, and what
one curve tears apart another keeps together. A query looks at all candidates within
``window`` ranks on every curve; what the curves find is merged and ranked by the inner
product of the original vectors in double precision.

Inner products become distances by one more coordinate: candidates are scaled to at
most unit length and completed to it, queries are scaled to unit length (Bachrach et al.,
"Speeding Up the Xbox Recommender System", 2014).

The window is fitted: for at most ``PROBES`` queries, chosen by hash, the true neighbours are
found in one scan of all vectors; the window is the distance on the best curve that ``recall``
of them lie within. It is small where vectors cluster, and wide where they have no structure;
the index is the same at every size. A curve's ranks are cut into blocks of ``block``
candidates, so a task holds one block however vectors are spread, and a query goes to
the blocks that its window reaches.

Equal vectors are one node with its smallest ids: as ties go to smaller ids, no other of
theirs can be among the nearest. Vectors that are null, empty, zero or hold null or
non-finite components, and rows without an id, take no part. Only vectors of one length are
compared. Rows that share an id and a vector count once; a query finds no row of its own id.
A query without candidates has no rows; an empty table gives none. Labels and other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, range_prefix
from .embeddings import _digests

NEAREST = 20
CURVES = 6
DIRECTIONS, BITS = 12, 5
BLOCK = 4096
RECALL = 0.95
#: Queries whose true neighbours fit the window, and vectors that fit the coordinates' spread.
PROBES, SAMPLE = 128, 8192
#: Queries compared with a block at once.
AT_ONCE = 256
#: Inner products this near (of the product of lengths) to the last one kept are computed again in full.
SLACK = 1e-12


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows, directions) along the Hilbert curve through a grid of
    2^bits a side (Skilling, "Programming the Hilbert curve", 2004)."""
    x = [c.copy() for c in cells.astype(np.int64).T]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | (c ^ turn) >> b & 1
    return key


def _unit(x: np.ndarray, longest: float, query: bool) -> np.ndarray:
    """Vectors on the unit sphere of one more dimension."""
    if query:
        return np.column_stack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros(len(x))])
    x = x / longest
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def _curve(dim: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """A curve's directions and its shift, the same in every task."""
    rng = np.random.default_rng([dim, curve])
    directions = np.linalg.qr(rng.standard_normal((dim + 1, min(DIRECTIONS, dim + 1))))[0]
    return directions, rng.uniform(0, 1, directions.shape[1])


def _logistic(z: np.ndarray) -> np.ndarray:
    """Near the normal distribution function, and quick."""
    return 1 / (1 + np.exp(-1.702 * np.clip(z, -40, 40)))


def _spread(sample: list, longest: float, curves: int) -> dict:
    """Means and deviations along each curve's directions, for each vector length of a sample."""
    out = {}
    for dim in {len(v) for v in sample}:
        x = _unit(np.array([v for v in sample if len(v) == dim], np.float64), longest, False)
        for c in range(curves):
            y = x @ _curve(dim, c)[0]
            out[dim, c] = y.mean(axis=0), np.maximum(y.std(axis=0), 1e-12)
    return out


def _matrix(column: pa.Array, at: np.ndarray | None = None) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    column = column if at is None else column.take(pa.array(at))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _keys(longest: float, spread: dict, curves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            asked = b.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                for query in (0, 1):
                    at = np.flatnonzero((dims == dim) & (asked >= query))
                    if not len(at):
                        continue
                    x = _unit(_matrix(b.column(1), at), longest, bool(query))
                    for c in range(curves):
                        directions, shift = _curve(int(dim), c)
                        mean, deviation = spread.get((dim, c), (0, 1))
                        cells = (_logistic((x @ directions - mean) / deviation) + shift) / 2 * (1 << BITS)
                        key = hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)
                        same = lambda v, t: pa.array(np.full(len(at), v, t))  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([same(c, np.int32), same(dim, np.int32), pa.array(key), b.column(0).take(pa.array(at)), same(query, np.int32), same(1 - query, np.int64)], names=["curve", "dim", "key", "rep", "query", "one"])

    return run


def _probe(probes: list[tuple[bytes, list]], k: int):
    """The k best of a task's vectors for each probe, itself aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list] = {rep: [] for rep, _ in probes}
        for b in batches:
            dims, reps = b.column(1).value_lengths().to_numpy(zero_copy_only=False), b.column(0).to_pylist()
            for dim in np.unique(dims):
                at, of = np.flatnonzero(dims == dim), [(rep, v) for rep, v in probes if len(v) == dim]
                if not of:
                    continue
                scores = np.array([v for _, v in of], np.float64) @ _matrix(b.column(1), at).T
                for (rep, _), s in zip(of, scores, strict=True):
                    top = np.argpartition(-s, min(k, len(s) - 1))[: k + 1]
                    best[rep] = sorted([*best[rep], *((-s[i], reps[at[i]]) for i in top if reps[at[i]] != rep)])[:k]
        flat = [(rep, near, -s) for rep, found in best.items() for s, near in found]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), (pa.binary(), pa.binary(), pa.float64()))], names=["rep", "near", "score"])

    return run


def _in_order(scores: np.ndarray, ids: list[list[int]], k: int) -> tuple[list[int], list[float]]:
    """The k best ids of nodes, ties to the smaller id."""
    of = np.repeat(scores, [len(i) for i in ids])
    flat = np.array([v for i in ids for v in i], np.int64)
    order = np.lexsort((flat, -of))[:k]
    return flat[order].tolist(), of[order].tolist()


def _rank(block: pa.RecordBatch, queries: pa.RecordBatch, k: int) -> list[tuple[bytes, list[int], list[float]]]:
    """Each query's k nearest ids in a block."""
    dims, out = block.column("embedding").value_lengths().to_numpy(zero_copy_only=False), []
    asked = queries.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
    ids = block.column("ids").to_pylist()
    for dim in np.intersect1d(dims, asked):
        at, of = np.flatnonzero(dims == dim), np.flatnonzero(asked == dim)
        x = _matrix(block.column("embedding"), at)
        lengths = np.linalg.norm(x, axis=1)
        for a in range(0, len(of), AT_ONCE):
            part = of[a : a + AT_ONCE]
            q = _matrix(queries.column("embedding"), part)
            rough = q @ x.T
            n = min(k, len(at))
            least = -np.partition(-rough, n - 1, axis=1)[:, n - 1]
            for i, row in enumerate(part):
                near = np.flatnonzero(rough[i] >= least[i] - SLACK * np.linalg.norm(q[i]) * lengths.max())
                exact = (x[near] * q[i]).sum(axis=1)  # in one order, so equal pairs score alike in every task
                out.append((queries.column("rep")[int(row)].as_py(), *_in_order(exact, [ids[at[j]] for j in near], k)))
    return out


def _search(k: int):
    """Blocks come with their candidates first, then the queries that reach them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for b in batches:
            out: list[tuple] = []
            home = np.column_stack([b.column("curve").to_numpy(), b.column("block").to_numpy(), b.column("query").to_numpy()])
            cuts = [0, *(np.flatnonzero((home[1:] != home[:-1]).any(axis=1)) + 1).tolist(), b.num_rows] if b.num_rows else []
            for a, z in zip(cuts, cuts[1:]):
                place, query = tuple(home[a, :2].tolist()), home[a, 2]
                if place != at:
                    at, held, block = place, [], None
                if not query:
                    held.append(b.slice(a, z - a))
                elif held:
                    if block is None:
                        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    out += _rank(block, b.slice(a, z - a), k)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64())))], names=["rep", "ids", "scores"])

    return run


def _merge(k: int):
    """What blocks and curves found for a query, which comes in sequence, as its k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, done = None, {}, []

        def close() -> None:
            if last is not None:
                top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
                done.append((last, [{"vec_id": i, "score": s} for i, s in top]))

        def batch() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.binary()), pa.array([f for _, f in done], kind)], names=["rep", "found"])

        for b in batches:
            done = []
            for rep, ids, scores in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if rep != last:
                    close()
                    last, best = rep, {}
                for i, s in zip(ids, scores, strict=True):
                    best[i] = max(s, best.get(i, s))
                if len(best) > 64 * k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])
            if done:
                yield batch()
        done = []
        close()
        if done:
            yield batch()

    return run


def nodes_of(vectors: DataFrame, asked: Column, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, digest) of the queries, and the distinct vectors: rep, embedding, their k + 1
    smallest ids and whether any of them is a query."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    kind = rows.schema["embedding"].dataType.simpleString()
    marked = map_arrow(rows.filter("vec_id IS NOT NULL"), _digests, f"vec_id bigint, embedding {kind}, digest binary").filter("digest IS NOT NULL")
    ids = materialise(marked.select("vec_id", "digest", F.coalesce(asked, F.lit(False)).cast("int").alias("asked")).distinct(), "near-ids")
    # a vector's ids beyond the first ones go before they are shuffled
    place = F.row_number().over(Window.partitionBy("digest", "asked").orderBy("vec_id"))
    first = ids.withColumn("place", place).filter(F.col("place") <= k + 1)
    first = first.groupBy(F.col("digest").alias("rep")).agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    distinct = marked.groupBy("digest").agg(F.first("embedding").alias("embedding"))
    nodes = first.join(distinct, F.col("rep") == F.col("digest")).select("rep", "embedding", "asked", "ids")
    return ids.filter("asked = 1").select("vec_id", "digest"), materialise(nodes, "near-nodes")


def _some(nodes: DataFrame, of: int, most: int) -> list[tuple[bytes, list, list[int]]]:
    """At most ``most`` of ``of`` nodes, chosen by hash."""
    share = min(1.0, 2 * most / max(of, 1) + 64 / max(of, 1))
    dealt = nodes.withColumn("at", F.pmod(F.xxhash64("rep"), F.lit(1 << 30))).filter(F.col("at") < F.lit(int(share * (1 << 30))))
    return [(bytes(r["rep"]), r["embedding"], r["ids"]) for r in dealt.orderBy("at", "rep").limit(most).collect()]


def true_nearest(nodes: DataFrame, probes: list[tuple[bytes, list, list[int]]], k: int) -> DataFrame:
    """(rep, near, score): the k nearest nodes of each probe, itself aside, by one scan."""
    near = map_arrow(nodes.select("rep", "embedding"), _probe([p[:2] for p in probes], k), "rep binary, near binary, score double")
    return near.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "near"))).filter(F.col("place") <= k).drop("place")


def fit_window(nodes: DataFrame, asked: int, ranks: DataFrame, k: int, recall: float, probes: int = PROBES) -> int:
    """Ranks that a query must look to either side so that ``recall`` of the true neighbours
    of at most ``probes`` queries lie within on some curve."""
    pairs = materialise(true_nearest(nodes, _some(nodes.filter("asked = 1"), asked, probes), k).select("rep", "near"), "near-probes")
    # at most probes x k pairs
    of = lambda query, rep, out: ranks.filter(F.col("query") == query).select("curve", F.col("rep").alias(rep), F.col("rank").alias(out))
    met = of(0, "near", "there").join(F.broadcast(pairs), "near")
    here = of(1, "rep", "here").join(F.broadcast(pairs.select("rep").distinct()), "rep", "left_semi")
    gaps = met.join(here, ["curve", "rep"]).groupBy("rep", "near").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("gap"))
    gap = gaps.agg(F.percentile("gap", F.lit(recall))).first()[0]
    return int(gap or 0) + 1


def nearest(vectors: DataFrame, asked: Column, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", curves: int = CURVES, recall: float = RECALL, block: int = BLOCK, window: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows of each row that ``asked``, an
    expression of vec_id, names."""
    queries, nodes = nodes_of(vectors, asked, k, vec_id, embedding)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    n, longest, n_asked = nodes.agg(F.count("*"), F.max(F.sqrt(square)), F.sum("asked")).first()
    sample = [v for _, v, _ in _some(nodes, n, SAMPLE)]
    keys = map_arrow(nodes.select("rep", "embedding", "asked"), _keys(longest, _spread(sample, longest, curves), curves), "curve int, dim int, key bigint, rep binary, query int, one bigint")
    order = [F.col(c) for c in ("dim", "key", "rep", "query")]
    ranks = materialise(range_prefix(keys, order, "one", "rank", group="curve", name="near-keys").select("curve", "rep", "query", "rank"), "near-ranks")
    if window is None:
        window = fit_window(nodes, n_asked or 0, ranks, k, recall)
    reach = F.sequence(F.greatest(F.floor((F.col("rank") - window) / block), F.lit(0)), F.floor(F.least(F.col("rank") + window, F.lit(max(n, 1) - 1)) / block))
    to = F.when(F.col("query") == 0, F.array(F.floor(F.col("rank") / block))).otherwise(reach)
    light = ranks.select("curve", "rep", "query", F.explode(to).alias("block"))
    dealt = light.join(nodes, "rep").select("curve", "block", "query", "rep", "embedding", F.when(F.col("query") == 0, F.col("ids")).alias("ids"))
    dealt = dealt.repartition("curve", "block").sortWithinPartitions("curve", "block", "query")
    found = map_arrow(dealt, _search(k + 1), "rep binary, ids array<bigint>, scores array<double>")
    merged = map_arrow(found.repartition("rep").sortWithinPartitions("rep"), _merge(k + 1), "rep binary, found array<struct<vec_id: bigint, score: double>>")
    near = queries.distinct().join(merged, F.col("digest") == F.col("rep")).withColumn("found", F.expr(f"slice(filter(found, f -> f.vec_id <> vec_id), 1, {k})"))
    return near.select(F.col("vec_id").alias("query_id"), F.posexplode("found").alias("place", "at")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("at.vec_id").alias("vec_id"), F.col("at.score").alias("score"))


def recall_of(found: DataFrame, vectors: DataFrame, asked: Column, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", probes: int = PROBES) -> float:
    """The share of the true nearest that were found, over at most ``probes`` query vectors,
    by one scan of all vectors."""
    _, nodes = nodes_of(vectors, asked, k, vec_id, embedding)
    some = _some(nodes.filter("asked = 1"), nodes.filter("asked = 1").count(), probes)
    ids = {bytes(r["rep"]): r["ids"] for r in nodes.join(F.broadcast(true_nearest(nodes, some, k).select(F.col("near").alias("rep")).distinct()), "rep").select("rep", "ids").collect()}
    true: dict[bytes, list] = {}
    for r in true_nearest(nodes, some, k).collect():
        true.setdefault(bytes(r["rep"]), []).extend((-r["score"], i) for i in ids[bytes(r["near"])])
    first = {rep: own[0] for rep, _, own in some}  # a query among the smallest ids, if these hold one
    got: dict[int, set] = {}
    for r in found.join(F.broadcast(found.sparkSession.createDataFrame([(i,) for i in first.values()], "query_id bigint")), "query_id").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for rep, v, own in some:
        length = -float(np.dot(np.array(v, np.float64), np.array(v, np.float64)))
        wanted = [i for _, i in sorted([*true.get(rep, []), *((length, i) for i in own)]) if i != own[0]][:k]
        if own[0] in got:
            hits, total = hits + len(got[own[0]].intersection(wanted)), total + len(wanted)
    return hits / total if total else 1.0
