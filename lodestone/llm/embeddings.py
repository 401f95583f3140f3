"""Near-duplicate vectors by sorted projection passes.

Each pass hashes a vector to the sign bits of random projections, sorts all
vectors lexicographically by the concatenated bits, and compares each with the
``window`` next ones, and with all others that share its first bits however many
they are, by cosine in double precision. Links of all passes are united. The
number of passes follows from that number of bits so that a pair right at the
threshold is met with probability ``recall``, and closer pairs more surely,
whatever the distribution: dense stretches, longer than a window, are compared in
full, block with block.

Equal vectors are one node from the start. A node carries its rank and its first
bits in every pass, so a task sees whether an earlier pass has met a pair: links
are counted once without a list of pairs ever being made or deduplicated. Of the
links of two blocks only a spanning star forest leaves the task.

Vectors that are null, empty or zero, or hold null or non-finite components, and
rows without an id, link with nothing; so do vectors of different lengths. Rows
that share an id are vectors of their own. Labels and other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, range_prefix
from .components import connected_components, with_least

THRESHOLD = 0.9
WINDOW = 1024
BLOCK = 4096
RECALL = 0.99
BITS = 63
#: Bits of the signatures (three columns) and the chance that a pair at the threshold fails them.
SIGN_BITS = 192
MISSED = 1e-7


def shared_bits(rows: int, window: int = WINDOW) -> int:
    """First bits that vectors must share to be compared in full: so many that they
    would part an even table into windows."""
    return max(0, math.ceil(math.log2(max(rows, 1) / window) + 1))


def passes_for(rows: int, window: int = WINDOW, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``:
    one pass brings it together if the first bits agree."""
    met = (1 - math.acos(threshold) / math.pi) ** shared_bits(rows, window)
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - met))) if met < 1 else 2


def sign_limit(threshold: float = THRESHOLD, bits: int = SIGN_BITS, missed: float = MISSED) -> int:
    """Bits that may differ: the least number that a pair at the threshold exceeds with a
    probability of at most ``missed``."""
    p, tail, k = math.acos(threshold) / math.pi, 0.0, bits
    while k > 0:
        tail += math.comb(bits, k) * p**k * (1 - p) ** (bits - k)
        if tail > missed:
            return k
        k -= 1
    return 0


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the digest of the components in double precision; null for vectors that link with nothing."""
    for b in batches:
        out = []
        for v in b.column(1):
            x = None if v.as_py() is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            ok = x is not None and len(x) and np.isfinite(x).all() and 0 < np.linalg.norm(x) < np.inf
            out.append(blake2b((x + 0.0).tobytes(), digest_size=16).digest() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["vec_id", "embedding", "digest"])


def _signs(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Sign bits of projections as integers of up to 64 bits, first bit highest."""
    bits = planes.shape[0]
    return ((x @ planes.T) > 0) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))


def _keys(passes: int, bits: int):
    """Sort keys of all passes, and behind them the signature in words of 64 bits."""
    words = SIGN_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            vectors = [np.asarray(v, np.float64) for v in b.column(1).to_pylist()]
            keys, signs = np.zeros((len(vectors), passes), np.int64), np.zeros((len(vectors), words), np.int64)
            for dim in {len(v) for v in vectors}:
                if dim not in planes:
                    rng = np.random.default_rng(dim)
                    planes[dim] = rng.standard_normal((passes, bits, dim)), rng.standard_normal((words, 64, dim))
                at = [n for n, v in enumerate(vectors) if len(v) == dim]
                x = np.stack([vectors[n] for n in at])
                for out, of in zip((keys, signs), planes[dim], strict=True):
                    for p in range(len(of)):
                        out[at, p] = _signs(x, of[p]).view(np.int64)
            flat = [pa.ListArray.from_arrays(np.arange(0, k.size + 1, k.shape[1], dtype=np.int32), k.ravel()) for k in (keys, signs)]
            yield pa.RecordBatch.from_arrays([b.column(0), *flat], names=["rep", "keys", "signs"])

    return run


def _screen(window: int, limit: int, block: int):
    """Of a block, or two, the rows that may have a link there: (rep, pass, a, b)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(np.argsort(table.column("rank").to_numpy(), kind="stable"))
        rank = table.column("rank").to_numpy()
        first, across = table.column("a")[0].as_py(), table.column("a")[0].as_py() != table.column("b")[0].as_py()
        signs = np.array(table.column("signs").to_pylist(), np.int64).view(np.uint64)
        hit = table.column("last").to_numpy() - table.column("first").to_numpy() > window
        owned = int((rank // block == first).sum())  # these come first
        for a in range(0, owned, 256):
            z = min(a + 256, owned)
            begin, end = owned if across else a, int(np.searchsorted(rank, rank[z - 1] + window, "right"))
            if end <= begin:
                continue
            apart = np.zeros((z - a, end - begin), np.uint16)
            for w in range(signs.shape[1]):
                apart += np.bitwise_count(signs[a:z, w, None] ^ signs[None, begin:end, w])
            i, j = np.nonzero(apart <= limit)
            i, j = i + a, j + begin
            keep = (j > i) & (rank[j] <= rank[i] + window)
            hit[i[keep]] = hit[j[keep]] = True
        return table.select(["rep", "pass", "a", "b"]).filter(pa.array(hit))

    return run


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each node's least known one) after links between i and j."""
    i, j = label[i], label[j]
    keep = i != j
    i, j = i[keep], j[keep]
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _compare(window: int, threshold: float, block: int):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        table = table.take(np.argsort(table.column("rank").to_numpy(), kind="stable"))
        rank, last = table.column("rank").to_numpy(), table.column("last").to_numpy()
        p, first = table.column("pass")[0].as_py(), table.column("a")[0].as_py()
        across = first != table.column("b")[0].as_py()
        own = rank // block == first
        copies = table.column("copies").to_numpy()
        ranks, firsts = (np.array(table.column(c).to_pylist(), np.int64).reshape(n, p) for c in ("ranks", "firsts"))  # of the passes before
        embedding = table.column("embedding").combine_chunks()
        dims, values = embedding.value_lengths().to_numpy(), embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.cumsum(dims) - dims
        links, label = np.zeros(n, np.int64), np.arange(n)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x = values[starts[at][:, None] + np.arange(dim)]
            x /= np.linalg.norm(x, axis=1)[:, None]
            owned = int(own[at].sum())  # these come first
            reach = np.maximum(rank[at] + window, last[at])
            for a in range(0, owned, 256):
                z = min(a + 256, owned)
                begin = owned if across else a
                end = int(np.searchsorted(rank[at], reach[a:z].max(), "right"))
                if end <= begin:
                    continue
                i, j = np.nonzero(x[a:z] @ x[begin:end].T >= threshold)
                i, j = i + a, j + begin
                keep = (j > i) & (rank[at][j] <= reach[i])
                i, j = at[i[keep]], at[j[keep]]
                for q in range(p):  # what an earlier pass has met counts there
                    keep = (np.abs(ranks[i, q] - ranks[j, q]) > window) & (firsts[i, q] != firsts[j, q])
                    i, j = i[keep], j[keep]
                if len(i):
                    links += np.bincount(i, copies[j], n).astype(np.int64) + np.bincount(j, copies[i], n).astype(np.int64)
                    label = _merge(label, i, j)
        hit = np.flatnonzero(links)
        rep = table.column("rep").combine_chunks()
        return pa.table({"rep": rep.take(pa.array(hit)), "links": pa.array(links[hit]), "root": rep.take(pa.array(label[hit]))})

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("embedding"))
    kind = rows.schema["embedding"].dataType.simpleString()
    marked = map_arrow(rows, _digests, f"vec_id bigint, embedding {kind}, digest binary").withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest")))
    ids = materialise(marked.select("vec_id", "digest"), "vec-ids")
    # equal digests are equal vectors, so any of theirs will do
    distinct = marked.filter("digest IS NOT NULL").groupBy(F.col("digest").alias("rep")).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    distinct = materialise(distinct, "vec-distinct")
    n = distinct.count()
    passes, bits = passes_for(n, window, threshold, recall), shared_bits(n, window)

    hashed = map_arrow(distinct.select("rep", "embedding"), _keys(passes, BITS), "rep binary, keys array<bigint>, signs array<bigint>")
    hashed = materialise(hashed, "vec-keys")
    keys = hashed.select("rep", F.posexplode("keys").alias("pass", "key")).withColumn("one", F.lit(1).cast("long"))
    ranks = range_prefix(keys, [F.col("key"), F.col("rep")], "one", "rank", group="pass", name="vec-ranks")
    # the rows that share their first bits are a stretch; those within a window need no mention
    stretches = ranks.groupBy("pass", F.shiftright("key", BITS - bits).alias("bits")).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    stretches = materialise(stretches.filter(F.col("last") - F.col("first") > window), "vec-stretches")
    ranks = ranks.withColumn("bits", F.shiftright("key", BITS - bits)).join(stretches, ["pass", "bits"], "left")
    ranks = ranks.select("rep", "pass", "rank", F.coalesce("first", "rank").alias("first"), F.coalesce("last", "rank").alias("last"))
    ranks = ranks.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("pass", "rank", "first", "last"))).alias("r"))
    ranks = materialise(ranks, "vec-places")
    # a row meets the blocks that its window and its stretch reach: two blocks are one task
    home, end = F.floor(F.col("rank") / block), (n - 1) // block
    low, high = F.least(F.col("rank") - window, F.col("first")), F.greatest(F.col("rank") + window, F.col("last"))
    met = F.sequence(F.greatest(F.floor(low / block), F.lit(0)), F.least(F.floor(high / block), F.lit(end)))
    light = ranks.select("rep", F.explode("r").alias("at")).select("rep", "at.*").join(hashed.select("rep", "signs"), "rep")
    light = light.select("*", home.alias("home"), F.explode(met).alias("met")).select("*", F.least("home", "met").alias("a"), F.greatest("home", "met").alias("b")).drop("home", "met")
    sent = light.groupBy("pass", "a", "b").applyInArrow(_screen(window, sign_limit(threshold), block), "rep binary, pass int, a bigint, b bigint")
    sent = materialise(sent, "vec-sent")
    before = [F.slice(F.col(f"r.{c}"), F.lit(1), F.col("pass")).alias(f"{c}s") for c in ("rank", "first")]
    at = F.element_at("r", F.col("pass") + 1)
    dealt = sent.join(ranks, "rep").select("rep", "pass", "a", "b", at["rank"].alias("rank"), at["last"].alias("last"), *before).join(distinct.select("rep", "copies", "embedding"), "rep")
    found = materialise(dealt.groupBy("pass", "a", "b").applyInArrow(_compare(window, threshold, block), "rep binary, links bigint, root binary"), "vec-found")

    classes = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    nodes = distinct.select("rep", "least", "copies").join(links, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left").withColumn("class", F.coalesce("component", "rep"))
    of = with_least(nodes, "class", "least", "component_id", "rep").select(F.col("rep").alias("digest"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return ids.join(of, "digest", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
