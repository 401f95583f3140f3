"""SimHash near-dedup with BK-trees.

Fingerprints: ASCII-lower-cased words, 3-word shingles with repeats, XXH64 (seed
42) of each, and the majority of every bit. Documents with equal fingerprints
are one node from then on.

Search: two fingerprints that differ in at most R bits agree in full on at least
B - R of B equal blocks. Each choice of B - R blocks routes a fingerprint to one
shard, so each linked pair shares a shard, and a shard holds at most
2 ** (64 * R / B) fingerprints however many documents there are (65,536 here). In
a shard, a BK-tree keys the children of a node by their Hamming distance to it; a
search follows only the edges within the radius. A shard's tree lives in the task
that has the shard and serves all its searches there; sending all trees to every
executor would grow with the corpus.

A shard yields the links of a spanning forest, not all pairs; components come
from :mod:`components`. Null and empty texts have the fingerprint zero and link
like any other. Rows that repeat an id get one result row each; a row without an id
links too, and a component of such rows alone has the null id as its smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialise, partitions, text_bytes
from .components import connected_components, with_least

RADIUS = 2
BLOCKS = 8
SHINGLE = 3
SEED = 42
#: Rows of a fingerprint that has over a HOT-th of all are dealt to SALTS groups.
HOT, SALTS = 1000, 32


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: bit set when set in over half of the shingle hashes."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.array([digest(flat[a:z], SEED) for a, z in zip(starts, stops, strict=True)], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(votes * 2 > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""
    narrow = docs.select(text_bytes(text).alias("_text"), F.col(f"`{doc_id}`").alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(fps)], names=["doc_id", "fp"])

    return map_arrow(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


class BKTree:
    """Fingerprints by Hamming distance: a node's children are keyed by theirs to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_search(self, value: int, radius: int) -> list[int]:
        """Places of the stored values within ``radius``, then store ``value``."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return []
        found, at = [], [0]
        while at:
            n = at.pop()
            d = (self.values[n] ^ value).bit_count()
            if d <= radius:
                found.append(n)
            kids = self.children[n]
            if len(kids) <= 2 * radius + 1:
                at += [k for e, k in kids.items() if -radius <= e - d <= radius]
            else:
                at += [kids[e] for e in range(d - radius, d + radius + 1) if e in kids]
        n, new = 0, len(self.values)
        while True:
            d = (self.values[n] ^ value).bit_count()
            if d not in self.children[n]:
                self.children[n][d] = new
                break
            n = self.children[n][d]
        self.values.append(value)
        self.children.append({})
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a forest with the components of all pairs within the radius."""
    tree, parent, out = BKTree(), list(range(len(values))), []

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for n, v in enumerate(values):
        for m in tree.add_and_search(v, radius):
            a, b = root(n), root(m)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((values[m], v))
    return out


def linked_fingerprints(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): links between the distinct ``fp`` that have their components."""
    width = 64 // blocks
    masks = []
    for keep in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << width) - 1) << (k * width) for k in keep)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    # a row becomes one for each route: many tasks are to do that, however small the table
    parts = partitions(distinct.sparkSession)
    dealt = distinct.repartition(parts, F.xxhash64("fp"))
    routes = dealt.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("route", "key"))
    # nearly all shards hold one row, so nothing is gained by gathering before the shuffle;
    # behind it a shard's rows stand in a row
    shards = routes.repartition(parts, "route", "key").sortWithinPartitions("route", "key")

    def links(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = spanning_links(sorted(fps.view(np.uint64).tolist()), radius)
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = [np.empty(0, np.int64)] * 3  # the shard that the next batch may go on with
        for batch in batches:
            fp, route, key = (np.concatenate([o, c.to_numpy().astype(np.int64)]) for o, c in zip(open_, batch.columns, strict=True))
            ends = np.flatnonzero((route[1:] != route[:-1]) | (key[1:] != key[:-1])) + 1
            starts = np.concatenate(([0], ends))
            for a, z in zip(starts[:-1][np.diff(starts) > 1].tolist(), ends[np.diff(starts) > 1].tolist(), strict=True):
                yield from links(fp[a:z])
            open_ = [c[starts[-1] :] for c in (fp, route, key)]
        if len(open_[0]) > 1:
            yield from links(open_[0])

    return map_arrow(shards, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    fps = materialise(with_fingerprints(docs, text, doc_id), "simhash")
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    members = connected_components(linked_fingerprints(nodes.select("fp"), radius))
    classes = nodes.join(members, nodes["fp"] == members["node"], "left").select("fp", "first", "n", F.coalesce("component", "fp").alias("class"))
    by_fp = with_least(classes, "class", "first", "component_id", "fp").select("fp", "component_id")
    # fingerprints of more than a HOT-th of all rows: fewer than HOT of them, so they may be sent everywhere
    hot = nodes.crossJoin(F.broadcast(nodes.agg(F.sum("n").alias("all")))).filter(F.col("n") * HOT > F.col("all")).select("fp", F.lit(True).alias("hot"))
    salts = F.when(F.col("hot"), F.array(*[F.lit(s) for s in range(SALTS)])).otherwise(F.array(F.lit(0)))
    dealt = by_fp.join(F.broadcast(hot), "fp", "left").select("fp", "component_id", F.explode(salts).alias("salt"))
    salt = F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    rows = fps.join(F.broadcast(hot), "fp", "left").select("doc_id", "fp", salt.alias("salt"))
    return rows.join(dealt, ["fp", "salt"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
