"""Prefix tries of conversations: which openings are shared, by how many, and what
sharing them saves.

A conversation is a path of turns, packed to one binary value: for each turn a digest of
role and text (16 bytes of SHA-256) and the text's length in UTF-8 bytes (8 bytes). Equal
paths are merged first, so copies count as one path with a weight. Paths are then
partitioned by the hash of their first turn, and a task builds the pointer dictionary
tries of its first turns and sums them up in postorder, without recursion. A first turn
with several paths and more turns below it than ``limit`` is not built: its node, and those
that all of its paths share, become a stretch of the spine, and what lies below is partitioned
by the next turn, again and again until every subtrie fits. Sums of the spine's nodes come from
the sums of the subtries below them. A task thus holds about ``limit`` turns, however many
conversations open alike; a conversation itself (24 bytes a turn) stays in one task.

The SHA-256 of the ids that end at a node is taken over range-sorted runs of ids, joined
to texts where they lie and streamed in order: no list of ids is ever gathered.

Turns are ordered by their number, null first, equal numbers by role and text digest. Null
roles and texts are empty. Rows without a conversation id belong to no conversation. Repeated
rows are turns of their own. An empty table gives no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, partitions

#: Bytes of a turn in a path: digest and length.
UNIT, DIGEST = 24, 16
#: Most turns that a subtrie may have; fewer where they are less than SHARE times a task's even part.
LIMIT, LEAST, SHARE = 100_000, 1024, 4
NODES = "node_id binary, parent_id binary, turn_id binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _turn(role: str, text: str):
    """The unit of a turn as hex digits; the role's length keeps role and text apart."""
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)
    return F.concat(digest, F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * (UNIT - DIGEST), "0"))


def conversation_paths(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and path of every conversation."""
    empty = F.lit("")
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.coalesce(f"`{role}`", empty).alias("role"), F.coalesce(f"`{text}`", empty).alias("text"))
    rows = rows.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.sha2("role", 256).alias("of"), _turn("role", "text").alias("unit"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "of", "unit")))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(F.transform(turns, lambda t: t["unit"]), "")).alias("path"))


def branched(paths: DataFrame, span: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that branch off one another: the first h turns of a conversation are those
    of the first one of its ``span``, h being the CRC-32 of its id modulo ``heads``."""
    base = F.expr(f"conv_id - conv_id % {span}")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    # at most span rows share a base
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.expr(f"substring(path, 1, {UNIT * (heads - 1)})"))).over(Window.partitionBy("base"))
    rows = paths.select("conv_id", "path", base.alias("base"), h.alias("h")).withColumn("first", F.coalesce(first, F.lit(b"")))
    return rows.select("conv_id", F.expr(f"concat(substring(first, 1, {UNIT} * h), substring(path, {UNIT} * h + 1))").alias("path"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each stretch of equal paths in a batch: its ids joined by commas."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, paths = b.column(0).to_numpy(), b.column(1)
        key = b.column(2).to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1)).astype(np.int64)
        ends = np.append(starts[1:], b.num_rows)
        joined = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(starts, ends, strict=True)]
        take = pa.array(starts)
        yield pa.RecordBatch.from_arrays([b.column(2).take(take), pa.array(ids[starts]), paths.take(take), pa.array(ends - starts), pa.array(joined)], names=["key", "conv_id", "path", "n", "ids"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of a path in ascending order become one row with the digest of all ids."""
    names = ["path", "conv_id", "n", "ends"]
    last, path, least, n, hashed = None, None, 0, 0, None
    for b in batches:
        out = []
        for key, conv, p, count, ids in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
            if key != last:
                if last is not None:
                    out.append((path, least, n, hashed.hexdigest()))
                last, path, least, n, hashed = key, p, conv, count, hashlib.sha256(ids.encode())
            else:
                n += count
                hashed.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([least]), pa.array([n]), pa.array([hashed.hexdigest()])], names=names)


def distinct_paths(paths: DataFrame) -> DataFrame:
    """path, conv_id (least), n, and ends: the SHA-256 of the path's ids in ascending order."""
    spark = paths.sparkSession
    keyed = materialise(paths.select("conv_id", "path", F.unhex(F.sha2("path", 256)).alias("key")), "trie-paths")
    order = ["key", "conv_id"]
    runs = map_arrow(keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), _runs, "key binary, conv_id bigint, path binary, n bigint, ids string")
    return map_arrow(runs.repartition("key").sortWithinPartitions(*order), _ends, "path binary, conv_id bigint, n bigint, ends string")


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of all subtries of a task. Each path starts at the node of its first ``k``
    turns; ``parent_conv_id`` is the conversation of the node above that one, ``line`` what
    the spine above it is."""
    tops: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    parent, depth, unit, ids, above, over, lines = [], [], [], [], [], [], []
    n_convs, least, ends = [], [], []

    def new(of: int, d: int, u: bytes, digest: bytes, conv: int | None, up: bytes | None, line: list | None) -> int:
        children.append({})
        for to, value in ((parent, of), (depth, d), (unit, u), (ids, digest), (above, conv), (over, up), (lines, line), (n_convs, 0), (least, None), (ends, NO_ENDS)):
            to.append(value)
        return len(parent) - 1

    for path, conv, n, ended, k, top_conv, line in zip(*(rows[c] for c in ("path", "conv_id", "n", "ends", "k", "parent_conv_id", "line")), strict=True):
        path, begin = bytes(path), bytes(path[: UNIT * k])
        hashed = hashlib.sha256(begin)
        node = tops.get(begin)
        if node is None:
            node = tops[begin] = new(-1, k, begin[-UNIT:], hashed.digest(), top_conv, hashlib.sha256(begin[:-UNIT]).digest(), list(line))
        at = UNIT * k
        while True:
            n_convs[node] += n
            least[node] = conv if least[node] is None else min(least[node], conv)
            if at == len(path):
                ends[node] = ended
                break
            u, at = path[at : at + UNIT], at + UNIT
            hashed.update(u)
            child = children[node].get(u)
            if child is None:
                child = children[node][u] = new(node, at // UNIT, u, hashed.digest(), None, None, None)
            node = child
    leaves, saved = [0] * len(parent), [0] * len(parent)
    stack = [(t, False) for t in tops.values()]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack.extend((c, False) for c in children[node].values())
            continue
        leaves[node] += not children[node]
        saved[node] += (n_convs[node] - 1) * int.from_bytes(unit[node][DIGEST:])
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    return pd.DataFrame({
        "node_id": ids, "parent_id": [ids[p] if p >= 0 else over[i] for i, p in enumerate(parent)], "turn_id": [u[:DIGEST] for u in unit], "conv_id": least, "depth": depth,
        "parent_conv_id": [least[p] if p >= 0 else above[i] for i, p in enumerate(parent)], "n_convs": n_convs, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "line": lines,
    })


def prefix_trie(paths: DataFrame, limit: int | None = None) -> DataFrame:
    """All nodes of the trie of (conv_id, path), the root at depth 0."""
    spark = paths.sparkSession
    given = materialise(distinct_paths(paths), "trie-distinct").withColumn("len", (F.octet_length("path") / UNIT).cast("int"))
    n_convs, least, n_turns = given.agg(F.sum("n"), F.min("conv_id"), F.sum("len")).first()
    if limit is None:
        limit = min(LIMIT, max(LEAST, SHARE * (n_turns or 0) // partitions(spark)))
    node = lambda d: F.expr(f"unhex(sha2(substring(path, 1, {UNIT} * ({d})), 256))")
    long = lambda v: F.lit(v).cast("long")

    # The spine, in stretches without a branch: from a depth to the one where paths part, with
    # the ids of the ends of the stretches above (``line``).
    root = spark.range(1).select(F.lit(b"").alias("path"), F.lit(0).alias("from"), F.lit(0).alias("to"), long(n_convs).alias("n_convs"), long(least).alias("conv_id"), long(None).alias("above"), F.array().cast("array<binary>").alias("line")).filter("n_convs IS NOT NULL")
    spine, ended = [root], [given.filter("len = 0").select("path", "ends")]
    settled, pending = [], given.filter("len > 0").select("*", F.lit(1).alias("k"), long(least).alias("parent_conv_id"), F.array(node("0")).alias("line"))
    while True:
        keyed = pending.withColumn("key", node("k"))
        sums = keyed.groupBy("key").agg(F.sum(F.col("len") - F.col("k")).alias("below"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"), F.min("path").alias("path"), F.max("path").alias("hi"), F.first("k").alias("from"), F.first("parent_conv_id").alias("above"), F.first("line").alias("line"))
        # what the first and the last path share in order, all between them share
        common = f"size(filter(sequence(1, int(least(octet_length(path), octet_length(hi)) / {UNIT})), d -> substring(path, 1, {UNIT} * d) = substring(hi, 1, {UNIT} * d)))"
        large = materialise(sums.filter((F.col("below") > limit) & (F.col("path") != F.col("hi"))).withColumn("to", F.expr(common)), "trie-large")
        if large.isEmpty():
            settled.append(keyed)
            break
        spine.append(large.select("path", "from", "to", "n_convs", F.col("least").alias("conv_id"), "above", "line"))
        parted = large.select("key", "to", "least", F.concat("line", F.array(node("`to`"))).alias("next"))
        dealt = materialise(keyed.join(parted, "key", "left"), "trie-dealt")
        settled.append(dealt.filter("to IS NULL").drop("to", "least", "next"))
        ended.append(dealt.filter("len = to").select("path", "ends"))
        pending = dealt.filter("len > to").select("path", "conv_id", "n", "ends", "len", (F.col("to") + 1).alias("k"), F.col("least").alias("parent_conv_id"), F.col("next").alias("line"))

    ready = _union([s.select("path", "conv_id", "n", "ends", "len", "k", "parent_conv_id", "line", "key") for s in settled])
    size = ready.agg(F.sum(F.col("len") - F.col("k") + 1)).first()[0] or 0
    tasks = max(partitions(spark), -(-size // max(limit, LEAST)))
    dealt = ready.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks))).drop("key", "len")
    built = materialise(dealt.groupBy("task").applyInPandas(build, f"{NODES}, line array<binary>"), "trie-nodes")

    size_of = lambda d: f"CASE WHEN {d} > 0 THEN bigint(conv(hex(substring(path, {UNIT} * {d} - {UNIT - DIGEST - 1}, {UNIT - DIGEST})), 16, 10)) ELSE 0 END"
    stretch = _union(spine).withColumn("end", node("`to`")).withColumn("own", (F.col("n_convs") - 1) * F.expr(f"aggregate(sequence(`from`, `to`), 0L, (s, d) -> s + {size_of('d')})"))
    give = lambda df, saved, leaves: df.select(F.posexplode("line").alias("pos", "of"), F.size("line").alias("size"), F.col(saved).alias("saved"), leaves.alias("leaves"))
    below = give(built.filter("line IS NOT NULL"), "saved_tokens", F.col("n_leaves")).unionByName(give(stretch, "own", long(0)))
    sums = below.groupBy("of").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.sum((F.col("pos") == F.col("size") - 1).cast("long")).alias("children"))
    each = stretch.join(sums, F.col("end") == F.col("of"), "left").withColumn("depth", F.explode(F.sequence("from", "to")))
    each = each.withColumn("own", (F.col("n_convs") - 1) * F.expr(size_of("depth")))
    each = each.withColumn("under", F.sum("own").over(Window.partitionBy("end").orderBy(F.desc("depth")))).withColumn("node_id", node("depth"))
    ends = _union(ended).select(node(f"octet_length(path) / {UNIT}").alias("at"), "ends")
    deep = F.col("depth") > 0
    top = each.join(ends, F.col("node_id") == F.col("at"), "left").select(
        "node_id", F.when(deep, node("depth - 1")).alias("parent_id"), F.when(deep, F.expr(f"substring(path, {UNIT} * depth - {UNIT - 1}, {DIGEST})")).alias("turn_id"), "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == F.col("from"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(F.col("depth") < F.col("to"), 1).otherwise(F.coalesce("children", long(0))).cast("long").alias("n_children"),
        F.coalesce("leaves", long(1)).alias("n_leaves"), (F.coalesce("saved", long(0)) + F.col("under")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return built.drop("line").unionByName(top)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes with ``role`` and ``text`` of their last turn; null at the root."""
    turns = conversations.select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("of", F.unhex(F.substring(_turn("role", "text"), 1, 2 * DIGEST))).groupBy("of").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, F.col("turn_id") == F.col("of"), "left").drop("of")
