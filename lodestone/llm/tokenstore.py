"""Content-addressed store of token ids.

Files under the store's folder, all Parquet:

``objects/kind=chunk``   digest, payload: each distinct chunk of ids once; the payload is
                 little-endian unsigned 16-bit, or 32-bit where an id needs it
``objects/kind=recipe``  the documents' recipes as the encoding tasks wrote them
                 (both kinds in buckets by digest, a recipe's being a number of its own)
``recipes``      doc_id, start, n_tokens, crc, digests, lengths: in ascending doc_id order;
                 ``start`` is the number of ids of all documents before, ``crc`` the
                 crc32 of all ids as they were encoded
``manifest``     segment, n_docs, n_tokens, root: a Merkle root for each run of
                 SEGMENT ids, over the leaves (hashed recipes) of its documents
``top``          one such row for the whole store, over the roots of all segments

A rolling hash over the ids cuts each document's stream, so equal passages give
equal chunks. A task drops the chunks it has already sent; after one shuffle by
digest, sorted by it, each is stored once. Reading puts every document together again
from its recipe; it recomputes every chunk's digest, every Merkle root and every
document's crc32 and fails on any difference or missing chunk.

Null texts count as empty: their documents hold the end id alone. Null ids come
first; rows that repeat an id are documents of their own, in the order of their
recipes. Only the id and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Codec, cut_points, vocabulary_path
from .common import map_arrow, materialise, partitions, range_prefix, text_bytes

END_ID = 1
#: Chunks have 2 ** CHUNK_BITS ids on average.
CHUNK_BITS = 9
SEGMENT = 1 << 18
#: Segments, or nodes over them, that a node of the tree over them joins.
FAN = 4096
#: Words that a worker remembers.
WORDS = 600_000
#: Digests that a task remembers as sent.
SENT = 1 << 20
#: Uses of a chunk that has over a HOT-th of all are dealt to SALTS groups.
HOT, SALTS = 1000, 32


def _digest(ids: np.ndarray) -> bytes:
    return blake2b(np.ascontiguousarray(ids, "<u4"), digest_size=16).digest()


def _pack(ids: np.ndarray) -> bytes:
    return (b"\x02" + ids.astype("<u2").tobytes()) if not len(ids) or ids.max() < 65536 else (b"\x04" + ids.astype("<u4").tobytes())


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[:1] == b"\x02" else "<u4", offset=1).astype("<u4")


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec, task, row = Codec.load(path), TaskContext.get().partitionId(), 0
        codec.room = WORDS  # kept for the worker's next task, too
        sent: set[bytes] = set()
        end = np.array([end_id], np.uint32)
        # the more words at once, the fewer look-ups
        for b in (b for two in batched(batches, 2) for b in pa.Table.from_batches(two).combine_chunks().to_batches()):
            flat, bounds = codec.encode_arrow(b.column(0))
            keys, payloads, digests, lengths, counts, crcs = [], [], [], [], [], []
            for a, z in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                ids = np.concatenate([flat[a:z], end])
                ends = [0, *cut_points(ids & 0xFFFF, CHUNK_BITS).tolist(), len(ids)]
                raw = ids.astype("<u4").tobytes()
                names = [blake2b(raw[4 * i : 4 * j], digest_size=16).digest() for i, j in zip(ends, ends[1:], strict=False)]
                for name, i, j in zip(names, ends, ends[1:], strict=False):
                    if name not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(name)
                        keys.append(name)
                        payloads.append(_pack(ids[i:j]))
                digests.append(b"".join(names))
                lengths.append(np.diff(ends).astype(np.int32))
                counts.append(len(ids))
                crcs.append(zlib.crc32(raw))
            n, m = len(keys), b.num_rows
            # a recipe has an address like a chunk, so that the tasks share them evenly
            keys += [blake2b(b"recipe %d %d" % (task, row + k), digest_size=16).digest() for k in range(m)]
            row += m
            recipes = [pa.array(digests, pa.binary()), pa.array(lengths, pa.list_(pa.int32())), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * n + ["recipe"] * m),
                    pa.array(keys, pa.binary()),
                    pa.array([*payloads, *[None] * m], pa.binary()),
                    *(pa.concat_arrays([pa.nulls(n, c.type), c]) for c in [b.column(1), *recipes]),
                ],
                names=["kind", "digest", "payload", "doc_id", "digests", "lengths", "n_tokens", "crc"],
            )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, the first of each."""
    last = None
    for b in batches:
        keep = []
        for d in b.column(1).to_pylist():
            keep.append(d is None or d != last)
            last = d
        yield b.filter(pa.array(keep, pa.bool_()))


def _leaf() -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("n_tokens").cast("string"), F.col("crc").cast("string"), F.hex("digests")), 256)


def merkle_root(leaves: list[str]) -> str:
    """Hex root of hex leaves; an odd node goes up as it is."""
    level = [bytes.fromhex(x) for x in leaves]
    while len(level) > 1:
        level = [sha256(level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0].hex() if level else sha256(b"").hexdigest()


def _join_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([merkle_root(x) for x in b.column(3).to_pylist()], pa.string())], names=["segment", "n_docs", "n_tokens", "root"])


def _roots(recipes: DataFrame) -> DataFrame:
    """Per run of SEGMENT ids: segment, n_docs, n_tokens, root. A document has an id
    at least, so a segment has SEGMENT leaves at most."""
    rows = recipes.select(F.expr(f"start div {SEGMENT}").alias("segment"), "start", "n_tokens", _leaf().alias("leaf"))
    rows = rows.groupBy("segment").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "leaf"))).alias("l")).select("segment", "n_docs", "n_tokens", F.col("l.leaf").alias("leaves"))

    return map_arrow(rows, _join_leaves, "segment bigint, n_docs bigint, n_tokens bigint, root string")


def _top(segments: DataFrame) -> DataFrame:
    """One row over all segments, FAN of them to a node, level by level: also what is missing at
    the end of a store shows."""
    most = segments.agg(F.max("segment")).first()[0]
    level = segments
    while most is not None:
        leaf = F.sha2(F.concat_ws("|", "segment", "n_docs", "n_tokens", "root"), 256).alias("leaf")
        rows = level.select(F.expr(f"segment div {FAN}").alias("at"), "segment", "n_docs", "n_tokens", leaf)
        rows = rows.groupBy("at").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("segment", "leaf"))).alias("l"))
        level = map_arrow(rows.select(F.col("at").alias("segment"), "n_docs", "n_tokens", F.col("l.leaf").alias("leaves")), _join_leaves, "segment bigint, n_docs bigint, n_tokens bigint, root string")
        most = most // FAN or None
    return level


def _table(path: str) -> str:
    """The catalog's name for a store's objects."""
    return f"lodestone_objects_{sha256(path.encode()).hexdigest()[:24]}"


def write_store(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode all documents and write the store to ``path``, a folder not there yet.

    The objects are written in buckets by digest and entered in the session's catalog, so a
    join on the digest reads them without a shuffle; a session that doesn't know the table
    reads the same files as plain Parquet."""
    narrow = docs.select(text_bytes(text).alias("_text"), F.col(f"`{doc_id}`").alias("doc_id"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    schema = f"kind string, digest binary, payload binary, doc_id {kind}, digests binary, lengths array<int>, n_tokens bigint, crc bigint"
    made = map_arrow(narrow, _encode(vocabulary or vocabulary_path(), end_id), schema)
    spark = docs.sparkSession
    buckets = partitions(spark)
    once = map_arrow(made.repartition(buckets, "digest").sortWithinPartitions("digest"), _once, schema)
    once.write.format("parquet").option("compression", "zstd").option("path", f"{path}/objects").partitionBy("kind").bucketBy(buckets, "digest").saveAsTable(_table(path))
    recipes = spark.read.schema(f"doc_id {kind}, digests binary, lengths array<int>, n_tokens bigint, crc bigint, kind string").parquet(f"{path}/objects").filter("kind = 'recipe'").drop("kind")
    ordered = range_prefix(recipes, [F.col("doc_id"), F.col("digests")], "n_tokens", "start", name="recipes")
    ordered.select("doc_id", "start", "n_tokens", "crc", "digests", "lengths").write.option("compression", "zstd").parquet(f"{path}/recipes")
    _roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    _top(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")


def forget(spark: SparkSession, path: str) -> None:
    """Take a store out of the session's catalog; its files stay, and are read as plain ones."""
    spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    if spark.catalog.tableExists(_table(path)):
        objects = spark.table(_table(path))
    else:
        objects = spark.read.schema("digest binary, payload binary, kind string").parquet(f"{path}/objects")
    return objects.filter("kind = 'chunk'").select("digest", "payload")


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes, once the manifest agrees with them."""
    recipes = spark.read.parquet(f"{path}/recipes")
    said, found = spark.read.parquet(f"{path}/manifest"), _roots(recipes)
    wrong = said.exceptAll(found).union(found.exceptAll(said)).limit(1).count()
    if wrong:
        raise ValueError(f"the manifest of {path} does not agree with its recipes")
    if spark.read.parquet(f"{path}/top").collect() != _top(said).collect():
        raise ValueError(f"the top root of {path} does not agree with its manifest")
    return recipes


def _uses(recipes: DataFrame) -> DataFrame:
    """One row per chunk use: doc_id, start, said, pos, n, digest."""
    use = recipes.select("doc_id", "start", F.col("crc").alias("said"), "digests", F.size("lengths").alias("n"), F.posexplode("lengths").alias("pos", "length"))
    return use.select("doc_id", "start", "said", "pos", "n", F.expr("substring(digests, pos * 16 + 1, 16)").alias("digest"))


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk use, a document's together and in order: doc_id, start, said (crc32
    when written), pos, n (of its chunks), digest, payload.

    Uses go to the buckets of their chunks and from there to their documents. Chunks with
    more than a HOT-th of all uses, fewer than HOT of them, are dealt to SALTS groups."""
    recipes = _recipes(spark, path)
    uses = _uses(recipes).select("doc_id", "start", "said", "pos", "n", "digest")
    counts = uses.groupBy("digest").agg(F.count("*").alias("uses"))
    total = recipes.agg(F.sum(F.size("lengths")).alias("all"))
    hot = counts.crossJoin(F.broadcast(total)).filter(F.col("uses") * HOT > F.col("all")).select("digest", F.lit(True).alias("hot"))
    hot = materialise(hot, "store-hot")
    marked = uses.join(F.broadcast(hot), "digest", "left")
    chunks = _chunks(spark, path)
    cold = marked.filter("hot IS NULL").join(chunks, "digest", "left")
    salted = chunks.join(F.broadcast(hot.drop("hot")), "digest", "left_semi").withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    warm = marked.filter("hot").withColumn("salt", F.pmod(F.xxhash64("start", "pos"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"], "left").drop("salt")
    columns = ["doc_id", "start", "said", "pos", "n", "digest", "payload"]
    parts = cold.select(*columns).unionByName(warm.select(*columns))
    return parts.repartition(partitions(spark), "start").sortWithinPartitions("start", "pos")


def _whole(digests: list[bytes], payloads: list[bytes], said: int) -> np.ndarray:
    """A document's ids from its chunks, checked against their digests and its crc32."""
    parts = [unpack(p) for p in payloads]
    ids = np.concatenate(parts)
    if any(_digest(x) != d for x, d in zip(parts, digests, strict=True)) or zlib.crc32(ids.tobytes()) != said:
        raise ValueError("the chunks of a document do not give the ids that were written")
    return ids


def _documents(fields: dict[str, pa.DataType], emit):
    """Rows of :func:`_payloads` to one row per document: doc_id, start and what ``emit``
    makes of the ids and their crc32. Only one document is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, payloads = [], []
        for b in batches:
            made, at = [], []
            for k, (said, pos, n, digest, payload) in enumerate(zip(*(c.to_pylist() for c in b.columns[2:]), strict=True)):
                if payload is None or pos != len(payloads):
                    raise ValueError("a chunk that a recipe names is missing")
                digests.append(digest)
                payloads.append(payload)
                if len(payloads) == n:
                    made.append(emit(_whole(digests, payloads, said), said))
                    at.append(k)
                    digests, payloads = [], []
            rows = b.take(pa.array(at, pa.int64()))
            columns = zip(*made, strict=True) if made else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(list(c), t) for c, t in zip(columns, fields.values(), strict=True))], names=["doc_id", "start", *fields])
        if payloads:
            raise ValueError("a document's last chunks are missing")

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, put together again from the files: doc_id, start, ids (array)."""
    parts = _payloads(spark, path)
    kind = parts.schema["doc_id"].dataType.simpleString()
    return map_arrow(parts, _documents({"ids": pa.list_(pa.int64())}, lambda ids, crc: (ids.astype(np.int64),)), f"doc_id {kind}, start bigint, ids array<bigint>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, put together again from the files: doc_id, start, n_tokens, ids_crc32."""
    parts = _payloads(spark, path)
    kind = parts.schema["doc_id"].dataType.simpleString()
    return map_arrow(parts, _documents({"n_tokens": pa.int64(), "ids_crc32": pa.int64()}, lambda ids, crc: (len(ids), crc)), f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
