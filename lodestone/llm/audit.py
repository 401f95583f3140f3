"""Audit of how filters interact: what each removes in every order of application.

Each document gets an integer mask with a bit for each filter that it fails. Documents
are counted by part and mask, and so are those with good and with toxic labels; these
histograms are the rows of one integer matrix. Multiplied with integer incidence
matrices (masks x steps of all orders) they give what each step keeps and removes,
what it would have removed had no earlier filter done so (redundant), and what it alone
removes (unique). The documents are read once, however many orders there are; what
remains is as small as the number of parts.

Filter E (a smaller id has the same text) compares SHA-256 digests of texts: documents
are first counted by digest and id, then by digest and histogram, so a text that a third
of all documents share is a few rows before any task holds it.

Null texts are empty: 0 words fail A; 0 is not below half of 0, so B holds. A null part and
an empty one are the same part. A row without an id has no smaller id and is smaller than
none; rows that share an id and a text are not smaller than one another. A document is good
or toxic if any of its label rows says so; rows without an id have no labels. An empty table
gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

FILTERS = "ABCDE"
MIN_WORDS = 200
SALTS = 64
WORDS = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts whose results are made at once; each gives as many rows as there are steps.
PARTS_AT_ONCE = 64
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C and D."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    length = F.length(text)
    capitals = length - F.length(F.translate(text, CAPITALS, ""))
    return [n < MIN_WORDS, 100 * distinct < 50 * n, 100 * capitals.cast("long") > 2 * length, text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """part, mask (bit n: fails the n-th filter), and long counts n, good, toxic."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    fails = text_failures(F.col("_text"))
    mask = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(f"`{doc_id}`").alias("_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), body.alias("_text"))
    rows = rows.select("_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    # rows without an id have no labels; dealt by digest, they don't meet in one task
    rows = rows.withColumn("salt", F.when(F.col("_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS)) + 1).otherwise(0))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_of")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(out) for c, out in (("quality", "good"), ("toxic", "toxic"))])
    marked = rows.join(marks.withColumn("_salt", F.lit(0).cast("long")), (F.col("_id") == F.col("_of")) & (F.col("salt") == F.col("_salt")), "left")
    kinds = ["digest", "part", "mask", "good", "toxic"]
    marked = marked.select("_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    by_id = marked.groupBy(*kinds, "_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n")))
    by_text = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), first.alias("first"))
    # at most four rows a text and part by now
    least = F.expr("min(first._id) OVER (PARTITION BY digest)")
    whole = by_text.withColumn("stay", F.col("no_id") + F.when(F.col("first._id") == least, F.col("first.n")).otherwise(0))
    halves = F.array(F.struct(F.col("mask").alias("m"), F.col("stay").alias("c")), F.struct((F.col("mask") + (1 << 4)).alias("m"), (F.col("n") - F.col("stay")).alias("c")))
    split = whole.select("part", "good", "toxic", F.explode(halves).alias("h")).filter("h.c > 0")
    counts = [F.sum(F.when(F.col(c), F.col("h.c")).otherwise(0)).alias(c) for c in ("good", "toxic")]
    return split.groupBy("part", F.col("h.m").alias("mask")).agg(F.sum("h.c").alias("n"), *counts)


def incidence(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) of each column, and integer matrices of masks by columns."""
    columns = [("".join(p), s) for p in permutations(filters) for s in range(1, len(filters) + 1)]
    bits = {f: 1 << n for n, f in enumerate(filters)}
    own = np.array([bits[o[s - 1]] for o, s in columns])
    before = np.array([sum(bits[f] for f in o[: s - 1]) for o, s in columns])
    masks = np.arange(1 << len(filters))[:, None]
    fails, earlier = (masks & own) > 0, (masks & before) > 0
    out = {"kept": ~fails & ~earlier, "removed": fails & ~earlier, "redundant": fails & earlier, "unique_fails": np.broadcast_to(masks == own, fails.shape)}
    return columns, {k: v.astype(np.int64) for k, v in out.items()}


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns, of = incidence()
    orders, steps = pa.array([o for o, _ in columns]), pa.array(np.array([s for _, s in columns], np.int32))
    letter = np.array([FILTERS.index(o[s - 1]) for o, s in columns])
    sums = (letter[:, None] == letter[None, :]).astype(np.int64)  # columns of one filter are summed
    for batch in batches:
        for a in range(0, batch.num_rows, PARTS_AT_ONCE):
            b = batch.slice(a, PARTS_AT_ONCE)
            n, good, toxic = (np.array(b.column(k).to_pylist(), np.int64).reshape(b.num_rows, -1) for k in range(1, 4))
            stack = np.concatenate([n, good, toxic])
            removed, good_lost, toxic_lost = np.split(stack @ of["removed"], 3)
            outcome = [n @ of["kept"], removed, n @ of["redundant"], n @ of["unique_fails"], good_lost, toxic_lost, removed @ sums]
            parts = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), len(columns))))
            yield pa.RecordBatch.from_arrays(
                [parts, pa.concat_arrays([orders] * b.num_rows), pa.concat_arrays([steps] * b.num_rows), *[pa.array(x.ravel()) for x in outcome]],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step."""
    counts = mask_counts(docs, labels, text, doc_id, part)
    cell = lambda c, m: F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0))
    rows = counts.groupBy("part").agg(*[F.array(*[cell(c, m) for m in range(1 << len(FILTERS))]).alias(c) for c in ("n", "good", "toxic")])
    return map_arrow(rows, _multiply, SCHEMA)
