"""Exact deduplication by skew-safe combining, in DataFrame functions only.

1. Locally: each task keeps one row per text it has (partial aggregation).
2. Salted: rows of a digest are dealt to ``salts`` groups by document, so that
   copies of one text never meet in one task before each group is a single row.
3. Globally: the groups' winners, at most ``salts`` per text, are combined.

The text itself is a grouping key at every stage, so texts with equal digests
are never taken for copies. Winners go back to the rows by (digest, salt) where the
comparison of contents has shown that the digest has one text only, which makes this
the same as a join on the text, and by (digest, salt, text) where it has several.

Null texts count as empty. Of equal texts the row with the largest ``doc_id``
stays; null ids are smallest, and rows that repeat an id are told apart by no
column, so all copies of the winning row count as kept in :func:`duplicate_groups`
while :func:`keep_one` returns one of them. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

#: Groups that the copies of one text are dealt to.
SALTS = 64


def _digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, text: str, doc_id: str, salts: int, digest: Callable[[Column], Column]) -> DataFrame:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("_id"),
        body.alias("_text"),
        digest(body).alias("_digest"),
        F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit("salt")), F.lit(salts)).cast("int").alias("_salt"),
    )


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (what
    ``digest`` gives)."""
    keyed = _keyed(docs, text, doc_id, salts, digest)
    local = keyed.groupBy("_digest", "_salt", "_text").agg(F.max("_id").alias("_id"), F.count("*").alias("_n"))
    # dealt by digest alone: all texts of a digest meet, in at most ``salts`` rows each
    dealt = local.repartition(partitions(docs.sparkSession), "_digest")
    whole = dealt.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_set("_salt").alias("_salts"))
    several = F.count("*").over(Window.partitionBy("_digest")) > 1
    winners = whole.select("_digest", F.when(several, F.col("_text")).alias("_text"), "keep_id", "group_size", "_salts")
    winners = materialise(winners, "exact-winners").withColumn("_salt", F.explode("_salts")).drop("_salts")
    rows = keyed.select("_id", "_digest", "_salt").join(winners.filter("_text IS NULL").drop("_text"), ["_digest", "_salt"])
    clashes = winners.filter("_text IS NOT NULL")
    if clashes.limit(1).count():
        rows = rows.unionByName(keyed.join(clashes, ["_digest", "_salt", "_text"]).drop("_text"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of rows with equal text and
    id, the one whose other columns are largest."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the id first: the largest struct is the winner; the text is not carried twice
    row = F.struct(
        F.col(f"`{doc_id}`").alias("_id"),
        F.col(f"`{text}`").isNotNull().alias("_given"),
        *[F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(docs.columns) if c not in (text, doc_id)],
    )
    keyed = docs.select(body.alias("_text"), _digest(body).alias("_digest"), F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit("salt")), F.lit(salts)).cast("int").alias("_salt"), row.alias("_row"))
    local = keyed.groupBy("_digest", "_salt", "_text").agg(F.max("_row").alias("_row"))
    whole = local.groupBy("_digest", "_text").agg(F.max("_row").alias("_row"))
    back = {text: F.when(F.col("_row._given"), F.col("_text")), doc_id: F.col("_row._id")}
    return whole.select(*[back[c].alias(c) if c in back else F.col(f"_row.c{n}").alias(c) for n, c in enumerate(docs.columns)])
