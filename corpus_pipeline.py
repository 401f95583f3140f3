"""A corpus pipeline of five stages, each on what its predecessor keeps.

``run`` writes every stage's rows as Parquet to the folder that executors share and
reads them again, so a lost executor repeats a stage's tasks at most; what a stage needed
on its way is deleted once its rows are written.

Rows that share an id, and rows without one, are rows of their own in every stage; columns
beyond those of ``documents`` come along, whatever their names. A null text has no
language and goes in the first stage; a stage that is given one all the same takes it
for empty: equal to empty texts, near to them, of size 0 in the mix, and so never sent,
and without tokens. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, exact_dedup, langid, mixing, simhash
from lodestone.llm.common import drop_but_last, free_name, materialise, recorded

#: Least mean probability of the predicted language; below it, and without any
#: letter, a document has no language that the corpus knows.
MIN_SCORE = 0.3


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key of its own for each row, fixed for good, and the key's name:
    ids may be null or repeat."""
    row = free_name(docs, "_row")
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "keyed"), row


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a known language. The network learns from this stage's input."""
    scored = langid.predict(docs, langid.train(docs))
    pred, score = scored.columns[-2:]
    return scored.filter((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest id."""
    return exact_dedup.keep_one(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of linked fingerprints the row with the smallest id, a null id last."""
    rows, row = keyed(docs)
    groups = simhash.near_duplicates(rows, doc_id=row).select(F.col("doc_id").alias("_member"), "component_id")
    ids = rows.select(F.col(row).alias("_of"), F.col("doc_id").alias("_id"))
    least = groups.join(ids, F.col("_member") == F.col("_of")).groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_of")).alias("_least"))
    stays = least.select(F.col("_least._of").alias("_stays"))
    return rows.join(stays, F.col(row) == F.col("_stays"), "left_semi").drop(row)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix sends it, a copy sent in part as a whole one."""
    rows, row = keyed(docs)
    sent = mixing.mix(rows, row=row, positions=False).filter("words > 0").groupBy(F.col("_row").alias("_sent")).agg(F.count("*").cast("int").alias("_copies"))
    joined = rows.join(sent, F.col(row) == F.col("_sent"))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens, ids_sha256 and
    decoded_sha256 of every copy."""
    return bpe.map_encoded(docs, lambda ids, codec: (ids, *bpe.digests(ids, codec)), f"ids binary, {bpe.DIGESTS}")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", mix),
    ("bpe_encode", encode),
]

#: The network of the first stage is not expressible in SQL; tests compare each stage
#: with a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with recorded() as made:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            drop_but_last(spark, made)  # the stage before and this one's tables on the way
    return docs
