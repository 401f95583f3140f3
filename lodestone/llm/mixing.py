"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue that serves its documents in shuffled order, again from
the start once all are through. A document's virtual finish time is the words
its source has sent by its end, divided by the source's weight. All documents
are sorted globally by it. At a document's finish, the mix has sent what the
sources that are through by then had in all, and weight x time of each of the others;
both are running sums over the sorted queue, which so tells behind which document
the total budget is spent and at what virtual time exactly. There the queue is
truncated: a document that is in service at that time is sent in part.

The shuffle orders by md5 of the seed and the id, so reruns agree. All running sums,
also those inside a source and the places of the sources, go over range-sorted rows:
no task holds a whole source or all sources.

Null texts have size 0 and are never taken; a null source is a source of its
own. Rows that repeat an id are queued one by one. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, range_prefix

WEIGHTS = (5, 2, 1)
BUDGET_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size and weight, by the source's place in code point order, null last."""
    totals = sizes.groupBy("_source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    placed = range_prefix(totals, [F.col("_source").asc_nulls_last()], "one", "place", name="mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return placed.select("_source", "source_size", weight.cast("long").alias("weight"))


def queue(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, row: str | None = None) -> DataFrame:
    """Documents with their place in their source's queue: doc_id, size, source_size,
    weight and ``_start``, the words of the source before them in shuffled order. A column ``row``
    that tells rows of one id apart comes along as ``_row``."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null"))))
    # written first: dealing by range reads its input twice, and texts should be counted once
    sizes = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("_source"), word_count(F.col(f"`{text}`")).alias("size"), key.alias("_key"), F.lit(None).cast("long").alias("_row") if row is None else F.col(f"`{row}`").alias("_row"))
    sizes = materialise(sizes, "mix-sizes")
    placed = range_prefix(sizes, [F.col(c) for c in ("_key", "doc_id", "size", "_row")], "size", "_start", group="_source", name="mix-queue")
    of = weighted(placed, weights).withColumnRenamed("_source", "_of")
    return placed.join(of, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED, epochs: int = MAX_EPOCHS, weights: tuple[int, ...] = WEIGHTS, budget_share: float = BUDGET_SHARE, row: str | None = None, positions: bool = True) -> DataFrame:
    """All copies of all documents with their virtual ``finish``, by which the mix sends
    them: doc_id, epoch, size, finish, ``words`` (those sent before the budget is spent; 0
    behind the cut), ``target`` (words that the source may send) and, if asked for,
    ``position``, the words of the mix before this copy."""
    copies = queue(docs, text, doc_id, source, seed, weights, row).withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    cap, sent = F.lit(epochs) * F.col("source_size"), F.col("epoch") * F.col("source_size") + F.col("_start") + F.col("size")
    ends = (F.col("size") > 0) & (sent == cap)  # its source's last words
    copies = copies.withColumn("finish", sent / F.col("weight"))
    copies = copies.withColumn("_ends", F.when(ends, F.col("weight")).otherwise(0)).withColumn("_ended", F.when(ends, cap).otherwise(0))
    copies = copies.select("doc_id", "epoch", "size", "source_size", "weight", "finish", "_ends", "_ended", "_source", "_key", "_start", *(["_row"] if row else []))
    order = [F.col(c) for c in ("finish", "_source", "epoch", "_key", "doc_id", "size")]
    queued = range_prefix(copies, order, ["_ends", "_ended"], ["_idle", "_past"], name="mix-order")

    # at each finish: the words of sources that are through, and the weight of the others
    spent = queued.select("finish", (F.col("_idle") + F.col("_ends")).alias("idle"), (F.col("_past") + F.col("_ended")).alias("past"))
    whole = queued.filter("epoch = 0").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.sum("_ends").alias("none"))
    total = queued.agg(F.coalesce(F.sum("_ends"), F.lit(0)).alias("all_weight")).crossJoin(F.broadcast(whole.select((F.lit(budget_share) * F.col("words")).cast("double").alias("budget"))))
    at = spent.crossJoin(F.broadcast(total)).filter((F.col("all_weight") - F.col("idle")) * F.col("finish") + F.col("past") <= F.col("budget"))
    cut = at.agg(F.max(F.struct("finish", "idle", "past")).alias("c")).crossJoin(F.broadcast(total))
    idle, past = F.coalesce("c.idle", F.lit(0)), F.coalesce("c.past", F.lit(0))
    end = F.when(F.col("all_weight") > idle, (F.col("budget") - past) / (F.col("all_weight") - idle)).otherwise(F.coalesce("c.finish", F.lit(0.0)))
    cut = cut.select(end.alias("_end"))  # one row: the virtual time at which the budget is spent

    target = F.when(cap / F.col("weight") <= F.col("_end"), cap.cast("double")).otherwise(F.col("weight") * F.col("_end"))
    words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.floor("target") - F.col("_start") - F.col("epoch") * F.col("source_size")))
    mixed = queued.crossJoin(F.broadcast(cut)).withColumn("target", target).withColumn("words", words.cast("long")).drop("_end", "_ends", "_ended", "_idle", "_past", "weight")
    return range_prefix(mixed, order, "words", "position", name="mix-positions") if positions else mixed


def taken_words(mixed: DataFrame, epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per document of a :func:`mix`: doc_id, size, source_size, target, taken."""
    rows = mixed.groupBy("_source", "_key", "doc_id", "_start", "size", "source_size", "target").agg(F.sum("words").alias("taken"), (F.count("*") / epochs).cast("int").alias("_rows"))
    # rows that share id and place have no words; each still gets its own result row
    return rows.withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("_rows")))).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    return taken_words(mix(docs, text, doc_id, source, seed, positions=False))
