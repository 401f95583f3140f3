"""Result streams: files in, each job once, tables kept idempotent batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import exists
from ..sources.sinks import new_rows


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(stream: DataFrame, key: list[str], ts: str, delay: str = "1 day") -> DataFrame:
    """Each key once; state older than the delay is dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], size: str, delay: str | None = None) -> DataFrame:
    """Rows per window; ``delay`` None: the stream has its watermark already."""
    marked = stream.withWatermark(ts, delay) if delay else stream
    return marked.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def append_stream(stream: DataFrame, path: str, checkpoint: str, key: list[str], scope: str, position: str | None = None) -> StreamingQuery:
    """Append new keys of each scope; a batch that runs again adds nothing. Of a key's rows
    in one batch the first by ``position`` counts, without it the first as read."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(path) if exists(spark, path) else None
        # all scopes of a batch at once: a key counts within its scope
        rows = batch.withColumn("_at", F.col(position) if position else F.monotonically_increasing_id())
        new_rows(rows, stored, list(dict.fromkeys([scope, *key])), "_at").drop("_at").write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
