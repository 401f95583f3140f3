"""Pages of a sorted table by row numbers.

A table is written in order, as files that follow one another, with an index of how many rows
each file has and how many are before it. A page opens the files that hold it, found by a
filter on the index, however far behind it lies: no sort, and no row before it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000


def write_pages(rows: DataFrame, path: str, order: list[str], files: int | None = None, options: dict[str, str] | None = None) -> None:
    """Write ``rows`` in ``order``, which should tell them apart, and the index; ``options`` are the writer's."""
    spark = rows.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.options(**options or {}).parquet(f"{path}/rows")
    counts = spark.read.parquet(f"{path}/rows").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
    # names begin with the number of the range; there are as many rows as files
    first = F.expr("coalesce(sum(n_rows) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    counts.withColumn("first", first).write.parquet(f"{path}/index")


def n_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/index").agg(F.sum("n_rows")).first()[0] or 0


def page(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows [offset, offset + limit) of the order, with their number ``row_number``."""
    if offset < 0 or not 1 <= limit <= MOST_ROWS:
        raise ValueError("offset must not be negative, limit at least 1 and not above the most")
    index = spark.read.parquet(f"{path}/index")
    # at most as many files as the page has rows
    held = index.filter((F.col("first") < offset + limit) & (F.col("first") + F.col("n_rows") > offset)).orderBy("first").collect()
    whole = spark.read.parquet(f"{path}/rows")
    if not held:
        return whole.limit(0).withColumn("row_number", F.lit(None).cast("long"))
    rows = spark.read.schema(whole.schema).parquet(*[f"{path}/rows/{h['file']}" for h in held])
    starts = F.create_map(*[F.lit(x) for h in held for x in (h["file"], h["first"])])
    numbered = rows.withColumn("row_number", starts[F.col("_metadata.file_name")] + F.col("_metadata.row_index"))
    return numbered.filter((F.col("row_number") >= offset) & (F.col("row_number") < offset + limit))
