"""A folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a local master may go without that
    setting and gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.setdefault("LODESTONE_LOCAL_SCRATCH", tempfile.mkdtemp(prefix="lodestone-scratch-"))
    return f"{base.rstrip('/')}/lodestone-scratch/{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once, for steps that read them more than once."""
    path = scratch(rows.sparkSession, name)
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
