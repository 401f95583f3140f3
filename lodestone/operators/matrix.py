"""Experiment matrices, their costs and registries."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_matrix(spark: SparkSession, models: dict[str, str], tiers: list[str], opts: list[str], contexts: list[str], top_k: int | None = None) -> DataFrame:
    """All combinations (a cross join of four short lists): experiment_id, model, tier,
    opt, context, top_k."""
    # given lists: one partition for the first, the others sent to it
    axis = lambda name, values: F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} string"))
    m = spark.createDataFrame(list(models.items()), "short string, model string").coalesce(1)
    rows = m.crossJoin(axis("tier", tiers)).crossJoin(axis("opt", opts)).crossJoin(axis("context", contexts))
    tail = [F.lit(f"top{top_k}")] if top_k else []
    return rows.select(F.concat_ws("_", F.lit("exp"), "short", F.lower("tier"), "opt", "context", *tail).alias("experiment_id"), "model", "tier", "opt", "context", F.lit(top_k).cast("int").alias("top_k"))


def price_of(model: Column, tiers: list[tuple[float, list[str]]], other: float) -> Column:
    """Price per million tokens: of the first tier with a tag that the model's name has."""
    out = F.lit(other)
    for price, tags in reversed(tiers):
        hit = F.lit(False)
        for t in tags:
            hit = hit | F.contains(model, F.lit(t))
        out = F.when(hit, F.lit(price)).otherwise(out)
    return out


def estimate_cost(matrix: DataFrame, tiers: list[tuple[float, list[str]]], other: float, functions: int = 300, prompt_tokens: int = 800) -> DataFrame:
    """Per experiment: calls, input tokens and cost in dollars."""
    return matrix.select("experiment_id", "model", F.lit(functions).alias("calls"), F.lit(functions * prompt_tokens).alias("input_tokens"), (price_of(F.col("model"), tiers, other) * functions * prompt_tokens / 1_000_000).alias("cost"))


def find(registry: DataFrame, task: str | None = None, status: str | None = None, tag: str | None = None) -> DataFrame:
    """Experiments by task, status and tag; None doesn't filter."""
    for column, value in (("task", task), ("status", status)):
        if value is not None:
            registry = registry.filter(F.col(column) == value)
    return registry if tag is None else registry.filter(F.array_contains("tags", tag))


def provider(model: Column, known: list[str]) -> Column:
    head = F.when(F.contains(model, F.lit("/")), F.lower(F.substring_index(model, "/", 1))).otherwise("")
    return F.when(head.isin(*known), head).otherwise("other")


def next_response_format(current: Column) -> Column:
    """What to ask for after a refusal: schema, then plain JSON, then nothing."""
    return F.when(current == "json_schema", "json_object").when(current == "json_object", "none")


def job_status(jobs: DataFrame, by: str, ok: str) -> DataFrame:
    """SUCCESS if all cells built, PARTIAL if some, FAILED if none or no cells."""
    some, every = F.bool_or(F.col(ok)), F.bool_and(F.col(ok))
    return jobs.groupBy(by).agg(F.when(F.coalesce(every, F.lit(False)), "SUCCESS").when(F.coalesce(some, F.lit(False)), "PARTIAL").otherwise("FAILED").alias("status"))


def snapshot_hash(files: DataFrame, by: str, path: str, content: str) -> DataFrame:
    """One hash over a job's files in path order. Files are hashed where they lie; a job's lines
    come to its task in order and are hashed as they pass, none of them kept."""
    lines = files.select(by, F.col(path).alias("_path"), F.concat(F.col(path), F.lit(":"), F.sha2(F.col(content).cast("binary"), 256)).alias("_line"))
    ordered = lines.repartition(by).sortWithinPartitions(by, "_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, hashed, done = [], None, []
        for b in batches:
            for key, line in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if not keys or key != keys[-1]:
                    done += [hashed.hexdigest()] if hashed else []
                    keys.append(key)
                    hashed = sha256(line.encode())
                else:
                    hashed.update(b"\n" + line.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], keys[0].type), pa.array([*done, hashed.hexdigest()])], names=[by, "snapshot"])

    return ordered.select(by, "_line").mapInArrow(run, f"`{by}` {files.schema[by].dataType.simpleString()}, snapshot string")

