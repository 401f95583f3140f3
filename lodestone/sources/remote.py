"""Rows of a paged endpoint as a table.

    spark.dataSource.register(Paged)
    spark.read.format("paged").schema("job bigint, model string").option("url", url).load()

The endpoint answers ``GET url?offset=&limit=&column=value`` with ``{"total": n, "rows": [...]}``.
The driver asks once for the total; tasks ask for pages, again if one fails, so pages come in
parallel and a lost executor's pages are asked for anew. A partition is a page, or a run of them
where there are more than MOST_TASKS. Equality filters on columns go along. A page with fewer rows than the total says, or another total
than at first, is an error: rows were added or lost meanwhile.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

PAGE_ROWS, RETRIES, TIMEOUT, MOST_TASKS = 10_000, 4, 30.0, 2_000


class Pages(InputPartition):
    def __init__(self, offset: int, n: int, total: int):
        self.offset, self.n, self.total = offset, n, total


class Paged(DataSource):
    """Format ``paged``; options: url, pageRows, retries. The schema is given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("name the columns with .schema(...)")

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options, to_arrow_schema(schema))


class PagedReader(DataSourceReader):
    def __init__(self, options, schema: pa.Schema):
        self.url, self.schema, self.asked = options["url"], schema, {}
        self.page_rows, self.retries = int(options.get("pageRows", PAGE_ROWS)), int(options.get("retries", RETRIES))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and isinstance(f.value, str | int) and f.attribute[0] not in self.asked:
                self.asked[f.attribute[0]] = f.value
            else:
                yield f

    def _get(self, offset: int, limit: int) -> dict:
        query = urlencode({"offset": offset, "limit": limit, **self.asked})
        for attempt in range(self.retries + 1):
            try:
                with urlopen(f"{self.url}?{query}", timeout=TIMEOUT) as answer:
                    return json.load(answer)
            except (URLError, TimeoutError, ConnectionError, ValueError):
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def partitions(self) -> list[Pages]:
        total = self._get(0, 0)["total"]
        run = self.page_rows * max(1, -(-total // (self.page_rows * MOST_TASKS)))
        return [Pages(at, min(run, total - at), total) for at in range(0, total, run)] or [Pages(0, 0, 0)]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        end = partition.offset + partition.n
        for offset in range(partition.offset, end, self.page_rows):
            n = min(self.page_rows, end - offset)
            got = self._get(offset, n)
            if got["total"] != partition.total or len(got["rows"]) != n:
                raise ValueError(f"page at {offset}: {len(got['rows'])} of {n} rows, total {got['total']}, at first {partition.total}")
            yield pa.RecordBatch.from_arrays([pa.array([row.get(f.name) for row in got["rows"]], f.type) for f in self.schema], schema=self.schema)


def read_pages(spark: SparkSession, url: str, schema: str, page_rows: int = PAGE_ROWS) -> DataFrame:
    spark.dataSource.register(Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").schema(schema).option("url", url).option("pageRows", page_rows).load()
