"""Pages by an index of row counts, and rows of a paged endpoint."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit

import pytest
from pyspark.sql import functions as F

from lodestone.plans import served
from lodestone.sources import pages, remote

SCHEMA = "id bigint, model string, note string"


@pytest.fixture
def endpoint(spark):
    """Rows served by pages; ``fail`` tells how often a request fails before it is answered."""
    state = {"rows": [{"id": n, "model": f"m{n % 3}", "note": None if n % 5 else "x"} for n in range(257)], "fail": 0, "asked": [], "short": False}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked = dict(parse_qsl(urlsplit(self.path).query))
            state["asked"].append(asked)
            if sum(a == asked for a in state["asked"]) <= state["fail"]:
                self.send_error(500)
                return
            rows = [r for r in state["rows"] if asked.get("model") in (None, r["model"])]
            offset, limit = int(asked["offset"]), int(asked["limit"])
            page = rows[offset : offset + limit]
            body = json.dumps({"total": len(rows), "rows": page[:-1] if state["short"] else page}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_address[1]}/rows"
    yield state
    server.shutdown()
    server.server_close()


def test_all_pages_arrive_though_some_fail(spark, endpoint):
    endpoint["fail"] = 2
    got = remote.read_pages(spark, endpoint["url"], SCHEMA, 50)
    assert got.rdd.getNumPartitions() == 6
    assert sorted(r.id for r in got.collect()) == list(range(257))
    assert sorted({(int(a["offset"]), int(a["limit"])) for a in endpoint["asked"]}) == sorted([(0, 0), *((n, min(50, 257 - n)) for n in range(0, 257, 50))])


def test_filters_go_to_the_endpoint(spark, endpoint):
    got = remote.read_pages(spark, endpoint["url"], SCHEMA, 50).filter((F.col("model") == "m1") & (F.col("id") > 100))
    assert sorted(r.id for r in got.collect()) == [n for n in range(101, 257) if n % 3 == 1]
    assert all(a.get("model") == "m1" for a in endpoint["asked"])


def test_a_short_page_or_a_lasting_failure_is_an_error(spark, endpoint):
    endpoint["short"] = True
    with pytest.raises(Exception, match="page at"):
        remote.read_pages(spark, endpoint["url"], SCHEMA, 50).collect()
    endpoint |= {"short": False, "fail": 99}
    with pytest.raises(Exception, match="500"):
        remote.read_pages(spark, endpoint["url"], SCHEMA, 50).collect()


def test_no_rows(spark, endpoint):
    endpoint["rows"] = []
    assert remote.read_pages(spark, endpoint["url"], SCHEMA).count() == 0


def test_a_page_opens_its_files_only(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(10_000).select(((F.col("id") * 7919) % 10_000).alias("k"), F.lit("v").alias("v"))
    pages.write_pages(rows, path, ["k"], files=16)
    assert pages.n_rows(spark, path) == 10_000
    for offset, limit in ((0, 5), (9990, 50), (4321, 700), (623, 4), (10_000, 5), (99_999, 5)):
        got = pages.page(spark, path, offset, limit)
        assert sorted((r.row_number, r.k) for r in got.collect()) == [(n, n) for n in range(offset, min(offset + limit, 10_000))]
    last = pages.page(spark, path, 9990, 50)
    assert len(last.inputFiles()) == 1 and "Sort" not in last._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="limit"):
        pages.page(spark, path, 0, 0)


def test_pages_of_nothing(spark, tmp_path):
    pages.write_pages(spark.range(0), str(tmp_path), ["id"])
    assert pages.page(spark, str(tmp_path), 0, 10).count() == 0 == pages.n_rows(spark, str(tmp_path))


def test_many_pages_are_runs_of_a_bounded_number_of_tasks(spark, endpoint):
    endpoint["fail"] = 1
    got = remote.read_pages(spark, endpoint["url"], SCHEMA, 10)
    reader = remote.PagedReader({"url": endpoint["url"], "pageRows": "10"}, None)
    most, remote.MOST_TASKS = remote.MOST_TASKS, 9
    try:
        runs = reader.partitions()
    finally:
        remote.MOST_TASKS = most
    assert [(p.offset, p.n) for p in runs] == [(at, min(30, 257 - at)) for at in range(0, 257, 30)]
    assert sorted((r.id, r.note) for r in got.collect()) == [(n, None if n % 5 else "x") for n in range(257)]


def test_a_served_page_reads_its_row_groups_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    rows = spark.range(30_000).select(F.col("id").alias("job"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('q"'), "id")).alias("note"))
    served.store(rows, path, ["job"])
    table, read = served.Rows(path), []
    whole = served.pq.ParquetFile.read_row_groups
    monkeypatch.setattr(served.pq.ParquetFile, "read_row_groups", lambda self, groups, **how: read.append(sum(self.metadata.row_group(g).num_rows for g in groups)) or whole(self, groups, **how))
    for offset, limit in ((0, 10), (7_495, 4000), (29_990, 50), (12_345, 1), (30_000, 5), (0, 30_000)):
        read.clear()
        got = json.loads(f"[{table.page(offset, limit)}]")
        assert [(r["job"], r.get("note")) for r in got] == [(n, f'q"{n}' if n % 3 else None) for n in range(offset, min(offset + limit, 30_000))]
        assert sum(read) <= limit + 4 * served.GROUP_ROWS
