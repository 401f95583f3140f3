"""Several writers of one table."""

import os
import threading
import time

import pytest

from lodestone.sources import sinks

SCHEMA = "experiment_id string, job_id string, place bigint"


def together(*jobs):
    failed = []

    def run(job):
        try:
            job()
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed


def test_appends_of_several_writers_lose_and_double_nothing(spark, tmp_path):
    path = str(tmp_path / "rows")
    batches = [spark.createDataFrame([("e", f"j{n}", n) for n in range(10 * k, 10 * k + 15)], SCHEMA) for k in range(4)]
    together(*[lambda b=b: sinks.append_new(spark, b, path, ["job_id"], "place") for b in batches])
    assert sorted(r.job_id for r in spark.read.parquet(path).collect()) == sorted(f"j{n}" for n in range(45))
    assert not os.path.exists(f"{path}.lock")


def test_patches_of_several_writers_add_up(spark, tmp_path):
    runs = sinks.RunRegistry(spark, str(tmp_path / "runs"))
    runs.create("r")
    together(*[lambda n=n: runs.patch("r", increment=n, error=f"e{n}") for n in (1, 2, 3)])
    got = runs.get("r")
    assert got["completed"] == 6 and sorted(got["errors"]) == ["e1", "e2", "e3"]


def test_a_lock_of_a_writer_that_is_gone(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(TimeoutError), sinks.locked(spark, path, wait=0.3):
        pass
    os.utime(tmp_path / "t.lock", (time.time() - 9999, time.time() - 9999))
    with sinks.locked(spark, path, wait=0.3):
        assert (tmp_path / "t.lock").exists()
    assert not (tmp_path / "t.lock").exists()
