"""Streams with state for each key, in event time.

State lives in the store of the stream's checkpoint and is looked up for a batch's keys only,
so a batch costs what its rows cost, however long the stream has run, and a restart goes on
where the checkpoint stands. Rows may come in any order and more than once within the
watermark's delay; what a key gives is written once, when the watermark has passed all that
could change it, by a timer. Rows later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _timer(micros: int) -> int:
    """Timers have milliseconds: the first that is not before."""
    return -(-micros // 1000)


class FirstRow(StatefulProcessor):
    """The first row of a key by time, then by ``position``; both come in front of the other columns.
    What has been written is remembered for ``keep_ms``, without it for good. All that a key needs
    is one value of state, so a batch reads a key's state once and writes it only for a new first row."""

    def __init__(self, names: list[str], types: list[str], keep_ms: int | None):
        self.names, self.keep_ms = names, keep_ms
        self.schema = ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"written boolean, {self.schema}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.held.get()
        if old is None or not old[0]:
            new = min((tuple(r) for r in rows if r[0] is not None), key=lambda r: r[:2], default=None)
            if new is not None and (old is None or new[:2] < tuple(old[1:3])):
                if old is not None:
                    self.handle.deleteTimer(_timer(old[1]))
                self.held.update((False, *new))
                self.handle.registerTimer(_timer(new[0]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held[0]:
            self.held.clear()
        else:
            self.held.update((True, *held[1:3], *[None] * (len(self.names) - 2)))
            if self.keep_ms is not None:
                self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
            yield Row(**dict(zip(self.names, held[1:], strict=True)))

    def close(self) -> None:
        pass


def _with_state(stream: DataFrame) -> None:
    """Timers need this store; the setting counts when a stream starts."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def first_rows(stream: DataFrame, key: list[str], ts: str, position: str, delay: str, keep_days: int | None = None) -> DataFrame:
    """The first row of each key by event time, once."""
    _with_state(stream)
    others = [f for f in stream.schema.fields if f.name != ts]
    names = [f"field{n}" for n in range(len(others))]
    processor = FirstRow(["_at", "_place", *names], ["bigint", "bigint", *[f.dataType.simpleString() for f in others]], None if keep_days is None else keep_days * DAY_MS)
    # the time goes as a number, so that no time zone of a worker counts; named columns come back by place
    given = stream.withWatermark(ts, delay).select(F.unix_micros(ts).alias("_at"), F.col(position).cast("long").alias("_place"), *[F.col(f.name).alias(n) for n, f in zip(names, others, strict=True)], ts)
    named = {f.name: n for n, f in zip(names, others, strict=True)}
    out = given.groupBy(*[named[k] for k in key]).transformWithState(processor, processor.schema, "Append", "EventTime")
    return out.select(*[F.timestamp_micros("_at").alias(c) if c == ts else F.col(named[c]).alias(c) for c in stream.columns])


def job_status(stream: DataFrame, key: list[str], ts: str, good: str, gap_ms: int, delay: str) -> DataFrame:
    """Each key's runs, one row a run: start, stop, n, n_good and status: SUCCESS if all rows are
    good, FAILED if none is, else PARTIAL. Runs are session windows: what is open is kept as merged
    stretches, and no row or timer leaves the JVM."""
    _with_state(stream)
    run = F.session_window(ts, f"{gap_ms} milliseconds").alias("_run")
    rows = stream.withWatermark(ts, delay).groupBy(*key, run).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("n"), F.count_if(good).alias("n_good"))
    status = F.when(F.col("n_good") == F.col("n"), "SUCCESS").when(F.col("n_good") == 0, "FAILED").otherwise("PARTIAL")
    return rows.select(*key, "start", "stop", "n", "n_good", status.alias("status"))
