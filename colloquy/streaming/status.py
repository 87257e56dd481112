"""Streaming forms of what an interactive service does piecemeal: ingest, de-duplication and status by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.window import Window

#: What may be said of a job: it was begun, its result is there, or it came to nothing.
QUEUED, CACHED, FAILED = "queued", "cached", "failed"


def ingest(spark: SparkSession, path: str, schema: str, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """New files of a folder, each once, handed to ``merge`` in batches until none is left.

    After a failure a batch is handed over again; ``versions.once`` makes a merge that counts it once.
    """
    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(events: DataFrame, key: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """Work in flight by key: a key's later events within the watermark are dropped (a batch: all but the first)."""
    if events.isStreaming:
        return events.withWatermark(time, within).dropDuplicatesWithinWatermark(key)
    return events.groupBy(*key).agg(F.min(F.struct(time, *(c for c in events.columns if c not in (*key, time)))).alias("_e")).select(*key, "_e.*")


def latest(events: DataFrame, key: str, time: str, state: str) -> DataFrame:
    """The state of each key's last event; of equal times the largest."""
    return events.groupBy(key).agg(F.max(F.struct(time, state)).alias("_e")).select(key, F.col(f"_e.{time}").alias(time), F.col(f"_e.{state}").alias(state))


def windowed(events: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; late events are taken as long as the watermark allows."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def out_of_scope(in_flight: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Work that no allowed key asks for any more."""
    return in_flight.join(allowed.select(key).distinct(), key, "left_anti")


def job_states(events: DataFrame, key: str, time: str, kind: str, now: Column, deadline: timedelta) -> DataFrame:
    """(key, ready, pending) at ``now``: ready once a result is there, else pending while the last begin is neither failed nor older
    than the deadline; what is neither is out of flight. Events after ``now`` do not count."""
    met = events.filter(F.col(time) <= now)
    last = lambda *kinds: F.max(F.when(F.col(kind).isin(*kinds), F.struct(F.col(time), F.col(kind) == QUEUED)))
    rows = met.groupBy(key).agg(F.count_if(F.col(kind) == CACHED).alias("_cached"), last(QUEUED, FAILED).alias("_last"))
    ready = F.col("_cached") > 0
    open_ = F.coalesce(F.col("_last.col2") & (F.col(f"_last.{time}") + F.lit(deadline) > now), F.lit(False))
    return rows.select(key, ready.alias("ready"), (~ready & open_).alias("pending"))


class _Jobs(StatefulProcessor):
    """A job's state by key: when it is dropped, in milliseconds of event time, and whether its result is there."""

    def __init__(self, name: str, deadline: timedelta):
        self.name, self.wait = name, int(deadline.total_seconds() * 1000)

    def _said(self, key: tuple, ready: bool, pending: bool) -> Row:
        return Row(**{self.name: key[0], "ready": ready, "pending": pending})

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", "ready boolean, drop long")

    def _held(self) -> tuple[bool, int]:
        held = self.state.get()
        return (held[0], held[1]) if held else (False, 0)

    def _dropped(self, drop: int) -> None:
        if drop:
            self.handle.deleteTimer(drop)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        ready, drop = before = self._held()
        # at one time a begin comes after a failure, as the larger of the two does in a batch
        for row in sorted(rows, key=lambda r: (r["at"], r["kind"] == QUEUED)):
            if row["kind"] == CACHED:
                ready = True
            elif row["kind"] in (QUEUED, FAILED):
                drop = row["at"] + self.wait if row["kind"] == QUEUED else 0
        drop = 0 if ready or drop <= timerValues.getCurrentWatermarkInMs() else drop
        if (ready, drop) != before:
            self._dropped(before[1])
            if drop:
                self.handle.registerTimer(drop)
            self.state.update((ready, drop))
        yield self._said(key, ready, bool(drop))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        self.state.clear()
        yield self._said(key, False, False)

    def close(self) -> None:
        pass


def job_updates(events: DataFrame, key: str, time: str, kind: str, deadline: timedelta, late: str = "10 minutes") -> DataFrame:
    """A stream of (key, ready, pending): each key's state after every batch with events of it, and when a job that nothing came of
    is dropped, which a timer at its deadline does. A result's state is kept, so that a later begin is not pending."""
    marked = events.withWatermark(time, late).select(key, F.unix_millis(time).alias("at"), F.col(kind).alias("kind"), time)
    schema = f"{key} {dict(events.dtypes)[key]}, ready boolean, pending boolean"
    return marked.groupBy(key).transformWithState(_Jobs(key, deadline), schema, "Update", "EventTime")


def cooling(events: DataFrame, key: str, time: str, rest: timedelta) -> DataFrame:
    """(key, start, stop, limits): when each key was out of use, as it rested after each limit that it met; overlapping rests are one."""
    w = Window.partitionBy(key).orderBy(time)
    marked = events.select(key, time, (F.coalesce(F.lag(time).over(w) + F.lit(rest) < F.col(time), F.lit(True))).cast("int").alias("_new"))
    run = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min(time).alias("start"), (F.max(time) + F.lit(rest)).alias("stop"), F.count("*").alias("limits")).drop("_run")
