"""Minutes that a stream closes by itself, and a row for minutes in which nothing came.

Both are stateful operators with event-time timers. Spark drops rows behind the watermark; here
nothing may be lost, so the watermark follows the newest event at a distance of ``HORIZON_DAYS``
and the timers are set that much earlier. A row is dropped only if it is older than that, while a
minute closes ``lateness`` after its end, as the newest event tells. Rows for a closed minute are
sent at once as corrections: the sum over a minute's rows is always its true figure.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import (DataStreamWriter, StatefulProcessor, StatefulProcessorHandle,
                                   StreamingQuery)

from querytrail.functions.events import is_nxdomain, is_servfail
from querytrail.schemas import COUNTERS_LATENCY
from querytrail.session import use_state_store

HORIZON_DAYS = 14_610  # forty years
_HORIZON = HORIZON_DAYS * 86_400_000
_MINUTE = 60_000
_COLUMNS = list(COUNTERS_LATENCY)
_LONGS = ", ".join(f"{c} long" for c in _COLUMNS)
CLOSED = f"minute_timestamp timestamp, resolver_id string, {_LONGS}, correction boolean"
FILLED = f"minute_timestamp timestamp, {_LONGS}, correction boolean"


# The driver looks at a processor in a Python process of its own, which does not know this
# package unless it is installed: classes of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def counted(events: DataFrame) -> DataFrame:
    """One row of counters per (prepared) event, with its minute in milliseconds. Events without
    an ``action`` are heartbeats: they move the clock and count nothing."""
    real = F.col("action").isNotNull()

    def flag(condition):
        return (real & F.coalesce(condition, F.lit(False))).cast("long")

    blocked, hit = F.col("is_blocked"), F.coalesce(F.col("cache_hit"), F.lit(False))
    values = [flag(F.lit(True)), flag(~blocked), flag(blocked), flag(is_nxdomain(F.col("rcode"))),
              flag(is_servfail(F.col("rcode"))), flag(hit), flag(~hit),
              F.when(real, F.coalesce("latency_ms", F.lit(0))).otherwise(0).cast("long")]
    minute = F.floor(F.unix_millis("ts") / _MINUTE) * _MINUTE
    return events.select(
        "ts", "resolver_id", F.date_trunc("hour", F.col("ts")).alias("hour_timestamp"),
        minute.cast("long").alias("minute_ms"),
        *[v.alias(c) for v, c in zip(values, _COLUMNS, strict=True)])


def _timestamps(minutes) -> pd.Series:
    return pd.to_datetime(pd.Series(list(minutes), dtype="int64"), unit="ms")


class _Minutes(StatefulProcessor):
    """Open minutes of a key as one state value: places and sums of all of them, as bytes, since
    Spark may hand over the rows of a micro-batch in several calls and each reads and writes it."""

    def __init__(self, lateness_ms: int):
        self.lateness = lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "minutes array<bigint>, sums array<bigint>")
        self.packed = handle.getValueState("packed", "minutes binary, sums binary")

    def close(self) -> None:
        pass

    def clock(self, timer_values) -> int:
        """Minutes that end here or before are closed."""
        mark = timer_values.getCurrentWatermarkInMs()
        return mark + _HORIZON - self.lateness if mark > 0 else -1

    def load(self) -> pd.DataFrame:
        width = len(_COLUMNS)
        if self.packed.exists():
            minutes, sums = (np.frombuffer(bytes(x), dtype="<i8") for x in self.packed.get())
        else:  # none, or a state from before it was packed
            minutes, sums = self.open.get() if self.open.exists() else ([], [])
        return pd.DataFrame(np.array(sums, dtype="int64").reshape(-1, width),
                            index=pd.Index(minutes, dtype="int64"), columns=_COLUMNS)

    def save(self, table: pd.DataFrame) -> None:
        if self.open.exists():
            self.open.clear()
        if len(table):
            self.packed.update((table.index.to_numpy(dtype="<i8").tobytes(),
                                table.to_numpy(dtype="<i8").tobytes()))
        else:
            self.packed.clear()

    def wake(self, minute: int) -> None:
        """A timer for the moment at which the minute closes."""
        self.handle.registerTimer(int(minute) + _MINUTE + self.lateness - _HORIZON)


class MinuteCloser(_Minutes):
    """Key: resolver and hour. Emits each minute when its timer fires."""

    def rows(self, key, table: pd.DataFrame, correction: bool) -> pd.DataFrame:
        out = table.reset_index(drop=True)
        out.insert(0, "minute_timestamp", _timestamps(table.index))
        out.insert(1, "resolver_id", key[0])
        out["correction"] = correction
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        fresh = pd.concat(parts).groupby("minute_ms")[_COLUMNS].sum()
        table, clock = self.load(), self.clock(timerValues)
        first = table.index.min() if len(table) else None
        beat = fresh["total_queries"] == 0
        late = (fresh.index + _MINUTE <= clock) & ~fresh.index.isin(table.index)
        at_once = beat | late
        if at_once.any():
            yield self.rows(key, fresh[at_once], True)
        fresh = fresh[~at_once]
        if len(fresh):
            table = table.add(fresh, fill_value=0).astype("int64").sort_index()
            self.save(table)
            if first is None or table.index.min() < first:
                self.wake(table.index.min())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        table, clock = self.load(), self.clock(timerValues)
        done = table.index + _MINUTE <= clock
        if done.any():
            yield self.rows(key, table[done], False)
            table = table[~done]
            self.save(table)
        if len(table):
            self.wake(table.index.min())


class MinuteFiller(_Minutes):
    """One key. Emits every minute from the first on, zeros where nothing came; the timer sets
    itself anew each time. The state holds the open minutes and how far it has come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.reach = handle.getValueState("reach", "first bigint, next bigint")

    def rows(self, table: pd.DataFrame, correction: bool) -> pd.DataFrame:
        out = table.reset_index(drop=True)
        out.insert(0, "minute_timestamp", _timestamps(table.index))
        out["correction"] = correction
        return out

    def filled(self, table: pd.DataFrame, first: int, end: int) -> Iterator[pd.DataFrame]:
        """The minutes from ``first`` to ``end`` (not included), a day at a time."""
        step = 1440 * _MINUTE
        for at in range(first, end, step):
            minutes = pd.Index(range(at, min(at + step, end), _MINUTE), dtype="int64")
            yield self.rows(table.reindex(minutes, fill_value=0).astype("int64"), False)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        fresh = pd.concat(parts).groupby("minute_ms")[_COLUMNS].sum()
        table = self.load()
        first, following = self.reach.get() if self.reach.exists() else (None, None)
        if first is None:
            first = following = int(fresh.index.min())
            self.wake(following)
        before = fresh[fresh.index < first]
        if len(before) and following == first:  # nothing sent yet: begin earlier
            first = following = int(before.index.min())
            self.wake(following)
        elif len(before):
            start = int(before.index.min())
            yield from self.filled(before, start, first)
            first = start
        late = fresh[(fresh.index < following) & ~fresh.index.isin(before.index)]
        if len(late):
            yield self.rows(late, True)
        fresh = fresh[fresh.index >= following]
        if len(fresh):
            self.save(table.add(fresh, fill_value=0).astype("int64").sort_index())
        self.reach.update((first, following))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, following = self.reach.get()
        end = self.clock(timerValues) // _MINUTE * _MINUTE
        if end > following:
            table = self.load()
            yield from self.filled(table, following, end)
            self.save(table[table.index >= end])
            following = end
            self.reach.update((first, following))
        self.wake(following)


def closed_minutes(events: DataFrame, lateness_ms: int = 0) -> DataFrame:
    """Counters per minute and resolver from a stream of prepared events, each minute once when
    it closes and late rows as corrections. Heartbeats pass at once, as corrections of nothing.

    Like ``filled_minutes`` it sets the session's state store, where that has Spark's default."""
    use_state_store(events.sparkSession)
    return (counted(events).withWatermark("ts", f"{HORIZON_DAYS} days")
            .groupBy("resolver_id", "hour_timestamp")
            .transformWithStateInPandas(MinuteCloser(lateness_ms), CLOSED, "Append", "EventTime"))


def write_closed(events: DataFrame, path: str, checkpoint: str, lateness_ms: int = 0):
    """Stream writer of closed minutes. A micro-batch becomes a file per core at most, not one per
    partition of the state: queries that follow the folder take so many files at a time."""
    spark = events.sparkSession
    files = min(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    return (closed_minutes(events, lateness_ms).repartition(files).writeStream.format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint))


def filled_minutes(minutes: DataFrame, lateness_ms: int = 0) -> DataFrame:
    """A row for every minute from a stream of closed minutes: a few rows a minute, so one key.

    Rows of a minute that was sent already, also as zeros, follow as corrections. One partition
    is enough for its state, see ``start``."""
    use_state_store(minutes.sparkSession)
    ready = minutes.select(
        "minute_timestamp", F.lit(0).alias("cluster"),
        F.unix_millis("minute_timestamp").alias("minute_ms"), *_COLUMNS)
    return (ready.withWatermark("minute_timestamp", f"{HORIZON_DAYS} days").groupBy("cluster")
            .transformWithStateInPandas(MinuteFiller(lateness_ms), FILLED, "Append", "EventTime"))


def start(writer: DataStreamWriter, spark: SparkSession, partitions: int) -> StreamingQuery:
    """Start the writer with its state in so many partitions, or in the session's number if that
    is less. Each partition writes state files per micro-batch, also one without keys: a query with
    few keys needs few. A checkpoint keeps the number that its query first started with."""
    name = "spark.sql.shuffle.partitions"
    held = spark.conf.get(name)
    spark.conf.set(name, str(min(int(held), partitions)))
    try:
        return writer.start()  # takes a copy of the session's settings
    finally:
        spark.conf.set(name, held)


def minute_sums(rows: DataFrame, *by: str) -> DataFrame:
    """Minutes with their corrections added."""
    return rows.groupBy("minute_timestamp", *by).agg(*[F.sum(c).alias(c) for c in _COLUMNS])
