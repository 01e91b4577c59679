"""Minutes that a stream closes: late files, restarts and gaps."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from querytrail import catalog
from querytrail import fixtures as fx
from querytrail.operators import metrics
from querytrail.streaming import stateful

SCHEMA = ("ts timestamp, resolver_id string, action string, is_blocked boolean, rcode int, "
          "cache_hit boolean, latency_ms long")
START = datetime(2024, 1, 1, 10)


def _rows(minutes, resolver="r0", n=3):
    return [(START + timedelta(minutes=m, seconds=7 * i), resolver,
             "BLOCKED" if i == 0 else "RESOLVED", i == 0, [0, 2, 3][i % 3], i == 1, 5 + i)
            for m in minutes for i in range(n)]


def _beat(minute):
    return [(START + timedelta(minutes=minute), "r0", None, None, None, None, None)]


class Feed:
    def __init__(self, spark, tmp_path):
        self.spark, self.base = spark, tmp_path
        self.landed, self.closed, self.filled = (str(tmp_path / n) for n in "abc")
        self.sent = []

    def send(self, rows):
        df = self.spark.createDataFrame(rows, SCHEMA)
        df.coalesce(1).write.mode("append").parquet(self.landed)
        self.sent += rows

    def run(self, lateness=0):
        source = (self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1)
                  .parquet(self.landed))
        self._write(stateful.closed_minutes(source, lateness), self.closed, "k1")
        return self.spark.read.schema(stateful.CLOSED).parquet(self.closed)

    def fill(self):
        source = self.spark.readStream.schema(stateful.CLOSED).parquet(self.closed)
        self._write(stateful.filled_minutes(source), self.filled, "k2")
        return self.spark.read.schema(stateful.FILLED).parquet(self.filled)

    def _write(self, df, path, ckpt):
        (df.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", str(self.base / ckpt)).trigger(availableNow=True)
         .start().awaitTermination())

    def truth(self):
        real = self.spark.createDataFrame([r for r in self.sent if r[2] is not None], SCHEMA)
        return metrics.agg_resolver_minute(real)


def _sums(df):
    return sorted(tuple(r) for r in df.select(
        "minute_timestamp", *stateful.COUNTERS_LATENCY).collect())


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_minutes_close_once_and_late_rows_are_corrections(feed):
    feed.send(_rows([0, 1, 1]) + _rows([1], "r1"))
    feed.run()
    feed.send(_rows([60, 61]))          # closes minutes 0 and 1
    feed.run()
    feed.send(_rows([1, 0]))            # late
    feed.send(_beat(200))
    rows = feed.run()                   # the same query, started again
    got = rows.filter("total_queries > 0").collect()
    first = [(r["minute_timestamp"], r["resolver_id"]) for r in got if not r["correction"]]
    assert len(first) == len(set(first)) == 5
    late = [r for r in got if r["correction"]]
    assert sorted((r["minute_timestamp"].minute, r["total_queries"]) for r in late) == [
        (0, 3), (1, 3)]
    assert _sums(stateful.minute_sums(rows).filter("total_queries > 0")) == _sums(feed.truth())


def test_lateness_waits(feed):
    feed.send(_rows([0]))
    feed.send(_rows([3]))
    feed.send(_rows([0]))               # within ten minutes: no correction
    feed.send(_rows([30]))
    feed.send(_beat(60))
    rows = feed.run(lateness=600_000).filter("total_queries > 0")
    assert rows.filter("correction").isEmpty()
    assert _sums(stateful.minute_sums(rows)) == _sums(feed.truth())


def test_gaps_of_hours_are_filled(feed):
    feed.send(_rows([5, 6]))
    feed.send(_rows([400]))
    feed.send(_rows([2, 7]))            # late, one of them before the first
    feed.send(_beat(410))
    feed.run()
    rows = feed.fill()
    sums = stateful.minute_sums(rows)
    last = START + timedelta(minutes=400)
    got = _sums(sums.filter(F.col("minute_timestamp") <= F.lit(last)))
    assert got == _sums(metrics.zero_fill_minutes(feed.truth()))
    assert len(got) == 399
    # Minutes after the last event are there, too, as far as the clock has come.
    assert sums.filter(F.col("minute_timestamp") > F.lit(last)).count() >= 5
    # Each minute was sent once, apart from corrections.
    plain = [r["minute_timestamp"] for r in rows.filter("not correction").collect()]
    assert len(plain) == len(set(plain))


def test_filling_goes_on_after_a_restart(feed):
    feed.send(_rows([0]) + _rows([3], "r1"))
    feed.send(_beat(10))
    feed.run()
    feed.fill()
    feed.send(_rows([1, 30]))
    feed.send(_beat(40))
    feed.run()
    sums = stateful.minute_sums(feed.fill())
    last = START + timedelta(minutes=30)
    assert _sums(sums.filter(F.col("minute_timestamp") <= F.lit(last))) == _sums(
        metrics.zero_fill_minutes(feed.truth()))


def test_a_session_with_the_default_state_store(feed, spark):
    """Timers need another store than Spark's default: the operators see to it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    held = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state."
                         "HDFSBackedStateStoreProvider")
    try:
        feed.send(_rows([0, 2]))
        feed.send(_beat(10))
        rows = feed.run()
        assert _sums(stateful.minute_sums(rows).filter("total_queries > 0")) == _sums(feed.truth())
        # Both operators do, also the second one alone.
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state."
                             "HDFSBackedStateStoreProvider")
        assert stateful.minute_sums(feed.fill()).count() >= 3
    finally:
        spark.conf.set(name, held)


def test_cost_of_filling_does_not_follow_the_shuffle_partitions(spark, tmp_path, monkeypatch):
    """One key keeps its state in one partition, and closed minutes come in a few files."""
    sf, kinds = str(tmp_path / "sf"), ["view", "click", "purchase", "signup", "error"]
    (spark.createDataFrame(
        [(i, START + timedelta(minutes=7 * i, seconds=i % 60), i % 5, kinds[i % 5], float(i % 9))
         for i in range(400)],
        "event_id long, ts timestamp, user_id long, event_type string, value double")
     .coalesce(1).write.parquet(f"{sf}/events.parquet"))
    (spark.createDataFrame([(i, f"https://h{i}.example/x") for i in range(3)],
                           "page_id long, url string")
     .coalesce(1).write.parquet(f"{sf}/pages.parquet"))
    made = []

    def folder(_, name):
        made.append(tmp_path / f"{name}-{len(made)}")
        return str(made[-1])

    monkeypatch.setattr(catalog, "scratch_dir", folder)
    name, cores = "spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism
    held = spark.conf.get(name)
    spark.conf.set(name, str(4 * cores))
    try:
        got = _sums(catalog.QUERIES["stream_zero_fill"](spark, sf))
        assert spark.conf.get(name) == str(4 * cores)
        assert got == _sums(metrics.zero_fill_minutes(
            metrics.agg_resolver_minute(fx.prepared_events(spark, sf))))
    finally:
        spark.conf.set(name, held)
    minutes, closing, filling = (at for n in ("minutes", "ckpt") for at in made
                                 if at.name.startswith(n))
    assert [len(list((at / "state" / "0").glob("[0-9]*"))) for at in (closing, filling)] == [
        cores, 1]
    batches = len(list((closing / "commits").glob("[0-9]*")))
    assert 0 < len(list(minutes.glob("part-*"))) <= cores * batches


def test_start_keeps_a_smaller_number_and_restarts(feed, spark):
    feed.send(_rows([0, 2]))
    feed.send(_beat(10))
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(partitions):
        source = spark.readStream.schema(SCHEMA).parquet(feed.landed)
        writer = stateful.write_closed(source, feed.closed, str(feed.base / "k1"))
        query = stateful.start(writer.trigger(availableNow=True), spark, partitions)
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numShufflePartitions"]

    assert run(100 * few) == few
    feed.send(_rows([60]))
    feed.send(_beat(70))
    assert run(1) == few                # the checkpoint's number
    rows = spark.read.schema(stateful.CLOSED).parquet(feed.closed).filter("total_queries > 0")
    assert _sums(stateful.minute_sums(rows)) == _sums(feed.truth())


class _Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


def test_open_minutes_are_kept_as_bytes_and_older_states_are_read():
    class Handle:
        def getValueState(self, *_):
            return _Value()

    closer = stateful.MinuteCloser(0)
    closer.init(Handle())
    assert len(closer.load()) == 0
    width = len(stateful.COUNTERS_LATENCY)
    closer.open.update(([60_000, 120_000], list(range(2 * width))))
    table = closer.load()
    assert table.index.tolist() == [60_000, 120_000]
    assert table.loc[120_000].tolist() == list(range(width, 2 * width))
    closer.save(table)
    assert not closer.open.exists()
    minutes, sums = closer.packed.get()
    assert isinstance(minutes, bytes) and len(sums) == 2 * width * 8
    assert closer.load().equals(table)
    closer.save(table[:0])
    assert not closer.packed.exists() and len(closer.load()) == 0
