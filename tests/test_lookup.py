"""Lookups by an index, and the streamed cube's bookkeeping."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querytrail.operators import metrics
from querytrail.schemas import DNS_QUERY_EVENTS
from querytrail.sources import facts, indexed, paths
from querytrail.streaming import metrics as stream
from test_pipeline import rows_of, some_events


def _rows_read(df):
    """Rows that the scan has decoded: those of the row groups that were not skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value()
               for i in range(leaves.size()))


@pytest.fixture(scope="module")
def facts_rows(spark):
    """A third of all rows under one client."""
    return spark.range(0, 60_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(
            F.concat(F.lit("c"), (F.col("id") % 5000).cast("string"))).alias("client_hash"),
        F.col("id").alias("hour"), F.sha2(F.col("id").cast("string"), 256).alias("filler"))


def test_lookup_reads_one_part_and_few_row_groups(spark, facts_rows, tmp_path):
    path = str(tmp_path / "i")
    indexed.write_indexed(facts_rows, path, "client_hash", parts=4, row_group_bytes=100_000)
    for client in ("c7", "c4321", "hot"):
        got = indexed.lookup(spark, path, "client_hash", client)
        assert rows_of(got) == rows_of(facts_rows.filter(F.col("client_hash") == client))
    one = indexed.lookup(spark, path, "client_hash", "c7")
    assert "PartitionFilters: [isnotnull(part" in one._jdf.queryExecution().executedPlan().toString()
    part = one.sparkSession.read.parquet(f"{path}/parts=4").filter(
        F.col("part") == F.pmod(F.xxhash64(F.lit("c7")), F.lit(4)))
    assert 0 < _rows_read(one) < part.count() / 2 < 30_000
    # A key that is nowhere: the filters leave nothing to read.
    assert _rows_read(indexed.lookup(spark, path, "client_hash", "c7x")) == 0
    with pytest.raises(ValueError):
        indexed.lookup(spark, path, "client_hash", None)
    with pytest.raises(ValueError):
        indexed.lookup(spark, str(tmp_path / "none"), "client_hash", "c7")


def test_more_digits_give_smaller_parts_and_the_same_facts(spark):
    from querytrail.operators import batches

    events = metrics.prepare_events(spark.createDataFrame(
        [(i, *r[1:2], f"10.0.{i % 40}.1", *r[3:]) for i, r in enumerate(some_events())],
        DNS_QUERY_EVENTS), "test")
    cube = metrics.event_cube(events)
    one, two = (batches.assemble_batches(cube, digits=d).cache() for d in (1, 2))
    assert two.count() > one.count()
    largest = [df.select(F.max(F.expr("aggregate(minutes, 0, (a, m) -> greatest(a, size("
                                      "m.client_stats)))"))).first()[0] for df in (one, two)]
    assert largest[1] <= largest[0]
    for flat in (batches.flatten_clients, batches.flatten_domains, batches.flatten_categories):
        assert rows_of(flat(one).drop("batch_id")) == rows_of(flat(two).drop("batch_id"))


def _stream_in(spark, landing, cube, ckpt):
    raw = spark.readStream.schema(DNS_QUERY_EVENTS).option("maxFilesPerTrigger", 1).parquet(landing)
    (stream.write_cube(metrics.prepare_events(raw, "test"), cube, ckpt)
     .trigger(availableNow=True).start().awaitTermination())


def test_unfinished_epochs_of_the_cube_are_not_shown(spark, tmp_path, monkeypatch):
    landing, cube, ckpt = (str(tmp_path / n) for n in ("in", "cube", "ckpt"))
    rows = some_events()
    spark.createDataFrame(rows[:200], DNS_QUERY_EVENTS).coalesce(1).write.parquet(landing)
    _stream_in(spark, landing, cube, ckpt)
    seen = stream.read_cube(spark, cube).agg(F.sum("total_queries")).first()[0]
    spark.createDataFrame(rows[200:], DNS_QUERY_EVENTS).coalesce(1).write.mode("append").parquet(
        landing)

    def dies(*a):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(stream, "commit", dies)
    with pytest.raises(Exception, match="lost the driver"):
        _stream_in(spark, landing, cube, ckpt)
    monkeypatch.undo()
    total = lambda: stream.read_cube(spark, cube).agg(F.sum("total_queries")).first()[0]
    assert total() == seen == 200
    _stream_in(spark, landing, cube, ckpt)
    assert total() == len(rows)


def test_publishing_does_not_look_at_past_epochs(spark, tmp_path, monkeypatch):
    """File-system calls of a run stay the same however many epochs and runs there were."""
    landing, cube, out, ckpt = (str(tmp_path / n) for n in ("in", "cube", "out", "ckpt"))
    rows, calls = some_events(), []
    real = paths._fs

    def counted(*a):
        calls.append(a)
        return real(*a)

    per_run = []
    for i in range(5):
        spark.createDataFrame(rows[i * 40:i * 40 + 40], DNS_QUERY_EVENTS).repartition(2).write.mode(
            "append").parquet(landing)
        _stream_in(spark, landing, cube, ckpt)
        monkeypatch.setattr(paths, "_fs", counted)
        calls.clear()
        assert stream.publish_batches(spark, cube, out, encoded=False).endswith(f"run={i}")
        per_run.append(len(calls))
        monkeypatch.undo()
    assert per_run[-1] == per_run[-2] == per_run[-3]
    assert list(facts.last_committed(spark, cube).values()) == [9]
