"""Tables of one epoch are written side by side, large months in several parts."""

from __future__ import annotations

from datetime import datetime
from functools import partial
from threading import Barrier, BrokenBarrierError

import pytest
from pyspark.sql import functions as F

from querytrail.schemas import DNS_BATCH
from querytrail.sources import facts
from querytrail.streaming import sink

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_hourly_tables_are_written_at_a_time(spark, tmp_path, monkeypatch):
    together, written = Barrier(4, timeout=60), []

    def waits(rows, root, table, *which):
        together.wait()
        written.append(table)

    monkeypatch.setattr(sink, "write_delta", waits)
    held = spark.conf.get(ADVISORY)
    sink._merge_hourly(spark.createDataFrame([], DNS_BATCH), 0, str(tmp_path), "main")
    assert len(set(written)) == 4
    assert spark.conf.get(ADVISORY) == held


def test_a_write_that_fails_shows(spark):
    def fails():
        raise BrokenBarrierError("stopped here")

    held = spark.conf.get(ADVISORY)
    with pytest.raises(BrokenBarrierError):
        facts.side_by_side(spark, [fails, lambda: None])
    assert spark.conf.get(ADVISORY) == held


def test_a_large_month_is_written_by_several_tasks(spark, tmp_path):
    root, table = str(tmp_path), "client_category_hourly"
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp")
    rows = spark.range(0, 500_000, 1, 8).select(
        at.alias("hour_timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("client_hash"),
        F.lit("ADS").alias("category"), F.col("id").alias("total_queries"),
        F.lit(0).cast("long").alias("blocked_queries"))
    facts.side_by_side(spark, [partial(facts.write_delta, rows, root, table, 0)])
    assert len(list(tmp_path.rglob("month=2024-01/**/*.parquet"))) > 1
    got = facts.read_facts(spark, root, table)
    assert got.agg(F.count("*"), F.sum("total_queries")).first() == (500_000, 499_999 * 250_000)
