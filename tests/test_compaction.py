"""Compaction and month pruning: same tables, fewer folders, only the months that are asked for."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_pipeline import HOURLY, cube, events, nested, rows_of, tables_of  # noqa: F401

from querytrail.functions.timewindow import TimeWindow, filter_between
from querytrail.operators import rollups
from querytrail.plans import compaction, reports, retention
from querytrail.sources.facts import LEDGER, read_facts
from querytrail.sources.paths import subfolders
from querytrail.streaming import sink

MAY = datetime(2024, 5, 1)


@pytest.fixture
def root(spark, nested, tmp_path):  # noqa: F811
    path = str(tmp_path / "r")
    for epoch in range(3):
        sink.apply_batches(nested.filter(F.crc32("batch_id") % 3 == epoch), epoch, path)
    return path


def leaves(spark, base):
    return [f"{s}/{e}" for s in subfolders(spark, base)
            for e in subfolders(spark, f"{base}/{s}")]


def test_one_folder_per_month_and_nothing_changes(spark, root, nested):  # noqa: F811
    before = tables_of(spark, root)
    assert compaction.compact_months(spark, root, MAY) == 0
    assert tables_of(spark, root) == before
    for table in HOURLY:
        for month in subfolders(spark, f"{root}/{table}"):
            assert leaves(spark, f"{root}/{table}/{month}") == ["stream=compacted/epoch=0"]
    for day in subfolders(spark, f"{root}/{LEDGER}"):
        assert len(leaves(spark, f"{root}/{LEDGER}/{day}")) == 1
    # Repeats are still known, late batches are added, and a second run takes both.
    sink.apply_batches(nested, 3, root)
    assert tables_of(spark, root) == before
    sink.apply_batches(nested.withColumn("batch_id", F.concat("batch_id", F.lit("-late"))), 4, root)
    after = tables_of(spark, root)
    assert after != before
    assert compaction.compact_months(spark, root, MAY) == 1
    assert tables_of(spark, root) == after
    assert compaction.compact_months(spark, root, MAY) is None
    assert tables_of(spark, root) == after


def test_open_months_are_left_alone(spark, root):
    before = tables_of(spark, root)
    compaction.compact_months(spark, root, datetime(2024, 4, 20), remove=False)
    assert tables_of(spark, root) == before
    base = f"{root}/client_hourly_stats"
    assert "stream=compacted/epoch=0" in leaves(spark, f"{base}/month=2024-03")
    assert not any("compacted" in x for x in leaves(spark, f"{base}/month=2024-04"))


@pytest.mark.parametrize("stop_at", range(1, 6))
def test_compaction_survives_a_stop(spark, root, monkeypatch, stop_at):
    before = tables_of(spark, root)
    calls, real = [], compaction.write_delta

    def dies(*arguments):
        real(*arguments)
        calls.append(1)
        if len(calls) == stop_at:
            raise RuntimeError("lost the driver")

    monkeypatch.setattr(compaction, "write_delta", dies)
    if stop_at == 5:  # committed, nothing removed
        compaction.compact_months(spark, root, MAY, remove=False)
    else:
        with pytest.raises(RuntimeError):
            compaction.compact_months(spark, root, MAY)
    monkeypatch.undo()
    assert tables_of(spark, root) == before
    # The next run takes another set of months.
    compaction.compact_months(spark, root, datetime(2024, 4, 20))
    assert tables_of(spark, root) == before
    compaction.compact_months(spark, root, MAY)
    assert tables_of(spark, root) == before


def test_rollover_after_compaction(spark, root):
    before = rows_of(retention.tiered_summary(spark, root))
    compaction.compact_months(spark, root, datetime(2024, 4, 20))
    retention.roll_up(spark, root, datetime(2024, 4, 20))
    compaction.compact_months(spark, root, MAY)
    assert rows_of(retention.tiered_summary(spark, root)) == before
    retention.month_rollover(spark, root, MAY)
    assert rows_of(retention.tiered_summary(spark, root)) == before
    assert read_facts(spark, root, "client_hourly_stats").isEmpty()


def test_time_filters_prune_months(spark, root):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")  # whole filters in the plan

    def months_read(df, which=all):
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x.split("PartitionFilters")[1].split("PushedFilters")[0]
                 for x in plan.splitlines() if "PartitionFilters" in x]
        assert scans
        # Bounds on the month beside what the logs say.
        return which("(month#" in x and "<= 2024-0" in x for x in scans)

    window = TimeWindow(datetime(2024, 3, 31), datetime(2024, 3, 31, 23, 59))
    hours, clients = (read_facts(spark, root, t)
                      for t in ("resolver_hourly_stats", "client_hourly_stats"))
    assert months_read(filter_between(clients, window))
    assert months_read(rollups.rows_before(clients, datetime(2024, 4, 1)))
    assert months_read(reports.traffic(hours, window, "24H"))
    assert months_read(reports.traffic(hours, window, "30D"))
    # Active clients are counted over all time, so one of its scans reads all months.
    assert months_read(reports.summary(hours, clients, window), any)
