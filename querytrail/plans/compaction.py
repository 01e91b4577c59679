"""Compaction: the many epochs of closed months become one folder per month and table."""

from __future__ import annotations

from datetime import datetime
from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from querytrail.operators.merge import merge_rows
from querytrail.plans.retention import HOURLY_TABLES
from querytrail.schemas import FACT_KEYS
from querytrail.sources.facts import (COMPACTED, COMPACTION_ENTRY, COMPACTION_LOG, LEDGER,
                                      compaction_entry, drop_epochs, finished_compactions,
                                      last_committed, read_deltas, side_by_side, up_to, write_delta)
from querytrail.sources.paths import delete, subfolders


def _scattered(spark: SparkSession, base: str, before: str, last: dict[str, int]) -> set[str]:
    """Months or days before ``before`` with more than one committed epoch."""
    out = set()
    for name in subfolders(spark, base):
        if "=" not in name or name.split("=")[1] >= before:
            continue
        epochs = [e for s, n in last.items()
                  for e in subfolders(spark, f"{base}/{name}/stream={s}")
                  if int(e.split("=")[1]) <= n]
        if len(epochs) > 1:
            out.add(name.split("=")[1])
    return out


def finish_compaction(spark: SparkSession, root: str) -> None:
    """Remove what finished compactions have taken, and what an unfinished one left."""
    runs = finished_compactions(spark, root)
    for run in runs:
        taken, months, days = compaction_entry(spark, root, run)
        for table in HOURLY_TABLES:
            for month in months:
                drop_epochs(spark, f"{root}/{table}/month={month}", taken)
        for day in days:
            drop_epochs(spark, f"{root}/{LEDGER}/batch_day={day}", taken)
    newest = runs[-1] if runs else -1
    for table in [*HOURLY_TABLES, LEDGER]:
        for name in subfolders(spark, f"{root}/{table}"):
            base = f"{root}/{table}/{name}/stream={COMPACTED}"
            for epoch in subfolders(spark, base):
                if int(epoch.split("=")[1]) > newest:
                    delete(spark, f"{base}/{epoch}")
    for run in runs[:-1]:
        delete(spark, f"{root}/{COMPACTION_LOG}/run={run}")


def compact_months(spark: SparkSession, root: str, before: datetime,
                   remove: bool = True) -> int | None:
    """Put the epochs of each hourly table and of the ledger together, for whole months before
    the month of ``before``; months and days of one epoch are left alone.

    The log entry, written last, is the commit: readers show either the epochs or what was made
    of them, so a stop at any point counts nothing twice and loses nothing, and the next run
    tidies up. Streams may go on merging; later epochs of an old month stay beside the compacted
    one. One rollover or compaction at a time. With ``remove=False`` the old files stay until
    the next run, for queries that are still reading them. Returns the number of the run, or
    None where nothing was to be done.
    """
    finish_compaction(spark, root)
    last, month = last_committed(spark, root), before.strftime("%Y-%m")
    months = sorted(set().union(*(_scattered(spark, f"{root}/{t}", month, last)
                                  for t in HOURLY_TABLES)))
    days = sorted(_scattered(spark, f"{root}/{LEDGER}", f"{month}-01", last))
    if not months and not days:
        return None
    run = last.get(COMPACTED, -1) + 1
    if months:
        writes = []
        for table in HOURLY_TABLES:
            rows = read_deltas(spark, root, table).filter(F.col("month").isin(months) & up_to(last))
            merged = merge_rows(rows.drop("stream", "epoch"), [*FACT_KEYS[table], "month"])
            writes.append(partial(write_delta, merged, root, table, run, COMPACTED))
        side_by_side(spark, writes)
    if days:
        (spark.read.schema("batch_id string, batch_day date, stream string, epoch long")
         .parquet(f"{root}/{LEDGER}")
         .filter(F.col("batch_day").isin([datetime.strptime(d, "%Y-%m-%d").date() for d in days])
                 & up_to(last))
         .select("batch_id", "batch_day").distinct()
         .withColumn("stream", F.lit(COMPACTED)).withColumn("epoch", F.lit(run).cast("long"))
         .hint("rebalance", "batch_day")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_day", "stream", "epoch").parquet(f"{root}/{LEDGER}"))
    (spark.createDataFrame([(s, n, months, days) for s, n in last.items()], COMPACTION_ENTRY)
     .coalesce(1).write.mode("overwrite").parquet(f"{root}/{COMPACTION_LOG}/run={run}"))
    if remove:
        finish_compaction(spark, root)
    return run
