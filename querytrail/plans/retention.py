"""Month rollover: hourly facts become day and month rows, then old detail goes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.operators import rollups
from querytrail.operators.metrics import sum_counters
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY, FACT_KEYS
from querytrail.sources import paths
from querytrail.sources.facts import (ROLLOVER_LOG, drop_epochs, finished_rollovers,
                                      last_committed, read_deltas, read_facts, rolled_epochs,
                                      stored_schema, up_to, write_delta)

HOURLY_TABLES = ["resolver_hourly_stats", "client_hourly_stats", "client_category_hourly",
                 "client_top_domains_hourly"]
ROLLED_TABLES = ["resolver_daily_stats", "resolver_monthly_stats", "client_daily_stats",
                 "client_monthly_stats"]


def first_of_month(as_of: datetime) -> datetime:
    return datetime(as_of.year, as_of.month, 1)


def rollover_tables(resolver_hourly: DataFrame, client_hourly: DataFrame,
                    cutoff: datetime) -> dict[str, DataFrame]:
    """Day and month sums of everything before the cutoff, by the month it belongs to.

    Takes stored deltas or finished hourly rows: sums do not care.
    """
    resolver = rollups.rows_before(resolver_hourly, cutoff)
    client = rollups.rows_before(client_hourly, cutoff)
    return {
        "resolver_daily_stats": resolver.groupBy(rollups.day_of_hour())
        .agg(*sum_counters(COUNTERS_LATENCY)),
        "resolver_monthly_stats": resolver.groupBy(rollups.month_of_hour())
        .agg(*sum_counters(COUNTERS_LATENCY)),
        "client_daily_stats": client.groupBy(rollups.day_of_hour(), "client_hash")
        .agg(*sum_counters(COUNTERS)),
        "client_monthly_stats": client.groupBy(rollups.month_of_hour(), "client_hash")
        .agg(*sum_counters(COUNTERS)),
    }


def _drop_months(spark: SparkSession, root: str, month: str, rolled: dict[str, int]) -> None:
    """Remove the folders of months before ``month``, up to the epochs that were rolled up."""
    for table in HOURLY_TABLES:
        base = f"{root}/{table}"
        for name in paths.subfolders(spark, base):
            if not (name.startswith("month=") and name.split("=")[1] < month):
                continue
            drop_epochs(spark, f"{base}/{name}", rolled)


def _drop_unfinished(spark: SparkSession, root: str, finished: list[int]) -> None:
    """Remove day and month rows of rollovers that stopped before their log entry."""
    for table in ROLLED_TABLES:
        for name in paths.subfolders(spark, f"{root}/{table}"):
            if name.startswith("epoch=") and int(name.split("=")[1]) not in finished:
                paths.delete(spark, f"{root}/{table}/{name}")


def roll_up(spark: SparkSession, root: str, as_of: datetime) -> int:
    """Write and commit the day and month rows of all hours before the month of ``as_of``.

    Only epochs committed when the job starts are read. The log entry, written after the rows,
    is the commit: readers show neither the rollups before it nor the rolled hours after it, so
    a stop at any point shows each hour once. A new run, of whatever month, begins by removing
    what an unfinished one left. Returns the number of the run.
    """
    cutoff = first_of_month(as_of)
    month, run = cutoff.strftime("%Y-%m"), cutoff.year * 100 + cutoff.month
    log = f"{root}/{ROLLOVER_LOG}/run={run}"
    if paths.is_complete(spark, log):
        return run
    # From here on readers trust the log, so a first rollover is not seen half-written.
    paths.make_folder(spark, f"{root}/{ROLLOVER_LOG}")
    _drop_unfinished(spark, root, finished_rollovers(spark, root))
    last = last_committed(spark, root)

    def pinned(table: str) -> DataFrame:
        # Whole months by partition, so that nothing of the current month is read.
        return read_deltas(spark, root, table).filter((F.col("month") < month) & up_to(last))

    # Hours are read once, for the days; months are added up from the days just written.
    tables = rollover_tables(pinned("resolver_hourly_stats"), pinned("client_hourly_stats"),
                             cutoff)
    for kind, counters in (("resolver", COUNTERS_LATENCY), ("client", COUNTERS)):
        table = f"{kind}_daily_stats"
        write_delta(tables[table], root, table, run)
        days = (spark.read.schema(stored_schema(table)).parquet(f"{root}/{table}")
                .filter(F.col("epoch") == run))
        keys = [F.date_format("date_timestamp", "yyyy-MM").alias("year_month"),
                *FACT_KEYS[table][1:]]
        write_delta(days.groupBy(*keys).agg(*sum_counters(counters)), root,
                    f"{kind}_monthly_stats", run)
    (spark.createDataFrame(list(last.items()), "stream string, last_epoch long")
     .coalesce(1).write.mode("overwrite").parquet(log))
    return run


def month_rollover(spark: SparkSession, root: str, as_of: datetime) -> None:
    """Roll up all hours before the month of ``as_of`` and drop them; safe to run again.

    Hours arriving later for an old month are added by the next rollover.
    """
    run = roll_up(spark, root, as_of)
    _drop_months(spark, root, first_of_month(as_of).strftime("%Y-%m"),
                 rolled_epochs(spark, root, run))


def purge_detail(spark: SparkSession, root: str, cutoff: datetime) -> None:
    """Drop whole months of category and domain detail before the month of the cutoff."""
    month = first_of_month(cutoff).strftime("%Y-%m")
    for table in ("client_category_hourly", "client_top_domains_hourly"):
        for name in paths.subfolders(spark, f"{root}/{table}"):
            if name.startswith("month=") and name.split("=")[1] < month:
                paths.delete(spark, f"{root}/{table}/{name}")


def tiered_summary(spark: SparkSession, root: str) -> DataFrame:
    """Totals per month, from the month rows and the hours not rolled up yet."""
    return rollups.tiered_months(read_facts(spark, root, "resolver_monthly_stats"),
                                 read_deltas(spark, root, "resolver_hourly_stats"))
