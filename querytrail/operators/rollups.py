"""Day and month tiers, materialized summaries, retention filters and plain totals."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.functions.timewindow import TimeWindow, filter_between, ts_literal
from querytrail.operators.metrics import sum_counters, weighted_latency
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY


def day_of_hour() -> Column:
    return F.to_date("hour_timestamp").alias("date_timestamp")


def month_of_hour() -> Column:
    return F.date_format("hour_timestamp", "yyyy-MM").alias("year_month")


def _resolver_tier(hourly: DataFrame, key: Column) -> DataFrame:
    return hourly.groupBy(key).agg(*sum_counters(COUNTERS_LATENCY), weighted_latency())


def daily_resolver(hourly: DataFrame) -> DataFrame:
    return _resolver_tier(hourly, day_of_hour())


def monthly_resolver(hourly: DataFrame) -> DataFrame:
    return _resolver_tier(hourly, month_of_hour())


def daily_client(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(day_of_hour(), "client_hash").agg(*sum_counters(COUNTERS))


def monthly_client(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(month_of_hour(), "client_hash").agg(*sum_counters(COUNTERS))


def mv_resolver_daily(hourly: DataFrame) -> DataFrame:
    """Per day: hours present, sums, plain mean of the hourly means, and the weighted one."""
    return (hourly.groupBy(F.date_trunc("day", F.col("hour_timestamp")).alias("stat_date"))
            .agg(F.count(F.lit(1)).alias("hourly_windows_count"),
                 *sum_counters(["total_queries", "blocked_queries", "cache_hits"]),
                 F.avg("avg_latency_ms").alias("avg_latency_ms"),
                 weighted_latency().alias("weighted_avg_latency_ms")))


def mv_top_categories(category_hourly: DataFrame) -> DataFrame:
    return (category_hourly.groupBy("category")
            .agg(*sum_counters(["total_queries", "blocked_queries"])))


def traffic_totals(hourly: DataFrame, window: TimeWindow | None = None) -> DataFrame:
    """One row with the sums and the plain mean of hourly latency, of all time or a period."""
    rows = hourly if window is None or window.all_time else filter_between(hourly, window)
    return rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c)
          for c in ("total_queries", "blocked_queries", "cache_hits")],
        F.coalesce(F.avg("avg_latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(weighted_latency(), F.lit(0.0)).alias("weighted_avg_latency_ms"))


def distinct_clients(client_hourly: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return client_hourly.agg(count("client_hash").alias("active_clients"))


def distinct_domains_per_client(domain_hourly: DataFrame) -> DataFrame:
    return (domain_hourly.groupBy("client_hash")
            .agg(F.count_distinct("domain").alias("distinct_domains")))


def rows_before(hourly: DataFrame, cutoff: datetime) -> DataFrame:
    if "month" in hourly.columns:  # stored facts: later months' folders stay unread
        hourly = hourly.filter(F.col("month") <= cutoff.strftime("%Y-%m"))
    return hourly.filter(F.col("hour_timestamp") < ts_literal(cutoff))


def purge_before(hourly: DataFrame, cutoff: datetime) -> DataFrame:
    """What a purge keeps."""
    return hourly.filter(F.col("hour_timestamp") >= ts_literal(cutoff))


def rows_of_client(facts: DataFrame, client: str) -> DataFrame:
    return facts.filter(F.col("client_hash") == client)


def tiered_months(monthly: DataFrame, hourly: DataFrame) -> DataFrame:
    """Month figures from the rolled-up rows plus the hours not rolled up yet."""
    columns = ["year_month", *COUNTERS_LATENCY]
    current = hourly.groupBy(month_of_hour()).agg(*sum_counters(COUNTERS_LATENCY))
    return (monthly.select(*columns).unionByName(current)
            .groupBy("year_month").agg(*sum_counters(COUNTERS_LATENCY), weighted_latency()))
