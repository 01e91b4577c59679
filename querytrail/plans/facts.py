"""Batch build of the hourly tables straight from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytrail.functions.events import is_present
from querytrail.operators import metrics


def write_event_cube(events: DataFrame, path: str) -> DataFrame:
    """Aggregate events (prepared) once, keep the result as a table, and return it.

    The four hourly tables are then built from the much smaller table, and a lost executor
    costs no second pass over the events.
    """
    metrics.event_cube(events).write.mode("overwrite").parquet(path)
    return events.sparkSession.read.parquet(path)


def hourly_facts(cube: DataFrame, k: int = metrics.TOP_K) -> dict[str, DataFrame]:
    """The hourly tables from an event cube, equal to merging its batches."""
    pair = ["total_queries", "blocked_queries"]
    tops = metrics.top_domains(metrics.cube_domain_minute(cube), k, ["resolver_id"])
    categories = cube.filter(is_present(F.col("category")))
    return {
        "resolver_hourly_stats": metrics.hourly_resolver(cube),
        "client_hourly_stats": metrics.hourly_client(cube),
        "client_category_hourly": metrics.hourly_client_category(
            categories.select("minute_timestamp", "client_hash", "category", *pair)),
        "client_top_domains_hourly": metrics.hourly_client_domain(
            tops, ["minute_timestamp", "resolver_id"]),
    }
