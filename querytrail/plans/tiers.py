"""Totals of any range of hours from the coarsest stored rows that cover it.

A range is cut into whole months, whole days and single hours. Months and days that a rollover
has taken come from its rows; hours are read at the two ends only, and for months that are not
rolled up yet. Each piece is a filter on stored rows, so folders of hours inside a covered month
are not opened.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.functions.timewindow import TimeWindow, ts_literal
from querytrail.operators.metrics import weighted_latency
from querytrail.schemas import COUNTERS_LATENCY
from querytrail.sources.facts import (compacted_rows, finished_rollovers, read_deltas,
                                      rolled_epochs, stored_schema, up_to)
from querytrail.sources.paths import subfolders

_TABLE = "resolver_hourly_stats"
HOUR, DAY = timedelta(hours=1), timedelta(days=1)
Span = tuple[datetime, datetime]


@dataclass(frozen=True)
class Cover:
    """Pieces of a range, none overlapping: first and end (not included) of months, days, hours."""

    months: Span | None = None
    days: tuple[Span, ...] = ()
    hours: tuple[Span, ...] = ()


def _month(at: datetime) -> datetime:
    return datetime(at.year, at.month, 1)


def _day(at: datetime) -> datetime:
    return datetime(at.year, at.month, at.day)


def _up(at: datetime, floor, step) -> datetime:
    return at if floor(at) == at else step(floor(at))


def _next_month(at: datetime) -> datetime:
    return _month(_month(at) + 31 * DAY)


def cover(first: datetime, end: datetime) -> Cover:
    """The fewest months, days and hours that make up ``first <= hour < end`` (whole hours)."""
    if first >= end:
        return Cover()
    d0, d1 = _up(first, _day, lambda d: d + DAY), _day(end)
    if d0 > d1:
        return Cover(hours=((first, end),))
    if d0 == d1:
        return Cover(hours=tuple(s for s in ((first, d0), (d1, end)) if s[0] < s[1]))
    hours = tuple(s for s in ((first, d0), (d1, end)) if s[0] < s[1])
    m0, m1 = _up(d0, _month, _next_month), _month(d1)
    if m0 >= m1:
        return Cover(days=((d0, d1),), hours=hours)
    return Cover((m0, m1), tuple(s for s in ((d0, m0), (m1, d1)) if s[0] < s[1]), hours)


def whole_hours(window: TimeWindow) -> Span:
    """First hour and end of the hours ``start <= hour <= end`` of a report period."""
    first, last = window.start, window.end
    floor = first.replace(minute=0, second=0, microsecond=0)
    return (floor if floor == first else floor + HOUR,
            last.replace(minute=0, second=0, microsecond=0) + HOUR)


def _between(column: str, spans: tuple[Span, ...]) -> Column:
    """Hours of the spans; ``month`` narrows the folders first."""
    def one(a: datetime, b: datetime) -> Column:
        last = (b - HOUR).strftime("%Y-%m")
        return (F.col("month").between(a.strftime("%Y-%m"), last)
                & (F.col(column) >= ts_literal(a)) & (F.col(column) < ts_literal(b)))
    return reduce(Column.__or__, [one(a, b) for a, b in spans], F.lit(False))


def _tier(spark: SparkSession, root: str, table: str, key: str, spans: tuple[Span, ...],
          text: str) -> DataFrame:
    """Day or month rows of finished rollovers inside the spans."""
    at = F.col(key)
    inside = [(at >= F.lit(a.strftime(text))) & (at < F.lit(b.strftime(text))) for a, b in spans]
    return read_deltas(spark, root, table).filter(reduce(Column.__or__, inside, F.lit(False)))


def _rolled_hours(spark: SparkSession, root: str, spans: tuple[Span, ...], run: int) -> DataFrame:
    """Hours at the ends of a range that a rollover has taken and nobody has removed yet."""
    base = f"{root}/{_TABLE}"
    there = set(subfolders(spark, base))
    taken = rolled_epochs(spark, root, run)
    for a, b in spans:
        month = a.strftime("%Y-%m")
        streams = (subfolders(spark, f"{base}/month={month}") if f"month={month}" in there else [])
        if any(s.removeprefix("stream=") in taken for s in streams):
            continue
        day = read_deltas(spark, root, "resolver_daily_stats").filter(
            F.col("date_timestamp") == F.lit(a.strftime("%Y-%m-%d")))
        if not day.isEmpty():  # a day without queries has no hours to miss
            raise ValueError(f"the hours of {month} are gone: ask for whole days")
    return (spark.read.schema(stored_schema(_TABLE)).parquet(base)
            .filter(_between("hour_timestamp", spans) & up_to(taken)
                    & ~compacted_rows(spark, root)))


def range_rows(spark: SparkSession, root: str, window: TimeWindow) -> DataFrame:
    """Stored rows of whatever tier that together hold each hour of the period once."""
    first, end = whole_hours(window)
    columns = COUNTERS_LATENCY
    runs = finished_rollovers(spark, root)
    # Rows that no rollover has taken: months not rolled up yet, and hours that came late.
    parts = [read_deltas(spark, root, _TABLE)
             .filter(_between("hour_timestamp", ((first, end),) if first < end else ()))]
    if runs:
        limit = datetime(runs[-1] // 100, runs[-1] % 100, 1)
        pieces = cover(first, min(end, limit))
        if pieces.months:
            parts.append(_tier(spark, root, "resolver_monthly_stats", "year_month",
                               (pieces.months,), "%Y-%m"))
        if pieces.days:
            rows = _tier(spark, root, "resolver_daily_stats", "date_timestamp", pieces.days,
                         "%Y-%m-%d")
            parts.append(rows)
        if pieces.hours:
            parts.append(_rolled_hours(spark, root, pieces.hours, runs[-1]))
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def tiered_range(spark: SparkSession, root: str, window: TimeWindow) -> DataFrame:
    """One row of totals for any period of whole hours.

    A period that cuts a day whose hours were removed is refused: only whole days are left.
    """
    zero = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS_LATENCY]
    return range_rows(spark, root, window).agg(
        *zero, F.coalesce(weighted_latency(), F.lit(0.0)).alias("avg_latency_ms"))


