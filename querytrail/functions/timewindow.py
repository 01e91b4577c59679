"""Report periods. Literals are computed on the driver so that they reach the scan."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TimeWindow:
    start: datetime
    end: datetime
    all_time: bool = False


_SPANS = {"1H": timedelta(hours=1), "24H": timedelta(hours=24), "7D": timedelta(days=7),
          "30D": timedelta(days=30)}
_LAST_SECOND = time(23, 59, 59)


def _month(text: str) -> TimeWindow | None:
    if not re.fullmatch(r"\d{4}-\d{2}", text):
        return None
    year, month = int(text[:4]), int(text[5:])
    if not (year and 1 <= month <= 12):
        return None
    last = date(year, month, calendar.monthrange(year, month)[1])
    return TimeWindow(datetime(year, month, 1), datetime.combine(last, _LAST_SECOND))


def _dates(first: str, last: str) -> TimeWindow | None:
    if not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", d) for d in (first, last)):
        return None
    try:
        start, end = date.fromisoformat(first), date.fromisoformat(last)
    except ValueError:
        return None
    return TimeWindow(datetime.combine(start, time()), datetime.combine(end, _LAST_SECOND))


def _ten_years_before(day: datetime) -> datetime:
    try:
        return day.replace(year=day.year - 10)
    except ValueError:  # 29 February
        return day.replace(year=day.year - 10, day=28)


def resolve_time_window(as_of: datetime, range: str | None = "24H", month: str | None = None,
                        start_date: str | None = None, end_date: str | None = None,
                        strict: bool = False) -> TimeWindow:
    """Month beats a date pair, which beats ``range``; what cannot be read falls through.

    Unknown ranges mean 24H. With ``strict`` both raise instead.
    """
    month, start_date, end_date = ((s or "").strip() for s in (month, start_date, end_date))
    if month:
        found = _month(month)
        if found:
            return found
        if strict:
            raise ValueError(f"not a month: {month}")
    if start_date and end_date:
        found = _dates(start_date, end_date)
        if found:
            return found
        if strict:
            raise ValueError(f"not a date pair: {start_date}, {end_date}")
    name = (range or "").upper()
    if name == "ALL":
        return TimeWindow(_ten_years_before(as_of), as_of, True)
    if strict and name not in _SPANS:
        raise ValueError(f"not a range: {range}")
    return TimeWindow(as_of - _SPANS.get(name, _SPANS["24H"]), as_of)


def ts_literal(moment: datetime) -> Column:
    """A timestamp literal read in the session zone, whatever zone Python runs in."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")


def filter_between(facts: DataFrame, window: TimeWindow,
                   column: str = "hour_timestamp") -> DataFrame:
    """Rows inside the window, both ends included, on the stored column (it pushes down).

    Stored facts also have a ``month``, whose bounds leave other months' folders unread.
    """
    if "month" in facts.columns:
        facts = facts.filter(F.col("month").between(window.start.strftime("%Y-%m"),
                                                    window.end.strftime("%Y-%m")))
    return facts.filter(F.col(column).between(ts_literal(window.start), ts_literal(window.end)))
