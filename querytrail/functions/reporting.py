"""Expressions used by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fragments that place a category in a family; the first match wins.
CATEGORY_FAMILIES = [
    ("THREAT", ["MALWARE", "PHISH", "SECURITY", "THREAT"]),
    ("ADS", ["AD", "PROMO"]),
    ("TRACKING", ["TRACK", "ANALYTICS", "TELEMETRY"]),
    ("CRYPTO", ["CRYPTO", "MINING"]),
    ("GAMBLING", ["GAMBLING", "BET"]),
    ("ADULT", ["ADULT", "PORN"]),
    ("SOCIAL", ["SOCIAL"]),
]

# Block rate (percent) above which a client has the level, with its badge.
RISK_LEVELS = [(20.0, "HIGH", "🔴"), (5.0, "MEDIUM", "🟡")]
LOWEST_RISK = ("LOW", "🟢")

# Labels that stand for a missing key.
NULL_LABELS = {"category": "GENERAL", "client_hash": "unknown", "domain": ""}


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity, on the binary value."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def pct(part: Column, total: Column, digits: int = 2) -> Column:
    """``part`` in percent of ``total``, rounded; 0 where there is no total."""
    return (F.when(total > 0, round_half_up(part * F.lit(100.0) / total, digits))
            .otherwise(F.lit(0.0)))


def risk_level(rate: Column) -> Column:
    out = F.lit(LOWEST_RISK[0])
    for bound, level, _ in reversed(RISK_LEVELS):
        out = F.when(rate > bound, level).otherwise(out)
    return out


def risk_badge(rate: Column) -> Column:
    out = F.lit(LOWEST_RISK[1])
    for bound, _, badge in reversed(RISK_LEVELS):
        out = F.when(rate > bound, badge).otherwise(out)
    return out


def category_family(category: Column) -> Column:
    name = F.upper(F.coalesce(category, F.lit("")))
    out = F.lit("OTHER")
    for family, fragments in reversed(CATEGORY_FAMILIES):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | name.contains(fragment)
        out = F.when(hit, family).otherwise(out)
    return out


def time_label(ts: Column, style: str) -> Column:
    """``hour`` 3PM, ``day_hour`` Jan 5 3PM, ``day`` Jan 05."""
    # Label formats.
    formats = {"hour": "ha", "day_hour": "MMM d ha", "day": "MMM dd"}
    return F.date_format(ts, formats[style])


def epoch_to_hour(seconds: Column) -> Column:
    return F.date_trunc("hour", F.timestamp_seconds(seconds))


def label_null_keys(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(NULL_LABELS[name])).alias(name)
