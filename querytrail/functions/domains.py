"""Domain names as Column expressions, all of them inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without blanks and control characters (up to \\x20) at both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _drop_last_dot(name: Column) -> Column:
    # Several times cheaper than a regular expression.
    return (F.when(F.endswith(name, F.lit(".")),
                   F.substring(name, F.lit(1), F.length(name) - 1)).otherwise(name))


def normalize_domain(domain: Column, trim: bool = False) -> Column:
    """Lower-case and drop one trailing dot; ``trim`` also strips blanks at both ends."""
    cleaned = F.lower(strip(domain) if trim else domain)
    return _drop_last_dot(cleaned)


def strip_url_to_domain(text: Column) -> Column:
    """Lower-case host of a pasted URL: no http(s) scheme, nothing from the first slash on."""
    bare = F.regexp_replace(F.lower(strip(text)), r"^https?://", "")
    return F.regexp_replace(bare, r"(?s)/.*$", "")


def label_count(domain: Column) -> Column:
    return F.size(F.split(domain, r"\."))


def has_empty_label(domain: Column) -> Column:
    return (domain.contains("..") | domain.startswith(".") | domain.endswith(".")
            | (domain == ""))


def suffix_count(domain: Column) -> Column:
    """How many suffixes a lookup visits: it ends at the first empty label."""
    n = label_count(domain)
    first_empty = F.array_position(F.split(domain, r"\."), F.lit("")).cast("int")
    return (F.when(~has_empty_label(domain), n)
            .when(first_empty == n, n - 1).otherwise(first_empty))


def domain_suffixes(domain: Column) -> Column:
    """Array of ``struct(depth, suffix)``: the domain itself (depth 0), then each parent."""
    n = label_count(domain)
    return F.transform(
        F.slice(F.sequence(F.lit(0), n), F.lit(1), suffix_count(domain)),
        lambda depth: F.struct(
            depth.alias("depth"),
            F.call_function("substring_index", domain, F.lit("."), depth - n).alias("suffix")))
