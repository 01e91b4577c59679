"""Find-or-create merges as one union and one group-by over the natural key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.operators.metrics import last_rank, sum_counters, weighted_latency
from querytrail.schemas import FACT_KEYS

# Not summed: derived again from sums, or carried along with the last row.
_DERIVED = {"avg_latency_ms", "domain_rank", "rank_at", "rank_batch"}


def merge_aggs(columns: list[str], keys: list[str]) -> list[Column]:
    """How each non-key column of a fact table combines over rows of the same key."""
    aggs = sum_counters([c for c in columns if c not in keys and c not in _DERIVED])
    if "avg_latency_ms" in columns:
        aggs.append(weighted_latency())
    if "domain_rank" in columns:
        order = [c for c in ("rank_at", "rank_batch") if c in columns]
        aggs.append(last_rank(order))
        aggs += [F.max(F.struct(*order))[c].alias(c) for c in order]
    return aggs


def merge_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*merge_aggs(rows.columns, keys)).select(*rows.columns)


def upsert_facts(existing: DataFrame, delta: DataFrame, table: str) -> DataFrame:
    """Add ``delta`` to ``existing``: counters add up, mean latency is weighted again.

    Serves the hourly tables and the day and month rollups alike; merging in any split or
    order gives the same table.
    """
    return merge_rows(existing.unionByName(delta), FACT_KEYS[table])
