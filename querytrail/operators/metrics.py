"""From query events to per-minute metrics and hourly facts.

Every aggregate here is a sum or a conditional count, so Spark combines on the map side and
a key holding a large share of the rows reaches its reducer as one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.functions.domains import normalize_domain
from querytrail.functions.events import (client_hash, is_blocked_action, is_nxdomain,
                                         is_present, is_servfail)
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY

TOP_K = 10


def prepare_events(events: DataFrame, secret: str, normalize: bool = True) -> DataFrame:
    """Replace the address by its pseudonym, clean the domain, mark blocked queries."""
    domain = normalize_domain(F.col("domain")) if normalize else F.col("domain")
    return (events
            .withColumn("client_hash", client_hash(F.col("client_ip"), secret))
            .withColumn("domain", domain)
            .withColumn("is_blocked", is_blocked_action(F.col("action")))
            .drop("client_ip"))


def event_counters() -> list[Column]:
    """The seven counters and the latency sum over prepared events."""
    blocked, hit = F.col("is_blocked"), F.coalesce(F.col("cache_hit"), F.lit(False))
    return [
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(~blocked).alias("allowed_queries"),
        F.count_if(blocked).alias("blocked_queries"),
        F.count_if(is_nxdomain(F.col("rcode"))).alias("nxdomain_queries"),
        F.count_if(is_servfail(F.col("rcode"))).alias("servfail_queries"),
        F.count_if(hit).alias("cache_hits"),
        F.count_if(~hit).alias("cache_misses"),
        F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("total_latency_ms"),
    ]


def sum_counters(names: list[str] = COUNTERS) -> list[Column]:
    return [F.sum(n).alias(n) for n in names]


def weighted_latency() -> Column:
    """Mean latency per query from summed latency; 0 when there were no queries."""
    total = F.sum("total_queries")
    return (F.when(total > 0, F.sum("total_latency_ms") / total).otherwise(F.lit(0.0))
            .alias("avg_latency_ms"))


def _windowed(events: DataFrame, grain: str, keys: list[str], aggs: list[Column],
              split_by: list[str]) -> DataFrame:
    return (events.groupBy(F.window("ts", grain).alias("w"), *split_by, *keys).agg(*aggs)
            .withColumn("minute_timestamp", F.col("w.start")).drop("w"))


def _minute_first(df: DataFrame) -> DataFrame:
    return df.select("minute_timestamp", *[c for c in df.columns if c != "minute_timestamp"])


def agg_resolver_minute(events: DataFrame, grain: str = "1 minute",
                        split_by: list[str] | None = None) -> DataFrame:
    """Counters per minute over the whole cluster (``split_by=["resolver_id"]`` per node)."""
    return _minute_first(_windowed(events, grain, [], event_counters(), split_by or []))


def agg_client_minute(events: DataFrame, grain: str = "1 minute",
                      split_by: list[str] | None = None) -> DataFrame:
    return _minute_first(
        _windowed(events, grain, ["client_hash"], event_counters(), split_by or []))


def _breakdown(events: DataFrame, key: str, grain: str, split_by: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("total_queries"),
            F.count_if(F.col("is_blocked")).alias("blocked_queries")]
    kept = events.filter(is_present(F.col(key)))
    return _minute_first(_windowed(kept, grain, ["client_hash", key], aggs, split_by))


def agg_client_category_minute(events: DataFrame, grain: str = "1 minute",
                               split_by: list[str] | None = None) -> DataFrame:
    return _breakdown(events, "category", grain, split_by or [])


def agg_client_domain_minute(events: DataFrame, grain: str = "1 minute",
                             split_by: list[str] | None = None) -> DataFrame:
    return _breakdown(events, "domain", grain, split_by or [])


def top_domains(domain_minutes: DataFrame, k: int = TOP_K,
                split_by: list[str] | None = None) -> DataFrame:
    """The ``k`` most queried domains per client and minute, ranked from 1.

    The rank filter is pushed below the shuffle as a group limit, so a busy client sends at
    most ``k`` rows per map task.
    """
    per_client = (Window.partitionBy(*(split_by or []), "minute_timestamp", "client_hash")
                  .orderBy(F.desc("total_queries"), F.asc("domain")))
    return (domain_minutes.withColumn("domain_rank", F.row_number().over(per_client))
            .filter(F.col("domain_rank") <= k))


def event_cube(events: DataFrame, grain: str = "1 minute") -> DataFrame:
    """Counters at the finest grain the facts need: one pass over the events.

    All resolver, client, category and domain figures are sums over this table.
    """
    return _minute_first(_windowed(
        events, grain, ["client_hash", "category", "domain"], event_counters(),
        ["resolver_id"]))


def cube_domain_minute(cube: DataFrame) -> DataFrame:
    return (cube.filter(is_present(F.col("domain")))
            .groupBy("resolver_id", "minute_timestamp", "client_hash", "domain")
            .agg(*sum_counters(["total_queries", "blocked_queries"])))


def _hour() -> Column:
    return F.date_trunc("hour", F.col("minute_timestamp")).alias("hour_timestamp")


def hourly_resolver(minutes: DataFrame) -> DataFrame:
    """Hour sums over all resolvers; latency is the mean per query."""
    return (minutes.groupBy(_hour())
            .agg(*sum_counters(COUNTERS_LATENCY), weighted_latency()))


def hourly_client(minutes: DataFrame) -> DataFrame:
    return minutes.groupBy(_hour(), "client_hash").agg(*sum_counters())


def hourly_client_category(minutes: DataFrame) -> DataFrame:
    return (minutes.groupBy(_hour(), "client_hash", "category")
            .agg(*sum_counters(["total_queries", "blocked_queries"])))


def last_rank(order: list[str]) -> Column:
    """The rank seen last in the given order. A single column keeps the hash aggregate."""
    by = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    return F.max_by("domain_rank", by).alias("domain_rank")


def hourly_client_domain(top_minutes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Sums over the per-minute top lists only, hence lower bounds; last rank seen wins."""
    return (top_minutes.groupBy(_hour(), "client_hash", "domain")
            .agg(*sum_counters(["total_queries", "blocked_queries"]),
                 last_rank(order or ["minute_timestamp"])))


def hourly_client_domain_exact(events: DataFrame) -> DataFrame:
    """As above from the events themselves, nothing cut and so without a rank."""
    return (events.filter(is_present(F.col("domain")))
            .groupBy(F.date_trunc("hour", F.col("ts")).alias("hour_timestamp"),
                     "client_hash", "domain")
            .agg(F.count(F.lit(1)).alias("total_queries"),
                 F.count_if(F.col("is_blocked")).alias("blocked_queries")))


def zero_fill_minutes(resolver_minutes: DataFrame) -> DataFrame:
    """A row for every minute between the first and the last, zero where none came."""
    bounds = resolver_minutes.agg(F.min("minute_timestamp").alias("lo"),
                                  F.max("minute_timestamp").alias("hi"))
    # Two steps, so that neither array nor task holds years of minutes.
    days = bounds.select("lo", "hi", F.explode(F.expr(
        "sequence(date_trunc('day', lo), hi, interval 1 day)")).alias("day"))
    minutes = (days.filter(F.col("day").isNotNull()).repartition("day")
               .select(F.explode(F.expr(
                   "sequence(greatest(lo, day),"
                   " least(hi, day + interval 1439 minutes), interval 1 minute)"))
                   .alias("minute_timestamp")))
    counters = [c for c in resolver_minutes.columns if c != "minute_timestamp"]
    return (minutes.join(resolver_minutes, "minute_timestamp", "left")
            .select("minute_timestamp",
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counters]))
