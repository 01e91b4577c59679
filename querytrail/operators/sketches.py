"""Mergeable summaries of hours: distinct counts, latency percentiles, heavy domains.

A summary of a longer period is merged from those of its hours, so no event and no client row is
looked at again. Every figure comes with bounds. Exact counts stay the default elsewhere.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 2 ** LG_K registers per distinct-count sketch; accuracy of the percentile sketch.
LG_K, KLL_K = 12, 400
#: Twice the relative standard error of a merged distinct count: 95 % of counts lie within.
SPREAD = 2 * 1.04 / sqrt(1 << LG_K)
#: Error of a rank at 99 %, as published for this kind of sketch.
RANK_ERROR = 2.296 / KLL_K ** 0.9723


def client_sketches(client_hourly: DataFrame) -> DataFrame:
    """Per hour the set of clients."""
    return (client_hourly.groupBy("hour_timestamp")
            .agg(F.hll_sketch_agg("client_hash", LG_K).alias("members")))


def domain_sketches(domain_hourly: DataFrame) -> DataFrame:
    """Per hour and client the set of domains."""
    return (domain_hourly.groupBy("hour_timestamp", "client_hash")
            .agg(F.hll_sketch_agg("domain", LG_K).alias("members")))


def latency_sketches(events: DataFrame) -> DataFrame:
    """Per hour and resolver the distribution of latency; queries without one do not count."""
    return (events.filter(F.col("latency_ms").isNotNull())
            .groupBy(F.date_trunc("hour", F.col("ts")).alias("hour_timestamp"), "resolver_id")
            .agg(F.count(F.lit(1)).alias("measured"),
                 F.kll_sketch_agg_bigint("latency_ms", KLL_K).alias("latencies")))


def merge_sets(sketches: DataFrame, *by: str | Column) -> DataFrame:
    return sketches.groupBy(*by).agg(F.hll_union_agg("members").alias("members"))


def merge_latencies(sketches: DataFrame, *by: str | Column) -> DataFrame:
    return sketches.groupBy(*by).agg(
        F.sum("measured").alias("measured"),
        F.kll_merge_agg_bigint("latencies", KLL_K).alias("latencies"))


def with_distinct(sketches: DataFrame) -> DataFrame:
    """The estimated number of members with bounds that hold for 95 % of sketches."""
    n = F.hll_sketch_estimate("members")
    return (sketches.withColumn("estimate", n)
            .withColumn("lower_bound", F.floor(F.col("estimate") / (1 + SPREAD)))
            .withColumn("upper_bound", F.ceil(F.col("estimate") / (1 - SPREAD)))
            .drop("members"))


def with_percentile(sketches: DataFrame, rank: float = 0.95) -> DataFrame:
    """The latency at ``rank``, and at the ranks that are the error below and above it."""
    def at(r: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("latencies", F.lit(min(max(r, 0.0), 1.0)))

    return (sketches.withColumn("latency_ms", at(rank))
            .withColumn("lower_bound", at(rank - RANK_ERROR))
            .withColumn("upper_bound", at(rank + RANK_ERROR)).drop("latencies"))


def listed_domains(domain_minutes: DataFrame, k: int) -> DataFrame:
    """The ``k`` most queried domains per client and minute with ``domain_rank``, and ``cut``: the
    most that a domain left out can have had."""
    by = ["minute_timestamp", "client_hash"]
    ranked = domain_minutes.withColumn("domain_rank", F.row_number().over(
        Window.partitionBy(*by).orderBy(F.desc("total_queries"), F.asc("domain"))))
    first = F.when(F.col("domain_rank") == k + 1, F.col("total_queries"))
    return (ranked.filter(F.col("domain_rank") <= k + 1)
            .withColumn("cut", F.coalesce(F.max(first).over(Window.partitionBy(*by)), F.lit(0)))
            .filter(F.col("domain_rank") <= k))


def domain_bounds(listed: DataFrame, period: Column) -> DataFrame:
    """Per period, client and listed domain the least and the most it can have been queried.

    A domain had what its minutes list, and in each other minute at most that minute's cut. The
    parts are sums, so periods merge into longer ones.
    """
    at = listed.withColumn("period", period)
    keys = ["period", "client_hash"]
    cuts = at.filter(F.col("domain_rank") == 1).groupBy(*keys).agg(F.sum("cut").alias("all_cut"))
    own = at.groupBy(*keys, "domain").agg(F.sum("total_queries").alias("at_least"),
                                          F.sum("cut").alias("own_cut"))
    return (own.join(cuts, keys)
            .withColumn("at_most", F.col("at_least") + F.col("all_cut") - F.col("own_cut"))
            .drop("all_cut", "own_cut"))


# --- stored hours --------------------------------------------------------------------------

def write_hours(sketches: DataFrame, path: str, epoch: int) -> None:
    """Store the sketches of some hours as one epoch, replacing what it had written before.

    An hour may come in several epochs: reading merges them. The same rows must not come in two.
    """
    (sketches.withColumns({"month": F.date_format("hour_timestamp", "yyyy-MM"),
                           "epoch": F.lit(epoch).cast("long")})
     .hint("rebalance", "month").sortWithinPartitions("month", "hour_timestamp")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month", "epoch").parquet(path))


def read_hours(spark, path: str, first_month: str | None = None, last_month: str | None = None
               ) -> DataFrame:
    """Stored sketches, several per hour where several epochs touched it; other months than
    those asked for are not opened."""
    rows = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
    if first_month:
        rows = rows.filter(F.col("month") >= first_month)
    if last_month:
        rows = rows.filter(F.col("month") <= last_month)
    return rows.drop("epoch")
