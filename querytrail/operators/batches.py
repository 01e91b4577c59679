"""Nested batch messages: ten minutes of metrics of one resolver in one row, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.functions.events import is_present
from querytrail.operators.metrics import TOP_K, cube_domain_minute, sum_counters, top_domains
from querytrail.schemas import COUNTERS_LATENCY

BATCH_SECONDS = 600
_CLIENT = ["resolver_id", "minute_timestamp", "client_hash"]


def batch_start(minute: Column) -> Column:
    """Epoch second at which the ten minutes of ``minute`` begin."""
    seconds = F.unix_timestamp(minute)
    return seconds - seconds % F.lit(BATCH_SECONDS)


def client_part(client_hash: Column, digits: int = 1) -> Column:
    """The part of a batch that a client belongs to: the first digits of its hash.

    Sixteen parts per digit (one more for unknown clients) at every size, so that the same ten
    minutes always have the same batch ids."""
    return F.substring(client_hash, 1, digits)


def assemble_batches(cube: DataFrame, k: int = TOP_K, digits: int = 1) -> DataFrame:
    """Nest an event cube into one row per resolver, ten minutes and client part.

    Every batch is split by client, so that a busy resolver is not one huge row. A part carries
    the resolver counters of its own clients: merging all parts gives the same facts as merging
    the whole batch. A deployment with more clients per resolver takes more ``digits``, sixteen
    times the parts each: once and for all, since batch ids name the part.

    The cube is read three times: pass a stored one, not a query over raw events.
    """
    # Every branch shrinks before it is shuffled by client and minute (partial sums, group
    # limit), so a client with very many domains in one minute is no large group anywhere.
    clients = cube.groupBy(*_CLIENT).agg(*sum_counters(COUNTERS_LATENCY))
    categories = (cube.filter(is_present(F.col("category")))
                  .groupBy(*_CLIENT, "category")
                  .agg(*sum_counters(["total_queries", "blocked_queries"]))
                  .groupBy(*_CLIENT)
                  .agg(F.sort_array(F.collect_list(F.struct(
                      "category", F.col("total_queries").alias("count"),
                      F.col("blocked_queries").alias("blocked_count")))).alias("categories")))
    domains = (top_domains(cube_domain_minute(cube), k, ["resolver_id"])
               .groupBy(*_CLIENT)
               .agg(F.sort_array(F.collect_list(F.struct(
                   F.col("domain_rank").alias("rank"), "domain",
                   F.col("total_queries").alias("count"),
                   F.col("blocked_queries").alias("blocked_count")))).alias("ranked")))
    part = client_part(F.col("client_hash"), digits)
    entries = (clients.join(categories, _CLIENT, "left").join(domains, _CLIENT, "left")
               .select(
                   "resolver_id", batch_start(F.col("minute_timestamp")).alias("batch_start"),
                   part.alias("part"),
                   F.unix_timestamp("minute_timestamp").alias("window_timestamp"),
                   *COUNTERS_LATENCY,
                   F.struct(
                       "client_hash", *COUNTERS_LATENCY,
                       F.coalesce("categories", F.array()).alias("categories"),
                       F.coalesce(F.transform("ranked", lambda d: F.struct(
                           d["domain"].alias("domain"), d["count"].alias("count"),
                           d["blocked_count"].alias("blocked_count"),
                           d["rank"].alias("rank"))), F.array()).alias("top_domains"),
                   ).alias("client")))
    batch = ["resolver_id", "batch_start", "part"]
    minutes = (entries.repartition(*batch)
               .groupBy(*batch, "window_timestamp")
               .agg(*sum_counters(COUNTERS_LATENCY),
                    F.sort_array(F.collect_list("client")).alias("client_stats"))
               .select(*batch, F.struct(
                   "window_timestamp",
                   F.struct("window_timestamp", *COUNTERS_LATENCY).alias("resolver_stats"),
                   "client_stats").alias("minute")))
    return (minutes.groupBy(*batch)
            .agg(F.sort_array(F.collect_list("minute")).alias("minutes"))
            .select(
                F.concat(F.lit("b-"), "resolver_id", F.lit("-"), "batch_start", F.lit("-"), "part")
                .alias("batch_id"),
                "resolver_id",
                F.col("minutes")[0]["window_timestamp"].alias("window_start_timestamp"),
                (F.element_at("minutes", -1)["window_timestamp"] + 60)
                .alias("window_end_timestamp"),
                "minutes"))


def _minutes(batches: DataFrame) -> DataFrame:
    return (batches.select("batch_id", "resolver_id", F.explode("minutes").alias("m"))
            .withColumn("minute_timestamp", F.timestamp_seconds("m.window_timestamp")))


def _clients(batches: DataFrame) -> DataFrame:
    return (_minutes(batches)
            .select("batch_id", "resolver_id", "minute_timestamp",
                    F.explode("m.client_stats").alias("c")))


def flatten_resolvers(batches: DataFrame) -> DataFrame:
    return _minutes(batches).select(
        "batch_id", "resolver_id", "minute_timestamp",
        *[F.col(f"m.resolver_stats.{n}").alias(n) for n in COUNTERS_LATENCY])


def flatten_clients(batches: DataFrame) -> DataFrame:
    return _clients(batches).select(
        "batch_id", "resolver_id", "minute_timestamp", "c.client_hash",
        *[F.col(f"c.{n}").alias(n) for n in COUNTERS_LATENCY])


def flatten_categories(batches: DataFrame) -> DataFrame:
    return (_clients(batches)
            .select("batch_id", "resolver_id", "minute_timestamp", "c.client_hash",
                    F.explode("c.categories").alias("x"))
            .select("batch_id", "resolver_id", "minute_timestamp", "client_hash", "x.category",
                    F.col("x.count").alias("total_queries"),
                    F.col("x.blocked_count").alias("blocked_queries")))


def flatten_domains(batches: DataFrame) -> DataFrame:
    return (_clients(batches)
            .select("batch_id", "resolver_id", "minute_timestamp", "c.client_hash",
                    F.explode("c.top_domains").alias("x"))
            .select("batch_id", "resolver_id", "minute_timestamp", "client_hash", "x.domain",
                    F.col("x.count").alias("total_queries"),
                    F.col("x.blocked_count").alias("blocked_queries"),
                    F.col("x.rank").alias("domain_rank")))
