"""Test tables derived from the given parquet tables, the same way in Spark and in SQL."""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.operators.metrics import (hourly_client, hourly_client_category, prepare_events,
                                          sum_counters, weighted_latency)
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY, DOMAIN_RULES

# For tests only; a deployment passes its own.
SECRET = "test-only-secret"
AS_OF = datetime(2024, 1, 31)
RULES_AT = datetime(2024, 1, 1)
HOST = r"^https?://([^/:?#]+)"
_LABELS = ["MALWARE", "PHISHING", "ADS", "TRACKING"]


@lru_cache(maxsize=32)
def _page_count(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").count()


def _events_from(spark: SparkSession, events: DataFrame, sf_dir: str) -> DataFrame:
    n_pages = _page_count(spark, sf_dir)
    pages = (spark.read.parquet(f"{sf_dir}/pages.parquet")
             .select("page_id", F.regexp_extract("url", HOST, 1).alias("domain")))
    kind, odd = F.col("event_type"), F.col("event_id") % 2 == 1
    action = (F.when(kind == "view", "L1_HIT").when(kind == "click", "L2_HIT")
              .when(kind == "purchase", "RESOLVED").when(kind == "signup", "BLOCKED")
              .when(odd, "ERROR").otherwise("FAILED"))
    qtype = (F.when(F.col("event_id") % 10 == 0, "AAAA").when(F.col("event_id") % 10 == 1, "TXT")
             .when(F.col("event_id") % 10 == 2, "ANY").otherwise("A"))
    threat = F.element_at(F.array(*[F.lit(c) for c in [*_LABELS, "SECURITY"]]),
                          (F.col("page_id") % 5 + 1).cast("int"))
    category = (F.when(F.col("event_id") % 97 == 0, "").when(kind != "signup", "GENERAL")
                .otherwise(threat))
    user = F.col("user_id")
    rcode = F.when(kind != "error", 0).when(odd, 2).otherwise(3)
    return (events.withColumn("page_id", F.col("event_id") % n_pages)
            .join(pages, "page_id")
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.concat(F.lit("10.0."), F.floor(user / 256).cast("string"), F.lit("."),
                             (user % 256).cast("string")).alias("client_ip"),
                    "domain", qtype.alias("qtype"), action.alias("action"),
                    category.alias("category"), (kind == "view").alias("cache_hit"),
                    F.floor("value").cast("long").alias("latency_ms"),
                    rcode.cast("int").alias("rcode"),
                    F.concat(F.lit("resolver-"), (F.col("event_id") % 3).cast("string"))
                    .alias("resolver_id")))


def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events_from(spark, spark.read.parquet(f"{sf_dir}/events.parquet"), sf_dir)


def prepared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_events(query_events(spark, sf_dir), SECRET)


def query_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet")
              .parquet(sf_dir))
    return _events_from(spark, stream, sf_dir)


def prepared_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_events(query_event_stream(spark, sf_dir), SECRET)


def hourly_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven years of hourly figures, several rows per key."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    qty = F.col("l_quantity").cast("long")
    half, quarter = F.floor(F.col("l_quantity") / 2), F.floor(F.col("l_quantity") / 4)
    category = F.element_at(F.array(*[F.lit(c) for c in [*_LABELS, "GENERAL"]]),
                            (F.col("l_partkey") % 5 + 1).cast("int"))
    return (line.select(
        (F.col("l_shipdate").cast("timestamp")
         + F.expr("make_interval(0, 0, 0, 0, l_linenumber)")).alias("hour_timestamp"),
        F.concat(F.lit("c"), F.col("l_suppkey").cast("string")).alias("client_hash"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 200).cast("string"), F.lit(".example"))
        .alias("domain"),
        category.alias("category"), qty.alias("total_queries"),
        F.when(F.col("l_returnflag") == "R", quarter).otherwise(0).cast("long")
        .alias("blocked_queries"),
        (F.col("l_linestatus") == "F").cast("long").alias("nxdomain_queries"),
        (F.col("l_linenumber") == 7).cast("long").alias("servfail_queries"),
        half.cast("long").alias("cache_hits"),
        F.floor("l_extendedprice").cast("long").alias("total_latency_ms"))
        .withColumn("allowed_queries", F.col("total_queries") - F.col("blocked_queries"))
        .withColumn("cache_misses", F.col("total_queries") - F.col("cache_hits")))


def resolver_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (hourly_deltas(spark, sf_dir).groupBy("hour_timestamp")
            .agg(*sum_counters(COUNTERS_LATENCY), weighted_latency()))


def client_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (hourly_deltas(spark, sf_dir).groupBy("hour_timestamp", "client_hash")
            .agg(*sum_counters(COUNTERS)))


def category_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (hourly_deltas(spark, sf_dir).groupBy("hour_timestamp", "client_hash", "category")
            .agg(*sum_counters(["total_queries", "blocked_queries"])))


def domain_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (hourly_deltas(spark, sf_dir).groupBy("hour_timestamp", "client_hash", "domain")
            .agg(*sum_counters(["total_queries", "blocked_queries"])))


def domain_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules made from the hosts of the pages, and three fixed ones."""
    size = F.length("domain")
    hosts = (spark.read.parquet(f"{sf_dir}/pages.parquet")
             .select(F.regexp_extract("url", HOST, 1).alias("domain")).distinct()
             .filter(size % 4 != 1)
             .select("domain", F.when(size % 3 == 0, "ALLOW").otherwise("BLOCK").alias("action"),
                     F.when(size % 2 == 0, "EXACT").otherwise("DOMAIN_AND_SUBDOMAINS")
                     .alias("match_type"),
                     F.when(size % 7 == 0, "INACTIVE").otherwise("ACTIVE").alias("status")))
    fixed = spark.sql("""SELECT * FROM VALUES
        ('example.net', 'BLOCK', 'EXACT', 'ACTIVE'),
        ('spam-farm.example.org', 'BLOCK', 'DOMAIN_AND_SUBDOMAINS', 'ACTIVE'),
        ('org', 'ALLOW', 'DOMAIN_AND_SUBDOMAINS', 'INACTIVE')
        AS t(domain, action, match_type, status)""")
    rows = (hosts.unionByName(fixed)
            .withColumn("category", F.when(F.col("action") == "ALLOW", "WHITELIST")
                        .otherwise("MALWARE"))
            .withColumn("severity", F.when(F.col("action") == "ALLOW", "LOW").otherwise("HIGH"))
            .withColumn("source", F.lit("ADMIN"))
            .withColumn("reason", F.concat(F.lit("rule for "), "domain"))
            .withColumn("created_at", F.lit(RULES_AT.isoformat(sep=" ")).cast("timestamp"))
            .withColumn("updated_at", F.col("created_at"))
            .withColumn("expires_at", F.lit(None).cast("timestamp")))
    return rows.select(*DOMAIN_RULES.names)
