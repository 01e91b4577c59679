"""Types of the events, the nested batch message, the fact tables and the rule tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Additive counters shared by the resolver and client facts.
COUNTERS = [
    "total_queries", "allowed_queries", "blocked_queries", "nxdomain_queries",
    "servfail_queries", "cache_hits", "cache_misses",
]
COUNTERS_LATENCY = [*COUNTERS, "total_latency_ms"]


def _longs(names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


DNS_QUERY_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("client_ip", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("qtype", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("cache_hit", T.BooleanType()),
    T.StructField("latency_ms", T.LongType()),
    T.StructField("rcode", T.IntegerType()),
    T.StructField("resolver_id", T.StringType()),
])

CATEGORY_COUNT = T.StructType(
    [T.StructField("category", T.StringType()), *_longs(["count", "blocked_count"])])

TOP_DOMAIN_COUNT = T.StructType([
    T.StructField("domain", T.StringType()), *_longs(["count", "blocked_count"]),
    T.StructField("rank", T.IntegerType())])

CLIENT_MINUTE_STATS = T.StructType([
    T.StructField("client_hash", T.StringType()), *_longs(COUNTERS_LATENCY),
    T.StructField("categories", T.ArrayType(CATEGORY_COUNT)),
    T.StructField("top_domains", T.ArrayType(TOP_DOMAIN_COUNT))])

RESOLVER_MINUTE_STATS = T.StructType(_longs(["window_timestamp", *COUNTERS_LATENCY]))

MINUTE_WINDOW = T.StructType([
    T.StructField("window_timestamp", T.LongType()),
    T.StructField("resolver_stats", RESOLVER_MINUTE_STATS),
    T.StructField("client_stats", T.ArrayType(CLIENT_MINUTE_STATS))])

DNS_BATCH = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("resolver_id", T.StringType()),
    *_longs(["window_start_timestamp", "window_end_timestamp"]),
    T.StructField("minutes", T.ArrayType(MINUTE_WINDOW))])

ENCODED_BATCH = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.BinaryType())])

DOMAIN_RULES = T.StructType(
    [T.StructField(n, T.StringType()) for n in
     ["domain", "action", "match_type", "category", "severity", "status", "source", "reason"]]
    + [T.StructField(n, T.TimestampType()) for n in ["created_at", "updated_at", "expires_at"]])

RULES_CSV = T.StructType([T.StructField(n, T.StringType()) for n in
                          ["domain", "action", "match_type", "category", "severity", "reason"]])

OVERRIDE_RECORDS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("domain", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("ip_address", T.StringType()),
    T.StructField("ttl", T.IntegerType()), T.StructField("description", T.StringType())])

# Natural keys of the fact tables; everything else in them is additive or derived.
FACT_KEYS = {
    "resolver_hourly_stats": ["hour_timestamp"],
    "client_hourly_stats": ["hour_timestamp", "client_hash"],
    "client_category_hourly": ["hour_timestamp", "client_hash", "category"],
    "client_top_domains_hourly": ["hour_timestamp", "client_hash", "domain"],
    "resolver_daily_stats": ["date_timestamp"],
    "client_daily_stats": ["date_timestamp", "client_hash"],
    "resolver_monthly_stats": ["year_month"],
    "client_monthly_stats": ["year_month", "client_hash"],
}
