"""The reports over the hourly facts. Ties are broken by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.functions.reporting import (label_null_keys, pct, risk_badge, risk_level,
                                            round_half_up, time_label)
from querytrail.functions.timewindow import TimeWindow, filter_between
from querytrail.operators.matching import salted_lookup
from querytrail.operators.metrics import sum_counters
from querytrail.operators.rollups import (distinct_clients, distinct_domains_per_client,
                                          traffic_totals)

# List length, the category shown for listed domains, request limit per second.
TOP_BLOCKED_ROWS = 50
TOP_BLOCKED_CATEGORY = "SECURITY"
MAX_QUERIES_PER_SECOND = 50
THREAT_CATEGORIES = ["MALWARE", "PHISHING", "ADS"]
DAY_SECONDS = 86400

_PAIR = ["total_queries", "blocked_queries"]


def summary(resolver_hourly: DataFrame, client_hourly: DataFrame,
            window: TimeWindow) -> DataFrame:
    """Totals and rates of the period.

    ``active_clients`` counts all time, ``active_clients_in_range`` the period.
    """
    in_range = client_hourly if window.all_time else filter_between(client_hourly, window)
    total = F.col("total_queries")
    return traffic_totals(resolver_hourly, window).select(
        "total_queries", "blocked_queries",
        pct(F.col("blocked_queries"), total).alias("blocked_percent"),
        pct(F.col("cache_hits"), total).alias("cache_hit_percent"),
        round_half_up(F.col("avg_latency_ms"), 2).alias("avg_latency_ms"),
        distinct_clients(client_hourly).scalar().alias("active_clients"),
        distinct_clients(in_range).scalar().alias("active_clients_in_range"))


def traffic_hourly(resolver_hourly: DataFrame, window: TimeWindow,
                   short_label: bool = False) -> DataFrame:
    """Hourly series; the short label suits periods within a day."""
    label = time_label(F.col("hour_timestamp"), "hour" if short_label else "day_hour")
    return (filter_between(resolver_hourly, window)
            .select("hour_timestamp", label.alias("time"), *_PAIR)
            .orderBy("hour_timestamp"))


def traffic_daily(resolver_hourly: DataFrame, window: TimeWindow) -> DataFrame:
    """Daily series; the same day of two years stays two rows."""
    return (filter_between(resolver_hourly, window)
            .groupBy(F.to_date("hour_timestamp").alias("date")).agg(*sum_counters(_PAIR))
            .select("date", time_label(F.col("date"), "day").alias("time"), *_PAIR)
            .orderBy("date"))


def traffic(resolver_hourly: DataFrame, window: TimeWindow, range: str = "24H",
            granularity: str | None = None) -> DataFrame:
    """Daily points for MONTH, 30D or DAILY, else hourly ones."""
    name = range.upper()
    if name in ("MONTH", "30D") or (granularity or "").upper() == "DAILY":
        return traffic_daily(resolver_hourly, window)
    return traffic_hourly(resolver_hourly, window, name in ("24H", "1H"))


def category_breakdown(category_hourly: DataFrame) -> DataFrame:
    return (category_hourly.groupBy("category").agg(*sum_counters(_PAIR))
            .select(label_null_keys("category"), *_PAIR)
            .orderBy(F.desc("total_queries"), "category"))


def top_blocked_domains(domain_hourly: DataFrame, limit: int = TOP_BLOCKED_ROWS) -> DataFrame:
    """Domains by blocked, then by all queries. Domains never blocked are not left out."""
    ranking = [F.desc("blocked_queries"), F.desc("total_queries"), F.asc("domain")]
    # Sums per client first, so that a domain all clients query is not one big group.
    per_client = domain_hourly.groupBy("domain", "client_hash").agg(*sum_counters(_PAIR))
    top = (per_client.groupBy("domain")
           .agg(*sum_counters(_PAIR), F.count("client_hash").alias("clients"))
           .orderBy(*ranking).limit(limit))
    # The window sees only the rows of the list.
    return top.select(F.row_number().over(Window.orderBy(*ranking)).alias("rank"),
                      label_null_keys("domain"),
                      F.lit(TOP_BLOCKED_CATEGORY).alias("category"), *_PAIR, "clients")


def top_clients(client_hourly: DataFrame, domain_hourly: DataFrame) -> DataFrame:
    """All clients by traffic with block rate, distinct domains and risk."""
    domains = distinct_domains_per_client(domain_hourly)
    rate = pct(F.col("blocked_queries"), F.col("total_queries"), 1)
    return (client_hourly.groupBy("client_hash").agg(*sum_counters(_PAIR))
            .join(domains, "client_hash", "left")
            .withColumn("block_rate", rate)
            .select(label_null_keys("client_hash"), *_PAIR, "block_rate",
                    F.coalesce("distinct_domains", F.lit(0)).alias("distinct_domains"),
                    risk_level(F.col("block_rate")).alias("risk_level"),
                    risk_badge(F.col("block_rate")).alias("risk_badge"))
            .orderBy(F.desc("total_queries"), "client_hash"))


def latest_hours(resolver_hourly: DataFrame, limit: int = 24) -> DataFrame:
    return resolver_hourly.orderBy(F.desc("hour_timestamp")).limit(limit)


def threat_counters(categories: DataFrame) -> DataFrame:
    """Blocked counts of the threat categories in one row, from the category breakdown."""
    def blocked(name: str) -> Column:
        hits = F.when(F.upper("category") == name, F.col("blocked_queries"))
        return F.coalesce(F.sum(hits), F.lit(0)).alias(f"{name.lower()}_blocked")
    return categories.agg(*[blocked(n) for n in THREAT_CATEGORIES])


def search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows where any of the columns contains the term, letter case aside."""
    needle = term.strip().lower()
    if not needle:
        return rows
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(name).contains(F.lit(needle)), F.lit(False))
    return rows.filter(hit)


def search_threats(threats: DataFrame, term: str) -> DataFrame:
    return search(threats, term, ["domain", "category"])


def search_clients(clients: DataFrame, term: str) -> DataFrame:
    return search(clients, term, ["client_hash", "risk_level"])


def search_rules(rules: DataFrame, term: str) -> DataFrame:
    return search(rules, term, ["domain", "category", "reason"])


def _client_count(clients: DataFrame) -> Column:
    """At least 1."""
    return F.greatest(clients.agg(F.count(F.lit(1)).alias("n")).scalar(), F.lit(1))


def client_category_share(categories: DataFrame, clients: DataFrame) -> DataFrame:
    """Category figures of an average client, from the two reports."""
    return (categories.withColumn("n", _client_count(clients))
            .select("category",
                    round_half_up(F.col("total_queries") / F.col("n")).cast("long")
                    .alias("queries"),
                    round_half_up(F.col("blocked_queries") / F.col("n")).cast("long")
                    .alias("blocked"),
                    pct(F.col("blocked_queries"), F.col("total_queries"), 0).cast("long")
                    .alias("pct_blocked")))


def client_activity_share(points: DataFrame, clients: DataFrame) -> DataFrame:
    """Traffic points of an average client."""
    return (points.withColumn("n", _client_count(clients))
            .select("hour_timestamp", F.col("time"),
                    round_half_up(F.col("total_queries") / F.col("n")).cast("long")
                    .alias("queries")))


def query_rate(totals: DataFrame, nodes: int) -> DataFrame:
    """Queries per second over a day, and the even share of a node."""
    qps = round_half_up(F.col("total_queries") / F.lit(DAY_SECONDS))
    return (totals.select("total_queries", qps.cast("long").alias("qps"))
            .withColumn("qps_per_node",
                        round_half_up(F.col("qps") / F.lit(nodes)).cast("long")))


def resolver_nodes(events: DataFrame) -> DataFrame:
    """What each resolver really did: queries, hits and the 95th percentile of latency.

    The percentile is exact; its state is one count per distinct millisecond value.
    """
    hits = F.count_if(F.col("cache_hit"))
    return (events.groupBy("resolver_id")
            .agg(F.count(F.lit(1)).alias("total_queries"),
                 pct(hits, F.count(F.lit(1))).alias("cache_hit_percent"),
                 F.expr("percentile_disc(0.95) within group (order by latency_ms)")
                 .cast("long").alias("p95_latency_ms"))
            .orderBy("resolver_id"))


def _second() -> Column:
    return F.date_trunc("second", F.col("ts")).alias("second")


def clients_over_rate(events: DataFrame, limit: int = MAX_QUERIES_PER_SECOND) -> DataFrame:
    """Client seconds with more than ``limit`` queries, and how many were too many."""
    return (events.groupBy("client_hash", _second())
            .agg(F.count(F.lit(1)).alias("queries"))
            .filter(F.col("queries") > limit)
            .withColumn("over_limit", F.col("queries") - limit))


def queries_over_rate(events: DataFrame, limit: int = MAX_QUERIES_PER_SECOND) -> DataFrame:
    """The single queries past the limit of their client second, in time order.

    Only the first ``limit`` rows of a client second are ever ranked (a group limit below
    the shuffle); the last of them is the threshold that all rows are compared with.
    """
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    keys = ["client_hash", "second"]
    timed = events.withColumn("second", _second())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("ts", "event_id"))
    last_allowed = (timed.select(*keys, "ts", "event_id").withColumn("n", rank)
                    .filter(F.col("n") <= limit).filter(F.col("n") == limit)
                    .select(*keys, F.struct("ts", "event_id").alias("last_allowed")))
    return (salted_lookup(timed, last_allowed, keys, ["event_id"], "inner")
            .filter(F.struct("ts", "event_id") > F.col("last_allowed"))
            .drop("second", "last_allowed"))


def clients_over_rate_sliding(events: DataFrame, limit: int = MAX_QUERIES_PER_SECOND,
                              window_us: int = 1_000_000, chunk_us: int = 600_000_000
                              ) -> DataFrame:
    """Queries at which a client has more than ``limit`` within the time ``window_us`` that ends
    there, whatever second of the clock that falls in.

    A client's queries are looked at in chunks of time; what lies less than a window before the
    next chunk is also looked at there, so that a busy client spreads over tasks.
    """
    at = F.unix_micros("ts")
    own = F.floor(at / chunk_us)
    timed = (events.select("client_hash", "event_id", "ts", at.alias("at"), own.alias("own"))
             .withColumn("chunk", F.explode(F.array_distinct(F.array(
                 "own", F.floor((F.col("at") + (window_us - 1)) / chunk_us))))))
    recent = (Window.partitionBy("client_hash", "chunk").orderBy("at")
              .rangeBetween(1 - window_us, 0))
    return (timed.withColumn("queries", F.count(F.lit(1)).over(recent))
            .filter((F.col("chunk") == F.col("own")) & (F.col("queries") > limit))
            .select("client_hash", "event_id", "ts", "queries",
                    (F.col("queries") - limit).alias("over_limit")))


def any_query_report(events: DataFrame) -> DataFrame:
    """Clients that ask for all records of a name, a sign of amplification attempts."""
    return (events.groupBy("client_hash")
            .agg(F.count(F.lit(1)).alias("total_queries"),
                 F.count_if(F.upper("qtype") == "ANY").alias("any_queries"))
            .filter(F.col("any_queries") > 0))
