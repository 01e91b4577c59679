"""Every operator as a query over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail import fixtures as fx
from querytrail import functions as fn
from querytrail.operators import (asof, batches, matching, merge, metrics, rollups, rules,
                                  sketches)
from querytrail.plans import compaction, facts, reports, retention, tiers, views
from querytrail.schemas import COUNTERS, COUNTERS_LATENCY, DNS_BATCH
from querytrail.session import scratch_dir, ship_package
from querytrail.sources import codec, indexed, lists, messages
from querytrail.sources.facts import commit, read_facts, write_delta
from querytrail.streaming import enrich, sink, stateful
from querytrail.streaming import metrics as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

YEAR_2000 = datetime(2000, 1, 1)
MARCH_1997 = ("1997-03", datetime(1997, 3, 1), datetime(1997, 3, 31, 23, 59, 59))
PAIR = ["total_queries", "blocked_queries"]


def query(func: Query) -> Query:
    @wraps(func)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return func(spark, sf_dir)
    QUERIES[func.__name__] = run
    return run


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return (spark.read.parquet(f"{sf}/pages.parquet")
            .select("page_id", "url", F.regexp_extract("url", fx.HOST, 1).alias("domain")))


def _messy_domain() -> Column:
    """Hosts with mixed case, blanks and stray dots."""
    d, i = F.col("domain"), F.col("page_id")
    return (F.when(i % 7 == 0, F.concat(F.lit("."), d))
            .when(i % 7 == 1, F.regexp_replace(d, r"^([^.]*)\.", "$1.."))
            .when(i % 7 == 2, F.concat(d, F.lit(".")))
            .when(i % 7 == 3, F.concat(F.upper(d), F.lit("..")))
            .when(i % 7 == 4, F.concat(F.lit("  "), F.initcap(d), F.lit(". ")))
            .otherwise(d))


def _await(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _stored_cube(spark: SparkSession, sf: str) -> DataFrame:
    return facts.write_event_cube(fx.prepared_events(spark, sf), scratch_dir(spark, "cube"))


def _batches(spark: SparkSession, sf: str) -> DataFrame:
    return batches.assemble_batches(_stored_cube(spark, sf))


def _landed(spark: SparkSession, sf: str) -> str:
    """Encoded batches written as files."""
    path = scratch_dir(spark, "landed")
    messages.write_batch_files(codec.encode_batches(_batches(spark, sf)), path)
    return path


# --- sources and sinks -----------------------------------------------------------------

@query
def src_batch_files(spark, sf):
    decoded = codec.decode_batches(messages.read_batch_files(spark, _landed(spark, sf)))
    return codec.good_batches(decoded).select(
        "batch_id", "resolver_id", "window_start_timestamp", "window_end_timestamp",
        F.size("minutes").cast("long").alias("minutes"))


@query
def encode_batch(spark, sf):
    """Client minutes after encoding and decoding, read from the nested messages."""
    encoded = codec.encode_batches(_batches(spark, sf))
    return batches.flatten_clients(codec.good_batches(codec.decode_batches(encoded)))


@query
def decode_batch(spark, sf):
    """Domain entries of decoded batches that were sent in several parts."""
    decoded = codec.decode_batches(messages.read_batch_files(spark, _landed(spark, sf)))
    return batches.flatten_domains(codec.good_batches(decoded)).drop("batch_id")


@query
def quarantine_bad_batches(spark, sf):
    """Every batch of resolver-1 is cut short; what is left is counted by outcome."""
    landed = messages.read_batch_files(spark, _landed(spark, sf))
    broken = landed.withColumn("value", F.when(
        F.col("key").contains("-resolver-1-"), F.substring("value", 1, 20))
        .otherwise(F.col("value")))
    return (codec.decode_batches(broken)
            .groupBy(F.col("error").isNotNull().alias("quarantined"),
                     F.col("batch").isNull().alias("no_batch"),
                     F.col("value").isNotNull().alias("payload_kept"))
            .agg(F.count(F.lit(1)).alias("batches")))


def _merged_root(spark: SparkSession, sf: str) -> str:
    root, path = scratch_dir(spark, "facts"), scratch_dir(spark, "landed")
    messages.write_nested_files(_batches(spark, sf), path)
    landed = messages.read_nested_files(spark, path, stream=True, maxFilesPerTrigger="4")
    _await(sink.merge_nested(landed, root, scratch_dir(spark, "ckpt")))
    return root


@query
def sink_hourly_upsert(spark, sf):
    return read_facts(spark, _merged_root(spark, sf), "client_hourly_stats").drop("month")


@query
def sink_hourly_upsert_resolver(spark, sf):
    out = read_facts(spark, _merged_root(spark, sf), "resolver_hourly_stats").drop("month")
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query
def sink_hourly_upsert_category(spark, sf):
    return read_facts(spark, _merged_root(spark, sf), "client_category_hourly").drop("month")


@query
def sink_hourly_upsert_domain(spark, sf):
    return read_facts(spark, _merged_root(spark, sf), "client_top_domains_hourly").drop("month")


@query
def scan_hourly_before(spark, sf):
    root = scratch_dir(spark, "facts")
    write_delta(fx.client_hourly(spark, sf), root, "client_hourly_stats", 0)
    return rollups.rows_before(
        read_facts(spark, root, "client_hourly_stats"), YEAR_2000).drop("month")


def _rule_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Rule input with URLs, blanks, repeats and missing fields, one per page."""
    i = F.col("page_id")
    return _pages(spark, sf).select(
        i.alias("seq"),
        F.when(i % 9 == 0, "  ").when(i % 9 == 1, F.col("url"))
        .otherwise(F.upper("domain")).alias("domain"),
        F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "ALLOW").when(i % 4 == 2, "allow")
        .otherwise("BLOCK").alias("action"),
        F.when(i % 3 == 0, "exact").when(i % 3 == 1, "DOMAIN_AND_SUBDOMAINS").alias("match_type"),
        F.when(i % 5 == 0, "phishing").when(i % 5 == 1, "").when(i % 5 == 2, "Ads")
        .alias("category"),
        F.when(i % 6 == 0, "critical").when(i % 6 == 1, "").alias("severity"),
        F.when(i % 7 == 0, F.concat(F.lit('say "no"; rule, '), i.cast("string")))
        .when(i % 7 == 1, "plain").alias("reason"))


def _csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The requests as CSV text: semicolons in odd lines, quotes around reasons."""
    quoted = F.concat(F.lit('"'), F.replace(F.col("reason"), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [F.coalesce(c, F.lit("")) for c in
              (F.col("domain"), F.col("action"), F.col("match_type"), F.col("category"),
               F.col("severity"), quoted)]
    return _rule_requests(spark, sf).select("seq", F.when(
        F.col("seq") % 2 == 1, F.concat_ws(" ; ", *fields)).otherwise(
        F.concat_ws(",", *fields)).alias("value"))


@query
def rules_csv_import(spark, sf):
    """A first file with its title, and the rest in as many files as it takes."""
    first, rest = scratch_dir(spark, "rules-csv"), scratch_dir(spark, "rules-csv")
    lines = _csv_lines(spark, sf)
    title = spark.createDataFrame([(-1, ",".join(lists.CSV_TITLES)), (-2, "   ")],
                                  "seq long, value string")
    (title.unionByName(lines.filter(F.col("seq") < 10)).coalesce(1)
     .sortWithinPartitions(F.col("seq") >= 0, "seq").select("value").write.text(first))
    (lines.filter(F.col("seq") >= 10).repartitionByRange("seq").sortWithinPartitions("seq")
     .select("value").write.text(rest))
    rows = lists.read_rules_csv(spark, first).unionByName(
        lists.read_rules_csv(spark, rest, header=False))
    return rules.normalize_rules_csv(rows).drop("file", "seq")


@query
def rules_csv_export(spark, sf):
    path = scratch_dir(spark, "rules-out")
    rows = rules.normalize_rules_api(_rule_requests(spark, sf))
    lists.write_rules_csv(rows, path)
    return rules.normalize_rules_csv(lists.read_rules_csv(spark, path, header=True)).drop(
        "file", "seq")


@query
def blocklist_text_load(spark, sf):
    path = scratch_dir(spark, "domains")
    _pages(spark, sf).select(F.when(F.col("page_id") % 5 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" "), "domain", F.lit("  "))).alias("value")).write.text(path)
    return lists.read_domain_list(spark, path)


# --- scalar functions ------------------------------------------------------------------

@query
def client_hash(spark, sf):
    ip = (F.when(F.col("event_id") % 101 == 0, F.lit(None))
          .when(F.col("event_id") % 103 == 0, F.lit("  "))
          .when(F.col("event_id") % 107 == 0, F.concat(F.lit(" "), "client_ip"))
          .otherwise(F.col("client_ip")))
    return fx.query_events(spark, sf).select(
        "event_id", fn.client_hash(ip, fx.SECRET).alias("client_hash"))


@query
def normalize_domain(spark, sf):
    messy = _messy_domain()
    return _pages(spark, sf).select(
        "page_id", fn.normalize_domain(messy).alias("domain"),
        fn.normalize_domain(messy, trim=True).alias("trimmed"))


@query
def strip_url_to_domain(spark, sf):
    return _pages(spark, sf).select("page_id", fn.strip_url_to_domain(
        F.when(F.col("page_id") % 2 == 0, F.upper("url")).otherwise(F.col("url")))
        .alias("domain"))


@query
def domain_suffixes(spark, sf):
    return (_pages(spark, sf)
            .select("page_id", F.explode(fn.domain_suffixes(_messy_domain())).alias("s"))
            .select("page_id", F.col("s.depth").cast("long").alias("depth"), "s.suffix"))


@query
def is_blocked_action(spark, sf):
    action = F.when(F.col("event_id") % 2 == 0, F.lower("action")).otherwise(F.col("action"))
    return fx.query_events(spark, sf).select(
        "event_id", fn.is_blocked_action(action).alias("is_blocked"))


@query
def classify_outcome(spark, sf):
    raw = fx.query_events(spark, sf)
    i = F.col("event_id")
    return raw.select("event_id", fn.classify_outcome(
        local_hit=F.col("cache_hit"),
        blocked=(F.col("action") == "BLOCKED") | (i % 50 == 0),
        shared_hit=F.col("action") == "L2_HIT",
        failed=F.col("action") == "ERROR",
        answers=F.when(F.col("action") == "FAILED", 0).otherwise(1),
        rcode=F.col("rcode")).alias("o")).select("event_id", "o.*")


@query
def rcode_flags(spark, sf):
    return fx.query_events(spark, sf).groupBy("resolver_id").agg(
        F.count_if(fn.is_nxdomain(F.col("rcode"))).alias("nxdomain_queries"),
        F.count_if(fn.is_servfail(F.col("rcode"))).alias("servfail_queries"))


@query
def skip_blank_keys(spark, sf):
    """Per client: all queries, and those that reach the category breakdown."""
    return fx.prepared_events(spark, sf).groupBy("client_hash").agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(fn.is_present(F.col("category"))).alias("with_category"))


@query
def resolve_time_window(spark, sf):
    """Totals of several periods, one of them unreadable (so 24H)."""
    hourly = metrics.hourly_resolver(metrics.agg_resolver_minute(fx.prepared_events(spark, sf)))
    wanted = {
        "1h": {"range": "1H"}, "24h": {}, "7d": {"range": "7d"}, "30d": {"range": "30D"},
        "all": {"range": "ALL"}, "month": {"month": "2024-01", "range": "1H"},
        "dates": {"start_date": "2024-01-05", "end_date": " 2024-01-07 "},
        "bad": {"month": "2024-13", "start_date": "x", "end_date": "y", "range": "WEEK"},
    }
    parts = []
    for name, arguments in wanted.items():
        window = fn.resolve_time_window(fx.AS_OF, **arguments)
        parts.append(fn.filter_between(hourly, window).agg(
            F.count(F.lit(1)).alias("hours"),
            F.coalesce(F.sum("total_queries"), F.lit(0)).alias("total_queries"))
            .select(F.lit(name).alias("period"), F.lit(window.all_time).alias("all_time"),
                    "hours", "total_queries"))
    return reduce(DataFrame.unionByName, parts)


@query
def filter_between(spark, sf):
    return fn.filter_between(fx.resolver_hourly(spark, sf).select(
        "hour_timestamp", *COUNTERS), fn.TimeWindow(MARCH_1997[1], MARCH_1997[2]))


@query
def safe_ratio_pct(spark, sf):
    total = F.when(F.col("total_queries") % 10 == 0, 0).otherwise(F.col("total_queries"))
    rows = fx.client_hourly(spark, sf).select("hour_timestamp", "client_hash",
                                              "blocked_queries", total.alias("total"))
    return rows.select(
        "hour_timestamp", "client_hash",
        fn.pct(F.col("blocked_queries"), F.col("total")).alias("pct_2"),
        fn.pct(F.col("blocked_queries"), F.col("total"), 1).alias("pct_1"))


@query
def risk_level(spark, sf):
    rate = fn.pct(F.col("blocked_queries"), F.col("total_queries"), 1)
    return fx.client_hourly(spark, sf).select(
        "hour_timestamp", "client_hash", fn.risk_level(rate).alias("risk_level"),
        fn.risk_badge(rate).alias("risk_badge"))


CATEGORY_NAMES = ["Malware site", "phishing", "Security", "AdNetwork", "Promo mail", "Tracker",
                  "web analytics", "telemetry", "cryptocurrency", "datamining", "gambling",
                  "alphabet", "adult", "Porn", "social", "news", ""]


@query
def category_family(spark, sf):
    names = F.array(*[F.lit(n) for n in CATEGORY_NAMES])
    category = F.get(names, (F.col("page_id") % (len(CATEGORY_NAMES) + 1)).cast("int"))
    return _pages(spark, sf).select("page_id", fn.category_family(category).alias("family"))


@query
def time_label(spark, sf):
    ts = F.col("hour_timestamp")
    return fx.resolver_hourly(spark, sf).select(
        ts, fn.time_label(ts, "hour").alias("hour_label"),
        fn.time_label(ts, "day_hour").alias("day_hour_label"),
        fn.time_label(ts, "day").alias("day_label"))


@query
def epoch_to_hour(spark, sf):
    return fx.query_events(spark, sf).select(
        "event_id", fn.epoch_to_hour(F.unix_timestamp("ts")).alias("hour_timestamp"))


@query
def label_null_keys(spark, sf):
    """Sums per category, client and domain after some keys went missing."""
    def holes(name: str, step: int) -> Column:
        return F.when(F.col("event_id") % step != 0, F.col(name)).alias(name)
    rows = fx.prepared_events(spark, sf).select(
        holes("category", 5), holes("client_hash", 7), holes("domain", 11))
    return (rows.select(*[fn.label_null_keys(n) for n in ("category", "client_hash", "domain")])
            .groupBy("category", "client_hash", "domain")
            .agg(F.count(F.lit(1)).alias("total_queries")))


# --- aggregations ----------------------------------------------------------------------

@query
def agg_resolver_minute(spark, sf):
    return metrics.agg_resolver_minute(fx.prepared_events(spark, sf))


@query
def agg_client_minute(spark, sf):
    return metrics.agg_client_minute(fx.prepared_events(spark, sf))


@query
def agg_client_category_minute(spark, sf):
    return metrics.agg_client_category_minute(fx.prepared_events(spark, sf))


@query
def agg_client_domain_minute(spark, sf):
    return metrics.agg_client_domain_minute(fx.prepared_events(spark, sf))


@query
def event_cube(spark, sf):
    return metrics.event_cube(fx.prepared_events(spark, sf))


@query
def assemble_batch(spark, sf):
    return _batches(spark, sf).select(
        "batch_id", "resolver_id", "window_start_timestamp", "window_end_timestamp",
        F.size("minutes").cast("long").alias("minutes"),
        F.aggregate("minutes", F.lit(0).cast("long"),
                    lambda a, m: a + F.size(m["client_stats"])).alias("client_minutes"),
        F.aggregate("minutes", F.lit(0).cast("long"),
                    lambda a, m: a + m["resolver_stats"]["total_queries"])
        .alias("total_queries"))


@query
def flatten_batch(spark, sf):
    return batches.flatten_categories(_batches(spark, sf))


@query
def flatten_batch_resolver(spark, sf):
    return batches.flatten_resolvers(_batches(spark, sf))


@query
def hourly_resolver(spark, sf):
    out = metrics.hourly_resolver(metrics.agg_resolver_minute(fx.prepared_events(spark, sf)))
    return out.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query
def hourly_client(spark, sf):
    return metrics.hourly_client(metrics.agg_client_minute(fx.prepared_events(spark, sf)))


@query
def hourly_client_category(spark, sf):
    return metrics.hourly_client_category(
        metrics.agg_client_category_minute(fx.prepared_events(spark, sf)))


@query
def hourly_client_domain(spark, sf):
    minutes = metrics.agg_client_domain_minute(fx.prepared_events(spark, sf))
    return metrics.hourly_client_domain(metrics.top_domains(minutes))


@query
def hourly_client_domain_day_top3(spark, sf):
    """The same with day windows of which three domains survive, so that much is cut."""
    days = metrics.agg_client_domain_minute(fx.prepared_events(spark, sf), "1 day")
    return metrics.hourly_client_domain(metrics.top_domains(days, 3))


@query
def hourly_client_domain_exact(spark, sf):
    return metrics.hourly_client_domain_exact(fx.prepared_events(spark, sf))


@query
def event_to_hour_pipeline(spark, sf):
    """Events to all four hourly tables through one stored cube; rows counted and summed."""
    tables = facts.hourly_facts(_stored_cube(spark, sf))
    return reduce(DataFrame.unionByName, [
        rows.agg(F.count(F.lit(1)).alias("rows"), *metrics.sum_counters(PAIR))
        .select(F.lit(name).alias("table_name"), "rows", *PAIR)
        for name, rows in tables.items()])


def _date_text(df: DataFrame, name: str = "date_timestamp") -> DataFrame:
    return df.withColumn(name, F.col(name).cast("string"))


def _round_latency(df: DataFrame) -> DataFrame:
    return df.withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query
def daily_resolver(spark, sf):
    return _date_text(_round_latency(rollups.daily_resolver(fx.hourly_deltas(spark, sf))))


@query
def daily_client(spark, sf):
    return _date_text(rollups.daily_client(fx.client_hourly(spark, sf)))


@query
def monthly_resolver(spark, sf):
    return _round_latency(rollups.monthly_resolver(fx.resolver_hourly(spark, sf)))


@query
def monthly_client(spark, sf):
    return rollups.monthly_client(fx.client_hourly(spark, sf))


@query
def mv_resolver_daily(spark, sf):
    out = rollups.mv_resolver_daily(fx.resolver_hourly(spark, sf))
    return _round_latency(out).withColumn("weighted_avg_latency_ms",
                                          F.round("weighted_avg_latency_ms", 6))


@query
def mv_top_categories(spark, sf):
    return rollups.mv_top_categories(fx.category_hourly(spark, sf))


def _totals(df: DataFrame) -> DataFrame:
    return _round_latency(df).withColumn("weighted_avg_latency_ms",
                                         F.round("weighted_avg_latency_ms", 6))


@query
def sum_all_time(spark, sf):
    return _totals(rollups.traffic_totals(fx.resolver_hourly(spark, sf)))


@query
def sum_between(spark, sf):
    window = fn.resolve_time_window(YEAR_2000, month=MARCH_1997[0])
    return _totals(rollups.traffic_totals(fx.resolver_hourly(spark, sf), window))


@query
def distinct_clients(spark, sf):
    return rollups.distinct_clients(fx.client_hourly(spark, sf))


@query
def distinct_domains_per_client(spark, sf):
    return rollups.distinct_domains_per_client(fx.domain_hourly(spark, sf))


# --- matching, lookups, upserts --------------------------------------------------------

def _domains(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("domain").distinct()


def _rule_action(matched: DataFrame) -> DataFrame:
    action = F.when(F.col("rule_block"), "BLOCK").when(~F.col("rule_block"), "ALLOW")
    return matched.select("domain", "rule_domain", action.alias("rule_action"))


@query
def match_rules(spark, sf):
    return _rule_action(matching.match_rules(_domains(spark, sf), fx.domain_rules(spark, sf),
                                             way="lookup"))


@query
def match_rules_shuffled(spark, sf):
    """Each distinct domain is decided once."""
    return _rule_action(matching.match_rules(_domains(spark, sf), fx.domain_rules(spark, sf),
                                             way="distinct"))


@query
def match_blocked_set(spark, sf):
    return matching.match_blocked_set(
        _domains(spark, sf), matching.blocked_set(fx.domain_rules(spark, sf)))


def _decide_events(spark: SparkSession, sf: str, mode: str = "compat", **options) -> DataFrame:
    rule_table = fx.domain_rules(spark, sf)
    decided = matching.policy_decision(
        fx.query_events(spark, sf).select("event_id", "domain"), rule_table,
        matching.blocked_set(rule_table, mode=mode), spread=["event_id"], **options)
    return decided.select("event_id", "rule_domain", "listed_parent", "blocked")


@query
def policy_decision(spark, sf):
    return _decide_events(spark, sf, way="lookup")


@query
def policy_decision_strict(spark, sf):
    return _decide_events(spark, sf, "strict")


@query
def policy_decision_shuffled(spark, sf):
    return _decide_events(spark, sf, way="distinct")


@query
def upsert_hourly(spark, sf):
    """Resolver hours of odd line numbers merged with those of even ones."""
    deltas = fx.hourly_deltas(spark, sf)
    odd = F.hour("hour_timestamp") % 2 == 1
    old = merge.merge_rows(deltas.filter(odd | (F.col("client_hash") == "c1"))
                           .select("hour_timestamp", *COUNTERS_LATENCY), ["hour_timestamp"])
    new = deltas.filter(~(odd | (F.col("client_hash") == "c1"))).select(
        "hour_timestamp", *COUNTERS_LATENCY)
    zero = F.lit(0.0)
    return _round_latency(merge.upsert_facts(
        old.withColumn("avg_latency_ms", zero), new.withColumn("avg_latency_ms", zero),
        "resolver_hourly_stats"))


@query
def upsert_rollup(spark, sf):
    """Client months of the years before 1996 merged with the rest."""
    hourly = fx.hourly_deltas(spark, sf)
    early = F.year("hour_timestamp") < 1996
    late_rows = rollups.monthly_client(hourly.filter(~early | (F.col("category") == "ADS")))
    old = rollups.monthly_client(hourly.filter(early & (F.col("category") != "ADS")))
    return merge.upsert_facts(old, late_rows, "client_monthly_stats")


@query
def normalize_rules_api(spark, sf):
    return rules.normalize_rules_api(_rule_requests(spark, sf))


@query
def normalize_rules_csv(spark, sf):
    return rules.normalize_rules_csv(_rule_requests(spark, sf))


@query
def upsert_rules(spark, sf):
    requests = rules.normalize_rules_csv(_rule_requests(spark, sf))
    return rules.upsert_rules(fx.domain_rules(spark, sf), requests, fx.AS_OF).drop("expires_at")


@query
def delete_rules(spark, sf):
    gone = _domains(spark, sf).filter(F.length("domain") % 5 == 0).select(
        F.concat(F.lit(" "), F.upper("domain")).alias("domain"))
    return rules.delete_by_domain(fx.domain_rules(spark, sf), gone).select(
        "domain", "action", "status")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Plain list entries: hosts of even length."""
    return _domains(spark, sf).filter(F.length("domain") % 2 == 0).select(
        "domain", F.lit("OLD").alias("category"))


@query
def upsert_blocked_entries(spark, sf):
    new = _pages(spark, sf).select(
        F.col("page_id").alias("seq"), _messy_domain().alias("domain"),
        F.when(F.col("page_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("PHISHING"))
        .alias("category"))
    return rules.upsert_blocked_entries(_entries(spark, sf), new)


@query
def delete_blocked_entries(spark, sf):
    gone = _domains(spark, sf).filter(F.length("domain") % 3 == 0)
    return rules.delete_by_domain(_entries(spark, sf), gone)


def _overrides(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select(
        F.col("page_id").alias("id"), "domain", F.lit("A").alias("record_type"),
        F.concat(F.lit("192.0.2."), (F.col("page_id") % 256).cast("string"))
        .alias("ip_address"),
        F.lit(300).alias("ttl"), F.lit(None).cast("string").alias("description"))


@query
def upsert_overrides(spark, sf):
    """Every second record and one unknown id change; a third of the fields is null."""
    i = F.col("id")
    changes = _overrides(spark, sf).filter(i % 2 == 0).select(
        F.when(i == 0, -1).otherwise(i).alias("id"),
        F.when(i % 3 != 0, F.concat(F.lit("new."), "domain")).alias("domain"),
        F.when(i % 3 != 1, "AAAA").alias("record_type"),
        F.lit(None).cast("string").alias("ip_address"),
        F.when(i % 3 != 2, 60).alias("ttl"), F.lit("changed").alias("description"))
    return rules.upsert_overrides(_overrides(spark, sf), changes)


@query
def create_overrides(spark, sf):
    """Hosts of the pages become records beside those of even length; a third has no address,
    some no domain."""
    i = F.col("page_id")
    hosts = _pages(spark, sf).groupBy("domain").agg(F.min("page_id").alias("page_id"))
    known = hosts.filter(F.length("domain") % 2 == 0).select(
        i.alias("id"), "domain", F.lit("A").alias("record_type"),
        F.lit("192.0.2.1").alias("ip_address"), F.lit(60).alias("ttl"),
        F.lit("old").alias("description"))
    new = _pages(spark, sf).select(
        (i + 1).alias("seq"), F.when(i % 11 == 0, " \t").otherwise(F.col("domain")).alias("domain"),
        F.when(i % 2 == 0, "AAAA").alias("record_type"),
        F.when(i % 3 != 0, F.concat(F.lit("192.0.2."), (i % 256).cast("string")))
        .alias("ip_address"),
        F.lit(None).cast("int").alias("ttl"), F.lit("new").alias("description"))
    return rules.create_overrides(known, new)


@query
def lookup_by_domain(spark, sf):
    """Rule, entry and override rows of one host."""
    name = " Example.NET\t"
    return reduce(DataFrame.unionByName, [
        rules.rows_of_domain(rows, name).select(F.lit(kind).alias("kind"), "domain")
        for kind, rows in [("rule", fx.domain_rules(spark, sf)), ("entry", _entries(spark, sf)),
                           ("override", _overrides(spark, sf))]])


@query
def delete_rules_from_list(spark, sf):
    """The blocked set after some domains lost their rule and their list entry."""
    gone = _domains(spark, sf).filter(F.length("domain") % 5 == 0).select(
        F.concat(F.lit("\t"), F.upper("domain"), F.lit("\r")).alias("domain"))
    return matching.blocked_set(*rules.delete_rules_and_entries(
        fx.domain_rules(spark, sf), _entries(spark, sf), gone))


@query
def delete_overrides(spark, sf):
    records = _overrides(spark, sf)
    return rules.delete_overrides(records, records.filter(F.col("id") % 4 == 1))


@query
def lookup_by_key(spark, sf):
    return rollups.rows_of_client(fx.domain_hourly(spark, sf), "c7")


@query
def lookup_by_key_hourly(spark, sf):
    return rollups.rows_of_client(fx.client_hourly(spark, sf), "c7")


@query
def lookup_by_key_category(spark, sf):
    return rollups.rows_of_client(fx.category_hourly(spark, sf), "c7")


@query
def lookup_by_key_stored(spark, sf):
    """One client's hours from facts laid out for lookups: one part is opened."""
    path = scratch_dir(spark, "indexed")
    indexed.write_indexed(fx.client_hourly(spark, sf), path, "client_hash")
    return indexed.lookup(spark, path, "client_hash", "c7")


@query
def lookup_by_domain_stored(spark, sf):
    path = scratch_dir(spark, "indexed")
    indexed.write_indexed(fx.domain_hourly(spark, sf), path, "domain")
    return indexed.lookup(spark, path, "domain", "d7.example")


@query
def rules_by_status(spark, sf):
    return rules.rules_by_status(fx.domain_rules(spark, sf)).select(
        "domain", "action", "match_type")


def _categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the rules, and those of the pages, some of which no rule has."""
    names = F.array(*[F.lit(n) for n in ("MALWARE", "SOCIAL", "", "ADS")])
    return rules.list_categories(fx.domain_rules(spark, sf), _pages(spark, sf).select(
        F.get(names, (F.col("page_id") % 4).cast("int")).alias("name")))


@query
def list_categories(spark, sf):
    return _categories(spark, sf)


@query
def category_by_name(spark, sf):
    return rules.category_by_name(_categories(spark, sf), "MALWARE")


@query
def publish_rule_snapshot(spark, sf):
    """The blocked set of the published version."""
    root = scratch_dir(spark, "snapshot")
    snapshot = rules.rule_snapshot(fx.domain_rules(spark, sf), _entries(spark, sf))
    lists.write_rule_snapshot(*snapshot, root, 1)
    return lists.read_rule_snapshot(spark, root)[1]


def _rule_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Changed rules, several per domain: the last one counts."""
    i = F.col("page_id")
    return _pages(spark, sf).select(
        i.alias("seq"), F.upper("domain").alias("domain"),
        F.when(i % 3 == 0, "ALLOW").otherwise("BLOCK").alias("action"),
        F.when(i % 5 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"),
        F.lit("EXACT").alias("match_type"))


@query
def apply_rule_delta(spark, sf):
    start = matching.blocked_set(fx.domain_rules(spark, sf), _entries(spark, sf))
    delta = _rule_delta(spark, sf)
    return rules.apply_rule_delta(start, delta)


@query
def apply_rule_delta_to_rules(spark, sf):
    snapshot = rules.rules_by_status(fx.domain_rules(spark, sf)).select(
        "domain", "action", "match_type", "status")
    return rules.apply_rule_delta_to_rules(snapshot, _rule_delta(spark, sf))


@query
def latest_rule_version(spark, sf):
    """Two versions are published; the reader takes the newer one."""
    root = scratch_dir(spark, "snapshot")
    table = fx.domain_rules(spark, sf)
    lists.write_rule_snapshot(*rules.rule_snapshot(table), root, 1)
    fewer = table.filter(F.col("action") == "BLOCK")
    lists.write_rule_snapshot(*rules.rule_snapshot(fewer), root, 2)
    version = lists.latest_rule_version(spark, root)
    return lists.read_rule_snapshot(spark, root, version)[0].select(
        F.lit(version).cast("long").alias("version"), "domain", "action")


# --- top lists and reports -------------------------------------------------------------

@query
def top10_domains_client_minute(spark, sf):
    return metrics.top_domains(
        metrics.agg_client_domain_minute(fx.prepared_events(spark, sf)))


@query
def top3_domains_client_day(spark, sf):
    return metrics.top_domains(
        metrics.agg_client_domain_minute(fx.prepared_events(spark, sf), "1 day"), 3)


@query
def top_blocked_domains(spark, sf):
    return reports.top_blocked_domains(fx.domain_hourly(spark, sf))


@query
def top_clients(spark, sf):
    """From events through the hourly tables to the report."""
    events = fx.prepared_events(spark, sf)
    minutes = metrics.agg_client_domain_minute(events)
    return reports.top_clients(
        metrics.hourly_client(metrics.agg_client_minute(events)),
        metrics.hourly_client_domain(metrics.top_domains(minutes)))


@query
def top_clients_from_facts(spark, sf):
    return reports.top_clients(fx.client_hourly(spark, sf), fx.domain_hourly(spark, sf))


@query
def category_breakdown(spark, sf):
    return reports.category_breakdown(fx.category_hourly(spark, sf))


@query
def latest_24_hours(spark, sf):
    return reports.latest_hours(fx.resolver_hourly(spark, sf).select(
        "hour_timestamp", *COUNTERS))


def _by_day(spark: SparkSession, sf: str) -> DataFrame:
    return fx.prepared_events(spark, sf).withColumn("ts", F.date_trunc("day", F.col("ts")))


@query
def clients_over_rate(spark, sf):
    """Seconds are too short for the test events: days stand in, with a small limit."""
    return reports.clients_over_rate(_by_day(spark, sf), 3)


@query
def queries_over_rate(spark, sf):
    return reports.queries_over_rate(_by_day(spark, sf), 2).select("event_id", "client_hash", "ts")


@query
def any_query_report(spark, sf):
    return reports.any_query_report(fx.prepared_events(spark, sf))


def _event_hours(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = fx.prepared_events(spark, sf)
    return (metrics.hourly_resolver(metrics.agg_resolver_minute(events)),
            metrics.hourly_client(metrics.agg_client_minute(events)))


@query
def summary(spark, sf):
    window = fn.resolve_time_window(fx.AS_OF, range="7D")
    return reports.summary(*_event_hours(spark, sf), window)


@query
def summary_all_time(spark, sf):
    window = fn.resolve_time_window(YEAR_2000, range="ALL")
    return reports.summary(fx.resolver_hourly(spark, sf), fx.client_hourly(spark, sf), window)


@query
def traffic_hourly(spark, sf):
    window = fn.resolve_time_window(fx.AS_OF, range="7D")
    return reports.traffic(_event_hours(spark, sf)[0], window, "7D")


@query
def traffic_daily(spark, sf):
    window = fn.resolve_time_window(fx.AS_OF, range="30D")
    return _date_text(reports.traffic(_event_hours(spark, sf)[0], window, "30D"), "date")


@query
def threat_counters(spark, sf):
    return reports.threat_counters(reports.category_breakdown(fx.category_hourly(spark, sf)))


@query
def search_threats(spark, sf):
    return reports.search_threats(reports.top_blocked_domains(fx.domain_hourly(spark, sf)), " D1")


@query
def search_clients(spark, sf):
    clients = reports.top_clients(fx.client_hourly(spark, sf), fx.domain_hourly(spark, sf))
    return reports.search_clients(clients, "MED").select("client_hash", "risk_level")


@query
def search_rules(spark, sf):
    return reports.search_rules(fx.domain_rules(spark, sf), "White").select("domain", "category")


@query
def client_share(spark, sf):
    clients = fx.client_hourly(spark, sf).select("client_hash").distinct()
    return reports.client_category_share(
        reports.category_breakdown(fx.category_hourly(spark, sf)), clients)


@query
def client_activity_share(spark, sf):
    resolver, client = _event_hours(spark, sf)
    window = fn.resolve_time_window(fx.AS_OF, range="7D")
    return reports.client_activity_share(
        reports.traffic_hourly(resolver, window), client.select("client_hash").distinct())


@query
def resolver_rates(spark, sf):
    return reports.query_rate(rollups.traffic_totals(fx.resolver_hourly(spark, sf)), 3)


@query
def resolver_nodes(spark, sf):
    return reports.resolver_nodes(fx.query_events(spark, sf))


# --- retention -------------------------------------------------------------------------

def _stored_facts(spark: SparkSession, sf: str) -> str:
    """Seven years of hours in a fact root, in two epochs with their ledger entries."""
    root = scratch_dir(spark, "facts")
    deltas = fx.hourly_deltas(spark, sf)
    for epoch, part in enumerate((F.col("total_queries") % 2 == 0,
                                  F.col("total_queries") % 2 == 1)):
        rows = deltas.filter(part)
        write_delta(rows.groupBy("hour_timestamp").agg(
            *metrics.sum_counters(COUNTERS_LATENCY)), root, "resolver_hourly_stats", epoch)
        write_delta(rows.groupBy("hour_timestamp", "client_hash").agg(
            *metrics.sum_counters(COUNTERS)), root, "client_hourly_stats", epoch)
        commit(spark, root, epoch)
    return root


@query
def month_rollover(spark, sf):
    """Client months after the job ran twice on stored facts."""
    root = _stored_facts(spark, sf)
    retention.month_rollover(spark, root, YEAR_2000)
    retention.month_rollover(spark, root, YEAR_2000)
    return read_facts(spark, root, "client_monthly_stats")


@query
def month_rollover_daily(spark, sf):
    tables = retention.rollover_tables(fx.hourly_deltas(spark, sf),
                                       fx.hourly_deltas(spark, sf), YEAR_2000)
    return _date_text(tables["client_daily_stats"])


@query
def month_rollover_kept_hours(spark, sf):
    """What the job leaves of the resolver hours."""
    root = _stored_facts(spark, sf)
    retention.month_rollover(spark, root, YEAR_2000)
    return _round_latency(read_facts(spark, root, "resolver_hourly_stats").drop("month"))


@query
def purge_before(spark, sf):
    return rollups.purge_before(fx.category_hourly(spark, sf), YEAR_2000)


@query
def tiered_summary(spark, sf):
    """Months on both sides of the rollover, no month lost or doubled."""
    root = _stored_facts(spark, sf)
    retention.month_rollover(spark, root, YEAR_2000)
    return _round_latency(retention.tiered_summary(spark, root))


@query
def tiered_summary_during_removal(spark, sf):
    """The rollover has committed; its hours are still in place."""
    root = _stored_facts(spark, sf)
    retention.roll_up(spark, root, YEAR_2000)
    return _round_latency(retention.tiered_summary(spark, root))


@query
def purge_detail(spark, sf):
    """Category hours in a fact root after whole months were dropped."""
    root = scratch_dir(spark, "facts")
    write_delta(fx.category_hourly(spark, sf), root, "client_category_hourly", 0)
    retention.purge_detail(spark, root, YEAR_2000)
    return read_facts(spark, root, "client_category_hourly").drop("month")


def _compacted_root(spark: SparkSession, sf: str) -> str:
    """Batches merged in two epochs and compacted; then all are sent again."""
    nested, root = _stored_batches(spark, sf), scratch_dir(spark, "facts")
    for side in (0, 1):
        sink.apply_batches(nested.filter(F.crc32("batch_id") % 2 == side), side, root)
    compaction.compact_months(spark, root, datetime(2024, 2, 1))
    sink.apply_batches(nested, 2, root)
    return root


@query
def compact_months(spark, sf):
    return read_facts(spark, _compacted_root(spark, sf), "client_hourly_stats").drop("month")


@query
def compact_months_domain(spark, sf):
    return read_facts(spark, _compacted_root(spark, sf), "client_top_domains_hourly").drop("month")


# --- streaming -------------------------------------------------------------------------

def _streamed_cube(spark: SparkSession, sf: str) -> str:
    path = scratch_dir(spark, "cube")
    _await(stream.write_cube(fx.prepared_stream(spark, sf), path, scratch_dir(spark, "ckpt")))
    return path


@query
def stream_minute_metrics(spark, sf):
    return stream.resolver_minutes(stream.read_cube(spark, _streamed_cube(spark, sf)))


@query
def stream_client_minutes(spark, sf):
    return stream.client_minutes(stream.read_cube(spark, _streamed_cube(spark, sf)))


@query
def stream_top_domains(spark, sf):
    return stream.client_top_domains(stream.read_cube(spark, _streamed_cube(spark, sf)))


@query
def stream_10min_batches(spark, sf):
    """Client minutes of the batches that the stream has published."""
    path = scratch_dir(spark, "published")
    out = stream.publish_batches(spark, _streamed_cube(spark, sf), path, encoded=False)
    return batches.flatten_clients(messages.read_nested_files(spark, out))


@query
def late_events(spark, sf):
    """Client minutes of two published runs: every third event comes after all the others."""
    cube, path = scratch_dir(spark, "cube"), scratch_dir(spark, "published")
    late = F.col("event_id") % 3 == 0
    for part in (~late, late):
        events = fx.prepared_stream(spark, sf).filter(part)
        _await(stream.write_cube(events, cube, scratch_dir(spark, "ckpt")))
        stream.publish_batches(spark, cube, path, encoded=False)
    rows = batches.flatten_clients(messages.read_nested_files(spark, f"{path}/batches"))
    return stream.client_minutes(rows)


@query
def sink_new_checkpoint(spark, sf):
    """Two halves of the batch files, merged into one root by queries with own checkpoints."""
    nested, root = _stored_batches(spark, sf), scratch_dir(spark, "facts")
    for side in (0, 1):
        landed = scratch_dir(spark, "landed")
        messages.write_batch_files(
            codec.encode_batches(nested.filter(F.crc32("batch_id") % 2 == side)), landed)
        _await(sink.merge_encoded(messages.read_batch_files(spark, landed, stream=True), root,
                                  scratch_dir(spark, "ckpt")))
    return read_facts(spark, root, "client_hourly_stats").drop("month")


@query
def stream_policy_decision(spark, sf):
    root, path = scratch_dir(spark, "snapshot"), scratch_dir(spark, "decided")
    lists.write_rule_snapshot(*rules.rule_snapshot(fx.domain_rules(spark, sf)), root, 1)
    events = fx.query_event_stream(spark, sf).select("event_id", "domain")
    _await(enrich.write_decisions(events, root, path, scratch_dir(spark, "ckpt")))
    return enrich.read_decisions(spark, path).select(
        "event_id", "rule_domain", "listed_parent", "blocked")


@query
def stream_policy_new_checkpoint(spark, sf):
    """Two halves of the events, decided into one folder by queries with own checkpoints; a newer
    rule version comes in between."""
    root, path = scratch_dir(spark, "snapshot"), scratch_dir(spark, "decided")
    table = fx.domain_rules(spark, sf)
    for side, part in enumerate((table, table.filter(F.col("action") == "BLOCK"))):
        lists.write_rule_snapshot(*rules.rule_snapshot(part), root, side + 1)
        events = fx.query_event_stream(spark, sf).select("event_id", "domain")
        _await(enrich.write_decisions(events.filter(F.col("event_id") % 2 == side), root, path,
                                      scratch_dir(spark, "ckpt")))
    return enrich.read_decisions(spark, path).select("event_id", "rule_version", "blocked")


@query
def zero_fill_minutes(spark, sf):
    return metrics.zero_fill_minutes(
        metrics.agg_resolver_minute(fx.prepared_events(spark, sf)))


def _stored_batches(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "nested")
    _batches(spark, sf).write.parquet(path)
    return spark.read.schema(DNS_BATCH).parquet(path)


@query
def dedup_batches(spark, sf):
    """Every batch is delivered three times, in one micro-batch and again in a later one."""
    nested, root = _stored_batches(spark, sf), scratch_dir(spark, "facts")
    sink.apply_batches(nested.unionByName(nested), 0, root)
    sink.apply_batches(nested, 1, root)
    return read_facts(spark, root, "client_hourly_stats").drop("month")


@query
def dedup_stream(spark, sf):
    """Client minutes of a stream in which every batch comes twice; file by file, the second half
    of the month first, and the repeats weeks late."""
    nested = _stored_batches(spark, sf)
    landed, root = scratch_dir(spark, "landed"), scratch_dir(spark, "once")
    late = F.col("window_start_timestamp") < 1705276800
    for part in (nested.filter(~late), nested.filter(late), nested):
        messages.write_nested_files(part.coalesce(2), landed)
    once = messages.read_nested_files(spark, landed, stream=True, maxFilesPerTrigger="1")
    _await(sink.keep_once(once, root, scratch_dir(spark, "ckpt")))
    return batches.flatten_clients(sink.read_once(spark, root))


@query
def late_data(spark, sf):
    """Batches of the second half of the month come first, older ones weeks late."""
    nested, root = _stored_batches(spark, sf), scratch_dir(spark, "facts")
    late = F.col("window_start_timestamp") < 1705276800
    sink.apply_batches(nested.filter(~late), 0, root)
    sink.apply_batches(nested.filter(late), 1, root)
    return _round_latency(read_facts(spark, root, "resolver_hourly_stats").drop("month"))


def _streamed_minutes(spark: SparkSession, sf: str) -> str:
    """Minutes that the stream has closed: four files, the later half of the time first, read in
    two runs of one query, with a heartbeat at the end."""
    landed, path, ckpt = (scratch_dir(spark, n) for n in ("landed", "minutes", "ckpt"))
    events = fx.prepared_events(spark, sf).select(
        "ts", "resolver_id", "action", "is_blocked", "rcode", "cache_hit", "latency_ms")
    last, middle = events.agg(F.max("ts"), F.timestamp_seconds(
        (F.unix_seconds(F.min("ts")) + F.unix_seconds(F.max("ts"))) / 2)).first()
    half = F.col("ts") > F.lit(middle.isoformat(sep=" ")).cast("timestamp")
    odd = F.crc32(F.col("ts").cast("string")) % 2 == 0
    beat = events.limit(1).select(
        (F.lit(last.isoformat(sep=" ")).cast("timestamp") + F.expr("interval 5 minutes"))
        .alias("ts"), "resolver_id",
        *[F.lit(None).cast(t).alias(n) for n, t in events.dtypes if n not in ("ts", "resolver_id")])

    def run() -> None:
        source = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                  .parquet(landed))
        writer = stateful.write_closed(source, path, ckpt).trigger(availableNow=True)
        stateful.start(writer, spark, spark.sparkContext.defaultParallelism).awaitTermination()

    for part in (events.filter(half & odd), events.filter(half & ~odd)):
        part.coalesce(1).write.mode("append").parquet(landed)
    run()
    for part in (events.filter(~half & odd), events.filter(~half & ~odd), beat):
        part.coalesce(1).write.mode("append").parquet(landed)
    run()
    return path


@query
def stream_minute_stateful(spark, sf):
    """Minutes closed by timers, with the corrections that late files brought."""
    rows = spark.read.schema(stateful.CLOSED).parquet(_streamed_minutes(spark, sf))
    return stateful.minute_sums(rows).filter(F.col("total_queries") > 0)


@query
def stream_zero_fill(spark, sf):
    """Every minute up to the last event, from the stream of closed minutes; file by file."""
    minutes, path = _streamed_minutes(spark, sf), scratch_dir(spark, "filled")
    source = (spark.readStream.schema(stateful.CLOSED).option("maxFilesPerTrigger", 20)
              .parquet(minutes))
    writer = (stateful.filled_minutes(source).writeStream.format("parquet").option("path", path)
              .option("checkpointLocation", scratch_dir(spark, "ckpt")).trigger(availableNow=True))
    stateful.start(writer, spark, 1).awaitTermination()
    rows = stateful.minute_sums(spark.read.schema(stateful.FILLED).parquet(path))
    last = fx.query_events(spark, sf).agg(F.date_trunc("minute", F.max("ts")).alias("last"))
    return rows.join(F.broadcast(last), F.col("minute_timestamp") <= F.col("last")).drop("last")


# --- summaries of any period ------------------------------------------------------------

@query
def mv_refresh_fast(spark, sf):
    """The daily view after two commits: all hours but those of 5 o'clock; then, from 1997 on,
    these too, changed hours of 3 o'clock, and those of 2 o'clock deleted."""
    log, view = scratch_dir(spark, "log"), scratch_dir(spark, "view")
    hours, late = fx.resolver_hourly(spark, sf), F.year("hour_timestamp") >= 1997
    at = F.hour("hour_timestamp")
    views.append_log(views.changes(None, hours.filter(at != 5)), log, 1)
    views.refresh(spark, log, view)
    old = hours.filter(late & (at == 3))
    new = (old.withColumn("total_queries", F.col("total_queries") + 7)
           .withColumn("total_latency_ms", F.col("total_latency_ms") + 70)
           .withColumn("avg_latency_ms", F.col("total_latency_ms") / F.col("total_queries")))
    views.append_log(views.changes(old.unionByName(hours.filter(late & (at == 2))),
                                   new.unionByName(hours.filter(late & (at == 5)))), log, 2)
    views.refresh(spark, log, view)
    return (_round_latency(views.read_daily(spark, view))
            .withColumn("weighted_avg_latency_ms", F.round("weighted_avg_latency_ms", 6)))


def _stored_sketches(spark: SparkSession, rows: DataFrame) -> str:
    """Sketches of hours, stored in two epochs that share hours."""
    path = scratch_dir(spark, "sketches")
    for epoch, part in enumerate(rows):
        sketches.write_hours(part, path, epoch)
    return path


def _in_two(df: DataFrame, key: str) -> list[DataFrame]:
    side = F.crc32(F.col(key).cast("string")) % 2
    return [df.filter(side == 0), df.filter(side == 1)]


@query
def distinct_clients_sketch(spark, sf):
    """Clients per month and of all time from stored sketches of hours, beside the exact count."""
    hours = fx.client_hourly(spark, sf)
    path = _stored_sketches(spark, [sketches.client_sketches(p)
                                    for p in _in_two(hours, "client_hash")])
    stored = sketches.read_hours(spark, path)
    months = sketches.merge_sets(stored, F.col("month").alias("period"))
    whole = sketches.merge_sets(months, F.lit("all").alias("period"))
    month = F.date_format("hour_timestamp", "yyyy-MM").alias("period")
    exact = (hours.groupBy(month).agg(F.count_distinct("client_hash").alias("exact"))
             .unionByName(hours.groupBy(F.lit("all").alias("period"))
                          .agg(F.count_distinct("client_hash").alias("exact"))))
    return sketches.with_distinct(months.unionByName(whole)).join(exact, "period")


@query
def distinct_domains_sketch(spark, sf):
    """Domains per client from stored sketches of hours, beside the exact count."""
    hours = fx.domain_hourly(spark, sf)
    path = _stored_sketches(spark, [sketches.domain_sketches(p) for p in _in_two(hours, "domain")])
    clients = sketches.merge_sets(sketches.read_hours(spark, path), "client_hash")
    exact = hours.groupBy("client_hash").agg(F.count_distinct("domain").alias("exact"))
    return sketches.with_distinct(clients).join(exact, "client_hash")


def _stored_latencies(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.query_events(spark, sf)
    return sketches.read_hours(spark, _stored_sketches(
        spark, [sketches.latency_sketches(p) for p in _in_two(events, "event_id")]))


@query
def resolver_p95_hourly(spark, sf):
    hours = sketches.merge_latencies(_stored_latencies(spark, sf), "hour_timestamp", "resolver_id")
    return sketches.with_percentile(hours).select(
        "hour_timestamp", "resolver_id", "measured", F.col("latency_ms").alias("p95_latency_ms"))


@query
def resolver_p95_daily(spark, sf):
    """Days merged from stored hours; at this size the summary holds every value."""
    days = sketches.merge_latencies(
        _stored_latencies(spark, sf),
        F.date_trunc("day", F.col("hour_timestamp")).alias("day_timestamp"), "resolver_id")
    return sketches.with_percentile(days).select(
        "day_timestamp", "resolver_id", "measured", F.col("latency_ms").alias("p95_latency_ms"))


@query
def resolver_p95_monthly(spark, sf):
    """The exact percentile of a month and whether the bounds of the merged summary hold it."""
    months = sketches.with_percentile(sketches.merge_latencies(
        _stored_latencies(spark, sf), F.col("month").alias("year_month"), "resolver_id"))
    exact = (fx.query_events(spark, sf)
             .groupBy(F.date_format("ts", "yyyy-MM").alias("year_month"), "resolver_id")
             .agg(F.expr("percentile_disc(0.95) within group (order by latency_ms)")
                  .cast("long").alias("p95_latency_ms")))
    return months.join(exact, ["year_month", "resolver_id"]).select(
        "year_month", "resolver_id", "measured", "p95_latency_ms",
        F.col("p95_latency_ms").between(F.col("lower_bound"), F.col("upper_bound"))
        .alias("within_bounds"))


@query
def client_domain_bounds(spark, sf):
    """Bounds from day lists of one domain each, per month, beside the exact figure."""
    events = fx.prepared_events(spark, sf)
    days = metrics.agg_client_domain_minute(events, "1 day")
    month = F.date_trunc("month", F.col("minute_timestamp"))
    bounds = sketches.domain_bounds(sketches.listed_domains(days, 1), month)
    exact = (days.groupBy(month.alias("period"), "client_hash", "domain")
             .agg(F.sum("total_queries").alias("exact")))
    return (bounds.join(exact, ["period", "client_hash", "domain"])
            .withColumn("holds", F.col("exact").between(F.col("at_least"), F.col("at_most"))))


#: First and last moment of odd report periods on both sides of the rollover.
RANGES = [
    ("1996-03-10 02:00:00", "1996-03-10 05:00:00"), ("1996-03-10 02:30:00", "1996-03-12 03:10:00"),
    ("1996-02-28 04:00:00", "1996-03-01 02:59:59"), ("1995-12-31 03:00:00", "1997-02-01 00:00:00"),
    ("1994-01-01 00:00:00", "1994-12-31 23:59:59"), ("1993-05-17 06:00:00", "1993-07-02 01:00:00"),
    ("1997-11-30 00:00:00", "2000-06-15 04:00:00"), ("1992-01-01 00:00:00", "2001-01-01 00:00:00"),
    ("2000-01-01 00:00:00", "2000-01-31 05:00:00"), ("1999-12-31 07:00:00", "2000-01-01 01:00:00"),
]


@query
def tiered_range(spark, sf):
    """Totals of odd periods from month, day and hour rows after a rollover that keeps hours."""
    root = _stored_facts(spark, sf)
    retention.roll_up(spark, root, YEAR_2000)
    return _round_latency(reduce(DataFrame.unionByName, [
        tiers.tiered_range(spark, root, fn.TimeWindow(*map(datetime.fromisoformat, r)))
        .withColumn("period", F.lit(i)) for i, r in enumerate(RANGES)]))


#: When the three versions of the test rules were published.
PUBLISHED = {1: "2024-01-05 00:00:00", 2: "2024-01-12 06:30:00", 3: "2024-01-20 12:00:00"}


@query
def policy_decision_as_of(spark, sf):
    """Each event by the version in force when it came: all rules, then only those that block,
    then those on names of even length."""
    table = fx.domain_rules(spark, sf)
    parts = [table, table.filter(F.col("action") == "BLOCK"),
             table.filter(F.length("domain") % 2 == 0)]
    snapshots = asof.all_snapshots({v: (p, matching.blocked_set(p))
                                    for v, p in enumerate(parts, 1)})
    published = spark.createDataFrame(list(PUBLISHED.items()), "version long, at string").select(
        "version", F.col("at").cast("timestamp").alias("published_at"))
    return asof.policy_decision_as_of(
        fx.query_events(spark, sf).select("event_id", "ts", "domain"),
        asof.version_spans(published), asof.policy_intervals(snapshots),
        spread=["event_id"]).select(
            "event_id", F.coalesce("rule_version", F.lit(0)).alias("rule_version"),
            "rule_domain", "blocked")


def _folded(spark: SparkSession, sf: str) -> DataFrame:
    """The events folded into twenty seconds, so that a second is a second."""
    folded = F.timestamp_micros(F.lit(1704067200000000)
                                + F.col("event_id") * 7919 % 20000 * 1000)
    return fx.prepared_events(spark, sf).withColumn("ts", folded)


@query
def clients_over_rate_second(spark, sf):
    return reports.clients_over_rate(_folded(spark, sf), 4)


@query
def clients_over_rate_sliding(spark, sf):
    """Chunks of three seconds, so that there are several."""
    return reports.clients_over_rate_sliding(_folded(spark, sf), 5, chunk_us=3_000_000)
