"""Summaries of any period: sketches, the refreshed view, tiers, rules as of a time, rates."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from querytrail import catalog, oracles
from querytrail import fixtures as fx
from querytrail.functions.timewindow import TimeWindow
from querytrail.operators import asof, matching, rollups, sketches
from querytrail.plans import reports, retention, tiers, views
from querytrail.sources.facts import write_delta
from querytrail.streaming import enrich


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sketches --------------------------------------------------------------------------

def test_distinct_bounds_hold_after_merging(spark):
    """Far more members than a sketch keeps one by one, in hours that share members."""
    rows = spark.range(200_000).select(
        (F.lit("2024-01-01").cast("timestamp")
         + F.make_dt_interval(hours=(F.col("id") % 48).cast("int"))).alias("hour_timestamp"),
        (F.col("id") % 70_000).cast("string").alias("client_hash"))
    days = sketches.with_distinct(sketches.merge_sets(
        sketches.client_sketches(rows), F.to_date("hour_timestamp").alias("day")))
    whole = sketches.with_distinct(sketches.merge_sets(sketches.client_sketches(rows)))
    for r in [*days.collect(), *whole.collect()]:
        exact = 70_000
        if "day" in r.asDict():
            exact = rows.filter(F.to_date("hour_timestamp") == F.lit(r["day"])).select(
                "client_hash").distinct().count()
        assert r["lower_bound"] <= exact <= r["upper_bound"]
        assert r["lower_bound"] <= r["estimate"] <= r["upper_bound"]


def test_percentile_bounds_hold_after_merging(spark):
    events = spark.range(60_000).select(
        (F.lit("2024-01-01").cast("timestamp")
         + F.make_dt_interval(hours=(F.col("id") % 24).cast("int"))).alias("ts"),
        F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("resolver_id"),
        F.when(F.col("id") % 100 > 0, F.pmod(F.xxhash64("id"), F.lit(10_000)))
        .alias("latency_ms"))
    got = sketches.with_percentile(sketches.merge_latencies(
        sketches.latency_sketches(events), "resolver_id")).collect()
    exact = {r["resolver_id"]: r["p"] for r in events.groupBy("resolver_id").agg(
        F.expr("percentile_disc(0.95) within group (order by latency_ms)").alias("p")).collect()}
    for r in got:
        assert r["lower_bound"] <= exact[r["resolver_id"]] <= r["upper_bound"]
        assert r["upper_bound"] - r["lower_bound"] < 300
    assert sum(r["measured"] for r in got) == 59_400


def test_stored_sketches_merge_epochs_and_prune_months(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame(
        [(datetime(2024, m, 1, h), f"c{c}") for m in (1, 2) for h in (0, 5) for c in range(m * 3)],
        "hour_timestamp timestamp, client_hash string")
    odd = F.crc32("client_hash") % 2 == 1
    for epoch, part in ((0, rows.filter(odd)), (1, rows.filter(~odd)), (1, rows.filter(~odd))):
        sketches.write_hours(sketches.client_sketches(part), path, epoch)
    got = sketches.with_distinct(sketches.merge_sets(sketches.read_hours(spark, path), "month"))
    assert {(r["month"], r["estimate"]) for r in got.collect()} == {("2024-01", 3), ("2024-02", 6)}
    one = sketches.read_hours(spark, path, "2024-02", "2024-02")
    assert "PartitionFilters: [isnotnull(month" in _plan(one)
    assert {r["month"] for r in one.collect()} == {"2024-02"}


def test_domain_bounds_enclose_the_exact_figures(spark):
    rows = [(datetime(2024, 1, 1, 0, m), "c", f"d{d}", (d * 7 + m * 3) % 11 + 1)
            for m in range(30) for d in range(8) if (d + m) % 3]
    minutes = spark.createDataFrame(
        rows, "minute_timestamp timestamp, client_hash string, domain string, total_queries long")
    hour = F.date_trunc("hour", F.col("minute_timestamp"))
    for k in (1, 3, 10):
        got = {r["domain"]: r for r in
               sketches.domain_bounds(sketches.listed_domains(minutes, k), hour).collect()}
        for d, r in got.items():
            exact = sum(n for _, _, x, n in rows if x == d)
            assert r["at_least"] <= exact <= r["at_most"]
            assert k < 10 or r["at_least"] == r["at_most"]


# --- the refreshed view ----------------------------------------------------------------

_HOUR = ("hour_timestamp timestamp, total_queries long, blocked_queries long, cache_hits long, "
         "total_latency_ms long, avg_latency_ms double")


def _hours(spark, at, n, factor=1):
    return spark.createDataFrame(
        [(at + timedelta(hours=i), 10 * factor + i, i, 3, (70 + i) * factor, (70 + i) / 7 * factor)
         for i in range(n)], _HOUR)


def _daily(df):
    return sorted((r["stat_date"], r["hourly_windows_count"], r["total_queries"],
                   r["blocked_queries"], r["cache_hits"], round(r["avg_latency_ms"], 6),
                   round(r["weighted_avg_latency_ms"], 6)) for r in df.collect())


def test_view_follows_inserts_updates_and_deletes(spark, tmp_path):
    log, view = str(tmp_path / "log"), str(tmp_path / "view")
    jan, feb, mar = (_hours(spark, datetime(2024, m, 3, 20), 10) for m in (1, 2, 3))
    views.append_log(views.changes(None, jan.unionByName(feb).unionByName(mar)), log, 1)
    assert views.refresh(spark, log, view) == ["2024-01", "2024-02", "2024-03"]
    assert views.refresh(spark, log, view) == []
    more = _hours(spark, datetime(2024, 2, 3, 20), 10, 3)
    views.append_log(views.changes(feb, more), log, 2)         # updates
    views.append_log(views.changes(jan, None), log, 3)         # deletes
    commit, months = views.pending(spark, log, view)
    assert commit == 3 and months == {"2024-01": 1, "2024-02": 1}
    plan = _plan(views.refreshed(spark, log, view, commit, months))
    # Both the log and the view are read for the touched months only.
    assert plan.count("month#") and "2024-03" not in plan
    assert plan.count("PartitionFilters: [") >= 2
    for part in plan.split("PartitionFilters: [")[1:]:
        assert "2024-01" in part.split("]")[0] or "IN" in part.split("PushedFilters")[0]
    assert views.refresh(spark, log, view) == ["2024-01", "2024-02"]
    assert _daily(views.read_daily(spark, view)) == _daily(
        rollups.mv_resolver_daily(more.unionByName(mar)))
    views.append_log(views.changes(None, jan), log, 4)         # and back again
    assert views.refresh(spark, log, view) == ["2024-01"]
    assert _daily(views.read_daily(spark, view)) == _daily(
        rollups.mv_resolver_daily(jan.unionByName(more).unionByName(mar)))


def test_view_survives_a_stop(spark, tmp_path, monkeypatch):
    """A refresh that stops before the old folders go is the same as one that did not."""
    log, view = str(tmp_path / "log"), str(tmp_path / "view")
    first, second = (_hours(spark, datetime(2024, 1, d), 5) for d in (1, 2))
    views.append_log(views.changes(None, first), log, 1)
    views.refresh(spark, log, view)
    views.append_log(views.changes(None, second), log, 2)

    def dies(*a):
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(views, "delete_all", dies)
    with pytest.raises(RuntimeError):
        views.refresh(spark, log, view)
    monkeypatch.undo()
    want = _daily(rollups.mv_resolver_daily(first.unionByName(second)))
    assert _daily(views.read_daily(spark, view)) == want
    assert views.refresh(spark, log, view) == []
    assert _daily(views.read_daily(spark, view)) == want


# --- tiers -----------------------------------------------------------------------------

def test_cover_is_whole_and_least():
    for a, b in [("1996-03-10 02", "1996-03-10 05"), ("1996-02-28 04", "1996-03-01 03"),
                 ("1995-12-31 03", "1997-02-01 01"), ("1994-01-01 00", "1995-01-01 00"),
                 ("1996-01-31 23", "1996-02-01 01"), ("1996-01-01 00", "1996-01-01 00"),
                 ("1993-05-17 06", "1993-07-02 02")]:
        first, end = (datetime.strptime(x, "%Y-%m-%d %H") for x in (a, b))
        c = tiers.cover(first, end)
        spans = sorted([*([c.months] if c.months else []), *c.days, *c.hours])
        at = first
        for x, y in spans:
            assert x == at and x < y
            at = y
        assert at == end or first >= end
        assert sum((y - x for x, y in c.hours), timedelta()) < 2 * tiers.DAY
        assert sum((y - x for x, y in c.days), timedelta()) < timedelta(62)


@pytest.fixture(scope="module")
def rolled(spark, sf_dir):
    root = catalog._stored_facts(spark, sf_dir)
    retention.roll_up(spark, root, catalog.YEAR_2000)
    return root


def test_covered_months_stay_unread(spark, rolled):
    window = TimeWindow(datetime(1995, 12, 31, 3), datetime(1997, 2, 1, 0))
    plan = _plan(tiers.range_rows(spark, rolled, window))
    rows = tiers.range_rows(spark, rolled, window)
    files = rows.select(F.input_file_name().alias("f")).distinct().collect()
    hours = {r["f"].split("/month=")[1][:7] for r in files if "/month=" in r["f"]}
    assert hours <= {"1995-12", "1997-02"} and "resolver_monthly_stats" in plan


def test_late_hours_of_a_rolled_month_count_once(spark, sf_dir):
    root = catalog._stored_facts(spark, sf_dir)
    retention.roll_up(spark, root, catalog.YEAR_2000)
    late = fx.hourly_deltas(spark, sf_dir).filter(
        (F.col("hour_timestamp") >= "1996-03-01") & (F.col("hour_timestamp") < "1996-03-09"))
    rows = late.groupBy("hour_timestamp").agg(
        *[F.sum(c).alias(c) for c in tiers.COUNTERS_LATENCY])
    window = TimeWindow(datetime(1996, 2, 10, 2), datetime(1996, 5, 5, 4))
    before = tiers.tiered_range(spark, root, window).first()["total_queries"]
    write_delta(rows, root, "resolver_hourly_stats", 2)
    catalog.commit(spark, root, 2)
    after = tiers.tiered_range(spark, root, window).first()["total_queries"]
    assert after - before == rows.agg(F.sum("total_queries")).first()[0]


def test_ranges_whose_hours_are_gone_are_refused(spark, sf_dir):
    root = catalog._stored_facts(spark, sf_dir)
    retention.month_rollover(spark, root, catalog.YEAR_2000)
    whole = TimeWindow(datetime(1995, 3, 4), datetime(1996, 7, 8, 23, 59, 59))
    want = fx.hourly_deltas(spark, sf_dir).filter(
        F.col("hour_timestamp").between("1995-03-04", "1996-07-08 23:59:59"))
    assert tiers.tiered_range(spark, root, whole).first()["total_queries"] == want.agg(
        F.sum("total_queries")).first()[0]
    with pytest.raises(ValueError, match="hours of 1995-03 are gone"):
        tiers.tiered_range(spark, root, TimeWindow(datetime(1995, 3, 4, 5),
                                                   datetime(1996, 7, 8, 23)))


# --- rules as of a time ----------------------------------------------------------------

def _rules(spark, rows):
    return spark.createDataFrame(
        [(d, a, "DOMAIN_AND_SUBDOMAINS", "ACTIVE") for d, a in rows],
        "domain string, action string, match_type string, status string")


def test_rules_hold_from_their_version_to_the_next(spark):
    none = spark.createDataFrame([], "domain string")
    parts = {1: [("a.org", "BLOCK"), ("b.org", "BLOCK")], 2: [("a.org", "BLOCK")],
             4: [("a.org", "ALLOW"), ("b.org", "BLOCK")], 5: [("a.org", "ALLOW"), ("b.org", "BLOCK")]}
    snapshots = asof.all_snapshots({v: (_rules(spark, r), none) for v, r in parts.items()})
    intervals = asof.policy_intervals(snapshots)
    assert sorted((r["rule_domain"], r["rule_block"], r["first_version"], r["last_version"])
                  for r in intervals.collect()) == [
        ("a.org", False, 4, 5), ("a.org", True, 1, 2), ("b.org", True, 1, 1),
        ("b.org", True, 4, 5)]
    day = {1: 1, 2: 3, 4: 3, 5: 9}  # 2 and 4 on the same day: the higher holds
    published = spark.createDataFrame([(v, datetime(2024, 1, d)) for v, d in day.items()],
                                      "version long, published_at timestamp")
    rows = [(i, datetime(2024, 1, d, h), n) for i, (d, h, n) in enumerate([
        (1, 0, "x.a.org"), (2, 23, "b.org"), (3, 0, "a.org"), (8, 23, "y.b.org"), (9, 0, "a.org"),
        (30, 5, "b.org"), (2, 5, None), (2, 6, "c.org")])]
    rows.append((99, datetime(2023, 12, 31, 23), "a.org"))
    rows.append((98, None, "a.org"))
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, domain string")
    got = {r["event_id"]: (r["rule_version"], r["blocked"]) for r in asof.policy_decision_as_of(
        events, asof.version_spans(published), intervals).collect()}
    assert got == {0: (1, True), 1: (1, True), 2: (4, False), 3: (4, True), 4: (5, False),
                   5: (5, True), 6: (1, False), 7: (1, False), 99: (None, False),
                   98: (None, False)}


def test_one_version_decides_like_the_plain_way(spark, sf_dir):
    table = fx.domain_rules(spark, sf_dir)
    events = fx.query_events(spark, sf_dir).select("event_id", "ts", "domain")
    blocked = matching.blocked_set(table)
    published = spark.createDataFrame([(7, datetime(2000, 1, 1))],
                                      "version long, published_at timestamp")
    got = asof.policy_decision_as_of(
        events, asof.version_spans(published),
        asof.policy_intervals(asof.all_snapshots({7: (table, blocked)})), spread=["event_id"])
    want = matching.policy_decision(events, table, blocked, spread=["event_id"])
    columns = ["event_id", "rule_domain", "listed_parent", "blocked"]
    assert got.select(*columns).exceptAll(want.select(*columns)).isEmpty()
    assert got.count() == want.count() and {r[0] for r in got.select("rule_version").distinct()
                                            .collect()} == {7}


def test_decisions_keep_their_version_when_done_again(spark, tmp_path, monkeypatch):
    """A micro-batch that stops after its version was chosen takes the same one again, and a
    query with a new checkpoint writes beside the old one."""
    root, path, landed = (str(tmp_path / n) for n in ("rules", "out", "in"))
    none = spark.createDataFrame([], "domain string")
    events = spark.createDataFrame([(i, "a.org") for i in range(20)],
                                   "event_id long, domain string")
    events.write.parquet(landed)

    def run(ckpt):
        source = spark.readStream.schema(events.schema).parquet(landed)
        enrich.write_decisions(source, root, path, str(tmp_path / ckpt)).trigger(
            availableNow=True).start().awaitTermination()

    from querytrail.sources.lists import write_rule_snapshot
    write_rule_snapshot(_rules(spark, [("a.org", "BLOCK")]), none, root, 1)
    real, calls = enrich.decide, []

    def dies(*a, **k):
        calls.append(1)
        raise RuntimeError("lost the driver")

    monkeypatch.setattr(enrich, "decide", dies)
    with pytest.raises(Exception, match="lost the driver"):
        run("c1")
    monkeypatch.setattr(enrich, "decide", real)
    write_rule_snapshot(_rules(spark, [("a.org", "ALLOW")]), none, root, 2)
    run("c1")
    rows = enrich.read_decisions(spark, path).collect()
    assert len(rows) == 20 and {(r["rule_version"], r["blocked"]) for r in rows} == {(1, True)}
    run("c2")
    rows = enrich.read_decisions(spark, path).collect()
    assert len(rows) == 40 and {(r["rule_version"], r["blocked"]) for r in rows} == {
        (1, True), (2, False)}


# --- rates -----------------------------------------------------------------------------

@pytest.mark.parametrize("chunk", [3_000_000, 1_500_000, 600_000_000])
def test_sliding_second_crosses_seconds_and_chunks(spark, chunk):
    import random

    rng = random.Random(2)
    base = datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"c{i % 5}",
             base + timedelta(microseconds=rng.randrange(0, 12_000) * 1000)) for i in range(900)]
    rows += [(1000 + i, "tie", base + timedelta(seconds=3)) for i in range(6)]
    rows += [(2000, "edge", base), (2001, "edge", base + timedelta(seconds=1)),
             (2002, "edge", base + timedelta(microseconds=999_999))]
    events = spark.createDataFrame(rows, "event_id long, client_hash string, ts timestamp")
    by = {}
    for i, c, t in rows:
        by.setdefault(c, []).append((t, i))
    want = set()
    for c, ts in by.items():
        for t, i in ts:
            n = sum(t - timedelta(seconds=1) < u <= t for u, _ in ts)
            if n > 1:
                want.add((c, i, n))
    got = reports.clients_over_rate_sliding(events, 1, chunk_us=chunk).collect()
    assert {(r["client_hash"], r["event_id"], r["queries"]) for r in got} == want
    assert len(got) == len(want) and all(r["over_limit"] == r["queries"] - 1 for r in got)


# --- at the size of the correctness run ------------------------------------------------

@pytest.mark.parametrize("name", ["distinct_clients_sketch", "distinct_domains_sketch",
                                  "resolver_p95_daily", "resolver_p95_monthly"])
def test_sketches_agree_at_ten_times_the_size(spark, sf_dir, name):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    theirs = connect(larger).execute(oracles.ORACLES[name]).df()
    assert differences(catalog.QUERIES[name](spark, larger).toPandas(), theirs) is None
