"""Batches, codec, merge sink, streams and retention: nothing lost, nothing counted twice."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from querytrail.operators import batches, merge, metrics, rollups
from querytrail.plans import facts, retention
from querytrail.schemas import DNS_BATCH, DNS_QUERY_EVENTS, FACT_KEYS
from querytrail.sources import codec, messages
from querytrail.sources.facts import read_deltas, read_facts, write_delta
from querytrail.sources.paths import subfolders
from querytrail.streaming import metrics as stream
from querytrail.streaming import sink

START = datetime(2024, 3, 31, 23, 40)
HOURLY = retention.HOURLY_TABLES


def some_events(n=400):
    """Forty minutes across a month end; client 0 and domain 0 hold a third of the rows."""
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        rows.append((
            i, START + timedelta(seconds=6 * i), None if i % 50 == 7 else f"10.0.0.{0 if hot else i % 9}",
            f"D{0 if hot else i % 31}.Test." if i % 41 else None, "A",
            "BLOCKED" if i % 4 == 0 else "RESOLVED", ["ADS", "", None, "MALWARE"][i % 4],
            i % 5 == 0, i % 70, [0, 2, 3][i % 3], f"r{i % 2}"))
    return rows


@pytest.fixture(scope="module")
def events(spark):
    raw = spark.createDataFrame(some_events(), DNS_QUERY_EVENTS)
    return metrics.prepare_events(raw, "test").cache()


@pytest.fixture(scope="module")
def cube(spark, events, tmp_path_factory):
    return facts.write_event_cube(events, str(tmp_path_factory.mktemp("cube") / "c"))


@pytest.fixture(scope="module")
def nested(spark, cube, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("nested") / "n")
    batches.assemble_batches(cube).write.parquet(path)
    return spark.read.schema(DNS_BATCH).parquet(path)


def rows_of(df):
    names = sorted(df.columns)
    return sorted(map(str, (tuple(r[n] for n in names) for r in df.collect())))


def tables_of(spark, root):
    return {t: rows_of(read_facts(spark, root, t).drop("month")) for t in HOURLY}


@pytest.fixture(scope="module")
def expected(cube):
    return {t: rows_of(df) for t, df in facts.hourly_facts(cube).items()}


def test_totals_agree(events):
    resolver = metrics.agg_resolver_minute(events)
    client = metrics.agg_client_minute(events)
    assert resolver.filter("allowed_queries + blocked_queries <> total_queries").isEmpty()
    assert resolver.filter("cache_hits + cache_misses <> total_queries").isEmpty()
    names = [c for c in resolver.columns if c != "minute_timestamp"]
    sums = client.groupBy("minute_timestamp").agg(*metrics.sum_counters(names))
    assert rows_of(sums) == rows_of(resolver)
    assert events.filter("client_hash = 'unknown'").count() == 8


def test_top_list_cuts_and_breaks_ties_by_name(spark):
    rows = spark.createDataFrame([(START, "c", f"d{i:02d}", 5 if i < 3 else 1, 0)
                                  for i in range(14)],
                                 "minute_timestamp timestamp, client_hash string, domain string,"
                                 " total_queries long, blocked_queries long")
    got = metrics.top_domains(rows).orderBy("domain_rank").collect()
    assert [r["domain"] for r in got] == [f"d{i:02d}" for i in range(10)]
    assert [r["domain_rank"] for r in got] == list(range(1, 11))
    plan = metrics.top_domains(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_parts_carry_the_same_facts(cube, nested, expected):
    resolvers = nested.select("resolver_id", "window_start_timestamp").distinct().count()
    assert nested.count() > resolvers
    # A part of the cube has the batch ids of the whole.
    ids = {r["batch_id"] for r in nested.select("batch_id").collect()}
    some = batches.assemble_batches(cube.filter(F.crc32("client_hash") % 2 == 0))
    assert {r["batch_id"] for r in some.select("batch_id").collect()} <= ids
    for table, delta in sink.hourly_deltas(nested).items():
        if table == "client_hourly_stats":
            assert rows_of(delta) == expected[table]
        if table == "resolver_hourly_stats":
            assert rows_of(delta.drop("avg_latency_ms")) == rows_of(
                facts.hourly_facts(cube)[table].drop("avg_latency_ms"))


def test_codec_round_trip(nested):
    back = codec.good_batches(codec.decode_batches(codec.encode_batches(nested)))
    assert back.schema == DNS_BATCH
    assert rows_of(back) == rows_of(nested)


def test_wire_bytes_are_plain_protobuf():
    """Field 1 is a string, field 3 a varint: checked against bytes written by hand."""
    import zstandard
    value = codec.encode_row({"batch_id": "b", "window_start_timestamp": 300})
    assert zstandard.ZstdDecompressor().decompress(value) == b"\x0a\x01b\x18\xac\x02"
    assert codec.decode_value(value)["minutes"] == []


def test_unreadable_messages_are_set_aside(spark, nested):
    good = codec.encode_batches(nested)
    bad = spark.createDataFrame([("x", bytearray(b"no zstd")), ("y", None), ("z", bytearray(b"")),
                                 ("w", bytearray(codec.encode_row({"batch_id": " "})))],
                                "key string, value binary")
    decoded = codec.decode_batches(good.unionByName(bad)).cache()
    assert codec.good_batches(decoded).count() == nested.count()
    dead = codec.bad_batches(decoded).collect()
    assert len(dead) == 4 and all(r["error"] for r in dead)
    assert {r["key"] for r in dead} == {"w", "x", "y", "z"}


def test_any_split_and_order_gives_the_same_tables(spark, nested, expected, tmp_path):
    parity = F.crc32("batch_id") % 2
    for order in ((0, 1), (1, 0)):
        root = str(tmp_path / f"r{order[0]}")
        for epoch, side in enumerate(order):
            sink.apply_batches(nested.filter(parity == side), epoch, root)
        got = tables_of(spark, root)
        for table in HOURLY[:3]:
            assert got[table] == expected[table], table
        # Equal but for the rank, where batch ids decide between resolvers of one minute.
        assert len(got[HOURLY[3]]) == len(expected[HOURLY[3]])


def test_repeats_are_not_counted(spark, nested, expected, tmp_path):
    root = str(tmp_path / "r")
    sink.apply_batches(nested.unionByName(nested), 0, root)
    sink.apply_batches(nested, 0, root)  # the same micro-batch once more
    sink.apply_batches(nested, 1, root)  # the same batches later
    got = tables_of(spark, root)
    assert got[HOURLY[1]] == expected[HOURLY[1]]


def test_interrupted_epoch_is_redone(spark, nested, expected, tmp_path, monkeypatch):
    root, done = str(tmp_path / "r"), []

    def dies(rows, base, table, *which):
        if len(done) == 2:
            raise RuntimeError("lost the driver")
        done.append(table)
        write_delta(rows, base, table, *which)

    monkeypatch.setattr(sink, "write_delta", dies)
    with pytest.raises(RuntimeError):
        sink.apply_batches(nested, 0, root)
    assert not sink.is_applied(spark, root, 0)
    monkeypatch.undo()
    # What the lost attempt wrote is not shown.
    assert all(read_facts(spark, root, t).isEmpty() for t in HOURLY)
    sink.apply_batches(nested, 0, root)
    got = tables_of(spark, root)
    for table in HOURLY:
        if table != HOURLY[3]:
            assert got[table] == expected[table], table


def test_stream_sink_restarts_where_it_stopped(spark, nested, expected, tmp_path):
    landing, root, ckpt = (str(tmp_path / n) for n in ("in", "facts", "ckpt"))
    encoded = codec.encode_batches(nested)
    late = F.crc32("key") % 2 == 0
    for part in (encoded.filter(late), encoded.filter(~late),
                 spark.createDataFrame([("bad", bytearray(b"?"))], "key string, value binary")):
        messages.write_batch_files(part, landing)
        source = messages.read_batch_files(spark, landing, stream=True)
        query = sink.merge_encoded(source, root, ckpt).trigger(availableNow=True).start()
        query.awaitTermination()
    got = tables_of(spark, root)
    for table in HOURLY[:3]:
        assert got[table] == expected[table], table
    assert sink.read_dead_letters(spark, root).count() == 1


def land_events(spark, path, rows, stamp):
    import os
    spark.createDataFrame(rows, DNS_QUERY_EVENTS).coalesce(1).write.mode("append").parquet(path)
    for name in os.listdir(path):  # files are read in the order of their times
        full = os.path.join(path, name)
        if os.path.getmtime(full) > stamp + 1000:
            os.utime(full, (stamp, stamp))


def test_no_event_is_too_late(spark, events, tmp_path):
    """Three files in any order of time; the batches of two runs add up to all events."""
    rows = sorted(some_events(), key=lambda r: r[1])
    landing, cube, out = (str(tmp_path / n) for n in ("in", "cube", "out"))
    land_events(spark, landing, rows[200:], 1_000_000)
    land_events(spark, landing, rows[:100], 1_010_000)

    def take():
        raw = (spark.readStream.schema(DNS_QUERY_EVENTS).option("maxFilesPerTrigger", 1)
               .parquet(landing))
        (stream.write_cube(metrics.prepare_events(raw, "test"), cube, str(tmp_path / "ckpt"))
         .trigger(availableNow=True).start().awaitTermination())

    take()
    assert stream.publish_batches(spark, cube, out)
    assert stream.publish_batches(spark, cube, out) is None
    land_events(spark, landing, rows[100:200], 1_020_000)
    take()
    assert stream.publish_batches(spark, cube, out).endswith("run=1")
    want = rows_of(metrics.agg_client_minute(events))
    assert rows_of(stream.client_minutes(stream.read_cube(spark, cube))) == want
    sent = codec.good_batches(codec.decode_batches(messages.read_batch_files(
        spark, f"{out}/batches")))
    assert rows_of(stream.client_minutes(batches.flatten_clients(sent))) == want
    ids = [r["batch_id"] for r in sent.select("batch_id").collect()]
    assert len(ids) == len(set(ids))


def test_dedup_stream_drops_repeats(spark, nested, tmp_path):
    landing = str(tmp_path / "in")
    nested.unionByName(nested).write.parquet(landing)
    once = sink.dedup_stream(spark.readStream.schema(DNS_BATCH).parquet(landing))
    (once.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt"))
     .option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination())
    assert spark.read.parquet(str(tmp_path / "out")).count() == nested.count()


def land_backwards(spark, nested, landing):
    """The newest batches first, older ones months late, then all again; each with a batch
    without an id."""
    import os
    late = F.col("window_start_timestamp") < START.timestamp() + 1200
    old = nested.filter(late).withColumn(
        "window_start_timestamp", F.col("window_start_timestamp") - 90 * 86400)
    new = nested.filter(~late)
    none = nested.limit(1).withColumn("batch_id", F.lit(None).cast("string"))
    seen = set()
    for n, part in enumerate((new, old, new.unionByName(old))):
        part.unionByName(none).coalesce(1).write.mode("append").parquet(landing)
        for name in set(os.listdir(landing)) - seen:  # files are read in the order of their times
            os.utime(os.path.join(landing, name), (1_000_000 + n, 1_000_000 + n))
        seen = set(os.listdir(landing))
    return (spark.readStream.schema(DNS_BATCH).option("maxFilesPerTrigger", 1).parquet(landing),
            rows_of(new.unionByName(old).select("batch_id", "window_start_timestamp")))


def test_dedup_stream_keeps_late_batches(spark, nested, tmp_path):
    landed, want = land_backwards(spark, nested, str(tmp_path / "in"))
    (sink.dedup_stream(landed).writeStream.format("parquet")
     .option("checkpointLocation", str(tmp_path / "ckpt")).option("path", str(tmp_path / "out"))
     .trigger(availableNow=True).start().awaitTermination())
    out = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(out.filter("batch_id is not null")
                   .select("batch_id", "window_start_timestamp")) == want
    assert out.filter("batch_id is null").count() == 3


def test_keep_once_keeps_late_batches(spark, nested, tmp_path):
    landed, want = land_backwards(spark, nested, str(tmp_path / "in"))
    root = str(tmp_path / "r")
    (sink.keep_once(landed, root, str(tmp_path / "ckpt"))
     .trigger(availableNow=True).start().awaitTermination())
    out = sink.read_once(spark, root)
    assert rows_of(out.select("batch_id", "window_start_timestamp")) == want
    assert sink.read_dead_letters(spark, root).count() == 3


def test_ledger_knows_batches_without_a_time(spark, nested, tmp_path):
    root = str(tmp_path / "r")
    timeless = nested.limit(2).withColumn("window_start_timestamp", F.lit(None).cast("long"))
    sink.apply_batches(timeless, 0, root)
    want = tables_of(spark, root)
    sink.apply_batches(timeless, 1, root)
    assert tables_of(spark, root) == want


def test_upserts_do_not_care_about_splits(cube):
    for table, whole in facts.hourly_facts(cube).items():
        if table == "client_top_domains_hourly":
            continue
        parts = [facts.hourly_facts(cube.filter(F.crc32("client_hash") % 3 == i))[table]
                 for i in range(3)]
        merged = merge.upsert_facts(merge.upsert_facts(parts[2], parts[0], table), parts[1], table)
        assert rows_of(merged) == rows_of(whole), table


def stored(spark, nested, root):
    sink.apply_batches(nested, 0, root)
    return root


def test_rollover_keeps_every_query(spark, nested, tmp_path):
    root = stored(spark, nested, str(tmp_path / "r"))
    before = rows_of(retention.tiered_summary(spark, root))
    as_of = datetime(2024, 4, 15)
    retention.month_rollover(spark, root, as_of)
    assert rows_of(retention.tiered_summary(spark, root)) == before
    assert {r["month"] for t in HOURLY for r in read_deltas(spark, root, t)
            .select("month").distinct().collect()} == {"2024-04"}
    # Late hours of the rolled month are added by the next rollover, not lost or doubled.
    late = nested.filter(F.col("window_start_timestamp") < START.timestamp() + 1200).withColumn(
        "batch_id", F.concat("batch_id", F.lit("-late")))
    sink.apply_batches(late, 1, root)
    after = rows_of(retention.tiered_summary(spark, root))
    retention.month_rollover(spark, root, as_of)  # this month has been done
    assert rows_of(retention.tiered_summary(spark, root)) == after
    retention.month_rollover(spark, root, datetime(2024, 5, 1))
    assert rows_of(retention.tiered_summary(spark, root)) == after
    assert read_deltas(spark, root, "client_hourly_stats").isEmpty()
    days = read_facts(spark, root, "client_daily_stats")
    months = read_facts(spark, root, "client_monthly_stats")
    total = F.sum("total_queries").alias("n")
    assert days.agg(total).first() == months.agg(total).first()


@pytest.mark.parametrize("stop_at", range(1, 5))
def test_rollover_survives_a_stop(spark, nested, tmp_path, monkeypatch, stop_at):
    root = stored(spark, nested, str(tmp_path / "r"))
    before = rows_of(retention.tiered_summary(spark, root))
    calls = []

    def dies(*arguments):
        calls.append(1)
        if len(calls) == stop_at:
            raise RuntimeError("lost the driver")
        write_delta(*arguments)

    monkeypatch.setattr(retention, "write_delta", dies)
    with pytest.raises(RuntimeError):
        retention.month_rollover(spark, root, datetime(2024, 4, 15))
    monkeypatch.undo()
    retention.month_rollover(spark, root, datetime(2024, 4, 15))
    assert rows_of(retention.tiered_summary(spark, root)) == before


@pytest.mark.parametrize("stop_at", range(1, 5))
def test_stopped_rollover_then_another_month(spark, nested, tmp_path, monkeypatch, stop_at):
    root = stored(spark, nested, str(tmp_path / "r"))
    before = rows_of(retention.tiered_summary(spark, root))
    calls = []

    def dies(*arguments):
        write_delta(*arguments)
        calls.append(1)
        if len(calls) == stop_at:
            raise RuntimeError("lost the driver")

    monkeypatch.setattr(retention, "write_delta", dies)
    with pytest.raises(RuntimeError):
        retention.month_rollover(spark, root, datetime(2024, 4, 15))
    monkeypatch.undo()
    assert rows_of(retention.tiered_summary(spark, root)) == before
    retention.month_rollover(spark, root, datetime(2024, 5, 2))
    assert rows_of(retention.tiered_summary(spark, root)) == before
    total = F.sum("total_queries").alias("n")
    assert (read_facts(spark, root, "client_daily_stats").agg(total).first()
            == nested_total(nested))


def nested_total(nested):
    return batches.flatten_clients(nested).agg(F.sum("total_queries").alias("n")).first()


def test_rolled_hours_are_hidden_before_they_are_removed(spark, nested, tmp_path, monkeypatch):
    root = stored(spark, nested, str(tmp_path / "r"))
    before = rows_of(retention.tiered_summary(spark, root))
    monkeypatch.setattr(retention, "_drop_months", lambda *a: None)
    retention.month_rollover(spark, root, datetime(2024, 4, 15))
    assert rows_of(retention.tiered_summary(spark, root)) == before
    assert {r["month"] for r in read_deltas(spark, root, "client_hourly_stats")
            .select("month").distinct().collect()} == {"2024-04"}


def test_new_checkpoint_loses_nothing(spark, nested, expected, tmp_path):
    """Two queries with checkpoints of their own, other files each, then one file again."""
    root, parity = str(tmp_path / "r"), F.crc32("batch_id") % 2
    for side in (0, 1):
        landed = str(tmp_path / f"landed{side}")
        codec.encode_batches(nested.filter(parity == side)).write.parquet(landed)
    for n, side in enumerate((0, 1, 0)):
        rows = messages.read_batch_files(spark, str(tmp_path / f"landed{side}"), stream=True)
        query = (sink.merge_encoded(rows, root, str(tmp_path / f"ckpt{n}"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    assert tables_of(spark, root)[HOURLY[1]] == expected[HOURLY[1]]
    assert sink.read_dead_letters(spark, root).isEmpty()


def test_time_filters_prune_months(spark, nested, tmp_path):
    from querytrail.functions.timewindow import TimeWindow, filter_between
    root = stored(spark, nested, str(tmp_path / "r"))
    facts_ = read_facts(spark, root, "client_hourly_stats")
    window = TimeWindow(datetime(2024, 4, 1), datetime(2024, 4, 1, 1))
    for rows in (filter_between(facts_, window),
                 rollups.rows_before(facts_, datetime(2024, 4, 2))):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "(month" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_rollover_finishes_an_unfinished_removal(spark, nested, tmp_path, monkeypatch):
    root = stored(spark, nested, str(tmp_path / "r"))
    before = rows_of(retention.tiered_summary(spark, root))
    monkeypatch.setattr(retention, "_drop_months", lambda *a: None)
    retention.month_rollover(spark, root, datetime(2024, 4, 15))
    monkeypatch.undo()
    retention.month_rollover(spark, root, datetime(2024, 4, 15))
    assert rows_of(retention.tiered_summary(spark, root)) == before


def test_purge_detail_drops_whole_months(spark, nested, tmp_path):
    root = stored(spark, nested, str(tmp_path / "r"))
    retention.purge_detail(spark, root, datetime(2024, 4, 20))
    assert subfolders(spark, f"{root}/client_category_hourly") == ["month=2024-04"]
    assert len(subfolders(spark, f"{root}/client_hourly_stats")) == 2


def test_month_filter_reaches_the_partitions(spark, nested, tmp_path):
    root = stored(spark, nested, str(tmp_path / "r"))
    plan = (read_facts(spark, root, "client_hourly_stats").filter("month = '2024-04'")
            ._jdf.queryExecution().executedPlan().toString())
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "(month" in pruned and "(epoch" in pruned
    assert FACT_KEYS["client_hourly_stats"] == ["hour_timestamp", "client_hash"]


def test_zero_fill_has_every_minute(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1, 23, 58), 1), (datetime(2024, 1, 3), 2)],
                                 "minute_timestamp timestamp, total_queries long")
    got = metrics.zero_fill_minutes(rows)
    assert got.count() == 2 + 1440 + 1
    assert got.agg(F.sum("total_queries")).first()[0] == 3
    assert got.select("minute_timestamp").distinct().count() == got.count()
    assert metrics.zero_fill_minutes(rows.limit(0)).isEmpty()


def test_tiers_add_up(spark, sf_dir):
    from querytrail import fixtures as fx
    hourly = fx.resolver_hourly(spark, sf_dir)
    total = F.sum("total_queries").alias("n")
    want = hourly.agg(total).first()
    assert rollups.daily_resolver(hourly).agg(total).first() == want
    assert rollups.monthly_resolver(hourly).agg(total).first() == want
