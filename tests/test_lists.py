"""Rule CSV, domain lists and rule snapshots."""

from __future__ import annotations

import pytest

from querytrail.operators import rules
from querytrail.sources import lists, messages

# An exchange file.
SAMPLE = """Domain,Action,MatchType,Category,Severity,Reason
c2.example,BLOCK,DOMAIN_AND_SUBDOMAINS,MALWARE,CRITICAL,Command server

"https://Track.example/path" ; block ; exact ; tracking ; ; "a; quoted, ""reason"" "
cdn.example,allow,,ADS,,
  ,BLOCK,EXACT,ADS,LOW,no domain
short.example
"""


def read(spark, tmp_path, text, **options):
    path = tmp_path / "rules.csv"
    path.write_text(text)
    rows = rules.normalize_rules_csv(lists.read_rules_csv(spark, str(path), **options))
    return [tuple(r)[2:] for r in rows.orderBy("seq").collect()]


def test_csv_import(spark, tmp_path):
    assert read(spark, tmp_path, SAMPLE) == [
        ("c2.example", "BLOCK", "DOMAIN_AND_SUBDOMAINS", "MALWARE", "CRITICAL", "Command server"),
        ("track.example", "BLOCK", "EXACT", "TRACKING", "HIGH", 'a; quoted, "reason"'),
        ("cdn.example", "ALLOW", "DOMAIN_AND_SUBDOMAINS", "WHITELIST", "LOW", "Whitelist import"),
        ("short.example", "BLOCK", "DOMAIN_AND_SUBDOMAINS", "MALWARE", "HIGH",
         "CSV bulk import rule")]


def test_csv_title_line(spark, tmp_path):
    text = "mydomain.example,BLOCK\r\nb.example,BLOCK\r\n"
    assert [r[0] for r in read(spark, tmp_path, text)] == ["b.example"]
    assert len(read(spark, tmp_path, text, header=False)) == 2
    assert [r[0] for r in read(spark, tmp_path, "a.example\nb.example\n", header=True)] \
        == ["b.example"]


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("".join(f"h{i}.example,BLOCK\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = lists.read_numbered_lines(spark, str(path))
        assert lines.rdd.getNumPartitions() > 2
        got = [r["line"].split(".")[0] for r in lines.orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"h{i}" for i in range(5000)]


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "a.example", "BLOCK", "EXACT", "ADS", "LOW", 'say "hi"; all, right'),
         (2, "b.example", None, "", None, None, None)],
        "seq int, domain string, action string, match_type string, category string,"
        " severity string, reason string")
    path = str(tmp_path / "out")
    lists.write_rules_csv(rows, path)
    back = rules.normalize_rules_csv(lists.read_rules_csv(spark, path, header=True))
    assert sorted(tuple(r)[2:] for r in back.collect()) == [
        ("a.example", "BLOCK", "EXACT", "ADS", "LOW", 'say "hi"; all, right'),
        ("b.example", "BLOCK", "DOMAIN_AND_SUBDOMAINS", "OTHER", "MEDIUM", "CSV bulk import rule")]
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"a.example","BLOCK","EXACT","ADS","LOW","say ""hi""; all, right"' in text
    assert '"b.example","BLOCK","DOMAIN_AND_SUBDOMAINS","OTHER","MEDIUM",""' in text


def test_domain_list(spark, tmp_path):
    path = tmp_path / "domains.dat"
    path.write_text(" a.example \n\nb.example\na.example\n")
    assert sorted(r[0] for r in lists.read_domain_list(spark, str(path)).collect()) == [
        "a.example", "b.example"]


def test_incomplete_snapshot_is_not_taken(spark, tmp_path):
    root = str(tmp_path / "snap")
    assert lists.latest_rule_version(spark, root) is None
    with pytest.raises(ValueError):
        lists.read_rule_snapshot(spark, root)
    frame = spark.createDataFrame([("a",)], "domain string")
    lists.write_rule_snapshot(frame, frame, root, 9)
    lists.write_rule_snapshot(frame, frame, root, 10)
    (tmp_path / "snap" / "rules" / "version=10" / "_SUCCESS").unlink()
    assert lists.latest_rule_version(spark, root) == 9


def test_kafka_options():
    options = messages.kafka_read_options("host:9092", maxOffsetsPerTrigger="100")
    assert options["subscribe"] == "dns.analytics.10min"
    assert options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == "100"
