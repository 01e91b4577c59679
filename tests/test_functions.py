from __future__ import annotations

import hashlib
import hmac
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querytrail import functions as fn

AS_OF = datetime(2024, 2, 29, 12)


def column(spark, values, expression):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


@pytest.mark.parametrize("secret", ["k", "x" * 64, "y" * 65, "schlüssel"])
def test_client_hash_is_hmac_sha256(spark, secret):
    addresses = ["10.0.0.1", "::1", " 10.0.0.1", "", " \t", None]
    expected = [hmac.new(secret.encode(), a.encode(), hashlib.sha256).hexdigest()[:16]
                for a in addresses[:3]] + ["unknown"] * 3
    assert column(spark, addresses, fn.client_hash(F.col("x"), secret)) == expected


def test_client_hash_needs_a_secret():
    with pytest.raises(ValueError):
        fn.client_hash(F.col("x"), "")


def walk(domain: str) -> list[str]:
    """Parents by the definition: cut at the first dot unless it leads or trails."""
    out = []
    while domain:
        out.append(domain)
        dot = domain.find(".")
        if not 0 < dot < len(domain) - 1:
            break
        domain = domain[dot + 1:]
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab.", max_size=9), min_size=40, max_size=60))
def test_domain_suffixes_follow_the_definition(spark, domains):
    got = column(spark, domains, F.transform(fn.domain_suffixes(F.col("x")),
                                             lambda s: s["suffix"]))
    assert got == [walk(d) for d in domains]


def test_normalize_and_strip(spark):
    assert column(spark, ["A.B.", "a.b..", " a.b. ", None], fn.normalize_domain(F.col("x"))) \
        == ["a.b", "a.b.", " a.b. ", None]
    assert column(spark, [" A.B. "], fn.normalize_domain(F.col("x"), trim=True)) == ["a.b"]
    assert column(spark, ["HTTPS://A.b/c?d", "http://x", "plain.org", "ftp://x/y"],
                  fn.strip_url_to_domain(F.col("x"))) == ["a.b", "x", "plain.org", "ftp:"]


def test_round_half_up_keeps_binary_value(spark):
    got = spark.range(1).select(
        fn.round_half_up(F.lit(0.125), 2), fn.round_half_up(F.lit(2.5)),
        fn.round_half_up(F.lit(1.005), 2), fn.pct(F.lit(1), F.lit(0))).first()
    assert tuple(got) == (0.13, 3.0, 1.0, 0.0)


def test_risk_bounds_are_exclusive(spark):
    got = spark.range(1).select(*[fn.risk_level(F.lit(r)) for r in (20.1, 20.0, 5.1, 5.0)])
    assert tuple(got.first()) == ("HIGH", "MEDIUM", "MEDIUM", "LOW")


def test_classify_outcome_cases(spark):
    def case(**changes):
        given_ = {"local_hit": False, "blocked": False, "shared_hit": False, "failed": False,
                  "answers": 1, "rcode": 0, **changes}
        return fn.classify_outcome(**{k: F.lit(v) for k, v in given_.items()})
    rows = spark.range(1).select(
        case(blocked=True), case(local_hit=True), case(local_hit=True, blocked=True),
        case(shared_hit=True), case(), case(answers=0, rcode=3), case(failed=True)).first()
    assert [tuple(r) for r in rows] == [
        ("BLOCKED", "SECURITY", False, 0), ("L1_HIT", "GENERAL", True, 0),
        ("BLOCKED", "GENERAL", True, 0), ("L2_HIT", "GENERAL", False, 0),
        ("RESOLVED", "GENERAL", False, 0), ("FAILED", "GENERAL", False, 3),
        ("ERROR", "GENERAL", False, 2)]


def test_time_windows():
    def window(**k):
        w = fn.resolve_time_window(AS_OF, **k)
        return w.start, w.end, w.all_time
    assert window() == (datetime(2024, 2, 28, 12), AS_OF, False)
    assert window(range="1h")[0] == datetime(2024, 2, 29, 11)
    assert window(range="ALL") == (datetime(2014, 2, 28, 12), AS_OF, True)
    assert window(month=" 2023-02 ", range="1H") == (
        datetime(2023, 2, 1), datetime(2023, 2, 28, 23, 59, 59), False)
    assert window(start_date="2024-01-01", end_date="2024-01-02")[:2] == (
        datetime(2024, 1, 1), datetime(2024, 1, 2, 23, 59, 59))
    # What cannot be read falls through to the next choice.
    assert window(month="2023-13", start_date="2024-01-01", end_date="2024-01-02")[0] \
        == datetime(2024, 1, 1)
    assert window(start_date="2024-1-1", end_date="x", range="7D")[0] == datetime(2024, 2, 22, 12)
    assert window(range="MONTH") == window()
    for bad in ({"month": "x"}, {"start_date": "a", "end_date": "b"}, {"range": "MONTH"}):
        with pytest.raises(ValueError):
            fn.resolve_time_window(AS_OF, strict=True, **bad)


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "hours")
    spark.range(10).select(F.timestamp_seconds("id").alias("hour_timestamp"),
                           F.col("id").alias("total_queries"), F.lit(1).alias("other")
                           ).write.parquet(path)
    plan = (fn.filter_between(spark.read.parquet(path), fn.TimeWindow(AS_OF, AS_OF))
            .agg(F.sum("total_queries"))._jdf.queryExecution().executedPlan().toString())
    assert "GreaterThanOrEqual(hour_timestamp" in plan
    assert "ReadSchema: struct<hour_timestamp:timestamp,total_queries:bigint>" in plan
