"""Rule truth table and random rule sets against a plain walk over the parents."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from querytrail.operators import matching, rules
from querytrail.schemas import DOMAIN_RULES

from test_functions import walk


def rule_frame(spark, rows):
    """Rows of (domain, action, match_type, status)."""
    full = [(d, a, m, "OTHER", "LOW", s, "ADMIN", None, None, None, None) for d, a, m, s in rows]
    return spark.createDataFrame(full, DOMAIN_RULES)


def decide(domain, rule_rows, blocked):
    active = {d: (a, m) for d, a, m, s in rule_rows if s == "ACTIVE"}
    parents = walk(domain)
    for suffix in parents:
        if suffix in active:
            action, match = active[suffix]
            if suffix == domain or match == "DOMAIN_AND_SUBDOMAINS":
                return action == "BLOCK"
    return any(s in blocked for s in parents)


def expected_set(rule_rows, entries, mode="compat"):
    active = [(d, a, m) for d, a, m, s in rule_rows if s == "ACTIVE"]
    adds = {d for d, a, m in active if a == "BLOCK"
            and (mode == "compat" or m == "DOMAIN_AND_SUBDOMAINS")} | set(entries)
    return adds - {d for d, a, m in active if a != "BLOCK"}


WAYS = [{"way": "lookup"}, {"way": "distinct", "salts": 3}]


@pytest.mark.parametrize("options", WAYS)
@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_rule_truth_table(spark, mode, options):
    """Rule on the name or its parent, by action, match type, status and list membership."""
    cases = itertools.product((True, False), ("BLOCK", "ALLOW"),
                              ("EXACT", "DOMAIN_AND_SUBDOMAINS"), ("ACTIVE", "INACTIVE"),
                              (False, True))
    rows, entries, domains = [], [], []
    for i, (own, action, match, status, listed) in enumerate(cases):
        parent = f"n{i}.test"
        domains.append(f"x.{parent}")
        rows.append((domains[-1] if own else parent, action, match, status))
        if listed:
            entries.append(parent)
    frame = rule_frame(spark, rows)
    blocked = matching.blocked_set(
        frame, spark.createDataFrame([(e,) for e in entries], "domain string"), mode)
    got = matching.policy_decision(
        spark.createDataFrame([(d,) for d in domains], "domain string"), frame, blocked, **options)
    in_set = expected_set(rows, entries, mode)
    assert {r["domain"]: r["blocked"] for r in got.collect()} == {
        d: decide(d, rows, in_set) for d in domains}


@pytest.mark.parametrize("options", WAYS)
def test_random_rules(spark, options):
    rng = random.Random(7)

    def name():
        return ".".join(rng.choice(["a", "b", "c", ""]) if rng.random() < 0.1 else
                        rng.choice("abc") for _ in range(rng.randint(1, 6)))
    rows = {d: (d, rng.choice(["BLOCK", "ALLOW"]), rng.choice(["EXACT", "DOMAIN_AND_SUBDOMAINS"]),
                rng.choice(["ACTIVE", "ACTIVE", "INACTIVE"])) for d in (name() for _ in range(80))
            if d.strip(".")}
    entries = sorted({name() for _ in range(15)} - {""})
    domains = sorted({name() for _ in range(400)} - {""})
    frame = rule_frame(spark, list(rows.values()))
    blocked = matching.blocked_set(frame, spark.createDataFrame([(e,) for e in entries],
                                                                "domain string"))
    in_set = {r["domain"] for r in blocked.collect()}
    assert in_set == expected_set(rows.values(), entries)
    queries = spark.createDataFrame([(i, d) for i, d in enumerate(domains)],
                                    "i int, domain string")
    got = matching.policy_decision(queries, frame, blocked, spread=["i"], **options)
    # Names are cleaned of one trailing dot before they are looked up.
    want = {d: decide(d[:-1] if d.endswith(".") else d, rows.values(), in_set) for d in domains}
    assert {r["domain"]: r["blocked"] for r in got.collect()} == want


def test_no_domain_is_not_blocked(spark):
    frame = rule_frame(spark, [("a", "BLOCK", "EXACT", "ACTIVE")])
    rows = spark.createDataFrame([(None,), ("",)], "domain string")
    for options in WAYS:
        out = matching.policy_decision(rows, frame, matching.blocked_set(frame), **options)
        assert [r["blocked"] for r in out.collect()] == [False, False]


def test_small_tables_do_not_shuffle_the_rows(spark, tmp_path):
    frame = rule_frame(spark, [(f"{i}.x.test", "BLOCK", "EXACT", "ACTIVE") for i in range(20)]
                       + [("test", "ALLOW", "DOMAIN_AND_SUBDOMAINS", "ACTIVE")])
    frame.write.parquet(str(tmp_path / "rules"))
    frame = spark.read.parquet(str(tmp_path / "rules"))
    rows = spark.range(100).select(F.concat("id", F.lit(".x.test")).alias("domain"))
    out = matching.policy_decision(rows, frame, matching.blocked_set(frame), way="lookup")
    assert out.filter("blocked").count() == 20
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    stream_side = plan.split("Range (0, 100")[0].splitlines()[-1]
    assert "SortMergeJoin" not in plan and "Exchange" not in stream_side


def test_rules_of_many_depths(spark):
    """Names of 1 to 30 labels, each with a rule of its own, by both ways."""
    names = [".".join("a" * n) for n in range(1, 31)]
    frame = rule_frame(spark, [(n, "BLOCK" if i % 2 else "ALLOW", "EXACT", "ACTIVE")
                               for i, n in enumerate(names)])
    rows = spark.createDataFrame([(n,) for n in names], "domain string")
    for options in WAYS:
        got = matching.policy_decision(rows, frame, None, **options).collect()
        assert {r["domain"]: r["blocked"] for r in got} == {
            n: i % 2 == 1 for i, n in enumerate(names)}


def test_way_of_a_stream(spark):
    frame = rule_frame(spark, [("a.test", "BLOCK", "EXACT", "ACTIVE")])
    stream = spark.readStream.format("rate").load().select(
        F.col("value").cast("string").alias("domain"))
    assert matching.policy_decision(stream, frame, None).isStreaming
    with pytest.raises(ValueError, match="lookup"):
        matching.policy_decision(stream, frame, None, way="distinct")
    with pytest.raises(ValueError):
        matching.policy_decision(stream, frame, None, way="other")


def test_hot_domain_is_spread(spark):
    """A third of the rows under one name, by the distinct way, lands in many partitions."""
    rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, "hot.test").otherwise(
        F.concat("id", F.lit(".cold.test"))).alias("domain"))
    frame = rule_frame(spark, [("hot.test", "BLOCK", "EXACT", "ACTIVE")])
    out = matching.policy_decision(rows, frame, None, spread=["id"], way="distinct")
    assert out.filter("blocked").count() == 10000
    salted = matching.salted_lookup(
        rows, spark.createDataFrame([("hot.test", 1)], "domain string, v int"), ["domain"],
        ["id"], "inner", 16)
    assert salted.count() == 10000


def test_expiry_counts_only_when_asked(spark):
    frame = rule_frame(spark, [("a.test", "BLOCK", "EXACT", "ACTIVE")]).withColumn(
        "expires_at", F.lit("2024-01-01").cast("timestamp"))
    rows = spark.createDataFrame([("a.test",)], "domain string")
    assert matching.policy_decision(rows, frame, None).first()["blocked"]
    later = F.lit("2024-01-02").cast("timestamp")
    assert not matching.policy_decision(rows, frame, None, as_of=later).first()["blocked"]


def test_wrong_mode_is_refused(spark):
    with pytest.raises(ValueError):
        matching.blocked_set(rule_frame(spark, []), mode="loose")


def test_delta_gives_the_set_of_a_new_snapshot(spark):
    """Set after a delta equals the set built from the changed rules."""
    base = [("a", "BLOCK", "EXACT", "ACTIVE"), ("b", "ALLOW", "EXACT", "ACTIVE"),
            ("c", "BLOCK", "EXACT", "ACTIVE")]
    delta = [("A ", "ALLOW", "EXACT", "ACTIVE", 1), ("b", "BLOCK", "EXACT", "ACTIVE", 2),
             ("c", "BLOCK", "EXACT", "INACTIVE", 4), ("c", "BLOCK", "EXACT", "ACTIVE", 3),
             ("d", "BLOCK", "EXACT", "ACTIVE", 5)]
    changes = spark.createDataFrame(
        delta, "domain string, action string, match_type string, status string, seq int")
    got = rules.apply_rule_delta(matching.blocked_set(rule_frame(spark, base)), changes)
    assert sorted(r["domain"] for r in got.collect()) == ["b", "d"]
    left = rules.apply_rule_delta_to_rules(
        rule_frame(spark, base).select("domain", "action", "match_type", "status"), changes)
    assert sorted((r["domain"], r["action"]) for r in left.collect()) == [
        ("a", "ALLOW"), ("b", "BLOCK"), ("d", "BLOCK")]
