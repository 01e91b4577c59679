"""Block / allow decisions for domains from hierarchical rules and the blocked set.

The rule on the domain itself applies whatever its match type, a rule on a parent only if it
covers subdomains, and the most specific applicable rule decides. Without one, the domain is
blocked when it or any parent is in the blocked set.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.functions.domains import (domain_suffixes, has_empty_label, label_count,
                                          normalize_domain, suffix_count,
                                          strip)
from querytrail.session import scratch_dir

SALTS = 16
WAYS = ("lookup", "distinct")


def active_rules(rules: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rules with status ACTIVE; expiry counts only when ``as_of`` is given."""
    kept = rules.filter(F.upper("status") == "ACTIVE")
    if as_of is not None:
        kept = kept.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))
    return kept


def blocked_set(rules: DataFrame, entries: DataFrame | None = None,
                mode: str = "compat") -> DataFrame:
    """Domains blocked by list: plain entries and active BLOCK rules, minus active ALLOW ones.

    ``compat`` takes BLOCK rules of any match type, which lets an EXACT rule reach subdomains
    through the list; ``strict`` leaves EXACT rules out.
    """
    if mode not in ("compat", "strict"):
        raise ValueError(f"mode is compat or strict, not {mode}")
    active = active_rules(rules)
    blocks = F.upper("action") == "BLOCK"
    name = F.lower(strip(F.col("domain"))).alias("domain")
    adding = active.filter(blocks)
    if mode == "strict":
        adding = adding.filter(F.col("match_type") == "DOMAIN_AND_SUBDOMAINS")
    rows = (adding.select(name, F.lit(False).alias("removed"))
            .unionByName(active.filter(~blocks).select(name, F.lit(True).alias("removed"))))
    if entries is not None:
        rows = rows.unionByName(entries.select(name, F.lit(False).alias("removed")))
    return (rows.groupBy("domain").agg(F.max("removed").alias("removed"))
            .filter(~F.col("removed")).select("domain"))


def policy_table(rules: DataFrame | None, blocked: DataFrame | None,
                 as_of: Column | None = None) -> DataFrame:
    """One row per listed domain: its rule, if any, and whether it is in the blocked set."""
    parts = []
    if rules is not None:
        parts.append(active_rules(rules, as_of).select(
            F.lower(strip(F.col("domain"))).alias("rule_domain"),
            (F.upper("action") == "BLOCK").alias("rule_block"),
            (F.col("match_type") == "DOMAIN_AND_SUBDOMAINS").alias("rule_subdomains"),
            F.lit(False).alias("listed")))
    if blocked is not None:
        missing = F.lit(None).cast("boolean")
        parts.append(blocked.select(
            F.col("domain").alias("rule_domain"), missing.alias("rule_block"),
            missing.alias("rule_subdomains"), F.lit(True).alias("listed")))
    if not parts:
        raise ValueError("give rules, a blocked set or both")
    rows = reduce(DataFrame.unionByName, parts)
    return (rows.groupBy("rule_domain")
            .agg(F.max("rule_block").alias("rule_block"),
                 F.max("rule_subdomains").alias("rule_subdomains"),
                 F.max("listed").alias("listed"))
            .withColumn("labels", label_count(F.col("rule_domain"))))


def _label_counts(table: DataFrame) -> list[int]:
    """Label counts that occur in the table, largest first: a few numbers at any size."""
    return sorted((r["labels"] for r in table.select("labels").distinct().collect()),
                  reverse=True)


_TABLE = ["rule_domain", "rule_block", "rule_subdomains", "listed"]
_DECISION = ["rule_domain", "rule_block", "listed_parent", "blocked"]


def _with_decision(df: DataFrame) -> DataFrame:
    return df.withColumn("blocked", F.coalesce("rule_block", "listed_parent"))


def _decide_lookup(df: DataFrame, domain: str, table: DataFrame, depths: list[int]) -> DataFrame:
    """One left join per label count, most specific first.

    Each joins the table's rows of that label count alone. Whether Spark sends them whole or
    shuffles follows from their size, which changes the plan and never the result.
    """
    keep, name = df.columns, F.col("__name")
    out = (df.withColumn("__name", normalize_domain(F.col(domain)))
           .withColumn("__n", label_count(name))
           .withColumn("__stop", F.when(has_empty_label(name), suffix_count(name))))
    for labels in depths:
        side = table.filter(F.col("labels") == labels).select(
            *[F.col(c).alias(f"__{c}{labels}") for c in _TABLE])
        visited = (F.col("__n") >= labels) & (
            F.col("__stop").isNull() | (F.col("__n") - F.lit(labels) < F.col("__stop")))
        key = F.when(visited, F.substring_index(name, ".", -labels))
        out = out.join(side, key == F.col(f"__rule_domain{labels}"), "left")

    def applies(labels: int) -> Column:
        return F.col(f"__rule_block{labels}").isNotNull() & (
            (F.col("__n") == labels) | F.col(f"__rule_subdomains{labels}"))

    def deciding(column: str, kind: str) -> Column:
        return F.coalesce(*[F.when(applies(d), F.col(f"__{column}{d}")) for d in depths],
                          F.lit(None).cast(kind))

    listed = [F.coalesce(F.col(f"__listed{d}"), F.lit(False)) for d in depths]
    out = (out.withColumn("rule_domain", deciding("rule_domain", "string"))
           .withColumn("rule_block", deciding("rule_block", "boolean"))
           .withColumn("listed_parent", reduce(Column.__or__, listed, F.lit(False))))
    return _with_decision(out).select(*keep, *_DECISION)


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str],
                  how: str = "left", salts: int = SALTS) -> DataFrame:
    """Shuffle join to a side that is unique by ``keys``, spreading every key over ``salts``.

    For keys that may hold a large share of the left rows. The right side is repeated once per
    salt.
    """
    salted = left.withColumn("__salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "__salt"], how).drop("__salt")


def _decide_distinct(df: DataFrame, domain: str, table: DataFrame, depths: list[int],
                     spread: list[str], salts: int) -> DataFrame:
    """Decide each distinct domain once, then join back; suffixes that no rule can have are
    left out before they are shuffled."""
    keep = df.columns
    names = df.select(normalize_domain(F.col(domain)).alias("__name"))
    suffixes = (names.filter(F.col("__name").isNotNull()).distinct()
                .select("__name", F.explode(domain_suffixes(F.col("__name"))).alias("s"))
                .select("__name", "s.depth", F.col("s.suffix").alias("rule_domain"))
                .filter((label_count(F.col("__name")) - F.col("depth")).isin(depths)))
    hits = salted_lookup(suffixes, table.drop("labels"), ["rule_domain"], ["__name"],
                         "inner", salts)
    applies = F.col("rule_block").isNotNull() & (
        (F.col("depth") == 0) | F.col("rule_subdomains"))
    best = F.min_by(F.struct("rule_domain", "rule_block"), F.when(applies, F.col("depth")))
    decisions = (hits.groupBy("__name")
                 .agg(best.alias("best"), F.max("listed").alias("listed_parent"))
                 .select("__name", "best.rule_domain", "best.rule_block", "listed_parent"))
    out = salted_lookup(df.withColumn("__name", normalize_domain(F.col(domain))), decisions,
                        ["__name"], spread, "left", salts)
    out = out.withColumn("listed_parent", F.coalesce("listed_parent", F.lit(False)))
    return _with_decision(out).select(*keep, *_DECISION)


def policy_decision(df: DataFrame, rules: DataFrame | None, blocked: DataFrame | None,
                    domain: str = "domain", as_of: Column | None = None,
                    spread: list[str] | None = None, way: str | None = None,
                    salts: int = SALTS) -> DataFrame:
    """Add ``rule_domain``, ``rule_block``, ``listed_parent`` and ``blocked`` to every row.

    ``way="lookup"`` joins the rows to the policy table once per label count; it is the only way
    for a stream. ``way="distinct"`` decides each distinct domain once and joins back by salted
    joins, over the columns ``spread``, which should differ within one domain. Without ``way`` a
    stream takes the first, other rows the second; sizes never decide. The policy table is stored
    first, as the ways look at it several times.
    """
    table = policy_table(rules, blocked, as_of)
    path = scratch_dir(df.sparkSession, "policy")
    _check_way(df, way)
    table.write.parquet(path)
    return decide(df, df.sparkSession.read.schema(table.schema).parquet(path), domain, spread,
                  way, salts)


def _check_way(df: DataFrame, way: str | None) -> str:
    way = way or ("lookup" if df.isStreaming else "distinct")
    if way not in WAYS:
        raise ValueError(f"way is one of {WAYS}, not {way}")
    if way == "distinct" and df.isStreaming:
        raise ValueError("a stream needs way='lookup'")
    return way


def decide(df: DataFrame, table: DataFrame, domain: str = "domain",
           spread: list[str] | None = None, way: str | None = None, salts: int = SALTS
           ) -> DataFrame:
    """``policy_decision`` by a policy table that is stored already."""
    way, depths = _check_way(df, way), _label_counts(table)
    if way == "lookup":
        return _decide_lookup(df, domain, table, depths)
    return _decide_distinct(df, domain, table, depths, spread or df.columns, salts)


def match_rules(domains: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """The deciding rule per row; no rule leaves ``rule_domain`` and ``rule_block`` null."""
    out = policy_decision(domains, rules, None, **options)
    return out.drop("listed_parent", "blocked")


def match_blocked_set(domains: DataFrame, blocked: DataFrame, **options) -> DataFrame:
    out = policy_decision(domains, None, blocked, **options)
    return out.drop("rule_domain", "rule_block", "listed_parent")
