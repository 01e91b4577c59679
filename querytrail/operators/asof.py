"""Decisions by the rules that were in force when a query came.

Published versions become intervals: a policy row holds from the version that brought it to the
last one that has it unchanged, so a rule that many versions share is stored and joined once. An
event gets the newest version published at or before its time, and is matched against the rows
whose interval holds that version. The version stays with the decision, so a replay, however
late, decides the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.functions.domains import domain_suffixes, normalize_domain
from querytrail.operators.matching import SALTS, policy_table, salted_lookup

_ROW = ["rule_block", "rule_subdomains", "listed"]
#: Events are joined to versions by the day; a version holds on all days up to its successor's.
_DAY = 86_400


def version_spans(published: DataFrame) -> DataFrame:
    """``version`` with ``valid_from`` and ``valid_to`` (not included, null for the newest), from
    ``version`` and ``published_at``. Of versions published at one time the highest holds."""
    last = (published.groupBy("published_at").agg(F.max("version").alias("version")))
    return last.select("version", F.col("published_at").alias("valid_from"),
                       F.lead("published_at").over(Window.orderBy("published_at"))
                       .alias("valid_to"))


def policy_intervals(snapshots: DataFrame) -> DataFrame:
    """Policy rows with ``first_version`` and ``last_version``, both included.

    ``snapshots``: the rows of ``policy_table`` of every version, with ``version``. A row that is
    missing from a version, or differs, ends its interval.
    """
    # Versions are numbered without gaps first: what follows what is then a difference of one.
    steps = snapshots.select("version").distinct().withColumn(
        "step", F.row_number().over(Window.orderBy("version")))
    per_rule = Window.partitionBy("rule_domain").orderBy("step")
    same = F.lit(True)
    for c in _ROW:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(per_rule))
    fresh = ~(same & (F.col("step") == F.lag("step").over(per_rule) + 1))
    marked = (snapshots.join(steps, "version")
              .withColumn("fresh", F.coalesce(fresh, F.lit(True)).cast("int"))
              .withColumn("run", F.sum("fresh").over(per_rule)))
    return (marked.groupBy("rule_domain", "run")
            .agg(*[F.max(c).alias(c) for c in _ROW], F.max("labels").alias("labels"),
                 F.min("version").alias("first_version"), F.max("version").alias("last_version"))
            .drop("run"))


def all_snapshots(parts: dict[int, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Policy rows of several versions: version -> (rules, blocked set)."""
    out = None
    for version, (rules, blocked) in sorted(parts.items()):
        rows = policy_table(rules, blocked).withColumn("version", F.lit(version).cast("long"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no version")
    return out


def with_version(events: DataFrame, spans: DataFrame, ts: str = "ts") -> DataFrame:
    """``rule_version`` in force at each event's time; null before the first.

    The days of a version's span meet the events' days; the newest version, whose span is open,
    needs no join.
    """
    def day(c: Column) -> Column:
        return F.floor(F.unix_seconds(c) / _DAY)

    newest = spans.filter(F.col("valid_to").isNull()).first()
    if newest is None:
        return events.withColumn("rule_version", F.lit(None).cast("long"))
    days = (spans.filter(F.col("valid_to").isNotNull())
            .select(F.col("version").alias("v_"), "valid_from", "valid_to",
                    F.explode(F.sequence(day(F.col("valid_from")), day(F.col("valid_to"))))
                    .alias("d_")))
    at = F.col(ts)
    holds = (at >= F.col("valid_from")) & (at < F.col("valid_to"))
    open_from = F.lit(newest["valid_from"].isoformat(sep=" ")).cast("timestamp")
    return (events.join(days, (day(at) == F.col("d_")) & holds, "left")
            .withColumn("rule_version", F.when(at >= open_from, F.lit(newest["version"]))
                        .otherwise(F.col("v_")).cast("long"))
            .select(*events.columns, "rule_version"))


def policy_decision_as_of(events: DataFrame, spans: DataFrame, intervals: DataFrame,
                          domain: str = "domain", ts: str = "ts",
                          spread: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """``rule_version``, ``rule_domain``, ``rule_block``, ``listed_parent``, ``blocked`` added.

    Each pair of domain and version is decided once; the joins are salted, so a hot domain or
    suffix spreads. Events before the first version have no version and are not blocked.
    """
    keep = events.columns
    timed = with_version(events, spans, ts).withColumn("__name", normalize_domain(F.col(domain)))
    pairs = (timed.select("__name", "rule_version")
             .filter(F.col("__name").isNotNull() & F.col("rule_version").isNotNull()).distinct())
    suffixes = (pairs.select("__name", "rule_version",
                             F.explode(domain_suffixes(F.col("__name"))).alias("s"))
                .select("__name", "rule_version", "s.depth",
                        F.col("s.suffix").alias("rule_domain")))
    hits = _salted_rows(suffixes, intervals, salts).filter(
        F.col("rule_version").between(F.col("first_version"), F.col("last_version")))
    applies = F.col("rule_block").isNotNull() & (
        (F.col("depth") == 0) | F.col("rule_subdomains"))
    best = F.min_by(F.struct("rule_domain", "rule_block"), F.when(applies, F.col("depth")))
    keys = ["__name", "rule_version"]
    decisions = (hits.groupBy(*keys)
                 .agg(best.alias("best"), F.max("listed").alias("listed_parent"))
                 .select(*keys, "best.rule_domain", "best.rule_block", "listed_parent"))
    out = salted_lookup(timed, decisions, keys, spread or keep, "left", salts)
    out = out.withColumn("listed_parent", F.coalesce("listed_parent", F.lit(False)))
    return (out.withColumn("blocked", F.coalesce("rule_block", "listed_parent"))
            .select(*keep, "rule_version", "rule_domain", "rule_block", "listed_parent", "blocked"))


def _salted_rows(suffixes: DataFrame, intervals: DataFrame, salts: int) -> DataFrame:
    """Suffixes with the policy rows of their name: a common suffix spreads over the salts."""
    return salted_lookup(suffixes, intervals.drop("labels"), ["rule_domain"], ["__name"], "inner",
                         salts)
