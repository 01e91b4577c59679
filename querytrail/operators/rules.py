"""Rule and list maintenance: normalizing input, upserts, deletes, snapshots and deltas."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.functions.domains import normalize_domain, strip, strip_url_to_domain
from querytrail.functions.events import is_present
from querytrail.functions.timewindow import ts_literal
from querytrail.operators.matching import active_rules, blocked_set
from querytrail.schemas import DOMAIN_RULES, OVERRIDE_RECORDS

RULE_FIELDS = ["action", "match_type", "category", "severity", "reason"]

# What a rule gets where the request leaves a field out.
API_DEFAULTS = {"action": "BLOCK", "match_type": "DOMAIN_AND_SUBDOMAINS", "category": "OTHER",
                "severity": "MEDIUM"}
API_REASON = "Admin rule entry"
BATCH_REASON = "Batch imported CSV rule"
CSV_REASON = {"ALLOW": "Whitelist import", "BLOCK": "CSV bulk import rule"}
ENTRY_CATEGORY = "MALWARE"
OVERRIDE_DEFAULTS = {"record_type": "A", "ip_address": "127.0.0.1", "ttl": 300}


def normalize_rules_api(requests: DataFrame, batch: bool = True) -> DataFrame:
    """Fill defaults of submitted rules and drop those without a domain.

    In a batch an ALLOW rule without category is WHITELIST. Other columns pass through.
    """
    rest = [c for c in requests.columns if c not in ("domain", *RULE_FIELDS)]
    action = F.coalesce("action", F.lit(API_DEFAULTS["action"]))
    category = F.lit(API_DEFAULTS["category"])
    if batch:
        category = F.when(action == "ALLOW", "WHITELIST").otherwise(category)
    return (requests.filter(is_present(strip(F.col("domain"))))
            .select(*rest, F.lower(strip(F.col("domain"))).alias("domain"),
                    action.alias("action"),
                    F.coalesce("match_type", F.lit(API_DEFAULTS["match_type"]))
                    .alias("match_type"),
                    F.coalesce("category", category).alias("category"),
                    F.coalesce("severity", F.lit(API_DEFAULTS["severity"])).alias("severity"),
                    F.coalesce("reason", F.lit(BATCH_REASON if batch else API_REASON))
                    .alias("reason")))


def normalize_rules_csv(lines: DataFrame) -> DataFrame:
    """Rules from parsed CSV fields: lenient values, upper-cased, pasted URLs cut to hosts."""
    rest = [c for c in lines.columns if c not in ("domain", *RULE_FIELDS)]
    allow = F.coalesce(F.upper(strip(F.col("action"))) == "ALLOW", F.lit(False))
    exact = F.coalesce(F.upper(strip(F.col("match_type"))) == "EXACT", F.lit(False))

    def given(name: str) -> Column:
        return F.when(is_present(strip(F.col(name))), F.upper(strip(F.col(name))))

    action = F.when(allow, "ALLOW").otherwise("BLOCK")
    reason = F.when(is_present(F.col("reason")), strip(F.col("reason")))
    return (lines.select(
        *rest, strip_url_to_domain(F.col("domain")).alias("domain"),
        action.alias("action"),
        F.when(exact, "EXACT").otherwise("DOMAIN_AND_SUBDOMAINS").alias("match_type"),
        F.when(allow, "WHITELIST").otherwise(F.coalesce(given("category"), F.lit("MALWARE")))
        .alias("category"),
        F.coalesce(given("severity"), F.when(allow, "LOW").otherwise("HIGH")).alias("severity"),
        F.coalesce(reason, F.when(allow, CSV_REASON["ALLOW"]).otherwise(CSV_REASON["BLOCK"]))
        .alias("reason"))
        .filter(is_present(F.col("domain"))))


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` per key, combined on the map side."""
    values = [c for c in rows.columns if c not in (key, order)]
    return (rows.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("last"))
            .select(key, *[F.col(f"last.{c}").alias(c) for c in values]))


def upsert_rules(existing: DataFrame, requests: DataFrame, as_of: datetime,
                 order: str = "seq") -> DataFrame:
    """Create or overwrite rules by domain; the later request for a domain wins.

    Touched rules become ACTIVE and keep their creation time, source and expiry.
    """
    new = last_per_key(requests.select("domain", *RULE_FIELDS, order), "domain", order)
    old, new = existing.alias("old"), new.withColumn("touched", F.lit(True)).alias("new")
    touched, known = F.col("new.touched").isNotNull(), F.col("old.domain").isNotNull()
    now = ts_literal(as_of)
    picked = {n: F.when(touched, F.col(f"new.{n}")).otherwise(F.col(f"old.{n}"))
              for n in RULE_FIELDS}
    picked["domain"] = F.coalesce("new.domain", "old.domain")
    picked["status"] = F.when(touched, "ACTIVE").otherwise(F.col("old.status"))
    picked["source"] = F.when(known, F.col("old.source")).otherwise("ADMIN")
    picked["created_at"] = F.when(known, F.col("old.created_at")).otherwise(now)
    picked["updated_at"] = F.when(touched, now).otherwise(F.col("old.updated_at"))
    picked["expires_at"] = F.col("old.expires_at")
    return (old.join(new, F.col("old.domain") == F.col("new.domain"), "full_outer")
            .select(*[picked[n].alias(n) for n in DOMAIN_RULES.names]))


def delete_by_domain(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Drop the rules or entries whose domain is listed (case and blanks aside)."""
    gone = domains.select(F.lower(strip(F.col("domain"))).alias("domain"))
    return rows.join(gone, "domain", "left_anti")


def delete_rules_and_entries(rules: DataFrame, entries: DataFrame,
                             domains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules and plain list entries without the given domains, so that the blocked set built
    from both no longer holds them."""
    return delete_by_domain(rules, domains), delete_by_domain(entries, domains)


def rows_of_domain(rows: DataFrame, domain: str) -> DataFrame:
    """Rules, entries or overrides of one domain (case and blanks aside)."""
    return rows.filter(F.lower(strip(F.col("domain"))) == F.lower(strip(F.lit(domain))))


def upsert_blocked_entries(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Add plain list entries; a known domain takes the new category."""
    cleaned = new.filter(is_present(strip(F.col("domain")))).select(
        normalize_domain(F.col("domain"), trim=True).alias("domain"),
        F.when(is_present(strip(F.col("category"))), F.col("category")).otherwise(ENTRY_CATEGORY)
        .alias("category"),
        F.col(order).cast("long").alias("__order"))
    rows = existing.select("domain", "category", F.lit(-1).cast("long").alias("__order"))
    return last_per_key(rows.unionByName(cleaned), "domain", "__order")


def create_overrides(existing: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """Add override records; those without a domain are refused, null fields get defaults.

    A domain has one record: of new rows for one domain the first by ``order`` is taken, and none
    where a record exists. The id is the greatest one so far plus ``order``, which counts from 1.
    """
    fields = [c for c in OVERRIDE_RECORDS.names if c not in ("id", "domain")]
    filled = [F.coalesce(c, F.lit(OVERRIDE_DEFAULTS[c])).alias(c) if c in OVERRIDE_DEFAULTS
              else F.col(c) for c in fields]
    given = (new.filter(is_present(strip(F.col("domain"))))
             .select("domain", *filled, (-F.col(order)).alias("__order"))
             .join(existing.select("domain"), "domain", "left_anti"))
    first = last_per_key(given.withColumn("__id", -F.col("__order")), "domain", "__order")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = first.select((last + F.col("__id")).cast("long").alias("id"), "domain", *fields)
    return existing.select("id", "domain", *fields).unionByName(added)


def upsert_overrides(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Change known override records by id; null fields leave the old value."""
    new = changes.select("id", *[F.col(c).alias(f"new_{c}")
                                 for c in OVERRIDE_RECORDS.names if c != "id"])
    return (existing.join(new, "id", "left")
            .select("id", *[F.coalesce(f"new_{c}", c).alias(c)
                            for c in OVERRIDE_RECORDS.names if c != "id"]))


def delete_overrides(existing: DataFrame, ids: DataFrame) -> DataFrame:
    return existing.join(ids.select("id"), "id", "left_anti")


def rules_by_status(rules: DataFrame, status: str = "ACTIVE") -> DataFrame:
    return rules.filter(F.col("status") == status)


def list_categories(rules: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """The category dimension by name, with the rules that carry each and those of them that are
    active. ``categories`` (``name``) may name some without a rule; blank names are none."""
    named = rules.filter(is_present(F.col("category"))).select(
        F.col("category").alias("name"), F.lit(1).alias("rule"),
        (F.upper("status") == "ACTIVE").cast("int").alias("active"))
    if categories is not None:
        named = named.unionByName(categories.filter(is_present(F.col("name"))).select(
            "name", F.lit(0).alias("rule"), F.lit(0).alias("active")))
    return named.groupBy("name").agg(F.sum("rule").alias("rules"),
                                     F.coalesce(F.sum("active"), F.lit(0)).alias("active_rules"))


def category_by_name(categories: DataFrame, name: str) -> DataFrame:
    """The category of exactly that name."""
    return categories.filter(F.col("name") == name)


def rule_snapshot(rules: DataFrame, entries: DataFrame | None = None,
                  mode: str = "compat") -> tuple[DataFrame, DataFrame]:
    """The complete active rules and the blocked set that goes with them."""
    return active_rules(rules), blocked_set(rules, entries, mode)


def apply_rule_delta(blocked: DataFrame, delta: DataFrame, order: str = "seq") -> DataFrame:
    """The blocked set after changed rules: active BLOCK adds, all else removes."""
    last = last_per_key(delta.select(F.lower(strip(F.col("domain"))).alias("domain"), "action",
                                     "status", order), "domain", order)
    adds = F.coalesce((F.upper("status") == "ACTIVE") & (F.upper("action") == "BLOCK"),
                      F.lit(False))
    return (blocked.join(last, "domain", "left_anti")
            .unionByName(last.filter(adds).select("domain")))


def apply_rule_delta_to_rules(snapshot: DataFrame, delta: DataFrame,
                              order: str = "seq") -> DataFrame:
    """The active rules after changed rules: an inactive one disappears."""
    fields = [c for c in snapshot.columns if c != "domain"]
    last = last_per_key(
        delta.select(F.lower(strip(F.col("domain"))).alias("domain"), *fields, order), "domain", order)
    return (snapshot.join(last, "domain", "left_anti").select("domain", *fields)
            .unionByName(active_rules(last).select("domain", *fields)))
