"""The same questions in SQL over the base tables, written from the meaning of each operator."""

from __future__ import annotations

from querytrail.catalog import CATEGORY_NAMES, PUBLISHED, RANGES
from querytrail.fixtures import SECRET
from querytrail.functions.events import hmac_pads
from querytrail.operators.sketches import SPREAD

_IPAD, _OPAD = hmac_pads(SECRET)


def _hash(ip: str) -> str:
    return (f"CASE WHEN {ip} IS NULL OR trim({ip}) = '' THEN 'unknown' ELSE "
            f"left(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({ip})))), 16)"
            " END")


_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"

_EV = f"""ev AS (
  SELECT event_id, ts,
         '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip,
         {_HOST} AS domain,
         CASE event_id % 10 WHEN 0 THEN 'AAAA' WHEN 1 THEN 'TXT' WHEN 2 THEN 'ANY' ELSE 'A' END
           AS qtype,
         CASE event_type WHEN 'view' THEN 'L1_HIT' WHEN 'click' THEN 'L2_HIT'
              WHEN 'purchase' THEN 'RESOLVED' WHEN 'signup' THEN 'BLOCKED'
              ELSE CASE WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'ERROR' END END AS action,
         CASE WHEN event_id % 97 = 0 THEN '' WHEN event_type <> 'signup' THEN 'GENERAL'
              ELSE CASE page_id % 5 WHEN 0 THEN 'MALWARE' WHEN 1 THEN 'PHISHING' WHEN 2 THEN 'ADS'
                   WHEN 3 THEN 'TRACKING' ELSE 'SECURITY' END END AS category,
         event_type = 'view' AS cache_hit,
         CAST(floor(value) AS BIGINT) AS latency_ms,
         CASE WHEN event_type <> 'error' THEN 0 WHEN event_id % 2 = 0 THEN 3 ELSE 2 END AS rcode,
         'resolver-' || (event_id % 3) AS resolver_id
  FROM events JOIN pages ON page_id = event_id % (SELECT count(*) FROM pages))"""

_PE = f"""{_EV},
pe AS (SELECT * REPLACE (regexp_replace(lower(domain), '\\.$', '') AS domain),
              {_hash('client_ip')} AS client_hash, date_trunc('minute', ts) AS m,
              action = 'BLOCKED' AS b FROM ev)"""

_CNT = """count(*) AS total_queries, count(*) FILTER (NOT b) AS allowed_queries,
  count(*) FILTER (b) AS blocked_queries, count(*) FILTER (rcode = 3) AS nxdomain_queries,
  count(*) FILTER (rcode = 2) AS servfail_queries, count(*) FILTER (cache_hit) AS cache_hits,
  count(*) FILTER (NOT cache_hit) AS cache_misses"""
_LAT = "CAST(sum(latency_ms) AS BIGINT) AS total_latency_ms"
_AVG = "round(sum(latency_ms) / count(*), 6) AS avg_latency_ms"
_PAIR = "count(*) AS total_queries, count(*) FILTER (b) AS blocked_queries"

_C7 = ["total_queries", "allowed_queries", "blocked_queries", "nxdomain_queries",
       "servfail_queries", "cache_hits", "cache_misses"]


def _sums(names: list[str]) -> str:
    return ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)


_S7, _S8, _S2 = _sums(_C7), _sums([*_C7, "total_latency_ms"]), _sums(
    ["total_queries", "blocked_queries"])
_SAVG = "round(sum(total_latency_ms) / sum(total_queries), 6) AS avg_latency_ms"

_FB0 = """fb0 AS (
  SELECT l_shipdate + to_hours(l_linenumber) AS hour_timestamp, 'c' || l_suppkey AS client_hash,
         'd' || (l_partkey % 200) || '.example' AS domain,
         CASE l_partkey % 5 WHEN 0 THEN 'MALWARE' WHEN 1 THEN 'PHISHING' WHEN 2 THEN 'ADS'
              WHEN 3 THEN 'TRACKING' ELSE 'GENERAL' END AS category,
         CAST(l_quantity AS BIGINT) AS total_queries,
         CASE WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity / 4) AS BIGINT) ELSE 0 END
           AS blocked_queries,
         CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS nxdomain_queries,
         CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS servfail_queries,
         CAST(floor(l_quantity / 2) AS BIGINT) AS cache_hits,
         CAST(floor(l_extendedprice) AS BIGINT) AS total_latency_ms
  FROM lineitem),
fb AS (SELECT *, total_queries - blocked_queries AS allowed_queries,
              total_queries - cache_hits AS cache_misses FROM fb0)"""

_RULES = f"""rules AS (
  SELECT domain, CASE WHEN length(domain) % 3 = 0 THEN 'ALLOW' ELSE 'BLOCK' END AS action,
         CASE WHEN length(domain) % 2 = 0 THEN 'EXACT' ELSE 'DOMAIN_AND_SUBDOMAINS' END
           AS match_type,
         CASE WHEN length(domain) % 7 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status
  FROM (SELECT DISTINCT {_HOST} AS domain FROM pages) WHERE length(domain) % 4 <> 1
  UNION ALL SELECT * FROM (VALUES
    ('example.net', 'BLOCK', 'EXACT', 'ACTIVE'),
    ('spam-farm.example.org', 'BLOCK', 'DOMAIN_AND_SUBDOMAINS', 'ACTIVE'),
    ('org', 'ALLOW', 'DOMAIN_AND_SUBDOMAINS', 'INACTIVE')))"""

_DOMAINS = f"domains AS (SELECT DISTINCT {_HOST} AS domain FROM pages)"
_ENTRIES = "entries AS (SELECT domain FROM domains WHERE length(domain) % 2 = 0)"

_MESSY = """CASE page_id % 7 WHEN 0 THEN '.' || domain
  WHEN 1 THEN CASE WHEN contains(domain, '.') THEN
    split_part(domain, '.', 1) || '..' || substr(domain, strpos(domain, '.') + 1)
    ELSE domain END
  WHEN 2 THEN domain || '.' WHEN 3 THEN upper(domain) || '..'
  WHEN 4 THEN '  ' || upper(domain[1]) || domain[2:] || '. ' ELSE domain END"""

# Walks from a domain to its parents, as far as a lookup goes.
_WALK = """walk AS (
  SELECT domain, 0 AS depth, domain AS suffix FROM domains WHERE domain <> ''
  UNION ALL
  SELECT domain, depth + 1, substr(suffix, strpos(suffix, '.') + 1) FROM walk
  WHERE strpos(suffix, '.') > 1 AND strpos(suffix, '.') < length(suffix))"""

_MATCHED = """matched AS (
  SELECT w.domain, arg_min(r.domain, depth) AS rule_domain,
         arg_min(r.action = 'BLOCK', depth) AS rule_block
  FROM walk w JOIN rules r ON r.domain = w.suffix AND r.status = 'ACTIVE'
   AND (depth = 0 OR r.match_type = 'DOMAIN_AND_SUBDOMAINS')
  GROUP BY w.domain)"""


def _listed(extra: str = "", entries: bool = False) -> str:
    plain = "UNION SELECT domain FROM entries" if entries else ""
    return f"""bset AS (
  (SELECT domain FROM rules WHERE status = 'ACTIVE' AND action = 'BLOCK' {extra} {plain})
  EXCEPT SELECT domain FROM rules WHERE status = 'ACTIVE' AND action <> 'BLOCK')"""


_LISTED_PARENT = """lp AS (SELECT DISTINCT w.domain FROM walk w JOIN bset s ON s.domain = w.suffix)"""


def _policy_events(extra: str = "") -> str:
    return f"""WITH RECURSIVE {_EV}, {_RULES}, {_DOMAINS}, {_WALK}, {_MATCHED}, {_listed(extra)},
{_LISTED_PARENT}
SELECT event_id, rule_domain, lp.domain IS NOT NULL AS listed_parent,
       coalesce(rule_block, lp.domain IS NOT NULL) AS blocked
FROM ev LEFT JOIN matched ON matched.domain = ev.domain LEFT JOIN lp ON lp.domain = ev.domain"""


_MATCH_RULES = f"""WITH RECURSIVE {_RULES}, {_DOMAINS}, {_WALK}, {_MATCHED}
SELECT d.domain, rule_domain,
  CASE WHEN rule_block THEN 'BLOCK' WHEN NOT rule_block THEN 'ALLOW' END AS rule_action
FROM domains d LEFT JOIN matched USING (domain)"""

_REQ = f"""req AS (
  SELECT page_id AS seq,
         CASE WHEN page_id % 9 = 0 THEN '  ' WHEN page_id % 9 = 1 THEN url
              ELSE upper({_HOST}) END AS domain,
         CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ALLOW' WHEN 2 THEN 'allow'
              ELSE 'BLOCK' END AS action,
         CASE page_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'DOMAIN_AND_SUBDOMAINS' END
           AS match_type,
         CASE page_id % 5 WHEN 0 THEN 'phishing' WHEN 1 THEN '' WHEN 2 THEN 'Ads' END AS category,
         CASE page_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN '' END AS severity,
         CASE page_id % 7 WHEN 0 THEN 'say "no"; rule, ' || page_id WHEN 1 THEN 'plain' END
           AS reason
  FROM pages)"""

_API = f"""{_REQ},
api AS (
  SELECT seq, lower(trim(domain)) AS domain, coalesce(action, 'BLOCK') AS action,
         coalesce(match_type, 'DOMAIN_AND_SUBDOMAINS') AS match_type,
         coalesce(category, CASE WHEN action = 'ALLOW' THEN 'WHITELIST' ELSE 'OTHER' END)
           AS category,
         coalesce(severity, 'MEDIUM') AS severity,
         coalesce(reason, 'Batch imported CSV rule') AS reason
  FROM req WHERE trim(domain) <> '')"""


def _csv(source: str) -> str:
    """Normalized CSV rules of a request table."""
    allow = "coalesce(upper(trim(action)) = 'ALLOW', false)"
    host = r"regexp_replace(regexp_replace(lower(trim(domain)), '^https?://', ''), '/.*$', '')"
    return f"""csv AS (
  SELECT seq, {host} AS domain, CASE WHEN {allow} THEN 'ALLOW' ELSE 'BLOCK' END AS action,
         CASE WHEN upper(trim(match_type)) = 'EXACT' THEN 'EXACT'
              ELSE 'DOMAIN_AND_SUBDOMAINS' END AS match_type,
         CASE WHEN {allow} THEN 'WHITELIST'
              ELSE coalesce(nullif(upper(trim(category)), ''), 'MALWARE') END AS category,
         coalesce(nullif(upper(trim(severity)), ''),
                  CASE WHEN {allow} THEN 'LOW' ELSE 'HIGH' END) AS severity,
         coalesce(nullif(reason, ''), CASE WHEN {allow} THEN 'Whitelist import'
                  ELSE 'CSV bulk import rule' END) AS reason
  FROM {source} WHERE {host} <> '')"""


_CSV_COLS = "domain, action, match_type, category, severity, reason"

# Minute tables per resolver, as the batches carry them.
_DM = """dm AS (SELECT resolver_id, m, client_hash, domain, count(*) AS t,
              count(*) FILTER (b) AS bl,
              row_number() OVER (PARTITION BY resolver_id, m, client_hash
                                 ORDER BY count(*) DESC, domain) AS r
       FROM pe WHERE domain <> '' GROUP BY resolver_id, m, client_hash, domain)"""
_BATCH_ID = ("'b-' || resolver_id || '-' || (CAST(epoch(m) AS BIGINT) // 600 * 600) || '-' || "
             "left(client_hash, 1)")
_CLIENT_MINUTES = f"""SELECT {_BATCH_ID} AS batch_id, resolver_id, m AS minute_timestamp,
  client_hash, {_CNT}, {_LAT} FROM pe %s GROUP BY resolver_id, m, client_hash"""


def _hour_domains(source: str, order: str, k: int = 10) -> str:
    return f"""SELECT date_trunc('hour', m) AS hour_timestamp, client_hash, domain,
  CAST(sum(t) AS BIGINT) AS total_queries, CAST(sum(bl) AS BIGINT) AS blocked_queries,
  CAST(last(r ORDER BY {order}) AS INTEGER) AS domain_rank
FROM {source} WHERE r <= {k} GROUP BY date_trunc('hour', m), client_hash, domain"""


def _top(grain: str) -> str:
    return f"""dm AS (SELECT date_trunc('{grain}', ts) AS m, client_hash, domain, count(*) AS t,
  count(*) FILTER (b) AS bl, row_number() OVER (PARTITION BY date_trunc('{grain}', ts), client_hash
    ORDER BY count(*) DESC, domain) AS r
  FROM pe WHERE domain <> '' GROUP BY date_trunc('{grain}', ts), client_hash, domain)"""


def _top_rows(grain: str, k: int) -> str:
    return f"""WITH {_PE}, {_top(grain)}
SELECT m AS minute_timestamp, client_hash, domain, t AS total_queries, bl AS blocked_queries,
       CAST(r AS INTEGER) AS domain_rank FROM dm WHERE r <= {k}"""


_HOUR_CLIENT = f"""WITH {_PE} SELECT date_trunc('hour', ts) AS hour_timestamp, client_hash, {_CNT}
FROM pe GROUP BY ALL"""
_HOUR_RESOLVER = f"""WITH {_PE} SELECT date_trunc('hour', ts) AS hour_timestamp, {_CNT}, {_LAT}, {_AVG}
FROM pe GROUP BY ALL"""
_HOUR_CATEGORY = f"""WITH {_PE} SELECT date_trunc('hour', ts) AS hour_timestamp, client_hash, category,
{_PAIR} FROM pe WHERE category <> '' GROUP BY ALL"""

_RH = f"rh AS (SELECT hour_timestamp, {_S8}, sum(total_latency_ms) / sum(total_queries) AS avg_latency_ms FROM fb GROUP BY 1)"
_EH = f"""eh AS (SELECT date_trunc('hour', ts) AS hour_timestamp, {_CNT},
  sum(latency_ms) / count(*) AS avg_latency_ms FROM pe GROUP BY 1)"""

_WEEK = "hour_timestamp BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31'"
_MONTH30 = "hour_timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'"
_MARCH = "hour_timestamp BETWEEN TIMESTAMP '1997-03-01' AND TIMESTAMP '1997-03-31 23:59:59'"
_Y2K = "TIMESTAMP '2000-01-01'"


def _pct(part: str, total: str, digits: int = 2) -> str:
    scale = f"1e{digits}"
    return (f"CASE WHEN {total} > 0 THEN floor({part} * 1e2 / {total} * {scale} + 0.5) / {scale}"
            " ELSE 0e0 END")


def _risk(rate: str, high: str, medium: str, low: str) -> str:
    return f"CASE WHEN {rate} > 20 THEN '{high}' WHEN {rate} > 5 THEN '{medium}' ELSE '{low}' END"


def _totals(where: str) -> str:
    return f"""WITH {_FB0}, {_RH} SELECT {_sums(['total_queries', 'blocked_queries', 'cache_hits'])},
round(avg(avg_latency_ms), 6) AS avg_latency_ms,
round(sum(total_latency_ms) / sum(total_queries), 6) AS weighted_avg_latency_ms FROM rh {where}"""


def _clients(counts: str, domains: str) -> str:
    """Report over ``counts(client_hash, t, bl)`` and ``domains(client_hash, n)``."""
    return f"""rate AS (SELECT client_hash, t AS total_queries, bl AS blocked_queries,
  {_pct('bl', 't', 1)} AS block_rate, coalesce(n, 0) AS distinct_domains
  FROM {counts} LEFT JOIN {domains} USING (client_hash)),
report AS (SELECT *, {_risk('block_rate', 'HIGH', 'MEDIUM', 'LOW')} AS risk_level,
  {_risk('block_rate', '🔴', '🟡', '🟢')} AS risk_badge FROM rate)"""


_FB_CLIENTS = f"""cc AS (SELECT client_hash, CAST(sum(total_queries) AS BIGINT) AS t,
  CAST(sum(blocked_queries) AS BIGINT) AS bl FROM fb GROUP BY 1),
dd AS (SELECT client_hash, count(DISTINCT domain) AS n FROM fb GROUP BY 1),
{_clients('cc', 'dd')}"""

_TOP50 = """top50 AS (
  SELECT row_number() OVER (ORDER BY sum(blocked_queries) DESC, sum(total_queries) DESC, domain)
           AS rank, domain, 'SECURITY' AS category,
         CAST(sum(total_queries) AS BIGINT) AS total_queries,
         CAST(sum(blocked_queries) AS BIGINT) AS blocked_queries,
         count(DISTINCT client_hash) AS clients
  FROM fb GROUP BY domain ORDER BY rank LIMIT 50)"""

_CATS = f"cats AS (SELECT category, {_S2} FROM fb GROUP BY category)"


def _windows() -> str:
    rows = [("1h", "2024-01-30 23:00:00", "2024-01-31"), ("24h", "2024-01-30", "2024-01-31"),
            ("7d", "2024-01-24", "2024-01-31"), ("30d", "2024-01-01", "2024-01-31"),
            ("all", "2014-01-31", "2024-01-31"), ("month", "2024-01-01", "2024-01-31 23:59:59"),
            ("dates", "2024-01-05", "2024-01-07 23:59:59"), ("bad", "2024-01-30", "2024-01-31")]
    values = ", ".join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{z}')" for n, a, z in rows)
    return f"""WITH {_PE}, {_EH}, w(period, lo, hi) AS (VALUES {values})
SELECT period, period = 'all' AS all_time, count(hour_timestamp) AS hours,
       CAST(coalesce(sum(total_queries), 0) AS BIGINT) AS total_queries
FROM w LEFT JOIN eh ON hour_timestamp BETWEEN lo AND hi GROUP BY period"""


def _family() -> str:
    families = [("THREAT", "MALWARE|PHISH|SECURITY|THREAT"), ("ADS", "AD|PROMO"),
                ("TRACKING", "TRACK|ANALYTICS|TELEMETRY"), ("CRYPTO", "CRYPTO|MINING"),
                ("GAMBLING", "GAMBLING|BET"), ("ADULT", "ADULT|PORN"), ("SOCIAL", "SOCIAL")]
    names = ", ".join(f"'{n}'" for n in CATEGORY_NAMES)
    cases = " ".join(f"WHEN regexp_matches(c, '{p}') THEN '{f}'" for f, p in families)
    return f"""WITH x AS (SELECT page_id, upper(coalesce(
  ([{names}])[page_id % {len(CATEGORY_NAMES) + 1} + 1], '')) AS c FROM pages)
SELECT page_id, CASE {cases} ELSE 'OTHER' END AS family FROM x"""


def _pipeline() -> str:
    tables = {
        "resolver_hourly_stats": f"SELECT date_trunc('hour', ts) AS h, {_PAIR} FROM pe GROUP BY ALL",
        "client_hourly_stats":
            f"SELECT date_trunc('hour', ts) AS h, client_hash, {_PAIR} FROM pe GROUP BY ALL",
        "client_category_hourly": f"""SELECT date_trunc('hour', ts) AS h, client_hash, category,
            {_PAIR} FROM pe WHERE category <> '' GROUP BY ALL""",
        "client_top_domains_hourly": _hour_domains("dm", "m, resolver_id"),
    }
    parts = [f"SELECT '{n}' AS table_name, count(*) AS rows, {_S2} FROM ({q})"
             for n, q in tables.items()]
    return f"WITH {_PE}, {_DM} " + " UNION ALL ".join(parts)


_KEPT = f"date_trunc('month', hour_timestamp) >= {_Y2K}"

ORACLES: dict[str, str] = {
    "src_batch_files": f"""WITH {_PE} SELECT {_BATCH_ID} AS batch_id, resolver_id,
CAST(epoch(min(m)) AS BIGINT) AS window_start_timestamp,
CAST(epoch(max(m)) AS BIGINT) + 60 AS window_end_timestamp, count(DISTINCT m) AS minutes
FROM pe GROUP BY 1, 2""",
    "encode_batch": f"WITH {_PE} " + _CLIENT_MINUTES % "",
    "decode_batch": f"""WITH {_PE}, {_DM} SELECT resolver_id, m AS minute_timestamp, client_hash,
domain, t AS total_queries, bl AS blocked_queries, CAST(r AS INTEGER) AS domain_rank
FROM dm WHERE r <= 10""",
    "quarantine_bad_batches": f"""WITH {_PE}
SELECT resolver_id = 'resolver-1' AS quarantined, resolver_id = 'resolver-1' AS no_batch,
       resolver_id = 'resolver-1' AS payload_kept, count(DISTINCT {_BATCH_ID}) AS batches
FROM pe GROUP BY ALL""",
    "sink_hourly_upsert": _HOUR_CLIENT,
    "sink_hourly_upsert_resolver": _HOUR_RESOLVER,
    "sink_hourly_upsert_category": _HOUR_CATEGORY,
    "sink_hourly_upsert_domain":
        f"WITH {_PE}, {_DM} " + _hour_domains("dm", f"m, {_BATCH_ID}"),
    "scan_hourly_before": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, {_S7} FROM fb
WHERE hour_timestamp < {_Y2K} GROUP BY ALL""",
    "rules_csv_import": f"WITH {_REQ}, {_csv('req')} SELECT {_CSV_COLS} FROM csv",
    "rules_csv_export": f"""WITH {_API},
filled AS (SELECT * REPLACE (coalesce(nullif(category, ''), 'OTHER') AS category,
                             coalesce(nullif(severity, ''), 'MEDIUM') AS severity) FROM api),
{_csv('filled')} SELECT {_CSV_COLS} FROM csv""",
    "blocklist_text_load": f"SELECT DISTINCT {_HOST} AS domain FROM pages WHERE page_id % 5 <> 0",

    "client_hash": f"""WITH {_EV}, x AS (SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL
  WHEN event_id % 103 = 0 THEN '  ' WHEN event_id % 107 = 0 THEN ' ' || client_ip
  ELSE client_ip END AS ip FROM ev)
SELECT event_id, {_hash('ip')} AS client_hash FROM x""",
    "normalize_domain": f"""WITH x AS (SELECT page_id, {_MESSY} AS d
  FROM (SELECT page_id, {_HOST} AS domain FROM pages))
SELECT page_id,
  CASE WHEN suffix(lower(d), '.') THEN left(lower(d), length(d) - 1) ELSE lower(d) END AS domain,
  CASE WHEN suffix(trim(d), '.') THEN left(lower(trim(d)), length(trim(d)) - 1)
       ELSE lower(trim(d)) END AS trimmed FROM x""",
    "strip_url_to_domain": """SELECT page_id, split_part(regexp_replace(lower(url),
  '^https?://', ''), '/', 1) AS domain FROM pages""",
    "domain_suffixes": f"""WITH RECURSIVE walk AS (
  SELECT page_id, 0 AS depth, {_MESSY} AS suffix
  FROM (SELECT page_id, {_HOST} AS domain FROM pages) WHERE domain <> ''
  UNION ALL
  SELECT page_id, depth + 1, substr(suffix, strpos(suffix, '.') + 1) FROM walk
  WHERE strpos(suffix, '.') > 1 AND strpos(suffix, '.') < length(suffix))
SELECT page_id, CAST(depth AS BIGINT) AS depth, suffix FROM walk""",
    "is_blocked_action": "SELECT event_id, event_type = 'signup' AS is_blocked FROM events",
    "classify_outcome": f"""WITH {_EV}, x AS (SELECT *, action = 'BLOCKED' OR event_id % 50 = 0
  AS block FROM ev)
SELECT event_id,
  CASE WHEN block THEN 'BLOCKED' WHEN cache_hit THEN 'L1_HIT' ELSE action END AS action,
  CASE WHEN block AND NOT cache_hit THEN 'SECURITY' ELSE 'GENERAL' END AS category, cache_hit,
  CAST(CASE WHEN block OR cache_hit OR action = 'L2_HIT' THEN 0 WHEN action = 'ERROR' THEN 2
       ELSE rcode END AS INTEGER) AS rcode
FROM x""",
    "rcode_flags": f"""WITH {_EV} SELECT resolver_id, count(*) FILTER (rcode = 3) AS nxdomain_queries,
count(*) FILTER (rcode = 2) AS servfail_queries FROM ev GROUP BY 1""",
    "skip_blank_keys": f"""WITH {_PE} SELECT client_hash, count(*) AS total_queries,
count(*) FILTER (event_id % 97 <> 0) AS with_category FROM pe GROUP BY 1""",
    "resolve_time_window": _windows(),
    "filter_between": f"""WITH {_FB0}, {_RH} SELECT hour_timestamp, {', '.join(_C7)} FROM rh
WHERE {_MARCH}""",
    "safe_ratio_pct": f"""WITH {_FB0}, ch AS (SELECT hour_timestamp, client_hash, {_S2} FROM fb
  GROUP BY ALL), x AS (SELECT *, CASE WHEN total_queries % 10 = 0 THEN 0 ELSE total_queries END AS t
  FROM ch)
SELECT hour_timestamp, client_hash, {_pct('blocked_queries', 't')} AS pct_2,
       {_pct('blocked_queries', 't', 1)} AS pct_1 FROM x""",
    "risk_level": f"""WITH {_FB0}, ch AS (SELECT hour_timestamp, client_hash, {_S2} FROM fb
  GROUP BY ALL), x AS (SELECT *, {_pct('blocked_queries', 'total_queries', 1)} AS rate FROM ch)
SELECT hour_timestamp, client_hash, {_risk('rate', 'HIGH', 'MEDIUM', 'LOW')} AS risk_level,
       {_risk('rate', '🔴', '🟡', '🟢')} AS risk_badge FROM x""",
    "category_family": _family(),
    "time_label": f"""WITH {_FB0} SELECT DISTINCT hour_timestamp,
strftime(hour_timestamp, '%-I%p') AS hour_label,
strftime(hour_timestamp, '%b %-d %-I%p') AS day_hour_label,
strftime(hour_timestamp, '%b %d') AS day_label FROM fb""",
    "epoch_to_hour": "SELECT event_id, date_trunc('hour', ts) AS hour_timestamp FROM events",
    "label_null_keys": f"""WITH {_PE}
SELECT CASE WHEN event_id % 5 = 0 THEN 'GENERAL' ELSE category END AS category,
       CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE client_hash END AS client_hash,
       CASE WHEN event_id % 11 = 0 THEN '' ELSE domain END AS domain, count(*) AS total_queries
FROM pe GROUP BY ALL""",

    "agg_resolver_minute": f"WITH {_PE} SELECT m AS minute_timestamp, {_CNT}, {_LAT} FROM pe GROUP BY m",
    "agg_client_minute": f"""WITH {_PE} SELECT m AS minute_timestamp, client_hash, {_CNT}, {_LAT}
FROM pe GROUP BY m, client_hash""",
    "agg_client_category_minute": f"""WITH {_PE} SELECT m AS minute_timestamp, client_hash, category,
{_PAIR} FROM pe WHERE category <> '' GROUP BY m, client_hash, category""",
    "agg_client_domain_minute": f"""WITH {_PE} SELECT m AS minute_timestamp, client_hash, domain,
{_PAIR} FROM pe WHERE domain <> '' GROUP BY m, client_hash, domain""",
    "event_cube": f"""WITH {_PE} SELECT m AS minute_timestamp, resolver_id, client_hash, category,
domain, {_CNT}, {_LAT} FROM pe GROUP BY m, resolver_id, client_hash, category, domain""",
    "assemble_batch": f"""WITH {_PE} SELECT {_BATCH_ID} AS batch_id, resolver_id,
CAST(epoch(min(m)) AS BIGINT) AS window_start_timestamp,
CAST(epoch(max(m)) AS BIGINT) + 60 AS window_end_timestamp, count(DISTINCT m) AS minutes,
count(DISTINCT (m, client_hash)) AS client_minutes, count(*) AS total_queries
FROM pe GROUP BY 1, 2""",
    "flatten_batch": f"""WITH {_PE} SELECT {_BATCH_ID} AS batch_id, resolver_id,
m AS minute_timestamp, client_hash, category, {_PAIR} FROM pe WHERE category <> ''
GROUP BY resolver_id, m, client_hash, category""",
    "flatten_batch_resolver": f"""WITH {_PE} SELECT {_BATCH_ID} AS batch_id, resolver_id,
m AS minute_timestamp, {_CNT}, {_LAT} FROM pe GROUP BY 1, resolver_id, m""",
    "hourly_resolver": _HOUR_RESOLVER,
    "hourly_client": _HOUR_CLIENT,
    "hourly_client_category": _HOUR_CATEGORY,
    "hourly_client_domain": f"WITH {_PE}, {_top('minute')} " + _hour_domains("dm", "m"),
    "hourly_client_domain_day_top3": f"WITH {_PE}, {_top('day')} " + _hour_domains("dm", "m", 3),
    "hourly_client_domain_exact": f"""WITH {_PE} SELECT date_trunc('hour', ts) AS hour_timestamp,
client_hash, domain, {_PAIR} FROM pe WHERE domain <> '' GROUP BY ALL""",
    "event_to_hour_pipeline": _pipeline(),
    "daily_resolver": f"""WITH {_FB0} SELECT CAST(CAST(hour_timestamp AS DATE) AS VARCHAR) AS date_timestamp, {_S8},
{_SAVG} FROM fb GROUP BY 1""",
    "daily_client": f"""WITH {_FB0} SELECT CAST(CAST(hour_timestamp AS DATE) AS VARCHAR) AS date_timestamp,
client_hash, {_S7} FROM fb GROUP BY 1, 2""",
    "monthly_resolver": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
{_S8}, {_SAVG} FROM fb GROUP BY 1""",
    "monthly_client": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
client_hash, {_S7} FROM fb GROUP BY 1, 2""",
    "mv_resolver_daily": f"""WITH {_FB0}, {_RH}
SELECT CAST(date_trunc('day', hour_timestamp) AS TIMESTAMP) AS stat_date,
count(*) AS hourly_windows_count, {_sums(['total_queries', 'blocked_queries', 'cache_hits'])},
round(avg(avg_latency_ms), 6) AS avg_latency_ms,
round(sum(total_latency_ms) / sum(total_queries), 6) AS weighted_avg_latency_ms
FROM rh GROUP BY 1""",
    "mv_top_categories": f"WITH {_FB0}, {_CATS} SELECT * FROM cats",
    "sum_all_time": _totals(""),
    "sum_between": _totals(f"WHERE {_MARCH}"),
    "distinct_clients": f"WITH {_FB0} SELECT count(DISTINCT client_hash) AS active_clients FROM fb",
    "distinct_domains_per_client": f"""WITH {_FB0} SELECT client_hash,
count(DISTINCT domain) AS distinct_domains FROM fb GROUP BY 1""",

    "match_rules": _MATCH_RULES,
    "match_rules_shuffled": _MATCH_RULES,
    "match_blocked_set": f"""WITH RECURSIVE {_RULES}, {_DOMAINS}, {_WALK}, {_listed()},
{_LISTED_PARENT} SELECT d.domain, lp.domain IS NOT NULL AS blocked
FROM domains d LEFT JOIN lp ON lp.domain = d.domain""",
    "policy_decision": _policy_events(),
    "policy_decision_strict": _policy_events("AND match_type = 'DOMAIN_AND_SUBDOMAINS'"),
    "policy_decision_shuffled": _policy_events(),
    "upsert_hourly": f"WITH {_FB0} SELECT hour_timestamp, {_S8}, {_SAVG} FROM fb GROUP BY 1",
    "upsert_rollup": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
client_hash, {_S7} FROM fb GROUP BY 1, 2""",
    "normalize_rules_api": f"WITH {_API} SELECT seq, {_CSV_COLS} FROM api",
    "normalize_rules_csv": f"WITH {_REQ}, {_csv('req')} SELECT seq, {_CSV_COLS} FROM csv",
    "upsert_rules": f"""WITH {_RULES}, {_REQ}, {_csv('req')},
new AS (SELECT * FROM csv QUALIFY row_number() OVER (PARTITION BY domain ORDER BY seq DESC) = 1)
SELECT domain, coalesce(n.action, r.action) AS action,
  coalesce(n.match_type, r.match_type) AS match_type,
  coalesce(n.category, CASE WHEN r.action = 'ALLOW' THEN 'WHITELIST' ELSE 'MALWARE' END)
    AS category,
  coalesce(n.severity, CASE WHEN r.action = 'ALLOW' THEN 'LOW' ELSE 'HIGH' END) AS severity,
  CASE WHEN n.seq IS NULL THEN r.status ELSE 'ACTIVE' END AS status, 'ADMIN' AS source,
  coalesce(n.reason, 'rule for ' || domain) AS reason,
  CASE WHEN r.status IS NULL THEN TIMESTAMP '2024-01-31' ELSE TIMESTAMP '2024-01-01' END
    AS created_at,
  CASE WHEN n.seq IS NULL THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-31' END
    AS updated_at
FROM rules r FULL JOIN new n USING (domain)""",
    "delete_rules": f"""WITH {_RULES}, {_DOMAINS} SELECT domain, action, status FROM rules
WHERE domain NOT IN (SELECT domain FROM domains WHERE length(domain) % 5 = 0)""",
    "upsert_blocked_entries": f"""WITH {_DOMAINS}, {_ENTRIES},
x AS (SELECT page_id, lower(trim({_MESSY})) AS d
      FROM (SELECT page_id, {_HOST} AS domain FROM pages)),
rows AS (SELECT -1 AS o, domain, 'OLD' AS category FROM entries UNION ALL
  SELECT page_id, CASE WHEN suffix(d, '.') THEN left(d, length(d) - 1) ELSE d END,
         CASE WHEN page_id % 2 = 0 THEN 'MALWARE' ELSE 'PHISHING' END FROM x)
SELECT domain, arg_max(category, o) AS category FROM rows GROUP BY domain""",
    "delete_blocked_entries": f"""WITH {_DOMAINS}, {_ENTRIES} SELECT domain, 'OLD' AS category
FROM entries WHERE length(domain) % 3 <> 0""",
    "upsert_overrides": f"""WITH o AS (SELECT page_id AS id, {_HOST} AS d,
  page_id % 2 = 0 AND page_id <> 0 AS c FROM pages)
SELECT id, CASE WHEN c AND id % 3 <> 0 THEN 'new.' || d ELSE d END AS domain,
  CASE WHEN c AND id % 3 <> 1 THEN 'AAAA' ELSE 'A' END AS record_type,
  '192.0.2.' || (id % 256) AS ip_address,
  CAST(CASE WHEN c AND id % 3 <> 2 THEN 60 ELSE 300 END AS INTEGER) AS ttl,
  CASE WHEN c THEN 'changed' END AS description FROM o""",
    "create_overrides": f"""WITH p AS (SELECT page_id, {_HOST} AS domain FROM pages),
known AS (SELECT min(page_id) AS id, domain FROM p WHERE length(domain) % 2 = 0 GROUP BY domain),
fresh AS (SELECT min(page_id) AS i, domain FROM p WHERE page_id % 11 <> 0
          AND domain NOT IN (SELECT domain FROM known) GROUP BY domain)
SELECT id, domain, 'A' AS record_type, '192.0.2.1' AS ip_address, CAST(60 AS INTEGER) AS ttl,
  'old' AS description FROM known
UNION ALL SELECT (SELECT max(id) FROM known) + i + 1, domain,
  CASE WHEN i % 2 = 0 THEN 'AAAA' ELSE 'A' END,
  CASE WHEN i % 3 <> 0 THEN '192.0.2.' || (i % 256) ELSE '127.0.0.1' END, 300, 'new' FROM fresh""",
    "lookup_by_domain": f"""WITH {_RULES}, {_DOMAINS}, {_ENTRIES}
SELECT 'rule' AS kind, domain FROM rules WHERE domain = 'example.net'
UNION ALL SELECT 'entry', domain FROM entries WHERE domain = 'example.net'
UNION ALL SELECT 'override', {_HOST} FROM pages WHERE {_HOST} = 'example.net'""",
    "delete_rules_from_list": f"""WITH {_RULES}, {_DOMAINS}, {_ENTRIES},
gone AS (SELECT domain FROM domains WHERE length(domain) % 5 = 0),
names AS (SELECT domain FROM rules WHERE status = 'ACTIVE' AND action = 'BLOCK'
          UNION SELECT domain FROM entries)
SELECT domain FROM names WHERE domain NOT IN (SELECT domain FROM gone)
AND domain NOT IN (SELECT domain FROM rules WHERE status = 'ACTIVE' AND action <> 'BLOCK')""",
    "delete_overrides": f"""SELECT page_id AS id, {_HOST} AS domain, 'A' AS record_type,
'192.0.2.' || (page_id % 256) AS ip_address, CAST(300 AS INTEGER) AS ttl,
CAST(NULL AS VARCHAR) AS description FROM pages WHERE page_id % 4 <> 1""",
    "lookup_by_key": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, domain, {_S2} FROM fb
WHERE client_hash = 'c7' GROUP BY ALL""",
    "lookup_by_key_hourly": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, {_S7} FROM fb
WHERE client_hash = 'c7' GROUP BY ALL""",
    "lookup_by_key_category": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, category, {_S2}
FROM fb WHERE client_hash = 'c7' GROUP BY ALL""",
    "rules_by_status": f"WITH {_RULES} SELECT domain, action, match_type FROM rules WHERE status = 'ACTIVE'",
    "publish_rule_snapshot":
        f"WITH {_RULES}, {_DOMAINS}, {_ENTRIES}, {_listed(entries=True)} SELECT domain FROM bset",
    "apply_rule_delta": f"""WITH {_RULES}, {_DOMAINS}, {_ENTRIES}, {_listed(entries=True)},
last AS (SELECT {_HOST} AS domain, arg_max(page_id, page_id) AS i FROM pages GROUP BY 1)
SELECT domain FROM bset WHERE domain NOT IN (SELECT domain FROM last)
UNION ALL SELECT domain FROM last WHERE i % 3 <> 0 AND i % 5 <> 0""",
    "apply_rule_delta_to_rules": f"""WITH {_RULES},
last AS (SELECT {_HOST} AS domain, max(page_id) AS i FROM pages GROUP BY 1)
SELECT domain, action, match_type, status FROM rules
WHERE status = 'ACTIVE' AND domain NOT IN (SELECT domain FROM last)
UNION ALL SELECT domain, CASE WHEN i % 3 = 0 THEN 'ALLOW' ELSE 'BLOCK' END, 'EXACT', 'ACTIVE'
FROM last WHERE i % 5 <> 0""",
    "latest_rule_version": f"""WITH {_RULES} SELECT CAST(2 AS BIGINT) AS version, domain, action
FROM rules WHERE status = 'ACTIVE' AND action = 'BLOCK'""",

    "top10_domains_client_minute": _top_rows("minute", 10),
    "top3_domains_client_day": _top_rows("day", 3),
    "top_blocked_domains": f"WITH {_FB0}, {_TOP50} SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM top50",
    "top_clients": f"""WITH {_PE}, {_top('minute')},
cc AS (SELECT client_hash, count(*) AS t, count(*) FILTER (b) AS bl FROM pe GROUP BY 1),
dd AS (SELECT client_hash, count(DISTINCT domain) AS n FROM dm WHERE r <= 10 GROUP BY 1),
{_clients('cc', 'dd')} SELECT * FROM report ORDER BY total_queries DESC, client_hash""",
    "top_clients_from_facts": f"""WITH {_FB0}, {_FB_CLIENTS} SELECT * FROM report
ORDER BY total_queries DESC, client_hash""",
    "category_breakdown": f"WITH {_FB0}, {_CATS} SELECT * FROM cats ORDER BY total_queries DESC, category",
    "latest_24_hours": f"""WITH {_FB0}, {_RH} SELECT hour_timestamp, {', '.join(_C7)} FROM rh
ORDER BY hour_timestamp DESC LIMIT 24""",
    "clients_over_rate": f"""WITH {_PE} SELECT client_hash, date_trunc('day', ts) AS second,
count(*) AS queries, count(*) - 3 AS over_limit FROM pe GROUP BY 1, 2 HAVING count(*) > 3""",
    "queries_over_rate": f"""WITH {_PE} SELECT event_id, client_hash, date_trunc('day', ts) AS ts
FROM pe QUALIFY row_number() OVER (PARTITION BY client_hash, date_trunc('day', ts)
                                   ORDER BY event_id) > 2""",
    "any_query_report": f"""WITH {_PE} SELECT client_hash, count(*) AS total_queries,
count(*) FILTER (qtype = 'ANY') AS any_queries FROM pe GROUP BY 1 HAVING any_queries > 0""",
    "summary": f"""WITH {_PE}, {_EH},
s AS (SELECT {_sums(['total_queries', 'blocked_queries', 'cache_hits'])},
  avg(avg_latency_ms) AS lat FROM eh WHERE {_WEEK})
SELECT total_queries, blocked_queries, {_pct('blocked_queries', 'total_queries')} AS blocked_percent,
  {_pct('cache_hits', 'total_queries')} AS cache_hit_percent,
  floor(lat * 1e2 + 0.5) / 1e2 AS avg_latency_ms,
  (SELECT count(DISTINCT client_hash) FROM pe) AS active_clients,
  (SELECT count(DISTINCT client_hash) FROM pe
   WHERE date_trunc('hour', ts) BETWEEN TIMESTAMP '2024-01-24' AND TIMESTAMP '2024-01-31')
   AS active_clients_in_range FROM s""",
    "summary_all_time": f"""WITH {_FB0}, {_RH},
s AS (SELECT {_sums(['total_queries', 'blocked_queries', 'cache_hits'])},
  avg(avg_latency_ms) AS lat FROM rh)
SELECT total_queries, blocked_queries, {_pct('blocked_queries', 'total_queries')} AS blocked_percent,
  {_pct('cache_hits', 'total_queries')} AS cache_hit_percent,
  floor(lat * 1e2 + 0.5) / 1e2 AS avg_latency_ms,
  (SELECT count(DISTINCT client_hash) FROM fb) AS active_clients,
  (SELECT count(DISTINCT client_hash) FROM fb) AS active_clients_in_range FROM s""",
    "traffic_hourly": f"""WITH {_PE}, {_EH} SELECT hour_timestamp,
strftime(hour_timestamp, '%b %-d %-I%p') AS time, total_queries, blocked_queries FROM eh
WHERE {_WEEK} ORDER BY hour_timestamp""",
    "traffic_daily": f"""WITH {_PE}, {_EH} SELECT CAST(CAST(hour_timestamp AS DATE) AS VARCHAR) AS date,
strftime(min(hour_timestamp), '%b %d') AS time, {_S2} FROM eh WHERE {_MONTH30}
GROUP BY 1 ORDER BY 1""",
    "threat_counters": f"""WITH {_FB0} SELECT """ + ", ".join(
        f"CAST(coalesce(sum(blocked_queries) FILTER (category = '{c}'), 0) AS BIGINT)"
        f" AS {c.lower()}_blocked" for c in ("MALWARE", "PHISHING", "ADS")) + " FROM fb",
    "search_threats": f"""WITH {_FB0}, {_TOP50} SELECT * REPLACE (CAST(rank AS INTEGER) AS rank)
FROM top50 WHERE contains(lower(domain), 'd1') OR contains(lower(category), 'd1')""",
    "search_clients": f"""WITH {_FB0}, {_FB_CLIENTS} SELECT client_hash, risk_level FROM report
WHERE contains(lower(client_hash), 'med') OR contains(lower(risk_level), 'med')""",
    "search_rules": f"""WITH {_RULES} SELECT domain,
CASE WHEN action = 'ALLOW' THEN 'WHITELIST' ELSE 'MALWARE' END AS category FROM rules
WHERE action = 'ALLOW' OR contains(domain, 'white')""",
    "client_share": f"""WITH {_FB0}, {_CATS}, n AS (SELECT count(DISTINCT client_hash) AS n FROM fb)
SELECT category,
  CAST(floor(total_queries / (SELECT n FROM n) + 0.5) AS BIGINT) AS queries,
  CAST(floor(blocked_queries / (SELECT n FROM n) + 0.5) AS BIGINT) AS blocked,
  CAST({_pct('blocked_queries', 'total_queries', 0)} AS BIGINT) AS pct_blocked FROM cats""",
    "client_activity_share": f"""WITH {_PE}, {_EH} SELECT hour_timestamp,
strftime(hour_timestamp, '%b %-d %-I%p') AS time,
CAST(floor(total_queries / (SELECT count(DISTINCT client_hash) FROM pe) + 0.5) AS BIGINT)
  AS queries FROM eh WHERE {_WEEK}""",
    "resolver_rates": f"""WITH {_FB0}, x AS (SELECT CAST(sum(total_queries) AS BIGINT) AS t FROM fb),
y AS (SELECT t, CAST(floor(t / 86400 + 0.5) AS BIGINT) AS q FROM x)
SELECT t AS total_queries, q AS qps, CAST(floor(q / 3 + 0.5) AS BIGINT) AS qps_per_node FROM y""",
    "resolver_nodes": f"""WITH {_EV} SELECT resolver_id, count(*) AS total_queries,
{_pct('count(*) FILTER (cache_hit)', 'count(*)')} AS cache_hit_percent,
quantile_disc(latency_ms, 0.95) AS p95_latency_ms FROM ev GROUP BY 1""",

    "month_rollover": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
client_hash, {_S7} FROM fb WHERE hour_timestamp < {_Y2K} GROUP BY 1, 2""",
    "month_rollover_daily": f"""WITH {_FB0} SELECT CAST(CAST(hour_timestamp AS DATE) AS VARCHAR) AS date_timestamp,
client_hash, {_S7} FROM fb WHERE hour_timestamp < {_Y2K} GROUP BY 1, 2""",
    "month_rollover_kept_hours": f"""WITH {_FB0} SELECT hour_timestamp, {_S8}, {_SAVG} FROM fb
WHERE {_KEPT} GROUP BY 1""",
    "purge_before": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, category, {_S2} FROM fb
WHERE hour_timestamp >= {_Y2K} GROUP BY ALL""",
    "purge_detail": f"""WITH {_FB0} SELECT hour_timestamp, client_hash, category, {_S2} FROM fb
WHERE hour_timestamp >= {_Y2K} GROUP BY ALL""",
    "compact_months": _HOUR_CLIENT,
    "compact_months_domain":
        f"WITH {_PE}, {_DM} " + _hour_domains("dm", f"m, {_BATCH_ID}"),
    "tiered_summary": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
{_S8}, {_SAVG} FROM fb GROUP BY 1""",
    "tiered_summary_during_removal": f"""WITH {_FB0} SELECT strftime(hour_timestamp, '%Y-%m') AS year_month,
{_S8}, {_SAVG} FROM fb GROUP BY 1""",

    "stream_minute_metrics": f"""WITH {_PE} SELECT m AS minute_timestamp, {_CNT}, {_LAT} FROM pe
GROUP BY m""",
    "stream_client_minutes": f"""WITH {_PE} SELECT m AS minute_timestamp, client_hash, {_CNT}, {_LAT}
FROM pe GROUP BY m, client_hash""",
    "stream_top_domains": _top_rows("minute", 10),
    "stream_10min_batches": f"WITH {_PE} " + _CLIENT_MINUTES % "",
    "late_events": f"""WITH {_PE} SELECT m AS minute_timestamp, client_hash, {_CNT}, {_LAT}
FROM pe GROUP BY m, client_hash""",
    "sink_new_checkpoint": _HOUR_CLIENT,
    "stream_policy_decision": _policy_events(),
    "zero_fill_minutes": f"""WITH {_PE},
span AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MINUTE)) AS m FROM pe),
x AS (SELECT m, {_CNT}, {_LAT} FROM pe GROUP BY m)
SELECT span.m AS minute_timestamp, """ + ", ".join(
        f"coalesce({c}, 0) AS {c}" for c in [*_C7, "total_latency_ms"])
    + " FROM span LEFT JOIN x ON x.m = span.m",
    "dedup_stream": f"WITH {_PE} " + _CLIENT_MINUTES % "",
    "dedup_batches": _HOUR_CLIENT,
    "late_data": _HOUR_RESOLVER,
}

# --- summaries of any period ------------------------------------------------------------

ORACLES["stream_minute_stateful"] = ORACLES["stream_minute_metrics"]
ORACLES["stream_zero_fill"] = ORACLES["zero_fill_minutes"]

ORACLES["mv_refresh_fast"] = f"""WITH {_FB0}, rh0 AS (
  SELECT hour_timestamp, hour(hour_timestamp) AS h, hour_timestamp >= TIMESTAMP '1997-01-01' AS late,
         {_S8} FROM fb GROUP BY ALL),
rh AS (SELECT * REPLACE (total_queries + CASE WHEN late AND h = 3 THEN 7 ELSE 0 END AS total_queries,
       total_latency_ms + CASE WHEN late AND h = 3 THEN 70 ELSE 0 END AS total_latency_ms)
  FROM rh0 WHERE NOT (h = 5 AND NOT late) AND NOT (h = 2 AND late))
SELECT CAST(date_trunc('day', hour_timestamp) AS TIMESTAMP) AS stat_date,
count(*) AS hourly_windows_count, {_sums(['total_queries', 'blocked_queries', 'cache_hits'])},
round(avg(total_latency_ms / total_queries), 6) AS avg_latency_ms,
round(sum(total_latency_ms) / sum(total_queries), 6) AS weighted_avg_latency_ms
FROM rh GROUP BY 1"""

# The tables here hold few members per sketch: the estimate is then the exact number.
_SPREAD = f"""n AS estimate, CAST(floor(n / (1 + {SPREAD!r})) AS BIGINT) AS lower_bound,
CAST(ceil(n / (1 - {SPREAD!r})) AS BIGINT) AS upper_bound, n AS exact"""

ORACLES["distinct_clients_sketch"] = f"""WITH {_FB0}, x AS (
  SELECT strftime(hour_timestamp, '%Y-%m') AS period, count(DISTINCT client_hash) AS n
  FROM fb GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT client_hash) FROM fb)
SELECT period, {_SPREAD} FROM x"""

ORACLES["distinct_domains_sketch"] = f"""WITH {_FB0}, x AS (
  SELECT client_hash, count(DISTINCT domain) AS n FROM fb GROUP BY 1)
SELECT client_hash, {_SPREAD} FROM x"""


def _p95(period: str, name: str, extra: str = "") -> str:
    return f"""WITH {_EV} SELECT {period} AS {name}, resolver_id, count(*) AS measured,
quantile_disc(latency_ms, 0.95) AS p95_latency_ms {extra} FROM ev GROUP BY 1, 2"""


ORACLES["resolver_p95_hourly"] = _p95("CAST(date_trunc('hour', ts) AS TIMESTAMP)", "hour_timestamp")
ORACLES["resolver_p95_daily"] = _p95("CAST(date_trunc('day', ts) AS TIMESTAMP)", "day_timestamp")
ORACLES["resolver_p95_monthly"] = _p95("strftime(ts, '%Y-%m')", "year_month",
                                       ", TRUE AS within_bounds")

ORACLES["client_domain_bounds"] = f"""WITH {_PE}, dd AS (
  SELECT date_trunc('day', ts) AS d, client_hash, domain, count(*) AS n FROM pe
  WHERE domain IS NOT NULL AND trim(domain) <> '' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER w AS r, coalesce(lead(n) OVER w, 0) AS cut FROM dd
  WINDOW w AS (PARTITION BY d, client_hash ORDER BY n DESC, domain)),
own AS (SELECT CAST(date_trunc('month', d) AS TIMESTAMP) AS period, client_hash, domain,
  CAST(sum(n) AS BIGINT) AS at_least, CAST(sum(cut) AS BIGINT) AS own_cut
  FROM ranked WHERE r = 1 GROUP BY ALL),
every AS (SELECT CAST(date_trunc('month', d) AS TIMESTAMP) AS period, client_hash,
  CAST(sum(cut) AS BIGINT) AS all_cut FROM ranked WHERE r = 1 GROUP BY ALL),
exact AS (SELECT CAST(date_trunc('month', d) AS TIMESTAMP) AS period, client_hash, domain,
  CAST(sum(n) AS BIGINT) AS exact FROM dd GROUP BY ALL)
SELECT period, client_hash, domain, at_least, at_least + all_cut - own_cut AS at_most, exact,
  exact BETWEEN at_least AND at_least + all_cut - own_cut AS holds
FROM own JOIN every USING (period, client_hash) JOIN exact USING (period, client_hash, domain)"""

ORACLES["tiered_range"] = f"WITH {_FB0}, r(period, lo, hi) AS (VALUES " + ", ".join(
    f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, (a, b) in enumerate(RANGES)) + ") SELECT period, " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in [*_C7, "total_latency_ms"]) + """,
coalesce(round(sum(total_latency_ms) / sum(total_queries), 6), 0.0) AS avg_latency_ms
FROM r LEFT JOIN fb ON hour_timestamp BETWEEN lo AND hi GROUP BY 1"""


def _decided_by(version: int, condition: str) -> str:
    """Decisions of one rule version, as CTEs of their own."""
    v = f"v{version}"
    return f"""rules{v} AS (SELECT * FROM rules WHERE status = 'ACTIVE' AND {condition}),
matched{v} AS (
  SELECT w.domain, arg_min(r.domain, depth) AS rule_domain, arg_min(r.action = 'BLOCK', depth) AS rule_block
  FROM walk w JOIN rules{v} r ON r.domain = w.suffix
   AND (depth = 0 OR r.match_type = 'DOMAIN_AND_SUBDOMAINS') GROUP BY w.domain),
bset{v} AS ((SELECT domain FROM rules{v} WHERE action = 'BLOCK')
  EXCEPT SELECT domain FROM rules{v} WHERE action <> 'BLOCK'),
lp{v} AS (SELECT DISTINCT w.domain FROM walk w JOIN bset{v} s ON s.domain = w.suffix),
decided{v} AS (SELECT CAST({version} AS BIGINT) AS rule_version, d.domain, rule_domain,
  coalesce(rule_block, l.domain IS NOT NULL) AS blocked
  FROM domains d LEFT JOIN matched{v} m USING (domain) LEFT JOIN lp{v} l ON l.domain = d.domain)"""


_VERSION_RULES = {1: "TRUE", 2: "action = 'BLOCK'", 3: "length(domain) % 2 = 0"}
_DECIDED = ", ".join(_decided_by(v, c) for v, c in _VERSION_RULES.items())

ORACLES["policy_decision_as_of"] = f"""WITH RECURSIVE {_EV}, {_RULES}, {_DOMAINS}, {_WALK},
{_DECIDED},
timed AS (SELECT event_id, domain, CAST(CASE {" ".join(
    f"WHEN ts >= TIMESTAMP '{at}' THEN {v}" for v, at in sorted(PUBLISHED.items(), reverse=True))}
  END AS BIGINT) AS rule_version FROM ev),
decided AS (SELECT * FROM decidedv1 UNION ALL SELECT * FROM decidedv2
            UNION ALL SELECT * FROM decidedv3)
SELECT event_id, coalesce(t.rule_version, 0) AS rule_version, d.rule_domain,
  coalesce(d.blocked, FALSE) AS blocked
FROM timed t LEFT JOIN decided d ON d.domain = t.domain AND d.rule_version = t.rule_version"""

ORACLES["stream_policy_new_checkpoint"] = f"""WITH RECURSIVE {_EV}, {_RULES}, {_DOMAINS}, {_WALK},
{_decided_by(1, "TRUE")}, {_decided_by(2, "action = 'BLOCK'")}
SELECT event_id, CAST(1 + event_id % 2 AS BIGINT) AS rule_version,
       coalesce(CASE WHEN event_id % 2 = 0 THEN a.blocked ELSE b.blocked END, FALSE) AS blocked
FROM ev LEFT JOIN decidedv1 a ON a.domain = ev.domain LEFT JOIN decidedv2 b ON b.domain = ev.domain"""

ORACLES["clients_over_rate_sliding"] = f"""WITH {_PE}, folded AS (
  SELECT event_id, client_hash, epoch_ms(1704067200000 + event_id * 7919 % 20000) AS ts FROM pe),
n AS (SELECT *, count(*) OVER (PARTITION BY client_hash ORDER BY ts
  RANGE BETWEEN INTERVAL 999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS queries FROM folded)
SELECT client_hash, event_id, ts, queries, queries - 5 AS over_limit FROM n WHERE queries > 5"""

ORACLES["lookup_by_key_stored"] = ORACLES["lookup_by_key_hourly"]
ORACLES["lookup_by_domain_stored"] = f"""WITH {_FB0} SELECT hour_timestamp, client_hash, domain,
{_S2} FROM fb WHERE domain = 'd7.example' GROUP BY ALL"""

ORACLES["clients_over_rate_second"] = f"""WITH {_PE}
SELECT client_hash, date_trunc('second', epoch_ms(1704067200000 + event_id * 7919 % 20000)) AS second,
  count(*) AS queries, count(*) - 4 AS over_limit FROM pe GROUP BY 1, 2 HAVING count(*) > 4"""

ORACLES["list_categories"] = f"""WITH {_RULES}, named AS (
  SELECT CASE WHEN action = 'ALLOW' THEN 'WHITELIST' ELSE 'MALWARE' END AS name, 1 AS rule,
         CAST(status = 'ACTIVE' AS INT) AS active FROM rules
  UNION ALL SELECT CASE page_id % 4 WHEN 0 THEN 'MALWARE' WHEN 1 THEN 'SOCIAL' ELSE 'ADS' END, 0, 0
  FROM pages WHERE page_id % 4 <> 2)
SELECT name, CAST(sum(rule) AS BIGINT) AS rules, CAST(sum(active) AS BIGINT) AS active_rules
FROM named GROUP BY name"""
ORACLES["category_by_name"] = (
    f"SELECT * FROM ({ORACLES['list_categories']}) WHERE name = 'MALWARE'")
