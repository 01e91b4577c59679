"""Per-event expressions: client pseudonym, outcome classes and counter conditions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHA256_BLOCK = 64


def hmac_pads(secret: str) -> tuple[str, str]:
    """Hex of the inner and outer HMAC-SHA256 key pads (RFC 2104)."""
    key = secret.encode("utf-8")
    if not key:
        raise ValueError("the client hash secret must not be empty")
    if len(key) > _SHA256_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_SHA256_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def client_hash(ip: Column, secret: str) -> Column:
    """First 16 hex digits of HMAC-SHA256(secret, ip); ``unknown`` for a blank address.

    Built from ``sha2`` so that it stays in the JVM; there is no default secret.
    """
    inner_pad, outer_pad = hmac_pads(secret)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), ip.cast("binary")), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)
    # The first character settles nearly every address; only odd ones are searched.
    given = (F.ascii(ip) > 32) | F.regexp_like(ip, F.lit(r"[^\x00-\x20]"))
    # Never null for Spark either, so joins and groupings add no null check of their own,
    # which would compute the hash a second time.
    return F.coalesce(F.when(given, F.substring(outer, 1, 16)), F.lit("unknown"))


def is_blocked_action(action: Column) -> Column:
    """Every status but BLOCKED counts as allowed, failures included."""
    return F.coalesce(F.upper(action) == "BLOCKED", F.lit(False))


def is_nxdomain(rcode: Column) -> Column:
    return F.coalesce(rcode == 3, F.lit(False))


def is_servfail(rcode: Column) -> Column:
    return F.coalesce(rcode == 2, F.lit(False))


def is_present(key: Column) -> Column:
    """False for null and empty keys, which count in totals but in no breakdown."""
    return F.length(F.coalesce(key, F.lit(""))) > 0


def classify_outcome(local_hit: Column, blocked: Column, shared_hit: Column, failed: Column,
                     answers: Column, rcode: Column) -> Column:
    """``struct(action, category, cache_hit, rcode)`` of one lookup.

    ``blocked`` is the policy decision, or for a local hit whether the kept answer was a
    block. A block answered from the local cache is GENERAL, only its first one is SECURITY,
    and only local hits count as cache hits.
    """
    fresh_block = ~local_hit & blocked
    action = (F.when(blocked, "BLOCKED")
              .when(local_hit, "L1_HIT")
              .when(shared_hit, "L2_HIT")
              .when(failed, "ERROR")
              .when(answers > 0, "RESOLVED")
              .otherwise("FAILED"))
    code = (F.when(local_hit | blocked | shared_hit, F.lit(0))
            .when(failed, F.lit(2))
            .otherwise(rcode))
    return F.struct(
        action.alias("action"),
        F.when(fresh_block, "SECURITY").otherwise("GENERAL").alias("category"),
        local_hit.alias("cache_hit"),
        code.cast("int").alias("rcode"))
