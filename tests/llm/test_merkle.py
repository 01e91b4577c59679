"""The Merkle manifest against a plain tree in memory."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from querytrail.llm import merkle
from querytrail.llm import queries as q


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _climb(level):
    """The root, and per node the hashes left and right of it on each level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 3 * 3:a // 3 * 3 + 3]
            paths[i].append(("".join(run[:a % 3]), "".join(run[a % 3 + 1:])))
        level = [_h(*level[i:i + 3]) for i in range(0, len(level), 3)]
        at = [a // 3 for a in at]
    return level[0], paths


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the contract's rows."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((_h(*map(_field, r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    climbed = {}
    for s in names:
        by[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        climbed[s] = _climb([leaf for leaf, _ in by[s]])
    root, above = _climb([climbed[s][0] for s in names])
    out = []
    for s, upper in zip(names, above, strict=True):
        for (leaf, r), path in zip(by[s], climbed[s][1], strict=True):
            path, node = path + upper, leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                node = _h(*map(_field, (*r[:4], r[4].replace("\n", ""))))
            for a, b in path:
                node = _h(a, node, b)
            out.append((r[0], leaf, climbed[s][0], root, _h(*[a + b for a, b in path]), node,
                        node == root))
    return out


def _key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def _run(spark, monkeypatch, docs):
    monkeypatch.setattr(q, "table", lambda *a: docs)
    return q.QUERIES["op11_merkle_manifest"](spark, "")


@pytest.mark.parametrize("digits", [5, 1])
def test_manifest_equals_the_plain_tree(spark, monkeypatch, docs, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** digits)
    got = _run(spark, monkeypatch, docs).collect()
    rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert _key(got) == _key(plain_manifest(rows))
    assert {r["verified"] for r in got} == {True, False}


def test_deep_tree_of_a_hot_source(spark, monkeypatch):
    """One source holds most rows and one doc_id a third of them; three layers of blocks."""
    monkeypatch.setattr(merkle, "DIGITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    docs = spark.range(0, 700, 1, 5).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 11 == 0, F.concat(F.lit("s"), F.col("id").cast("string")))
        .otherwise("hot").alias("source"),
        F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"),
        F.when(F.col("id") % 6 == 0, "a\nb").otherwise(F.concat(F.lit("x\n"), "id"))
        .alias("text"))
    rows = [tuple(r) for r in docs.collect()]
    assert _key(_run(spark, monkeypatch, docs).collect()) == _key(plain_manifest(rows))


def test_odd_rows_and_none(spark, monkeypatch, odd, none):
    got = _run(spark, monkeypatch, odd).collect()
    assert _key(got) == _key(plain_manifest(
        [tuple(r) for r in odd.select(*merkle.FIELDS).collect()]))
    assert _run(spark, monkeypatch, none).collect() == []
    one = odd.limit(1)
    row = _run(spark, monkeypatch, one).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == _h("")


def test_no_block_takes_a_join(spark, monkeypatch, docs):
    """Below the blocks the plan groups; only the placing of ranges joins."""
    plan = _run(spark, monkeypatch, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
