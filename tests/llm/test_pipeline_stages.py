"""Each stage of the pipeline on its own input, and the whole."""

from __future__ import annotations

import brute
import pytest

import corpus_pipeline as cp
from querytrail.llm.common import store


def _rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark, sf_dir, docs):
    columns = docs.columns
    kept = store(cp.quality_rules(spark, docs, sf_dir), "t")
    want = [(d, t) for d, t in _rows(docs) if not brute.quality(t)["base_failed"]
            and 10 * brute.quality(t)["n_symbols"] <= brute.quality(t)["n_words"]]
    assert sorted(_rows(kept)) == sorted(want) and kept.columns == columns

    one = store(cp.near_duplicates(spark, kept, sf_dir), "t")
    groups = brute.near_groups(_rows(kept))
    assert sorted(_rows(one)) == sorted((d, t) for d, t in _rows(kept) if groups[d][0] == d)

    cut = store(cp.substring_dedup(spark, one, sf_dir), "t")
    removed = {d: (n, gone) for d, n, gone, _ in brute.span_dedup(_rows(one))}
    assert {d: len(brute.words(t)) for d, t in _rows(cut)} == {
        d: n - gone for d, (n, gone) in removed.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    mixed = store(cp.mix_sources(spark, cut, sf_dir), "t")
    assert mixed.columns == columns and set(_rows(mixed)) <= set(_rows(cut))
    total = sum(len(brute.words(t)) for _, t in _rows(cut))
    assert abs(sum(len(brute.words(t)) for _, t in _rows(mixed)) - total) < 0.1 * total

    packed = cp.best_fit_packing(spark, mixed, sf_dir).collect()
    assert sum(r["length"] for r in packed) == sum(len(brute.words(t)) for _, t in _rows(mixed))


@pytest.mark.parametrize("which", ["odd", "none"])
def test_stages_take_odd_rows(request, spark, sf_dir, which):
    docs = request.getfixturevalue(which)
    for name, stage in cp.STAGES:
        docs = store(stage(spark, docs, sf_dir), "t")
        if name != cp.STAGES[-1][0]:
            assert docs.columns == request.getfixturevalue(which).columns
    if which == "none":
        assert docs.count() == 0


def test_packing_keeps_the_training_order(spark, sf_dir, monkeypatch):
    """Falling, even and rising sources keep their mean times; copies stay apart and numbered."""
    from pyspark.sql import functions as F

    from querytrail.llm import mixing, packing

    n = 3000
    docs = spark.range(n, numPartitions=3).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"),
        F.element_at(F.array(*map(F.lit, "abbc")), (F.col("id") % 4 + 1).cast("int"))
        .alias("source"))
    mixed = store(cp.mix_sources(spark, docs, sf_dir).repartitionByRange(
        5, F.monotonically_increasing_id()).sortWithinPartitions(
        F.monotonically_increasing_id()), "t")
    monkeypatch.setattr(packing.pack_in_order, "__defaults__",
                        (*packing.pack_in_order.__defaults__[:-1], 100))
    rows = cp.best_fit_packing(spark, mixed, sf_dir).collect()
    total = len(rows)
    assert sorted(r["position"] for r in rows) == list(range(total))
    assert all(r["shard"] == r["position"] // 100 for r in rows)
    assert all(r["bin_id"].split("-")[0] == str(r["shard"]) for r in rows)
    order = mixing.training_order(mixing.plan(docs)).where("copy is not null").collect()
    at = {(r["doc_id"], r["copy"]): i for i, r in enumerate(
        sorted(order, key=lambda r: (r["position"], r["doc_id"], r["copy"])))}
    assert at == {(r["doc_id"], r["copy"]): r["position"] for r in rows}
    assert max(r["copy"] for r in rows) > 0
    mean = {s: [r["position"] / total for r in rows if "abbc"[r["doc_id"] % 4] == s] for s in "abc"}
    mean = {s: sum(x) / len(x) for s, x in mean.items()}
    assert mean["a"] < mean["b"] - 0.02 and mean["b"] < mean["c"] - 0.02


def test_packing_parts_are_bounded_by_pieces(spark):
    from querytrail.llm import packing

    df = spark.createDataFrame([(i, 4096 * 9, i, 0) for i in range(6)],
                               "doc_id long, n_words long, position long, copy long")
    rows = packing.pack_in_order(df, rows_per_shard=4).collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["bin_id"].rsplit("-", 1)[0], []).append(r)
    assert len(rows) == 54 and max(map(len, parts.values())) <= 4


def test_near_duplicates_keeps_strangers_with_one_id(spark, sf_dir):
    """Texts decide, not ids: unrelated texts under one doc_id stay, copies under several go."""
    import random

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(80)) for _ in range(4)]
    near = texts[2].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0], 1), (1, texts[1], 2), (2, texts[2], 3), (3, near, 4), (4, texts[2], 5),
            (None, texts[3], 6), (None, texts[0], 7), (5, None, 8), (None, None, 9), (6, " ", 10),
            (6, " ", 11), (1, texts[0], 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copy int")
    kept = cp.near_duplicates(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([(False, 1, texts[0]), (False, 1, texts[1]), (False, 2, texts[2]),
                          (True, 0, texts[3]), (False, 5, ""), (True, 0, ""), (False, 6, " "),
                          (False, 6, " ")])


def test_run_as_registered(spark, sf_dir):
    """The whole pipeline over its whole table; the stages above say what it must hold."""
    import __spark_entry__ as contract

    rows = contract.queries()["pipeline"](spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    words = {}
    for d, t in _rows(docs):
        words[d] = words.get(d, 0) + len(brute.words(t))
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == words


def test_copies_of_a_hot_text_are_counted_in_stretches(spark):
    from pyspark.sql import functions as F

    from querytrail.llm import packing

    rows = spark.range(500).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("doc_id"),
        (F.col("id") % 2).alias("text_"), F.col("id").alias("position"))
    got = packing.with_copy(rows, ["doc_id", "text_"], 30).collect()
    seen = {}
    for r in sorted(got, key=lambda r: r["position"]):
        key = (r["doc_id"], r["text_"])
        assert r["copy"] == seen.get(key, 0)
        seen[key] = r["copy"] + 1
    assert len(got) == 500
