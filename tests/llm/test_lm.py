"""Language-model scores against counts in plain dictionaries."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from querytrail.llm import lm
from querytrail.llm import queries as q

ASCII = {i: i + 32 for i in range(65, 91)}


def _tokens(text):
    return [*brute.words((text or "").translate(ASCII)), None]


def _part(doc_id):
    if doc_id is None:
        return lm.HELD_OUT
    r = zlib.crc32(str(doc_id).encode()) % 10
    return {0: lm.HELD_OUT, 1: lm.DELETED}.get(r, lm.COUNTED)


class Plain:
    def __init__(self, pairs, parts):
        self.one, self.two, self.docs = Counter(), Counter(), 0
        for d, t in pairs:
            if _part(d) in parts:
                ts = _tokens(t)
                self.docs += 1
                self.one.update(ts)
                self.two.update(zip(["<s>", *ts[:-1]], ts, strict=True))
        self.n, self.v = sum(self.one.values()), len(self.one)

    def estimates(self, text):
        ts = _tokens(text)
        for before, t in zip(["<s>", *ts[:-1]], ts, strict=True):
            seen = self.docs if before == "<s>" else self.one[before]
            yield (0 if not seen else 1 + int(math.log2(seen)),
                   (1 / (self.v + 1), self.one[t] / max(self.n, 1),
                    self.two[(before, t)] / max(seen, 1)))

    def base(self, text):
        return sum(math.log10((self.one[t] + 0.1) / (self.n + 0.1 * (self.v + 1)))
                   for t in _tokens(text))


def _weights(pairs):
    """Exact expectation-maximisation on every token of the deleted part."""
    counted = Plain(pairs, {lm.COUNTED})
    by = {}
    for d, t in pairs:
        if _part(d) == lm.DELETED:
            for b, p in counted.estimates(t):
                by.setdefault(b, []).append(p)
    out = {}
    for b, ps in by.items():
        p, usable = np.array(ps).T, np.array([1, 1, b > 0], float)
        w = usable / usable.sum()
        for _ in range(lm.ROUNDS):
            s = w[:, None] * p
            s = (s / s.sum(axis=0)).sum(axis=1) + usable
            w = s / s.sum()
        out[b] = w
    return out


def _check(rows, pairs, table):
    whole = Plain(pairs, {lm.COUNTED, lm.DELETED})
    want = sorted((d is not None, d or 0, len(_tokens(t)), sum(whole.one[x] > 0 for x in _tokens(t)),
                   whole.base(t), sum(math.log10(float(table[b] @ np.array(p)))
                                      for b, p in whole.estimates(t))) for d, t in pairs)
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["n_known"],
                  r["base_score"], r["score"]) for r in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4:] for g in got] == [pytest.approx(w[4:], rel=1e-9) for w in want]
    assert {r["train_tokens"] for r in rows} == {whole.n}


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_scores_equal_plain_counts(spark, monkeypatch, request, which):
    docs = request.getfixturevalue(which)
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    seen = []
    table = lm.weight_table
    monkeypatch.setattr(lm, "weight_table", lambda *a: seen.append(table(*a)) or seen[-1])
    monkeypatch.setattr(lm, "PER_RANGE", 5_000)
    monkeypatch.setattr(lm, "TOKENS", 3_000)  # many chunks and ranges
    monkeypatch.setattr(q, "table", lambda *a: docs)
    rows = q.QUERIES["op12_lm_score"](spark, "").collect()
    _check(rows, pairs, seen[0])
    for r in rows:
        assert r["held_out"] == (_part(r["doc_id"]) == lm.HELD_OUT)
    for b, w in _weights(pairs).items():
        assert seen[0][b] == pytest.approx(w, abs=0.02)


def test_held_out_texts_score_better_than_the_base(spark, sf_dir):
    rows = [r for r in q.QUERIES["op12_lm_score"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_add_up():
    of = lm.Counts(10, 3, 2)
    cells = [(1, 20, 8, 5), (1, -1, -1, 2), (0, 20, -1, 4), (3, 10, 2, 100)]
    table = lm.weight_table(lm.maximise(cells, of), of)
    assert table.sum(axis=1) == pytest.approx(np.ones(65)) and (table >= 0).all()
    assert table[0, 2] == 0 and (table[:, 0] > 0).all()
    assert (lm.weight_table({}, lm.Counts(0, 0, 0))[:, 0] == 1).all()
    assert lm.weight_table({}, of).sum(axis=1) == pytest.approx(np.ones(65))


def test_nothing_learned_and_none(spark, monkeypatch, none):
    monkeypatch.setattr(q, "table", lambda *a: none)
    assert q.QUERIES["op12_lm_score"](spark, "").collect() == []
    unseen = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = lm.score(unseen.withColumn("part", F.lit(lm.HELD_OUT))).collect()
    assert {(r["base_score"], r["score"], r["n_known"]) for r in rows} == {(0.0, 0.0, 0)}


def test_packed_numbers():
    for x in (np.array([], "<u8"), np.array([0, 1, 1 << 63, 5], "<u8"), np.arange(1000, dtype="<u8")):
        assert (lm.unsqueeze(lm.squeeze(x), "<u8") == x).all()
        assert (lm.unsqueeze_sorted(lm.squeeze_sorted(np.sort(x))) == np.sort(x)).all()
