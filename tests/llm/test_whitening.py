"""Whitening against numpy's eigenvectors of the covariance."""

from __future__ import annotations

import numpy as np
import pytest

from querytrail.llm import queries as q
from querytrail.llm import whitening


def _plain(rows, wanted=16):
    """rows: (vec_id, list) -> x of all rows, distinct x, eigenvalues and vectors."""
    x = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(v) for _, v in x}), float)
    centred = fit - fit.mean(axis=0)
    e, w = np.linalg.eigh(centred.T @ centred / len(fit))
    return x, fit, e[::-1], w[:, ::-1]


def _run(spark, monkeypatch, df):
    monkeypatch.setattr(q, "table", lambda *a: df)
    return q.QUERIES["op13_whiten"](spark, "").collect()


def test_whitening_equals_the_eigenvectors(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    x, fit, e, w = _plain(rows)
    got = q.QUERIES["op13_whiten"](spark, sf_dir).collect()
    assert len(got) == len(rows) * 16
    n, sums = len(fit), fit.sum(axis=0)
    by = {(r["vec_id"], r["component"]): r for r in got}
    signs = {}
    for i, v in x:
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums, strict=True))
        want = ((np.array(v) - sums / n) @ w[:, :16]) / np.sqrt(e[:16])
        for c in range(16):
            r = by[(i, c + 1)]
            assert (r["n"], r["deviation"]) == (n, deviation)
            signs.setdefault(c, np.sign(want[c] * r["whitened"]))
            assert r["whitened"] == pytest.approx(signs[c] * want[c], abs=1e-8)
            assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-9)
            assert r["identity_error"] <= 1e-9


def test_equal_eigenvalues_and_missing_rank(spark, monkeypatch):
    """Unit vectors have one eigenvalue many times; a flat direction is no component."""
    rows = [(i, [float(i == j) for j in range(20)] + [1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = _run(spark, monkeypatch, df)
    assert len(got) == 20 * 16 and {r["n"] for r in got} == {20}
    assert all(r["identity_error"] < 1e-9 for r in got)
    assert all(r["explained"] == pytest.approx(1 / 19) for r in got)
    two = spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0])],
                                "vec_id long, embedding array<float>")
    got = _run(spark, monkeypatch, two)
    assert sorted((r["vec_id"], r["component"], abs(r["whitened"])) for r in got) == [
        (1, 1, 1.0), (2, 1, 1.0)]


def test_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    good = [(i // 2, rng.normal(size=4).tolist()) for i in range(30)]
    rows = [*good, (None, good[0][1]), (7, good[3][1]), (90, None), (91, []),
            (92, [1.0, None, 0.0, 0.0]), (93, [1.0, float("nan"), 0.0, 0.0]),
            (94, [float("inf"), 0.0, 0.0, 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows],
                               "vec_id long, embedding array<double>, n int, x double, data string")
    got = _run(spark, monkeypatch, df)
    assert len(got) == 32 * 4 and {r["n"] for r in got} == {30}
    assert {r["vec_id"] for r in got} == {None, *range(15)}
    _, _, e, _ = _plain(good)
    assert sorted({round(r["explained"], 9) for r in got}) == sorted(np.round(e / e.sum(), 9))
    assert all(r["identity_error"] < 1e-9 for r in got)
    for few in (df.limit(0), df.limit(1), df.where("vec_id > 80")):
        assert [r for r in _run(spark, monkeypatch, few) if r["vec_id"] != 95] == []


def test_bidiagonalisation_keeps_its_form():
    """B is bidiagonal: the short vectors stand for orthonormal left ones, and XV = UB."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)
    x -= x.mean(axis=0)
    v, s, steps = whitening.bidiagonalise(lambda z: (x @ z) @ x, 12, float((x * x).sum()), 5)
    want = np.linalg.svd(x)[1][:5]
    assert s == pytest.approx(want, rel=1e-12) and steps <= 12
    assert np.abs(v.T @ v - np.eye(5)).max() < 1e-13
    assert np.abs(x.T @ (x @ v) - v * s ** 2).max() < 1e-10


def test_steps_end_early_where_few_directions_matter():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 60)) * np.array([100.0, 50, 25] + [1e-3] * 57)
    _, s, steps = whitening.bidiagonalise(lambda z: (x @ z) @ x, 60, float((x * x).sum()), 3)
    assert s == pytest.approx(np.linalg.svd(x)[1][:3], rel=1e-9) and steps < 30
