"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Vectors are put on a grid of whole numbers. The distinct ones are the rows of X, centred on their
exact mean. The bidiagonalisation alternates the products Xv and X'u, each a sum over the
blocks of rows that Spark holds, with full reorthogonalisation of both sides. A left vector has
a number per row, so it is never kept: it is X times a short vector that the driver knows, which
gives the same u, the next X'u in the same pass over the blocks, and all inner products between
left vectors. What the driver holds is a few numbers per dimension and step. The SVD of the small
bidiagonal matrix gives components and deviations.

A step that ends in nothing (an invariant subspace, equal eigenvalues) goes on with a new
vector, orthogonal to all before. The steps end when the wanted triplets have converged and what
is left of the variance is less than the last of them, so that no equal one can be missing, or
when there is a step per dimension.

Defined results: vectors that are null, or hold a null, a non-finite entry or one of 2**47 or
more, take no part, nor do empty ones; where lengths differ, the most common one counts (the
smaller of equals) and other vectors take no part; rows that share vec_id, or have none, are
rows each; equal vectors are fitted once; directions without variance are no components, so that
a table of one distinct vector gives no rows; a deviation beyond 64 bits is null; other columns
do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytrail.llm.common import store

SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 47)
#: Residual of a triplet, and least deviation of a component, as shares of the largest.
CONVERGED, NOTHING = 1e-14, 1e-10
SCHEMA = ("vec_id long, component int, n long, deviation long, whitened double, "
          "explained double, identity_error double")


@dataclass(frozen=True)
class Centre:
    """Number and sums of the fitted vectors; ``n * x - sums`` is exact in 64 bits."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        return self.n * (x - whole) - rest

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x) / self.n


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    components: np.ndarray  # dimensions x components
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float
    steps: int


def grid(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the whole numbers of the rows that take part."""
    fine = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LIMIT))  # NaN is above all
    on_grid = F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    rows = (vectors.select(F.col("vec_id").cast("long"),
                           F.col(vector).cast("array<double>").alias("v"))
            .where(F.col("v").isNotNull()).where((F.size("v") > 0) & fine)
            .select("vec_id", on_grid.alias("x")))
    common = (rows.groupBy(F.size("x").alias("dim")).count()
              .orderBy(F.col("count").desc(), "dim").first())
    return rows.where(F.size("x") == (common["dim"] if common else 0))


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def _blocks(batches):
    """Arrow batches of vectors as one binary value each, with their sums."""
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(x, "<i8").tobytes()], pa.binary()),
                 pa.array([len(x)], pa.int64()), pa.array([x.sum(axis=0).tolist()])],
                names=["data", "n", "sums"])


def _add_up(blocks: DataFrame, centre: Centre, part: Callable[[np.ndarray], np.ndarray]
            ) -> np.ndarray:
    """The sum over all blocks of ``part`` of the centred block: added up in tasks, then by Spark
    per place, so that the driver gets one value per place."""
    dim = len(centre.sums)

    def run(batches) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column("data"):
                x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, dim)
                got = part(centre.centred(x))
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                names=["place", "value"])

    rows = (blocks.select("data").mapInArrow(run, "place int, value double")
            .groupBy("place").agg(F.sum("value").alias("value")).collect())
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["place"])])


def _orthogonal(v: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    for _ in range(2 if basis else 0):
        q = np.array(basis)
        v = v - q.T @ (q @ v)
    return v


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], dim: int, variance: float,
                  wanted: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray, int]:
    """The first right singular vectors (as columns) and singular values of X.

    ``product(z)`` is X'(Xz), one pass over the rows; ``variance`` the sum of squares in X.
    """
    rng = np.random.default_rng(seed)
    right: list[np.ndarray] = []     # v
    short: list[np.ndarray] = []     # y with u = Xy
    back: list[np.ndarray] = []      # X'u
    alphas, betas = [], []

    def fresh() -> np.ndarray:
        v = _orthogonal(rng.standard_normal(dim), right)
        return v / np.linalg.norm(v)

    v, beta = fresh(), 0.0
    floor = NOTHING * np.sqrt(variance)
    while True:
        right.append(v)
        z = v - beta * short[-1] if beta else v.copy()
        g = product(z)
        for _ in range(2 if short else 0):
            c = np.array(short) @ g          # u_k'(Xz)
            z = z - c @ np.array(short)
            g = g - c @ np.array(back)
        alpha = float(np.sqrt(max(z @ g, 0.0)))
        if alpha > floor:
            short.append(z / alpha)
            back.append(g / alpha)
        else:
            alpha = 0.0
            short.append(np.zeros(dim))
            back.append(np.zeros(dim))
        alphas.append(alpha)
        k = len(alphas)
        ahead = _orthogonal(back[-1] - alpha * v, right)
        beta = float(np.linalg.norm(ahead))
        if beta <= floor:
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        left, sigma, turned = np.linalg.svd(small)
        at_end = k == dim
        if k >= min(wanted, dim) and not at_end:
            last = min(wanted, k) - 1
            rest = variance - float((sigma ** 2).sum())
            at_end = (beta * np.abs(left[-1, :last + 1]).max() <= CONVERGED * sigma[0]
                      and rest < sigma[last] ** 2)
        if at_end:
            keep = min(wanted, int((sigma > floor).sum()))
            return np.array(right).T @ turned[:keep].T, sigma[:keep], k
        betas.append(beta)
        v = ahead / beta if beta else fresh()


def fit(rows: DataFrame, wanted: int = 16) -> Whitening | None:
    """The whitening of the distinct vectors of ``rows``; None where they do not vary."""
    blocks = store(rows.select("x").distinct().mapInArrow(
        _blocks, "data binary, n long, sums array<long>"), "whiten-fit")
    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    sums = (blocks.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
            .collect())
    centre = Centre(n, tuple(r["s"] for r in sorted(sums, key=lambda r: r["pos"])))
    variance = float(_add_up(blocks, centre, lambda x: np.array([(x * x).sum()]))[0])
    if not variance > 0:
        return None
    components, sigma, steps = bidiagonalise(
        lambda z: _add_up(blocks, centre, lambda x: (x @ z) @ x), len(centre.sums), variance,
        wanted)
    # Either sign is right: the largest entry is positive, so that runs agree.
    top = np.abs(components).argmax(axis=0)
    components = components * np.sign(components[top, np.arange(len(top))])
    turn, k = components / (sigma / np.sqrt(n)), len(sigma)

    def moments(x):
        w = x @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])

    total = _add_up(blocks, centre, moments) / n
    covariance = total[:k * k].reshape(k, k) - np.outer(total[k * k:], total[k * k:])
    return Whitening(centre, components, sigma ** 2 / n, sigma ** 2 / variance,
                     float(np.abs(covariance - np.eye(k)).max()), steps)


def apply(rows: DataFrame, w: Whitening | None) -> DataFrame:
    """A row per row of ``rows`` and component."""
    if w is None:
        return rows.sparkSession.createDataFrame([], SCHEMA)
    turn, k = w.components / np.sqrt(w.eigenvalues), len(w.eigenvalues)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scaled = w.centre.scaled(_matrix(batch.column("x")))
            m = len(scaled)
            fits = (scaled.astype(float) ** 2).sum(axis=1) < 2.0 ** 63
            deviation = pa.array(np.repeat((scaled * scaled).sum(axis=1), k),
                                 mask=np.repeat(~fits, k))
            white = (scaled / w.centre.n) @ turn
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                 pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, w.centre.n)), deviation, pa.array(white.ravel()),
                 pa.array(np.tile(w.explained, m)),
                 pa.array(np.full(m * k, w.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                       "identity_error"])

    return rows.mapInArrow(run, SCHEMA)

