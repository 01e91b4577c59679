"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length 1, where the nearest by cosine is the nearest by distance, and
projected on random normal directions; the floor of each projection over a width is one part of
a table's bucket. A query visits, besides its own bucket, the buckets that differ by one step in
some parts, in order of the estimated probability that a neighbour at distance ``reach`` lies
there, ``probes`` of them per table.

A table's buckets are dealt into cells of about ``BLOCK`` rows. A row goes to its cell of each
table, a query once to each cell that holds buckets it visits, with their list. In a cell the
rows of the visited buckets are the candidates: a product with the scaled rows finds the few that
can be among the best, whose cosines are then computed exactly, in double precision, and the
tables' candidates are merged last. Candidate pairs are never written out.

A cell that is too large, as with many equal vectors, is split into blocks, and the queries go to
every block, so no bucket is capped. A query that found fewer than ``k`` candidates is compared
with all rows, block by block.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite number take
no part, and neither do rows without vec_id; every other row is indexed, and of rows that share a
vec_id the best counts, as query and as candidate; vectors of other dimension are no candidates;
ties go to the smaller vec_id; other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import store
from querytrail.llm.wordhash import mix

BLOCK = 4096


@dataclass(frozen=True)
class Index:
    """Tables, projections per table, width of a step, probes per table, expected distance of a
    neighbour between unit vectors, and seed."""

    tables: int = 2
    parts: int = 8
    width: float = 2.0
    probes: int = 1400
    reach: float = 1.1
    seed: int = 3


@lru_cache(maxsize=16)
def _projections(index: Index, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng((index.seed, dim))
    return (rng.standard_normal((dim, index.tables * index.parts)),
            rng.uniform(0, index.width, index.tables * index.parts))


def _spots(index: Index, vectors: np.ndarray) -> np.ndarray:
    """Projections of scaled vectors in steps: rows x tables x parts."""
    a, b = _projections(index, vectors.shape[1])
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    return ((unit @ a + b) / index.width).reshape(len(vectors), index.tables, index.parts)


def _bucket(cells: np.ndarray) -> np.ndarray:
    """A 64-bit key of the whole-number cells in the last axis."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + cells[..., k].astype(np.int64)
                  .astype(np.uint64) + np.uint64(k + 1))
    return key.view(np.int64)


_phi = np.vectorize(lambda z: 0.5 * (1 + erf(z / sqrt(2))), otypes=[float])


def probe_cells(index: Index, spots: np.ndarray) -> np.ndarray:
    """Cells to visit for one table, best first: queries x probes x parts.

    The chance of a step in one part is that of a normal difference of spread ``reach``; the
    chances multiply, and the best combinations are kept part by part.
    """
    steps = np.array([-1, 0, 1])
    base = np.floor(spots)
    low = base[:, :, None] + steps - spots[:, :, None]
    spread = index.reach / index.width
    chance = np.log(_phi((low + 1) / spread) - _phi(low / spread) + 1e-12)
    total, chosen = np.zeros((len(spots), 1)), np.zeros((len(spots), 1, 0), np.int64)
    for part in range(index.parts):
        grown = (total[:, :, None] + chance[:, None, part, :]).reshape(len(spots), -1)
        path = np.concatenate([np.repeat(chosen, 3, axis=1),
                               np.tile(steps, chosen.shape[1])[None, :, None]
                               .repeat(len(spots), axis=0)], axis=2)
        best = np.argsort(-grown, axis=1, kind="stable")[:, :index.probes]
        total = np.take_along_axis(grown, best, 1)
        chosen = np.take_along_axis(path, best[:, :, None], 1)
    return base[:, None, :] + chosen


def _by_dim(batch):
    """Rows of a batch by dimension, with their vectors in double precision."""
    lists = batch.column("v")
    dims = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(dims):
        part = batch.take(pa.array(np.flatnonzero(dims == dim)))
        yield part, _matrix(part.column("v"), int(dim))


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), dim).astype(float)


def _cell(buckets: np.ndarray, cells: int) -> np.ndarray:
    return (buckets.view(np.uint64) % np.uint64(cells)).astype(np.int64)


def _short(buckets: np.ndarray) -> np.ndarray:
    """What names a bucket within its cell. Two that get one name only add candidates."""
    return np.ascontiguousarray(buckets).astype(np.uint64).astype(np.uint32).view(np.int32)


_PLACE = "dim int, tbl int, cell long, salt long, buckets array<int>, vec_id long, "
#: Rows of a table of split cells that may be sent to every task, 24 bytes each.
MOST_SPLIT = 1_000_000


def _rows_to_cells(index: Index, cells: int, kind: str):
    """Each row once per table, with its bucket."""
    def run(batches):
        seen = 0
        for batch in batches:
            for part, vectors in _by_dim(batch):
                n, dim = vectors.shape
                buckets = _bucket(np.floor(_spots(index, vectors)))
                for t in range(index.tables):
                    own = np.ascontiguousarray(buckets[:, t])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)),
                         pa.array(_cell(own, cells)), pa.array(np.arange(seen, seen + n)),
                         pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)),
                                                  pa.array(_short(own))),
                         part.column("vec_id"), part.column("v")],
                        names=["dim", "tbl", "cell", "salt", "buckets", "vec_id", "v"])
                seen += n
    return run, _PLACE + f"v array<{kind}>"


def _queries_to_cells(index: Index, cells: int, kind: str):
    """Each query once per cell that holds buckets it visits, with the list of them."""
    def run(batches):
        for batch in batches:
            for part, vectors in _by_dim(batch):
                for at in range(0, len(vectors), 64):
                    spots = _spots(index, vectors[at:at + 64])
                    some = part.slice(at, 64)
                    for t in range(index.tables):
                        keys = _bucket(probe_cells(index, spots[:, t]))
                        yield from _visits(some, keys, t, vectors.shape[1], cells)

    def _visits(some, keys, t, dim, cells):
        n, probes = keys.shape
        whose = np.repeat(np.arange(n), probes)
        flat = np.ascontiguousarray(keys.ravel())
        cell = _cell(flat, cells)
        order = np.lexsort((cell, whose))
        whose, cell = whose[order], cell[order]
        first = np.flatnonzero(np.concatenate(
            ([True], (whose[1:] != whose[:-1]) | (cell[1:] != cell[:-1]))))
        m = len(first)
        own = some.take(pa.array(whose[first]))
        offsets = np.concatenate((first, [len(flat)])).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, dim, np.int32)), pa.array(np.full(m, t, np.int32)),
             pa.array(cell[first]), pa.array(np.zeros(m, np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(_short(flat[order]))),
             own.column("vec_id"), own.column("v")],
            names=["dim", "tbl", "cell", "salt", "buckets", "vec_id", "v"])

    return run, _PLACE + f"v array<{kind}>"


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


class _Block:
    """The rows of one block of a cell."""

    #: Products of unit vectors differ by less than this from exact cosines.
    SLACK = 1e-9

    def __init__(self, ids, buckets, vectors):
        self.ids, self.vectors = np.concatenate(ids), np.concatenate(vectors)
        self.lengths = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.unit = self.vectors / self.lengths[:, None]
        self.names, self.bucket = np.unique(np.concatenate(buckets), return_inverse=True)
        #: Rows that share an id: so many places more than k may be needed for k ids.
        self.most = int(np.unique(self.ids, return_counts=True)[1].max())

    def nearest(self, vec_id, buckets, v, k):
        at = np.searchsorted(self.names, buckets)
        at[at == len(self.names)] = 0
        visited = np.zeros(len(self.names), bool)
        visited[at[self.names[at] == buckets]] = True
        rows = np.flatnonzero(visited[self.bucket] & (self.ids != vec_id))
        if not len(rows):
            return rows, np.zeros(0)
        length = np.sqrt((v * v).sum())
        few = len(rows) * 4 < len(self.ids)
        near = (self.unit[rows] @ (v / length)) if few else (self.unit @ (v / length))[rows]
        want = k * self.most
        if len(rows) > want:
            cut = np.partition(near, len(near) - want)[len(near) - want] - self.SLACK
            rows = rows[near >= cut]
        # Sums in one order for every row: equal vectors get equal scores.
        cos = (self.vectors[rows] * v).sum(axis=1) / (self.lengths[rows] * length)
        at = best(cos, self.ids[rows], k)
        return rows[at], cos[at]


def _score(k: int):
    """Best ``k`` rows of a block for each query sent to it; rows come before queries, both sorted
    by block. One block of rows is held."""
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        key, held, block = None, ([], [], []), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64)
                             for c in ("dim", "tbl", "cell", "block")], axis=1)
            probe = batch.column("probe").to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)
                                    | (probe[1:] != probe[:-1])) + 1
            out = []
            for a, b in zip([0, *change], [*change, n], strict=True):
                vectors = _matrix(batch.column("v").slice(a, b - a), int(keys[a, 0]))
                lists = batch.column("buckets").slice(a, b - a)
                if key != tuple(keys[a]):
                    key, held, block = tuple(keys[a]), ([], [], []), None
                if not probe[a]:
                    for x, y in zip(held, (ids[a:b], lists.flatten().to_numpy(), vectors),
                                    strict=True):
                        x.append(y)
                    continue
                if not held[0]:
                    continue
                block = block or _Block(*held)
                flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
                at = at - at[0]
                for i, (q, v) in enumerate(zip(ids[a:b], vectors, strict=True)):
                    rows, cos = block.nearest(q, flat[at[i]:at[i + 1]], v, k)
                    out.append((np.full(len(rows), q), block.ids[rows], cos))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
    return run


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v`` of the rows that take part; floats stay floats, others are doubles."""
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"),
                           F.col(vector).cast(f"array<{kind}>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
            .where(fine & F.exists("v", lambda x: x != 0)))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 5, index: Index = Index()) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` from usable ``rows`` and ``queries``, which are
    read several times: store what is dear to work out."""
    kind = "float" if dict(rows.dtypes)["v"] == "array<float>" else "double"
    cells = max(1, -(-rows.count() // BLOCK))
    held = rows.mapInArrow(*_rows_to_cells(index, cells, kind))
    asked = queries.mapInArrow(*_queries_to_cells(index, cells, kind))
    first = store(_merge(_search(held, asked, k), k), "ann-first")
    # Queries with too few candidates see every row.
    found = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    short = store(queries.join(found, F.col("vec_id") == F.col("query_id"), "left_anti"),
                  "ann-short")
    whole = [F.size("v").alias("dim"), F.lit(-1).alias("tbl"), F.lit(0).cast("long").alias("cell"),
             F.monotonically_increasing_id().alias("salt"),
             F.array(F.lit(0)).alias("buckets"), "vec_id", "v"]
    rest = rows.join(short.select(F.size("v").alias("d")).distinct(),
                     F.size("v") == F.col("d"), "left_semi")
    second = _merge(_search(rest.select(*whole), short.select(*whole), k), k)
    kept = first.join(found.select("query_id"), "query_id", "left_semi")
    return kept.unionByName(second).select("query_id", "rank", "vec_id", "score")


def _search(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Candidates of every query: rows lie in one block of their cell, queries go to all."""
    cell = ["dim", "tbl", "cell"]
    # Only cells of twice the rows they should have are split: one in 8,192 rows at most.
    split = store(held.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > 2 * BLOCK)
                  .select(*cell, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")),
                  "ann-split")
    if split.count() <= MOST_SPLIT:
        split = F.broadcast(split)
    parts = F.coalesce("blocks", F.lit(1))
    rows = held.join(split, cell, "left").withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "salt"), parts).cast("int"))
    asked = asked.join(split, cell, "left").withColumn(
        "block", F.explode(F.sequence(F.lit(0), parts - 1)))
    columns = [*cell, "block", "buckets", "vec_id", "v"]
    both = (rows.select(*columns, F.lit(False).alias("probe"))
            .unionByName(asked.select(*columns, F.lit(True).alias("probe"))))
    return (both.repartition(*cell, "block")
            .sortWithinPartitions(*cell, "block", "probe")
            .mapInArrow(_score(k), "query_id long, vec_id long, score double"))


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (candidates.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def asked(rows: DataFrame, every: int = 50) -> DataFrame:
    """The stated query set: rows whose id is divisible by ``every``."""
    return rows.where(_divisible(F.col("vec_id"), every))


def _divisible(column: Column, n: int) -> Column:
    return column % n == 0
