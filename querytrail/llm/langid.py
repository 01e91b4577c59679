"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is the
product of its letters' vectors, each rotated by its place (binding); a text is the sum of its
n-grams (bundling), and a language's prototype is the sum of its texts. A text gets the language
of the nearest prototype by cosine. Sums are of whole numbers, so every run gives the same.

Learning reads all training texts in one pass: each task adds up one vector per language it
meets, and sends them on when it holds ``LANGUAGES`` of them. Prototypes are a stored table.
Texts are compared with blocks of ``LANGUAGES`` prototypes, one after the other, and keep the
best so far, so any number of languages is learned and no task holds them all.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is all
when nothing could be learned; ties go to the smaller language name; rows that repeat count each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytrail.llm.common import store

UNKNOWN = "und"


@dataclass(frozen=True)
class Space:
    """Dimensions, n-gram length and seed of the letter vectors."""

    dims: int = 1024
    n: int = 3
    seed: int = 7


#: Letters of text worked on at a time, and n-gram vectors held at a time.
STRETCH, GRAMS_AT_ONCE, ROWS_AT_ONCE = 1 << 20, 2048, 256
#: Prototypes held at a time.
LANGUAGES = 1000


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=200_000)
def _letter(space: Space, code: int) -> np.ndarray:
    if code == 0:  # the gap between words
        code = 0x110000
    bits = np.random.default_rng((space.seed, code)).integers(0, 2, space.dims, dtype=np.int8)
    return bits * 2 - 1


def letters(text: str) -> np.ndarray:
    """Code points of the lowered letters, any run of others as one 0, a 0 at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def _bundle(space: Space, rows: list[np.ndarray], owner: np.ndarray, n_owners: int) -> np.ndarray:
    """Sum of n-gram vectors of each owner over letter sequences ``rows``."""
    out = np.zeros((n_owners, space.dims), np.float64)
    seqs = [r for r in rows if len(r) >= space.n]
    if not seqs:
        return out
    own = np.repeat(owner[[len(r) >= space.n for r in rows]],
                    [len(r) - space.n + 1 for r in seqs])
    alphabet, _ = np.unique(np.concatenate(seqs), return_inverse=True)
    table = np.zeros(int(alphabet[-1]) + 1, np.int64)
    table[alphabet] = np.arange(len(alphabet))
    grams = []
    for r in seqs:
        r, g = table[r], 0
        for k in range(space.n):
            g = g * len(alphabet) + r[k:len(r) - space.n + 1 + k]
        grams.append(g)
    gram, at = np.unique(np.concatenate(grams), return_inverse=True)
    pair, count = np.unique(at.astype(np.int64) * n_owners + own, return_counts=True)
    which, whose = pair // n_owners, pair % n_owners
    base = np.stack([np.stack([np.roll(_letter(space, int(c)), space.n - 1 - k)
                               for c in alphabet]) for k in range(space.n)])
    for first in range(0, len(gram), GRAMS_AT_ONCE):
        part = gram[first:first + GRAMS_AT_ONCE]
        vectors, rest = np.ones((len(part), space.dims), np.int8), part
        for k in range(space.n - 1, -1, -1):
            vectors *= base[k][rest % len(alphabet)]
            rest = rest // len(alphabet)
        a, b = np.searchsorted(which, (first, first + len(part)))
        counts = np.zeros((n_owners, len(part)), np.float32)
        counts[whose[a:b], which[a:b] - first] = count[a:b]
        out += counts @ vectors.astype(np.float32)
    return out


def _stretches(texts: Iterator[tuple[int, str]], n: int) -> Iterator[tuple[list, np.ndarray]]:
    """Letter sequences with their owners, about ``STRETCH`` letters at a time; a longer text
    comes in parts that overlap by n-1 letters."""
    rows, owners, total = [], [], 0
    for owner, text in texts:
        seq = letters(text)
        for at in range(0, max(1, len(seq) - n + 1), STRETCH):
            part = seq[at:at + STRETCH + n - 1]
            rows.append(part)
            owners.append(owner)
            total += len(part)
            if total >= STRETCH:
                yield rows, np.array(owners)
                rows, owners, total = [], [], 0
    if rows:
        yield rows, np.array(owners)


def fit(labelled: DataFrame, space: Space = Space()) -> DataFrame:
    """Stored prototypes, ``lang`` and ``v``, from rows of ``text`` and ``lang`` (nulls are left
    out)."""
    def rows_of(sums):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))],
            names=["lang", "v"])

    def learn(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            index = {x: i for i, x in enumerate(names)}
            texts = ((index[x], t) for x, t in zip(langs, batch.column("text").to_pylist(),
                                                   strict=True))
            for rows, owner in _stretches(texts, space.n):
                for name, v in zip(names, _bundle(space, rows, owner, len(names)), strict=True):
                    sums[name] = sums[name] + v if name in sums else v
            if len(sums) >= LANGUAGES:
                yield rows_of(sums)
                sums = {}
        if sums:
            yield rows_of(sums)

    parts = (labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
             .select("text", "lang").mapInArrow(learn, "lang string, v array<double>"))
    summed = (parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d")
              .agg(F.sum("x").alias("x")).groupBy("lang")
              .agg(F.sort_array(F.collect_list(F.struct("d", "x"))).alias("v"))
              .select("lang", F.transform("v", lambda e: e["x"]).alias("v")))
    return store(summed, "langid-prototypes")


def _compare(names: list[str], table: np.ndarray, space: Space, last: bool):
    """Best language so far of each text after a block of prototypes; the text itself goes on to
    the next block."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column("text").to_pylist()
                sums = np.zeros((len(texts), space.dims))
                seen = np.zeros(len(texts), bool)
                own = ((i, t) for i, t in enumerate(texts) if t)
                for rows, owner in _stretches(own, space.n):
                    sums += _bundle(space, rows, owner, len(texts))
                    seen[owner] |= [bool(r.any()) for r in rows]
                norm = np.linalg.norm(sums, axis=1)
                lang, top = part.column("lang_pred").to_pylist(), part.column("cos").to_pylist()
                if names:
                    cos = (sums @ table.T) / np.where(norm > 0, norm, 1)[:, None]
                    for i in np.flatnonzero(seen & (norm > 0)):
                        b = cos[i].argmax()  # the smaller name where equal
                        if top[i] is None or cos[i, b] > top[i]:
                            lang[i], top[i] = names[b], float(cos[i, b])
                columns = [part.column("doc_id"), pa.array(lang, pa.string()),
                           pa.array(top, pa.float64())]
                if not last:
                    columns.append(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "lang_pred", "cos", "text"][:len(columns)])

    return run, "doc_id long, lang_pred string, cos double" + ("" if last else ", text string")


def predict(docs: DataFrame, prototypes: DataFrame, space: Space = Space()) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of every row, from its whole text alone."""
    rows = docs.select(F.col("doc_id").cast("long"), "text",
                       F.lit(None).cast("string").alias("lang_pred"),
                       F.lit(None).cast("double").alias("cos"))
    after = None
    while True:
        left = prototypes if after is None else prototypes.where(F.col("lang") > after)
        found = left.orderBy("lang").limit(LANGUAGES + 1).collect()
        block, last = found[:LANGUAGES], len(found) <= LANGUAGES
        table = np.array([r["v"] for r in block], np.float64).reshape(len(block), space.dims)
        norms = np.linalg.norm(table, axis=1)
        names = [r["lang"] for r, n in zip(block, norms, strict=True) if n > 0]
        rows = rows.mapInArrow(*_compare(names, table[norms > 0] / norms[norms > 0, None], space,
                                         last))
        if last:
            break
        rows, after = store(rows, "langid-best"), block[-1]["lang"]
    score = F.least(F.greatest(F.coalesce("cos", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"),
                       score.alias("score"))
