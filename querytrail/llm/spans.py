"""Substring dedup by level-wise doubling.

Repeats are looked for at a short length first. What repeats there, and only that, is extended
to twice the length, level after level, until no candidate is left or the window's length is
reached (25, then 50 words by default; ``levels`` adds shorter ones).

Below the last level a document does not send all its windows. A window stands for itself at its
own level; at the level below it is represented by the least (first of equals) of the shorter
windows inside it, which equal windows share at the same place. So a short window whose hash
occurs in one document alone settles every longer window that it stands for.

Exact copies stand back for the copy with the least doc_id: whatever they hold is covered there.

Judged on the input: a word goes if a window over it also starts in a document with a smaller
doc_id. Windows of the last level are compared by 128 bits of hash. Joins are by hash or document
key, so a passage that a third of all documents share is split like any skewed join, and windows
are counted on the map side before they meet.

Defined results: null and empty texts have no words; documents shorter than a window lose
nothing; a null doc_id is not smaller than any other and has none smaller, so its text stays;
rows that share a doc_id are judged each and never remove from one another.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querytrail.llm.wordhash import minimizers, mix, window_hashes, word_hashes

WINDOW = 50


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(batches, *names):
    """Rows one by one, the text as bytes."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)


class _Out:
    """Collects arrays and yields record batches of some size."""

    def __init__(self, names: list[str], rows: int = 1 << 17):
        self.names, self.limit, self.parts, self.n = names, rows, [], 0

    def add(self, *columns) -> bool:
        self.parts.append(columns)
        self.n += len(columns[0])
        return self.n >= self.limit

    def take(self) -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c)) for c in zip(*self.parts, strict=True)]
        self.parts, self.n = [], 0
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


def _keyed(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Documents with keys that are never null, so that all joins can share one exchange.

    ``version`` is a hash of the text; its lowest bit says that doc_id is null.
    """
    no_id = F.col("doc_id").isNull()
    version = F.xxhash64("text").bitwiseAND(F.lit(-2)).bitwiseOR(F.when(no_id, 1).otherwise(0))
    out = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc"),
                      F.coalesce(version, F.lit(0)).cast("long").alias("version"), "text",
                      *([F.struct(*carry).alias("carry")] if carry else []))
    return out


def _has_id() -> F.Column:
    return F.col("version").bitwiseAND(F.lit(1)) == 0


def lengths(window: int, levels: int) -> list[int]:
    """Window lengths from the shortest level, each (rounded up) half of the next."""
    out = [window]
    while len(out) < levels and out[0] > 1:
        out.insert(0, -(-out[0] // 2))
    return out


def _level(steps: list[int], k: int):
    """Windows of level ``k``: document key, place and two hashes; above the first level only
    those whose representative one level below is among ``places``."""
    names = ["doc", "version", "text"] + ["places"] * (k > 0)

    def run(batches):
        out = _Out(["doc", "version", "at", "h1", "h2"])
        for doc, version, text, *places in _texts(batches, *names):
            w1, w2 = word_hashes((text or "").encode("utf-8", "surrogatepass"), (1, 2))
            n = len(w1) - steps[-1] + 1
            if n <= 0:
                continue
            at, below = np.arange(n), None
            for j in range(len(steps) - 1, max(k, 1) - 1, -1):
                stands = minimizers(window_hashes(w1, steps[j - 1]), steps[j] - steps[j - 1] + 1)
                below = stands[at]
                if j > k:
                    at = np.unique(below)
            if k:
                at = at[np.isin(below, np.array(places[0]))]
            h1, h2 = window_hashes(w1, steps[k])[at], window_hashes(w2, steps[k])[at]
            if out.add(np.full(len(at), doc, np.int64), np.full(len(at), version, np.int64),
                       at.astype(np.int32), h1.view(np.int64), mix(h2).view(np.int64)):
                yield out.take()
        if out.n:
            yield out.take()
    return run


def _repeated(rows: DataFrame, key: list[str], later_only: bool) -> DataFrame:
    """Rows whose key occurs in several documents; with ``later_only`` those with a smaller one.

    The key is turned over for the join, so that both sides are dealt anew: Spark splits a skewed
    partition only where it comes straight from a shuffle, not from an aggregation.
    """
    def turned(c: str) -> F.Column:
        column = F.reverse(c) if dict(rows.dtypes)[c] == "string" else F.bitwise_not(F.col(c))
        return column.alias(f"turned_{c}")

    ends = (rows.groupBy(*key).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
            .where(F.col("first") < F.col("last")))
    ends = ends.select("first", "last", *[turned(c) for c in key])
    joined = rows.select(*[c for c in rows.columns if c not in key],
                         *[turned(c) for c in key]).join(ends, [f"turned_{c}" for c in key])
    return joined.where(F.col("doc") > F.col("first")) if later_only else joined


def repeated_windows(keyed: DataFrame, window: int = WINDOW, levels: int = 2) -> DataFrame:
    """``doc``, ``version`` and sorted ``starts`` of windows that start in an earlier document."""
    steps = lengths(window, levels)
    schema = "doc long, version long, at int, h1 long, h2 long"
    first_copy = (keyed.where(_has_id() & F.col("text").isNotNull())
                  .groupBy(F.sha2("text", 256).alias("copy"))
                  .agg(F.min(F.struct("doc", "version")).alias("k")).select("k.*"))
    texts = keyed.select("doc", "version", "text")
    rows = (texts.join(first_copy, ["doc", "version"]).select("doc", "version", "text")
            .mapInArrow(_level(steps, 0), schema))
    if len(steps) > 1:
        rows = rows.drop("h2")  # a false candidate costs a look at the next level, no more
    for k in range(1, len(steps)):
        left = (_repeated(rows, ["h1"], later_only=False).groupBy("doc", "version")
                .agg(F.collect_set("at").alias("places")))
        rows = (texts.join(left, ["doc", "version"]).select("doc", "version", "text", "places")
                .mapInArrow(_level(steps, k), schema))
        if k < len(steps) - 1:
            rows = rows.drop("h2")
    return (_repeated(rows, ["h1", "h2"], later_only=True).groupBy("doc", "version")
            .agg(F.sort_array(F.collect_set("at")).alias("starts")))


def later_copies(keyed: DataFrame) -> DataFrame:
    """``doc``, ``version`` of texts that equal the text of a smaller doc_id."""
    rows = (keyed.where(_has_id() & F.col("text").isNotNull())
            .select("doc", "version", F.sha2("text", 256).alias("copy")))
    return _repeated(rows, ["copy"], later_only=True).select("doc", "version").distinct()


def _cut(window: int, keep_text: bool, columns: list[str]):
    def run(batches):
        for batch in batches:
            kept_text, n_words, n_removed, digest = [], [], [], []
            for text, starts, copy in _texts([batch], "text", "starts", "copy_"):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n = len(words)
                kept = words
                if copy and n >= window:
                    kept = []
                elif starts:
                    edges = np.zeros(n + 1, np.int64)
                    at = np.array(starts)
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
                    kept = [words[i] for i in stay]
                joined = b" ".join(kept)
                n_words.append(n)
                n_removed.append(n - len(kept))
                if keep_text:
                    same = len(kept) == n
                    kept_text.append(text if same else joined.decode("utf-8", "surrogatepass"))
                digest.append(hashlib.sha256(joined).hexdigest())
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                    pa.array(digest, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if keep_text:
                made.append(pa.array(kept_text, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in columns], *made], names=[*columns, *names])
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, levels: int = 2,
                   carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one
    blank); with ``carry`` also ``kept_text`` (the text itself where nothing goes, else the kept
    words joined by one blank) and those columns of ``docs`` in a struct ``carry``."""
    keyed = _keyed(docs, [])
    # The starts of one document at most: no row holds more than its own text gives.
    marks = (later_copies(keyed)
             .select("doc", "version", F.lit(None).cast("array<int>").alias("starts"),
                     F.lit(True).alias("copy_"))
             .unionByName(repeated_windows(keyed, window, levels)
                          .withColumn("copy_", F.lit(False))))
    if carry is not None:
        keyed = _keyed(docs, carry)
    joined = keyed.join(marks, ["doc", "version"], "left")
    columns = ["doc", "version"] + ["carry"] * bool(carry)
    schema = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in columns)
    out = joined.select(*columns, "text", "starts", "copy_").mapInArrow(
        _cut(window, carry is not None, columns),
        schema + ", n_words long, n_removed long, kept_sha256 string"
        + ", kept_text string" * (carry is not None))
    doc_id = F.when(_has_id(), F.col("doc")).alias("doc_id")
    own = ["n_words", "n_removed", "kept_sha256"]
    return out.select(doc_id, *own, *["kept_text"] * (carry is not None),
                      *["carry"] * bool(carry))
