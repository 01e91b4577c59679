"""Language-model scores by deleted interpolation of n-gram estimates.

A token's probability is a mixture of three maximum-likelihood estimates: one over the
vocabulary and an unknown word, the word's own, and the word's after the word before it. The
mixture weights depend on how often the context was seen, in buckets that double. They are
learned by expectation-maximisation on counts of a part of the training documents that is
deleted from the counts of the estimates; the scores then use the counts of all training
documents.

Tokens are never shuffled one by one. Tasks gather documents into chunks of about ``TOKENS``
tokens, stored as a vocabulary and an index per token. A chunk asks for each distinct word and
word pair once, by 64-bit hash, as one packed row per range of hashes; a range is added up in
one task and answered in the order of the question. There are as many ranges as the corpus has
tokens by ``PER_RANGE``, so all counts of all words are kept, whatever the corpus holds.

Defined results: null, empty and blank texts hold the end token alone; rows without doc_id are
held out, never learned from; rows that repeat count and are scored each; a vocabulary of no
training token gives every token the probability 1; an empty table has no rows; columns beside
``doc_id`` and ``text`` do not matter. A text is held whole in one task.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.llm.common import store
from querytrail.llm.wordhash import _SEP, STRETCH, mix, word_hashes

U = np.uint64
TOKENS, PER_RANGE = 1_200_000, 250_000
#: Parts of the corpus: counted, deleted (counted last), held out.
COUNTED, DELETED, HELD_OUT = 0, 1, 2
#: The end token, and what stands before a text's first token. Words have even keys, pairs odd.
END, BEGIN = U(0), U(2)
#: Probabilities of the deleted part are told apart by this many steps per factor of two.
GRAIN = 8
ROUNDS, SETTLED = 500, 1e-9


# --- packed numbers ------------------------------------------------------------------------

def squeeze(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes; planes of zeros take no room."""
    codec = pa.Codec("zstd", compression_level=1)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    out = [struct.pack("<IB", len(values), values.itemsize)]
    for plane in planes:
        data = codec.compress(np.ascontiguousarray(plane).tobytes(), asbytes=True) \
            if plane.any() else b""
        out.append(struct.pack("<I", len(data)) + data)
    return b"".join(out)


def unsqueeze(data: bytes, dtype: str) -> np.ndarray:
    codec = pa.Codec("zstd", compression_level=1)
    n, width = struct.unpack_from("<IB", data)
    planes, at = np.zeros((width, n), np.uint8), 5
    for plane in planes:
        (size,) = struct.unpack_from("<I", data, at)
        if size:
            plane[:] = np.frombuffer(codec.decompress(data[at + 4:at + 4 + size], n), np.uint8)
        at += 4 + size
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=U(0)))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, "<u8"), dtype=U)


# --- tokens --------------------------------------------------------------------------------

def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lower-cased words of all texts, each text followed by the end token, and the
    number of tokens of each text."""
    data = b"\n".join(texts).lower() + b"\n"  # ASCII letters only
    inside = ~_SEP[np.frombuffer(data, np.uint8)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    counts = np.add.reduceat(starts, first, dtype=np.int64)
    (words,) = word_hashes(data)
    out = np.full(len(words) + len(texts), END)
    ends = np.cumsum(counts + 1) - 1
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words & ~U(1)
    return out, counts + 1


class Chunk:
    """Documents of one part, gathered in a task."""

    def __init__(self):
        self.ids, self.lengths, self.keys, self.n = [], [], [], 0

    def add(self, ids, lengths, keys):
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.keys.append(keys)
        self.n += len(keys)

    def row(self, name: str, part: int) -> pa.RecordBatch:
        """Words are numbered by frequency, which packs best."""
        lengths = np.concatenate(self.lengths)
        words, at, n = np.unique(np.concatenate(self.keys), return_inverse=True,
                                 return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([part], pa.int32()), pa.array([len(lengths)], pa.int64()),
             pa.array([self.n], pa.int64()), pa.array([pa.concat_arrays(self.ids).to_pylist()],
                                                      pa.list_(pa.int64())),
             pa.array([squeeze(lengths.astype("<u4"))], pa.binary()),
             pa.array([words[order].tobytes()], pa.binary()),
             pa.array([squeeze(rank[at])], pa.binary())],
            names=["chunk", "part", "n_docs", "n_tokens", "ids", "lengths", "words", "at"])


BODY = ("chunk string, part int, n_docs long, n_tokens long, ids array<long>, lengths binary, "
        "words binary, at binary")


def _gather(batches):
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    chunks = {}
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        parts = batch.column("part").to_numpy()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= STRETCH):
                size += len(texts[last])
                last += 1
            keys, lengths = tokens(texts[first:last])
            here = parts[first:last]
            for part in np.unique(here):
                own = here == part
                chunk = chunks.setdefault(int(part), Chunk())
                chunk.add(batch.column("doc_id").slice(first, last - first).filter(pa.array(own)),
                          lengths[own], keys[np.repeat(own, lengths)])
                if chunk.n >= TOKENS:
                    yield chunks.pop(int(part)).row(f"{task}-{made}", int(part))
                    made += 1
            first = last
    for part, chunk in chunks.items():
        yield chunk.row(f"{task}-{made}", part)
        made += 1


def chunks_of(docs: DataFrame) -> DataFrame:
    """The corpus as stored chunks; ``docs``: ``doc_id``, ``part``, ``text``."""
    return store(docs.select(F.col("doc_id").cast("long"), F.col("part").cast("int"), "text")
                 .mapInArrow(_gather, BODY), "lm-chunks")


class Body:
    """A chunk unpacked: its words and pairs, and how its tokens refer to them."""

    def __init__(self, lengths: bytes, words: bytes, at: bytes):
        self.lengths = unsqueeze(lengths, "<u4").astype(np.int64)
        self.words = np.frombuffer(words, "<u8")
        self.at = unsqueeze(at, "<u4").astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        keys = self.words[self.at]
        before = np.concatenate((keys[:1], keys[:-1]))
        before[self.first] = BEGIN
        pairs = mix(before * U(0x9E3779B97F4A7C15) + keys) | U(1)
        self.pairs, self.pair_at, self.pair_n = np.unique(
            pairs, return_inverse=True, return_counts=True)
        both = np.concatenate((self.words, self.pairs))
        self.order = np.argsort(both, kind="stable")
        self.keys = both[self.order]

    def counts(self) -> np.ndarray:
        """Own counts in the order of ``keys``."""
        own = np.concatenate((np.bincount(self.at, minlength=len(self.words)), self.pair_n))
        return own[self.order]

    def per_token(self, answers: np.ndarray, begins: int
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token's word, its context and its pair, from answers to ``keys``."""
        got = np.empty(len(self.keys), np.int64)
        got[self.order] = answers
        word = got[:len(self.words)][self.at]
        context = np.concatenate((word[:1], word[:-1]))
        context[self.first] = begins
        return word, context, got[len(self.words):][self.pair_at]


# --- counts --------------------------------------------------------------------------------

QUESTION = "range int, chunk string, part int, keys binary, counts binary"


def _ask(ranges: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                body = Body(r["lengths"], r["words"], r["at"])
                counts = body.counts().astype("<u4")
                where = ((body.keys >> U(32)) * U(ranges)) >> U(32)
                cuts = np.flatnonzero(np.diff(where, prepend=where[:1])).tolist()
                spans = list(zip([0, *cuts], [*cuts, len(where)], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(where[a]) for a, _ in spans], pa.int32()),
                     pa.array([r["chunk"]] * len(spans)),
                     pa.array([r["part"]] * len(spans), pa.int32()),
                     pa.array([squeeze_sorted(body.keys[a:b]) for a, b in spans], pa.binary()),
                     pa.array([squeeze(counts[a:b]) for a, b in spans], pa.binary())],
                    names=["range", "chunk", "part", "keys", "counts"])
    return run


ANSWER = ("range int, chunk string, part int, whole binary, counted binary, words long, "
          "words_counted long")


def _answer(table: pa.Table) -> pa.Table:
    """Counts over all training chunks, and over the counted ones for chunks of the deleted."""
    parts = table.column("part").to_pylist()
    asked = [unsqueeze_sorted(k.as_py()) for k in table.column("keys")]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([len(a) for a in asked])
    spans = [at[e - len(a):e] for e, a in zip(ends, asked, strict=True)]
    sums = np.zeros((2, len(keys)), np.int64)
    for part, span, n in zip(parts, spans, table.column("counts"), strict=True):
        if part != HELD_OUT:  # a chunk's keys are distinct
            sums[part, span] += unsqueeze(n.as_py(), "<u4")
    counted, whole = sums[COUNTED], sums[COUNTED] + sums[DELETED]
    word = (keys & U(1)) == 0
    rest = [0] * (len(parts) - 1)
    return pa.table({
        "range": table.column("range"), "chunk": table.column("chunk"),
        "part": table.column("part"),
        "whole": pa.array([squeeze(whole[s]) for s in spans], pa.binary()),
        "counted": pa.array([squeeze(counted[s]) if p == DELETED else None
                             for p, s in zip(parts, spans, strict=True)], pa.binary()),
        "words": pa.array([int((word & (whole > 0)).sum()), *rest], pa.int64()),
        "words_counted": pa.array([int((word & (counted > 0)).sum()), *rest], pa.int64())})


@dataclass(frozen=True)
class Counts:
    """Tokens, vocabulary and documents of a training part."""

    tokens: int
    words: int
    docs: int


def count(chunks: DataFrame) -> tuple[DataFrame, Counts, Counts]:
    """Stored answers to every chunk, and totals of all training chunks and the counted ones."""
    sizes = {r["part"]: (r["t"], r["d"]) for r in chunks.groupBy("part").agg(
        F.sum("n_tokens").alias("t"), F.sum("n_docs").alias("d")).collect()}
    size = [sizes.get(p, (0, 0)) for p in (COUNTED, DELETED, HELD_OUT)]
    ranges = max(1, -(-sum(t for t, _ in size) // PER_RANGE))
    answers = store(chunks.select("chunk", "part", "lengths", "words", "at")
                    .mapInArrow(_ask(ranges), QUESTION).groupBy("range")
                    .applyInArrow(_answer, ANSWER), "lm-counts")
    words = answers.agg(F.sum("words"), F.sum("words_counted")).first()
    (t0, d0), (t1, d1) = size[COUNTED], size[DELETED]
    return (answers, Counts(t0 + t1, words[0] or 0, d0 + d1), Counts(t0, words[1] or 0, d0))


# --- weights -------------------------------------------------------------------------------

def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of the binary logarithm."""
    return np.frexp(context.astype(float))[1]


def estimates(word, context, pair, of: Counts) -> np.ndarray:
    """The three estimates per token."""
    return np.stack([np.full(len(word), 1.0 / (of.words + 1)), word / max(of.tokens, 1),
                     pair / np.maximum(context, 1)])


def _body_and_answers(left: pa.Table, right: pa.Table, column: str):
    r = {c: left.column(c)[0].as_py() for c in ("lengths", "words", "at")}
    order = np.argsort(right.column("range").to_numpy())
    answers = [unsqueeze(right.column(column)[int(i)].as_py(), "<i8") for i in order]
    return Body(**r), np.concatenate(answers)


def _cells(of: Counts):
    """Tokens of a deleted chunk by bucket and estimates, the latter on a logarithmic grid."""
    def step(p):
        return np.where(p > 0, np.floor(-np.log2(np.where(p > 0, p, 1)) * GRAIN), -1).astype(
            np.int64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int64()), ("one", pa.int64()), ("two", pa.int64()),
                            ("n", pa.int64())])
        if not left.num_rows:
            return schema.empty_table()
        body, answers = _body_and_answers(left, right, "counted")
        word, context, pair = body.per_token(answers, of.docs)
        _, one, two = estimates(word, context, pair, of)
        code = np.stack([bucket_of(context), step(one), step(two)])
        cells, n = np.unique(code, axis=1, return_counts=True)
        return pa.table([*map(pa.array, cells), pa.array(n)], schema=schema)
    return run


def maximise(cells: list[tuple[int, int, int, int]], of: Counts) -> dict[int, tuple]:
    """Weights per bucket from cells (bucket, step of the word's estimate, step of the pair's,
    tokens). Each estimate that a bucket can use counts as one token more, so none gets nothing."""
    def value(step):
        return np.where(step >= 0, 2.0 ** (-(step + 0.5) / GRAIN), 0.0)

    table = np.array(sorted(cells), float).reshape(-1, 4)
    out = {}
    for b in np.unique(table[:, 0]):
        own = table[table[:, 0] == b]
        p = np.stack([np.full(len(own), 1.0 / (of.words + 1)), value(own[:, 1]),
                      value(own[:, 2])])
        usable = np.array([True, of.tokens > 0, b > 0])
        weights = usable / usable.sum()
        for _ in range(ROUNDS):
            share = weights[:, None] * p
            seen = (share / share.sum(axis=0) * own[:, 3]).sum(axis=1) + usable
            new = seen / seen.sum()
            moved = np.abs(new - weights).max()
            weights = new
            if moved < SETTLED:
                break
        out[int(b)] = tuple(weights)
    return out


def learn(chunks: DataFrame, answers: DataFrame, counted: Counts) -> dict[int, tuple]:
    """Mixture weights per bucket, from the deleted part. The driver gets one row per cell of the
    grid, whose number depends on the grid, not on the corpus."""
    left = chunks.where(F.col("part") == DELETED).select("chunk", "lengths", "words", "at")
    right = answers.where(F.col("part") == DELETED).select("chunk", "range", "counted")
    cells = (left.groupBy("chunk").cogroup(right.groupBy("chunk"))
             .applyInArrow(_cells(counted), "bucket long, one long, two long, n long")
             .groupBy("bucket", "one", "two").agg(F.sum("n").alias("n")).collect())
    return maximise([tuple(r) for r in cells], counted)


def weight_table(weights: dict[int, tuple], of: Counts) -> np.ndarray:
    """Weights of every bucket: a bucket without tokens in the deleted part takes those of the
    nearest one that had some."""
    if not of.tokens:
        return np.tile([1.0, 0.0, 0.0], (65, 1))
    out = np.zeros((65, 3))
    for b in range(65):
        near = min(weights, key=lambda x: (abs(x - b), x), default=None)
        w = np.array(weights[near]) if near is not None else np.full(3, 1 / 3)
        if b == 0:
            w[2] = 0.0
        out[b] = w / w.sum()
    return out


# --- scores --------------------------------------------------------------------------------

SCORED = ("doc_id long, n_tokens long, n_known long, base_score double, score double")


def _score(of: Counts, table: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        kinds = [pa.int64()] * 3 + [pa.float64()] * 2
        if not left.num_rows:
            return pa.schema(list(zip(names, kinds, strict=True))).empty_table()
        body, answers = _body_and_answers(left, right, "whole")
        word, context, pair = body.per_token(answers, of.docs)
        mixed = (table[bucket_of(context)].T * estimates(word, context, pair, of)).sum(axis=0)
        base = (word + 0.1) / (of.tokens + 0.1 * (of.words + 1))

        def add(x):
            return pa.array(np.add.reduceat(x, body.first))

        return pa.Table.from_arrays(
            [pa.array(left.column("ids")[0].as_py(), pa.int64()), pa.array(body.lengths),
             add((word > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(mixed))],
            names=names)
    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of
    every row of ``docs`` (``doc_id``, ``part``, ``text``)."""
    chunks = chunks_of(docs)
    answers, whole, counted = count(chunks)
    table = weight_table(learn(chunks, answers, counted), whole)
    left = chunks.select("chunk", "ids", "lengths", "words", "at")
    right = answers.select("chunk", "range", "whole")
    rows = (left.groupBy("chunk").cogroup(right.groupBy("chunk"))
            .applyInArrow(_score(whole, table), SCORED))
    return rows.withColumn("train_tokens", F.lit(whole.tokens).cast("long"))


def part_of(remainder: Column) -> Column:
    """The part of a document from crc32(doc_id) modulo 10: 0 is held out, 1 deleted."""
    return F.when(F.coalesce(remainder, F.lit(0)) == 0, HELD_OUT).when(
        remainder == 1, DELETED).otherwise(COUNTED)
