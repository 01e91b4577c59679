"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of 5-word shingles. Equal texts are one class, with a number of its own; MinHash
values of the classes are cut into bands, and classes that share a band are candidates.
Candidate pairs are not written out: classes are gathered round the least class they share a
band with (their hub), hubs that meet in a band are paired once, and the classes of two hubs are
compared in blocks inside one task. There MinHash values are compared a few at a time; a pair is
dropped when the posterior probability that it reaches the threshold falls below ``tolerance``
(uniform prior). All that stay are counted exactly on their shingle sets. A task returns a
number of links per class and a spanning tree of the links, never the links themselves, so that
a group of thousands of near copies gives as many rows as it has members.

Groups are the connected components of the links, found by spreading the least label over the
trees and jumping, each round written to the checkpoint folder.

Defined results: null, empty and blank texts have no shingles, so no links, and are groups of
their own; texts of one to four words are one shingle; the text alone is compared, so rows that
share a doc_id but not the text are strangers, and rows with one text are copies whatever their
doc_id; a group is named after its least doc_id (null where no row of it has one).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import numbered, store
from querytrail.llm.wordhash import mix, window_hashes, word_hashes

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
#: 24 bands of 4: a pair at 0.8 shares none with a probability of 3e-6, at 0.85 of 9e-9.
BANDS, ROWS = 24, 4
#: MinHash values beside those of the bands, compared so many at a time.
EXTRA, STEP = 64, 16
#: A block of classes in one task: so many classes, or about so many characters.
BLOCK_ROWS, BLOCK_CHARS = 512, 4_000_000


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams."""
    (words,) = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    return np.unique(window_hashes(words, min(n, len(words))))


@lru_cache(maxsize=4)
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return (rng.integers(0, 1 << 32, (n, 1), np.uint32, endpoint=False),
            rng.integers(0, 1 << 32, (n, 1), np.uint32, endpoint=False) | np.uint32(1))


def minhash(sh: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of a set of 64-bit hashes."""
    flip, factor = _permutations(n)
    low = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = (low[at:at + 1024] ^ flip) * factor
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(12)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key per band, of its values and its number."""
    rows = values[:BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float, most: int, step: int) -> tuple[int, ...]:
    """For ``step``, 2 ``step`` ... compared values the matches below which
    P(similarity >= threshold | matches) < tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    above, out = grid >= threshold, []
    for n in range(step, most + 1, step):
        need = n + 1
        for m in range(n, -1, -1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(logs - logs.max())
            if density[above].sum() / density.sum() < tolerance:
                break
            need = m
        out.append(need)
    return tuple(out)


def _bands(batches):
    for batch in batches:
        keep, keys = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            sh = shingles(text)
            if len(sh):
                keep.append(i)
                keys.append(band_keys(minhash(sh, BANDS * ROWS)))
        flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
        offsets = np.arange(len(keep) + 1, dtype=np.int32) * BANDS
        part = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("copy"),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
            names=["doc_id", "copy", "bands"])


def _compare(threshold: float, tolerance: float):
    """Links between the two sides of a block pair; per class its links and its tree parent."""
    need = least_matches(threshold, tolerance, EXTRA, STEP)

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["side", "node"], kind="stable")
        sets = [shingles(t) for t in pdf["text"]]
        values = np.stack([minhash(s, BANDS * ROWS + EXTRA) for s in sets])
        bands = np.stack([band_keys(v) for v in values])
        node, weight = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        side = pdf["side"].to_numpy()
        one = np.flatnonzero(side == 0)
        two = one if key[2] == key[0] and key[3] == key[1] else np.flatnonzero(side == 1)
        flat = np.concatenate(sets)
        lengths = np.array([len(s) for s in sets])
        ids = np.unique(flat, return_inverse=True)[1].ravel()
        starts = np.concatenate(([0], np.cumsum(lengths)))
        mark = np.zeros(ids.max() + 1, np.int32)
        links, texts = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
        parent = np.arange(len(sets))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in one:
            js = two[two > i] if two is one else two
            js = js[node[js] != node[i]]
            js = js[(bands[js] == bands[i]).any(axis=1)]
            matches = np.zeros(len(js), int)
            for k, least in enumerate(need):
                cols = slice(BANDS * ROWS + k * STEP, BANDS * ROWS + (k + 1) * STEP)
                matches += (values[js, cols] == values[i, cols]).sum(axis=1)
                stay = matches >= least
                js, matches = js[stay], matches[stay]
            if not len(js):
                continue
            mark[ids[starts[i]:starts[i + 1]]] = 1
            size = lengths[js]
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(starts[js], size)
            both = np.add.reduceat(mark[ids[at]], first)
            mark[ids[starts[i]:starts[i + 1]]] = 0
            js = js[both >= threshold * (lengths[i] + size - both) - 1e-9]
            links[i] += weight[js].sum()
            texts[i] += len(js)
            np.add.at(links, js, weight[i])
            np.add.at(texts, js, 1)
            for j in js:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(len(sets))])
        hit = texts > 0
        return pd.DataFrame({"node": node[hit], "near_docs": links[hit], "near_texts": texts[hit],
                             "parent": node[roots[hit]]})
    return run


def _components(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node of its component, for every node of ``edges`` (a, b)."""
    both = store(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "jaccard-edges")
    labels = store(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("label")),
                   "jaccard-labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a")
                .agg(F.min("label").alias("near")))
        spread = (labels.join(near, F.col("node") == F.col("a"), "left")
                  .select("node", "label", F.least("label", F.coalesce("near", "label"))
                          .alias("new")))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        moved = (spread.join(jump, F.col("new") == F.col("at"), "left")
                 .select("node", F.least("new", F.coalesce("beyond", "new")).alias("new"),
                         F.col("label").alias("old")))
        moved = store(moved, "jaccard-labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.where(F.col("new") != F.col("old")).isEmpty():
            return labels


#: The label of a group goes back to its members by a salted join: a group may be very large.
SALTS = 16


def _copy() -> Column:
    """The class of a text: null for null."""
    return F.unhex(F.md5("text"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
                 ) -> DataFrame:
    """One row per text with shingles: ``copy`` (its md5), ``copies`` (rows that hold it),
    ``near_docs`` and ``near_texts`` (other rows and other texts that reach the threshold),
    ``class_id`` (the least doc_id of its group) and ``leads``: it is the group's text with the
    least doc_id, the smaller md5 where equal."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", _copy().alias("copy"))
    named = rows.where(F.col("text").isNotNull())
    sketched = named.mapInArrow(_bands, "doc_id long, copy binary, bands array<long>")
    # Numbers follow the least doc_id: what many near copies were made from mostly comes first,
    # and as the least of its bands it gathers them round one hub.
    by_copy = sketched.groupBy("copy").agg(
        F.min("doc_id").alias("doc"), F.count("*").alias("copies"),
        F.first("bands").alias("bands"))
    classes = numbered(by_copy, [F.col("doc").asc_nulls_last(), F.col("copy")],
                       "jaccard-classes").withColumnRenamed("number", "node")
    shared = classes.select("node", F.explode("bands").alias("band"))
    met = (shared.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least"))
           .where("n > 1"))
    # The key is turned over so that the join deals both sides anew: Spark splits a skewed
    # partition only where it comes straight from a shuffle, not from an aggregation.
    turned = F.bitwise_not(F.col("band"))
    met = met.select(turned.alias("turned"), "least")
    members = store(shared.withColumn("turned", turned).join(met, "turned")
                    .select("band", "node", "least"), "jaccard-bands")
    hubs = members.groupBy("node").agg(F.min("least").alias("hub"))
    in_band = members.join(hubs, "node").select("band", "hub").distinct()
    other = in_band.select("band", F.col("hub").alias("hub2"))
    pairs = (in_band.join(other, "band").where(F.col("hub") <= F.col("hub2"))
             .select("hub", "hub2").distinct())
    # Only texts that met another in a band are read again, and they are dealt out once.
    met_classes = (classes.select("node", "copies", F.col("copy").alias("copy_"), "doc")
                   .join(hubs, "node"))
    # Of a text with many copies the row of its least doc_id is sent on, or one without.
    own = (F.col("copy") == F.col("copy_")) & F.col("doc_id").eqNullSafe(F.col("doc"))
    texts = (named.join(met_classes, own).dropDuplicates(["node"])
             .select("node", "hub", "copies", "text"))
    texts = store(texts, "jaccard-texts")
    blocks = texts.groupBy("hub").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS),
        F.lit(1)).cast("int").alias("n"))
    placed = (texts.join(blocks, "hub")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).drop("n"))
    two = blocks.select(F.col("hub").alias("hub2"), F.col("n").alias("n2"))
    units = (pairs.join(blocks, "hub").join(two, "hub2")
             .withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
             .withColumn("b2", F.explode(F.sequence(
                 F.when(F.col("hub") == F.col("hub2"), F.col("b1")).otherwise(0),
                 F.col("n2") - 1)))
             .select(F.col("hub").alias("h1"), "b1", F.col("hub2").alias("h2"), "b2"))
    same = (F.col("h1") == F.col("h2")) & (F.col("b1") == F.col("b2"))
    sides = F.when(same, F.array(F.struct(F.lit(0).alias("side"), F.col("h1").alias("hub"),
                                          F.col("b1").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("h1").alias("hub"),
                         F.col("b1").alias("block")),
                F.struct(F.lit(1).alias("side"), F.col("h2").alias("hub"),
                         F.col("b2").alias("block"))))
    work = (units.withColumn("s", F.explode(sides)).select("h1", "b1", "h2", "b2", "s.*")
            .join(placed, ["hub", "block"])
            .select("h1", "b1", "h2", "b2", "side", "node", "copies", "text"))
    found = store(work.groupBy("h1", "b1", "h2", "b2").applyInPandas(
        _compare(threshold, tolerance),
        "node long, near_docs long, near_texts long, parent long"), "jaccard-links")
    links = found.groupBy("node").agg(F.sum("near_docs").alias("near_docs"),
                                      F.sum("near_texts").alias("near_texts"))
    labels = _components(found.select(F.col("node").alias("a"), F.col("parent").alias("b"))
                         .where("a <> b"))
    members = store(classes.select("copy", "node", "doc", "copies").join(links, "node", "left")
                    .join(labels, "node", "left")
                    .withColumn("group", F.coalesce("label", "node")), "jaccard-members")
    lead = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "copy"))
    groups = (members.where(F.col("label").isNotNull()).groupBy("group").agg(lead.alias("lead"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    return (salted.join(groups, ["group", "salt"], "left").select(
        "copy", "copies", F.coalesce("near_docs", F.lit(0)).alias("near_docs"),
        F.coalesce("near_texts", F.lit(0)).cast("long").alias("near_texts"),
        F.when(F.col("lead").isNull(), F.col("doc")).otherwise(F.col("lead")["doc"])
        .alias("class_id"),
        F.coalesce(F.col("lead")["copy"] == F.col("copy"), F.lit(True)).alias("leads")))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
                ) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the least doc_id of its group),
    ``n_copies`` (rows with its very text, itself included), ``n_links`` (other rows, copies
    included, that reach the threshold) and ``n_text_links`` (other texts that do)."""
    per_copy = near_classes(docs, threshold, tolerance).withColumnRenamed("copy", "copy_")
    rows = docs.select(F.col("doc_id").cast("long"), _copy().alias("copy"))
    out = rows.join(per_copy, F.col("copy") == F.col("copy_"), "left")
    one = F.coalesce(F.col("copies"), F.lit(1))
    return out.select(
        "doc_id", F.when(F.col("copy_").isNull(), F.col("doc_id"))
        .otherwise(F.col("class_id")).alias("class_id"), one.alias("n_copies"),
        (one - 1 + F.coalesce(F.col("near_docs"), F.lit(0))).alias("n_links"),
        F.coalesce(F.col("near_texts"), F.lit(0)).alias("n_text_links"))


def first_of_groups(docs: DataFrame) -> DataFrame:
    """``docs`` with one row per near-duplicate group: of the group's text with the least doc_id
    the row with the least doc_id. Rows whose text is null or holds no word all stay."""
    columns = docs.columns
    copy, rank = _free("copy", columns), _free("rank", columns)
    leads = (near_classes(docs.select("doc_id", "text")).where("leads")
             .select(F.col("copy").alias(copy)))
    has_word = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    order = Window.partitionBy(copy).orderBy(F.col("doc_id").asc_nulls_last())
    # One row per text first, which each task sees to before it sends any on: a text that a third
    # of the rows hold does not meet in one task.
    kept = (docs.where(has_word).withColumn(copy, _copy())
            .withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1)
            .join(leads, copy, "left_semi"))
    return kept.select(*columns).unionByName(docs.where(~has_word))


def _free(name: str, taken: list[str]) -> str:
    """A column name that nobody has."""
    return name + "_" * (1 + max(map(len, taken), default=0))
