"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents longer than the longest are cut into whole
sequences and a rest. All pieces of a shard are taken longest first; each goes into the open bin
with the least room that holds it, over bins of all capacities at once. Where none does, a bin is
opened at the capacity with the least cost: what the bin costs (``overhead`` + capacity), spread
over the share of it that pieces still to come can be expected to fill. When all are placed,
every bin is shrunk to the least permitted length that holds its contents.

A shard is a hash range of rows and their places in the input, or with ``pack_in_order`` a
stretch of them, about ``SHARD`` pieces at every size of input, packed in one task from lengths
alone; the number of shards follows from the count of pieces. Equal rows have different places,
so that they spread over the shards, too.

Defined results: documents without length take a place in no bin (``bin_id`` null); a null length
counts as none; rows that repeat are packed each; ties go to the smaller doc_id, then the earlier
piece; a null doc_id is packed like others; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import placed, store

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16
SHARD = 8192


def best_fit(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES,
             overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each length (already longest first), and the bins' final capacities.

    The open bins are kept sorted by room. A new bin of capacity c for a piece of length x costs
    ``overhead + c`` less what the remaining pieces that fit beside x will take of the rest: with
    many short pieces left a long bin is cheap, near the end a snug one.
    """
    caps = sorted(capacities)
    bins: list[int] = []          # words in each bin
    room: list[tuple[int, int]] = []   # (room, bin), sorted
    place, offset = [0] * len(lengths), [0] * len(lengths)
    # Words still to come in pieces of at most a given length: suffix sums of the sorted list.
    after = np.concatenate((np.cumsum(lengths[::-1])[::-1], [0])) if lengths else [0]
    rising = lengths[::-1]
    for i, x in enumerate(lengths):
        at = bisect_left(room, (x, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            def cost(c: int, x: int = x, i: int = i) -> float:
                spare = c - x
                # Pieces later in the list that fit into the spare room.
                first = max(i + 1, len(lengths) - bisect_left(rising, spare + 1))
                filled = min(spare, int(after[first]))
                return (overhead + c) / (x + filled)
            c = min((c for c in caps if c >= x), key=lambda c: (cost(c), c))
            b, left = len(bins), c
            bins.append(0)
        place[i], offset[i] = b, bins[b]
        bins[b] += x
        if left > x:
            insort(room, (left - x, b))
    final = [caps[bisect_left(caps, used)] for used in bins]
    return place, offset, final


def pack(docs: DataFrame, length: str = "n_words", capacities: tuple[int, ...] = CAPACITIES,
         overhead: int = OVERHEAD, rows_per_shard: int = SHARD) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start`` and ``length`` in the document,
    ``bin_id`` (shard and number), ``offset`` in the bin, ``capacity`` and ``used`` of the bin."""
    # Lengths are looked at twice, the table they come from once.
    items = store(_items(placed(docs, "packing-rows"), length, ["place_"]), "packing-lengths")
    longest = max(capacities)
    count = items.agg(F.sum(_n_pieces(longest))).first()[0] or 0
    shards = max(1, -(-count // rows_per_shard))
    pieces = _pieces(items, longest).withColumn("shard", F.pmod(
        F.xxhash64("doc_id", "piece", "all_", "place_"), F.lit(shards)).cast("int"))
    return _packed(pieces, ["shard"], [], capacities, overhead)


def with_copy(rows: DataFrame, keys: list[str], stretch: int = SHARD) -> DataFrame:
    """``rows`` (with ``position``) with ``copy``: how many rows with the same keys come before.

    Copies are counted in stretches of positions, and the stretches' counts are added up, so a
    text that a third of all rows hold is no single group.
    """
    cut = rows.withColumn("stretch_", F.floor(F.col("position") / stretch))
    before = (Window.partitionBy(*keys).orderBy("stretch_")
              .rowsBetween(Window.unboundedPreceding, -1))
    counts = cut.groupBy(*keys, "stretch_").agg(F.count("*").alias("n_"))
    starts = counts.select(
        *[F.col(k).alias(f"{k}_key") for k in keys], F.col("stretch_").alias("at_"),
        F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))
    on = F.col("stretch_") == F.col("at_")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}_key"))
    here = Window.partitionBy(*keys, "stretch_").orderBy("position")
    return (cut.join(starts, on)
            .withColumn("copy", F.col("start_") + F.row_number().over(here) - 1)
            .select(*rows.columns, "copy"))


def pack_in_order(docs: DataFrame, length: str = "n_words",
                  capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD,
                  rows_per_shard: int = SHARD) -> DataFrame:
    """As ``pack``, of rows with ``position`` (their number in training order, from 0) and
    ``copy``, which are returned with ``shard``.

    A shard is a stretch of ``rows_per_shard`` rows; where their pieces are more than that, it is
    packed in parts of so many pieces. Ties go to the earlier row, and the bins of a part are
    numbered by the mean position in them.
    """
    longest = max(capacities)
    items = _items(docs, length, ["position", "copy"]).withColumn(
        "shard", F.floor(F.col("position") / rows_per_shard))
    # No window is longer than a stretch.
    earlier = (Window.partitionBy("shard").orderBy("position")
               .rowsBetween(Window.unboundedPreceding, -1))
    items = items.withColumn("before_", F.coalesce(F.sum(_n_pieces(longest)).over(earlier),
                                                   F.lit(0)))
    pieces = _pieces(items, longest).withColumn(
        "part", F.floor((F.col("before_") + F.col("piece")) / rows_per_shard)).drop("before_")
    return _packed(pieces, ["shard", "part"], ["position", "copy", "shard"], capacities, overhead)


def _n_pieces(longest: int) -> Column:
    return F.greatest(F.ceil(F.col("all_") / longest), F.lit(1))


def _items(docs: DataFrame, length: str, more: list[str]) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"),
                       F.coalesce(F.col(length), F.lit(0)).cast("long").alias("all_"),
                       *[F.col(c).cast("long").alias(c) for c in more])


def _pieces(items: DataFrame, longest: int) -> DataFrame:
    cut = F.sequence(F.lit(0), F.greatest(
        F.ceil(F.col("all_") / longest) - 1, F.lit(0)).cast("int"))
    return (items.withColumn("piece", F.explode(cut))
            .withColumn("start", (F.col("piece") * longest).cast("long"))
            .withColumn("length", F.least(F.lit(longest), F.col("all_") - F.col("start"))))


def _packed(pieces: DataFrame, by: list[str], more: list[str], capacities: tuple[int, ...],
            overhead: int) -> DataFrame:
    """Each group of pieces packed; ``more`` names columns that pass, by ``position`` in order."""
    import pandas as pd

    own = ["doc_id", "piece", "start", "length"]
    columns = [*own, "bin_id", "offset", "capacity", "used", *more]
    tie = "position" if more else "doc_id"

    def run(key, pdf):
        pdf = pdf.sort_values(["length", tie, "piece"], ascending=[False, True, True],
                              kind="stable", ignore_index=True)
        n = pdf["length"].astype("int64").tolist()
        place, offset, final = best_fit(n, capacities, overhead)
        used = np.bincount(place, weights=n, minlength=len(final)).astype("int64")
        place = np.array(place)
        number = np.arange(len(final))
        if more:
            mean = np.bincount(place, weights=pdf["position"]) / np.bincount(place)
            number[np.argsort(mean, kind="stable")] = np.arange(len(final))
        shard = "-".join(map(str, key))
        return pd.DataFrame({
            **{c: pdf[c] for c in (*own, *more)},
            "bin_id": [f"{shard}-{b}" for b in number[place]], "offset": offset,
            "capacity": np.array(final)[place], "used": used[place]})[columns]

    schema = ("doc_id long, piece int, start long, length long, bin_id string, offset long, "
              "capacity int, used long" + "".join(f", {c} long" for c in more))
    packed = (pieces.where("length > 0").select(*own, *dict.fromkeys([*by, *more])).groupBy(*by)
              .applyInPandas(run, schema))
    none = pieces.where("length <= 0").select(
        *own, F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast("long").alias("offset"), F.lit(None).cast("int").alias("capacity"),
        F.lit(None).cast("long").alias("used"), *more)
    return packed.unionByName(none)
