"""Mixing sources to target weights along a curriculum.

Every source has a weight curve over training time (0 to 1), piecewise linear. The area below
it is the source's weight: areas are turned into word targets, no source above ``repeat_cap``
times its size. Within a source the documents follow each other in hash order, and the whole
order is repeated until the target is reached. The words so far, as a share of the target, are
looked up in the inverse of the curve's running area, which gives each copy its position in
training; copies are sorted by range of position.

Defined results: a null text has size 0; documents without words are never taken; a null source
is a source of its own, last in order; rows that repeat are documents of their own; an empty
table gives no rows. A copy is taken when its middle lies within the target, so a source misses
its target by half a document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import numbered, placed, store, word_count

Curve = tuple[tuple[float, float], ...]

# Falling, even and rising curves with areas 5, 2 and 1, given to the sources in turn.
CURVES: tuple[Curve, ...] = (
    ((0.0, 7.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
REPEAT_CAP = 3
SHARE = 1.0
# A source is added up in hash buckets of about so many rows, so that a large one is no single
# task; equal rows, which share a bucket, are first added up by their place in the input.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64


def area(curve: Curve) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:], strict=False))


def time_at(curve: Curve, share: Column) -> Column:
    """The time at which the running area of ``curve`` reaches ``share`` of its whole."""
    whole, done, pieces = area(curve), 0.0, []
    for (t0, w0), (t1, w1) in zip(curve, curve[1:], strict=False):
        rise = (w1 - w0) / (t1 - t0)
        left = F.greatest(share * whole - done, F.lit(0.0))
        root = F.sqrt(F.greatest(w0 * w0 + 2 * rise * left, F.lit(0.0)))
        done += (t1 - t0) * (w0 + w1) / 2
        pieces.append((done / whole, t0, t1, F.least(t0 + 2 * left / (w0 + root), F.lit(t1))))
    out = F.lit(pieces[-1][2])
    for end, t0, _t1, time in reversed(pieces):
        out = F.when(share <= end, F.coalesce(time, F.lit(t0))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, curves: tuple[Curve, ...] = CURVES,
                   repeat_cap: int = REPEAT_CAP, share: float = SHARE) -> DataFrame:
    """``sizes`` (source, source_size) with curve number and target.

    The overflow of capped sources is shared again by weight until none is above its cap; each
    round is one sum over the source table, of which two numbers reach the driver.
    """
    ranked = numbered(sizes, [F.col("source").asc_nulls_last()], "mix-sources")
    weights = F.array(*[F.lit(float(area(c))) for c in curves])
    ranked = (ranked.withColumn("curve", (F.col("number") % len(curves)).cast("int"))
              .withColumn("weight", F.element_at(weights, F.col("curve") + 1))
              .withColumn("cap", F.col("source_size") * repeat_cap).drop("number"))
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level, capped_before = (budget / weight if weight else 0.0), -1
    while True:
        over = F.col("cap") <= level * F.col("weight")
        n, capped, weight = ranked.agg(
            F.count(F.when(over, 1)), F.sum(F.when(over, F.col("cap"))),
            F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped_before or not weight:
            break
        level, capped_before = (budget - (capped or 0)) / weight, n
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"),
                                               level * F.col("weight"))).drop("weight", "cap")


def plan(docs: DataFrame, curves: tuple[Curve, ...] = CURVES, repeat_cap: int = REPEAT_CAP,
         share: float = SHARE, seed: int = 17) -> DataFrame:
    """``docs`` (with ``doc_id``, ``text``, ``source``; other columns pass) with ``size``,
    ``source_size``, ``target``, ``curve``, ``before`` (words of the source before the row, in
    hash order) and ``copies``."""
    own = ["size", "source_size", "target", "curve", "before", "copies", "skey", "snull",
           "order_", "part_", "place_"]
    sized = (placed(docs.drop(*own), "mix-rows")
             .withColumn("size", word_count(F.col("text")))
             .withColumn("skey", F.coalesce(F.col("source"), F.lit("")))
             .withColumn("snull", F.col("source").isNull())
             .withColumn("order_", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))))
    source, key = ["skey", "snull"], ["skey", "snull", "order_", "part_"]
    # Sizes are counted in a pass over the text alone; what is joined to the rows is narrow.
    narrow = store(sized.select(*source, "order_", "place_", "size"), "mix-sizes")
    buckets = max(LEAST_BUCKETS, -(-narrow.count() // BUCKET_ROWS))
    part = F.pmod(F.col("place_"), F.lit(buckets)).cast("int")
    bucket = F.pmod(F.col("order_"), F.lit(buckets)).cast("int")
    alike = (narrow.withColumn("part_", part).groupBy(*key).agg(F.sum("size").alias("words"))
             .withColumn("bucket", bucket))
    sums = store(alike.groupBy(*source, "bucket").agg(F.sum("words").alias("words")), "mix-sums")
    sizes = (sums.groupBy(*source).agg(F.sum("words").alias("source_size"))
             .select(F.when(~F.col("snull"), F.col("skey")).alias("source"), "source_size"))
    targets = store(source_targets(sizes, curves, repeat_cap, share), "mix-targets")
    earlier = (Window.partitionBy(*source).orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("start_", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    starts = starts.join(
        targets.select(F.coalesce("source", F.lit("")).alias("skey"),
                       F.col("source").isNull().alias("snull"),
                       "source_size", "target", "curve"), source).drop("words")
    within = (Window.partitionBy(*source, "bucket").orderBy("order_", "part_")
              .rowsBetween(Window.unboundedPreceding, -1))
    first = (alike.withColumn("ahead_", F.coalesce(F.sum("words").over(within), F.lit(0)))
             .join(starts, [*source, "bucket"])
             .select(*key, (F.col("start_") + F.col("ahead_")).alias("start_"), "source_size",
                     "target", "curve"))
    equal = (Window.partitionBy(*key).orderBy("doc_id", "size")
             .rowsBetween(Window.unboundedPreceding, -1))
    ordered = (sized.withColumn("part_", part).join(first, key)
               .withColumn("before", F.col("start_")
                           + F.coalesce(F.sum("size").over(equal), F.lit(0))))
    middle = F.col("before") + F.col("size") / 2
    copies = F.floor((F.col("target") - middle) / F.col("source_size")) + 1
    return (ordered.withColumn("copies", F.when(F.col("size") == 0, 0)
                               .otherwise(F.greatest(copies, F.lit(0))).cast("long"))
            .drop("start_", *key, "place_"))


def training_order(planned: DataFrame, curves: tuple[Curve, ...] = CURVES) -> DataFrame:
    """One row per taken copy (``copy`` from 0) with its ``position`` in training, sorted by
    range of position; documents that are not taken follow at the end with null copy."""
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies").cast("int") - 1))
    rows = planned.select(*[c for c in planned.columns if c not in ("copy", "position")],
                          F.explode_outer(copies).alias("copy"))
    share = ((F.col("copy") * F.col("source_size") + F.col("before") + F.col("size") / 2)
             / F.col("target"))
    position = F.lit(None).cast("double")
    for k, curve in enumerate(curves):
        position = F.when(F.col("curve") == k, time_at(curve, share)).otherwise(position)
    position = F.when(F.col("copy").isNotNull(), position)
    order = [F.col("position").asc_nulls_last(), F.col("doc_id"), F.col("copy")]
    return (rows.withColumn("position", position)
            .repartitionByRange(*order).sortWithinPartitions(*order))
