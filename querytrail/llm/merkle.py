"""Merkle manifest of a dataset by nested-struct rollup.

Every document is a leaf, a hash of its columns. The leaves of a source, in order of doc_id, are
the bottom of a tree in which runs of three nodes become their hash, and the sources' roots are
the bottom of the tree of the whole. A node's place is its rank in base three: within a block of
``RUN ** DIGITS`` nodes the digits of the rank are grouped away one after the other, each time
nesting the children's structs in their parent's, so that a block becomes one row of bounded
size. The roots of the blocks are ranked and rolled up alike until a tree has a single block.

Proofs come from the nested rows alone: a transform walks down a block's levels, adds the
siblings on the way, and an explode gives one row per node. What a block hands down meets the
nested row of the block below in a grouping by block, as one more row of that group; no proof is
joined. A hot source has many blocks, and no group holds more than one.

Defined results: null columns are ``-``; a null source is a source of its own and comes first, a
null doc_id comes first in its source; rows that share source and doc_id are ordered by leaf, and
repeated rows are leaves each; a source of one row has its leaf as root; an empty table has no
rows and no root; columns beside those of the leaf do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querytrail.llm.common import store

#: Nodes per run; digits of the rank that one block groups away.
RUN, DIGITS = 3, 5
BLOCK = RUN ** DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def leaf_hash(**other: Column) -> Column:
    """The leaf of a row; ``other`` gives columns that differ from the stored ones."""
    def field(name: str) -> Column:
        value = other.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value),
                          F.lit("-"))
    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def proof_hash(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""),
                  256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``path``."""
    return F.aggregate(path, leaf, lambda node, e: F.sha2(
        F.concat(e["left"], node, e["right"]), 256))


def _ranked(nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``rank`` in their ``tree`` and ``n``, the nodes of the tree.

    Ranges of rows are numbered each by itself; a row per range and tree places them. Equal rows
    get a number of their own first, so that they, too, spread over the ranges.
    """
    rows = store(nodes.withColumn("row_", F.monotonically_increasing_id()), f"{name}-rows")
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "row_")]
    placed = store(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("row_")
                   .withColumn("part_", F.spark_partition_id())
                   .withColumn("at_", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)),
                   f"{name}-placed")
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("tree", "part_")
              .agg(F.min("at_").alias("first_"), F.count("*").alias("rows_"))
              .select(F.col("tree").alias("tree_"), F.col("part_").alias("range_"),
                      (F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_"))
                      .alias("shift_"), F.sum("rows_").over(tree).alias("n")))
    return (placed.join(starts, (F.col("part_") == F.col("range_"))
                        & F.col("tree").eqNullSafe(F.col("tree_")))
            .withColumn("rank", F.col("at_") + F.col("shift_"))
            .drop("part_", "at_", "range_", "tree_", "shift_"))


def _rolled(nodes: DataFrame) -> DataFrame:
    """One row per block: ``tree``, ``n``, ``block`` and ``node``, its root with all below it.

    One exchange deals the blocks out; the groupings by ever fewer digits follow in place.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    rows = nodes.select(
        "tree", "n", F.floor(F.col("rank") / BLOCK).alias("block"),
        *[(F.floor(F.col("rank") / RUN ** k) % RUN).cast("int").alias(d)
          for k, d in enumerate(digits)],
        F.struct("hash", "item").alias("node")).repartition("tree", "block")
    for k, digit in enumerate(digits):
        kids = F.sort_array(F.collect_list(F.struct(F.col(digit).alias("at"), "node")))
        rows = (rows.groupBy("tree", "n", "block", *digits[k + 1:])
                .agg(F.transform(kids, lambda x: x["node"]).alias("kids"))
                .withColumn("hash", F.when(
                    F.col("n") > RUN ** k,
                    F.sha2(F.array_join(F.transform("kids", lambda x: x["hash"]), ""), 256))
                    .otherwise(F.col("kids")[0]["hash"]))
                .withColumn("node", F.struct("hash", "kids")).drop("hash", "kids"))
    return rows


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of each layer, up to the layer where every tree has one block."""
    layers = []
    while True:
        layers.append(store(_rolled(nodes), f"{name}-{len(layers)}"))
        widest = layers[-1].agg(F.max("n")).first()[0] or 0
        if widest <= BLOCK:
            return layers
        nodes = layers[-1].select(
            "tree", F.ceil(F.col("n") / BLOCK).alias("n"), F.col("block").alias("rank"),
            F.col("node")["hash"].alias("hash"), F.struct("block").alias("item"))


def _below(k: int):
    """From an item of ``node`` and ``path`` to those of its children, ``k`` digits high."""
    def siblings(kids, first, count):
        return F.array_join(F.transform(F.slice(kids, first, count), lambda x: x["hash"]), "")

    def below(it):
        kids = it["node"]["kids"]

        def one(kid, i):
            step = F.array(F.struct(siblings(kids, F.lit(1), i).alias("left"),
                                    siblings(kids, i + 2, F.lit(RUN)).alias("right")))
            here = F.when(F.col("n") > RUN ** k, step).otherwise(F.array().cast(PATH))
            return F.struct(kid.alias("node"), F.concat(here, it["path"]).alias("path"))

        return F.transform(kids, one)
    return below


def _spread(rows: DataFrame) -> DataFrame:
    """One row per node below the blocks: ``tree``, ``hash``, ``item``, ``path``, ``top``."""
    items = F.array(F.struct("node", "path"))
    for k in reversed(range(DIGITS)):
        items = F.flatten(F.transform(items, _below(k)))
    return (rows.select("tree", "top", F.explode(items).alias("x"))
            .select("tree", "x.node.hash", "x.node.item", "x.path", "top"))


def _meet(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``blocks`` with the ``path`` and ``top`` that were handed down to them."""
    columns = ["n", "node", "path", "top"]
    both = blocks.unionByName(above, allowMissingColumns=True)
    return both.groupBy("tree", "block").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in columns])


def _descend(layers: list[DataFrame], rows: DataFrame) -> DataFrame:
    """The nodes at the bottom of ``layers``, from ``rows``, the blocks of the highest."""
    for layer in reversed(layers[:-1]):
        above = _spread(rows).select("tree", F.col("item")["block"].alias("block"), "path", "top")
        rows = _meet(layer, above)
    return _spread(rows)


def manifest(leaves: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``leaves`` (``doc_id``, ``source``, ``leaf`` and the columns ``carry``) with ``subroot``,
    ``root`` and ``path``: per level the hashes left and right of the node, from leaf to root."""
    ranked = _ranked(leaves.select(F.col("source").alias("tree"), "doc_id", "leaf", *carry),
                     ["doc_id", "leaf"], "merkle-leaves")
    layers = _climb(ranked.select("tree", "n", "rank", F.col("leaf").alias("hash"),
                                  F.struct("doc_id", *carry).alias("item")), "merkle-source")
    tops = layers[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("source"),
                             F.col("node")["hash"].alias("hash"))
    upper = _climb(_ranked(tops, ["source"], "merkle-roots")
                   .select("tree", "n", "rank", "hash", F.struct("source").alias("item")),
                   "merkle-whole")
    whole = upper[-1].withColumns({
        "path": F.array().cast(PATH), "top": F.struct(F.col("node")["hash"].alias("root"))})
    above = _descend(upper, whole).select(
        F.col("item")["source"].alias("tree"), F.lit(0).cast("long").alias("block"), "path", "top")
    sources = _meet(layers[-1], above).withColumn("top", F.struct(
        F.col("node")["hash"].alias("subroot"), F.col("top")["root"].alias("root")))
    return _descend(layers, sources).select(
        F.col("tree").alias("source"), "item.*", F.col("hash").alias("leaf"), "top.*", "path")
