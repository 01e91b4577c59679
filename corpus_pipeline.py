"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read
again by the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.llm import jaccard, ledger, mixing, packing, spans
from querytrail.llm.common import in_file_order, prepare, store, table, word_count

POLICY = "v1"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the policy rejects."""
    prepare(spark)
    book = ledger.apply_policy(ledger.ledger(docs, docs.columns), POLICY)
    return book.where("kept").select("carry.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id. Groups are of texts, so rows
    that share a doc_id but not the text are strangers; rows without text stay."""
    prepare(spark)
    return jaccard.first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; ``n_chars`` follows the text."""
    prepare(spark)
    carry = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = spans.remove_repeats(docs, carry=carry)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"),
           "n_chars": F.length("kept_text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("carry")[c]).alias(c)
                        for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes, in training order."""
    prepare(spark)
    own = ["doc_id", "text", "source"]
    rest = [c for c in docs.columns if c not in own]
    narrow = docs.select(*own, *([F.struct(*rest).alias("carry")] if rest else []))
    order = mixing.training_order(mixing.plan(narrow)).where(F.col("copy").isNotNull())
    return order.select(*[(F.col(c) if c in own else F.col("carry")[c]).alias(c)
                          for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document, or piece of one, in the training sequences.

    ``position`` is the row's number in the order that the mix has written, ``copy`` counts the
    rows with the same doc_id and text in it; shards are stretches of that order."""
    prepare(spark)
    # Texts are looked at where they lie; what is placed and shuffled is narrow.
    narrow = docs.select("doc_id", F.xxhash64("text").alias("text_"),
                         word_count(F.col("text")).alias("n_words"))
    rows = in_file_order(narrow, "packing-in")
    return packing.pack_in_order(packing.with_copy(rows, ["doc_id", "text_"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

# Hash signatures, window hashes and packing are not SQL; tests hold each stage against a
# brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
