"""The operators of this folder over the test tables: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querytrail.llm import (
    ann,
    bitpack,
    chat,
    jaccard,
    langid,
    ledger,
    lm,
    merkle,
    mixing,
    packing,
    separators,
    spans,
    whitening,
)
from querytrail.llm.common import prepare, store, table, word_count
from querytrail.llm.oracles import ORACLES  # noqa: F401
from querytrail.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOKENIZER = "byte_bpe_50k.json"
#: The id after the vocabulary of that file: no text encodes to it.
FLAT_END = 50256


def query(func: Query) -> Query:
    @wraps(func)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return func(spark, sf_dir)
    QUERIES[func.__name__] = run
    return run


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN


@query
def op1_mix_sources(spark, sf):
    order = mixing.training_order(mixing.plan(
        table(spark, sf, "documents").select("doc_id", "text", "source")).drop("text"))
    first = order.where(F.col("copy").isNull() | (F.col("copy") == 0))
    return first.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"),
                        F.col("position").alias("first_position"))


@query
def op2_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    # A document without an id is never learned from.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    prototypes = langid.fit(docs.where(~held_out))
    return (langid.predict(docs, prototypes)
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))


@query
def op3_token_files(spark, sf):
    path, pattern = tokenizer()
    files = bitpack.write(table(spark, sf, "documents"), scratch_dir(spark, "bits"), path, pattern)
    return bitpack.read_documents(files)


@query
def op4_quality_rules(spark, sf):
    book = ledger.apply_policy(ledger.ledger(table(spark, sf, "documents")), "v1")
    base = F.col("failed").bitwiseAND(F.lit(ledger.mask(ledger.POLICIES["base"]))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", base.alias("base_failed"), "kept",
                       F.col("failed").alias("failed_rules"))


@query
def op5_token_counts(spark, sf):
    path, pattern = tokenizer()
    files, names = separators.write_flat(table(spark, sf, "documents"),
                                         scratch_dir(spark, "flat"), path, pattern, FLAT_END)
    counts = separators.stitch(separators.scan_blocks(files, FLAT_END))
    return (names.join(counts, ["file", "doc_no"])
            .select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "doc_no",
                    "start", "n_tokens"))


@query
def op10_chat_format(spark, sf):
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string")
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.events_of(talks.unionByName(extra))
    return chat.read_back(store(chat.format_log(log), "chat"))


@query
def op6_substring_dedup(spark, sf):
    return spans.remove_repeats(table(spark, sf, "documents"))


@query
def op7_best_fit_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents").select(
        "doc_id", word_count(F.col("text")).alias("n_words")))


@query
def op8_nearest(spark, sf):
    rows = ann.usable(table(spark, sf, "embeddings"))
    return ann.nearest(rows, ann.asked(rows))


@query
def op9_jaccard_join(spark, sf):
    return jaccard.near_groups(table(spark, sf, "documents"))


@query
def op11_merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    # What someone else did to the files: every other document lost its line ends.
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("text").contains("\n")
    leaves = docs.select("doc_id", "source", merkle.leaf_hash().alias("leaf"), F.when(
        hit, merkle.leaf_hash(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))
    proofs = merkle.manifest(leaves, carry=("tampered",))
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    return (proofs.select("doc_id", "leaf", "subroot", "root",
                          merkle.proof_hash(F.col("path")).alias("proof_sha256"),
                          folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


@query
def op12_lm_score(spark, sf):
    remainder = F.crc32(F.col("doc_id").cast("string")) % 10
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", lm.part_of(remainder).alias("part"))
    return lm.score(docs).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(True)).alias("held_out"), "n_tokens",
        "n_known", "train_tokens", "base_score", "score")


@query
def op13_whiten(spark, sf):
    rows = whitening.grid(table(spark, sf, "embeddings"))
    return whitening.apply(rows, whitening.fit(rows))
