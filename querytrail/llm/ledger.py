"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a policy is a named set of rules, applied as a mask, so a new version or an
ablation reads the ledger and never the text. All of it is Spark SQL functions on one row: the
repeated windows of a text are found by sorting its window hashes inside the row.

Defined results: null, empty and blank texts have no words and fail ``few_words``; rows that
repeat are judged each; columns beside ``doc_id`` and ``text`` do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querytrail.llm.common import SPACES, words

# Bit by position. Integer comparisons, so that no rounding decides.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words",
           "long_words"),
}
SYMBOLS = "[#*$%&|<>]"


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the row."""
    def windows(w: Column) -> Column:
        marks = F.transform(w, lambda x, i: F.struct(
            F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
        return F.sort_array(F.slice(marks, 1, F.greatest(F.size(w) - 2, F.lit(0))))

    def repeated(s: Column) -> Column:
        kept = F.filter(s, lambda x, i:
                        F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        return F.sort_array(F.transform(kept, lambda x: x["p"]))

    def covered(p: Column) -> Column:
        reach = F.transform(p, lambda x, i: F.least(
            F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    return _once(_once(_once(ws, windows), repeated), covered)


def _once(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed a single time."""
    return F.transform(F.array(value), then)[0]


def measure(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One row per document with what the rules look at; ``carry``: those columns of ``docs`` in
    a struct of that name."""
    own = ["doc_id"] if carry is None else ["doc_id", F.struct(*carry).alias("carry")]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                        _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"),
                        (F.size(x) - F.size(F.array_distinct(x))).cast("long")
                        .alias("n_dup_lines"))

    return (docs.select(*own, _once(words(F.col("text")), of_words).alias("w"),
                        _once(lines, of_lines).alias("l"),
                        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
            .select("doc_id", *["carry"] * (carry is not None), "w.n_words", "w.word_chars", "n_symbols", "l.n_lines",
                    "l.n_dup_lines", "w.n_repeat_words"))


def ledger(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed``, the bits of the rules that a document fails."""
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0))
                for i, rule in enumerate(RULES.values())), F.lit(0))
    return measure(docs, carry).withColumn("failed", bits.cast("long"))


def apply_policy(book: DataFrame, policy: str) -> DataFrame:
    """``kept``: no rule of the policy has failed."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents it fails, fails alone, and kept without it.

    The ledger is first counted by bit pattern, so the rest runs on at most 2**rules rows.
    """
    whole = mask(POLICIES[policy])
    patterns = (book.groupBy(F.col("failed").bitwiseAND(F.lit(whole)).alias("bits"))
                .agg(F.count("*").alias("n")))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit"))
                      for r in POLICIES[policy]])
    rows = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*")
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))
              .otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0))
        .alias("failed_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"))
