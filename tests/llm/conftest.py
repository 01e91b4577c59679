from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC = ("doc_id long, text string, lang string, source string, n_chars long, size int, node int, "
       "carry string, h1 string, copy string, number int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, ties, repeated rows, clashing names."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    long_text = " ".join(rng.choices(vocabulary, k=40_000))
    near = rng.choices(vocabulary, k=200)
    other = [*near[:100], "changed", *near[101:]]
    rows = [
        (1, "Ein " + passage + " end\nof it", "de", "b"),
        (2, "other start " + passage, "en", None),
        (3, None, None, None), (4, "", "en", "a"), (5, " \t\n\r ", "en", "a"),
        (6, long_text, "en", "é"), (7, long_text, "en", "é"),
        (8, " ".join(near), "fr", "a"), (9, "\n".join(other), "fr", "a"),
        (9, "\n".join(other), "fr", "a"), (10, "same " * 300, None, "a"),
        (None, "no id " + passage, "en", "a"), (None, None, None, None),
        (11, "four words are here", "en", "𝄞"), (12, "four words are here", "en", "￿"),
        (13, "<|endoftext|> a   b \n  c <>#", "en", "a"), (14, "ß1 2 3", "xx", "a"),
    ]
    return spark.createDataFrame(
        [(*r, 1, 2, 3, "x", "y", "z", 4) for r in rows], DOC)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
