from __future__ import annotations

import random

import pytest

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key string, host string, component_id string"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, extra columns with clashing names."""
    rng = random.Random(5)
    words = ["the", "and", "of", "tion", "Ere", "über", "naïve", "x1", "it's", "<|endoftext|>", "a  b", "▁", "​", "ﬁ", "é", "日本", "😀", "3.14", "--"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    texts = [None, "", " ", "\n", "  two  blanks  ", "!!! 123", "\t tab\x0bline\x0c", long, long, "same text of some words " * 40, "same text of some words " * 40, "\x00 zero", "ÀÉ ß-Ö. \"quoted\"", "a", "0", "퟿ end "]
    rows = [(i, t, "en", "s", len(t or ""), "w", "k", "h", "c") for i, t in enumerate(texts)]
    rows += [(3, "\n", None, None, None, None, None, None, None), (None, "the and of tion", "en", None, 5, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[9], rows[9], (9, "other text, same id", "fr", "s", 3, "", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
