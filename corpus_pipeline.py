"""Corpus pipeline: language ID, quality rules, SimHash near-dedup, suffix-array dedup, packing.

Each stage is one operator of `paceline.llm` over all rows that the stage before kept. All but the last return the columns
of `documents`, whatever these are; rows with nulls, repeated rows and extra columns go through like others. An empty table
stays empty. SQL can express neither the models nor the dedup stages; tests hold each stage against its operator's
brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm import language_id, packing, quality_rules, simhash, suffix_dedup
from paceline.llm.common import checkpointed, table, text_key

# Posterior below which no language is taken as recognised.
LEAST_SCORE = 0.5
# Passages of over 50 words are to go: 51 words of four bytes, their blanks included, are about so many bytes. Passages of
# shorter words on average (under three letters) may stay. Anchors keep the quarter of the minimum that they have in op 9.
PASSAGE_BYTES, PASSAGE_GRAM = 200, 50
ORACLE_SQL = None


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts of no recognised language. Where nothing can be learned, no text is recognised."""
    score = language_id.predict(language_id.train(docs), spark)
    found = docs.withColumn("__language", score(F.col("text")))
    return found.filter((F.col("__language.lang_pred") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)).drop("__language")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rule or are depleted by frequent lines; the texts that stay are left as they are."""
    verdicts = quality_rules.quality_rules(docs)
    # The verdict is a function of host and text, so rejected rows need no id.
    rejected = checkpointed(verdicts.filter(~F.col("kept")).select(F.col("host").alias("__host"), F.col("key").alias("__key")).distinct(), "rejected")
    marked = docs.withColumn("__host", quality_rules.host_name(F.col("source"))).withColumn("__key", text_key(F.col("text")))
    return marked.join(rejected, ["__host", "__key"], "left_anti").select(*[f"`{c}`" for c in docs.columns])


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each SimHash component."""
    return simhash.one_of_each(docs)


def without_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of `PASSAGE_BYTES` or more that repeat out of the texts; `n_chars` follows. No row is dropped."""
    cut = suffix_dedup.without_repeats(docs, min_length=PASSAGE_BYTES, gram=PASSAGE_GRAM)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", recognised_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("repeated_strings", without_repeated_strings),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
