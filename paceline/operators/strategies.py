"""Strategies out of responses, their frequencies and categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paceline.functions.text import (
    CATEGORY_NAMES,
    UNRECOGNIZED,
    relevant_section,
    render_template,
    resolve_category,
    strategy_entries,
)


def clean_responses(df: DataFrame, response: str = "resp") -> DataFrame:
    """The raw response becomes `suggestion` (T1) and `strategy` entries."""
    sections = df.withColumn("suggestion", relevant_section(response)).drop(response)
    return sections.withColumn("strategy", strategy_entries("suggestion"))


def explode_strategies(cleaned: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """One row per (response, title), with its place in the whole run as `first_seen`."""
    return cleaned.select(
        *order, F.posexplode("strategy").alias("entry_pos", "_entry")
    ).select(
        F.struct(*order, "entry_pos").alias("first_seen"),
        F.col("_entry.title").alias("strategy"),
        F.col("_entry.content").alias("suggestion"),
    )


def strategy_frequency(strategies: DataFrame) -> DataFrame:
    """T4: per title its frequency and the first-seen suggestion.

    Partial aggregation leaves one row per title and task before the shuffle, so a title
    present in most responses costs no more than a rare one.
    """
    return (
        strategies.groupBy("strategy")
        .agg(F.count("*").alias("frequency"), F.min(F.struct("first_seen", "suggestion")).alias("_first"))
        .select("strategy", "frequency", "_first.first_seen", "_first.suggestion")
    )


def by_frequency(frequencies: DataFrame) -> DataFrame:
    """T4 order: most frequent first, ties in order of appearance."""
    return frequencies.orderBy(F.desc("frequency"), "first_seen")


def strategy_totals(frequencies: DataFrame) -> DataFrame:
    """T5: all occurrences and distinct titles."""
    return frequencies.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).alias("strategies"), F.count("*").alias("titles")
    )


def classification_prompts(df: DataFrame, template: str, categories: Mapping[str, str]) -> DataFrame:
    """The template with the category list and `title: suggestion` filled in as `prompt`."""
    listing = "".join(f"{name}: {definition}\n\n" for name, definition in categories.items())
    strategy = F.concat(F.col("strategy"), F.lit(": "), F.col("suggestion"))
    return df.withColumn("prompt", render_template(template, {"category": F.lit(listing), "strategy": strategy}))


def classify(df: DataFrame, answer: str = "answer", categories: Sequence[str] = CATEGORY_NAMES) -> DataFrame:
    """T8 as an operator: add `category`."""
    return df.withColumn("category", resolve_category(answer, categories))


def unrecognized(classified: DataFrame) -> DataFrame:
    """T9, first half: rows without a category."""
    return classified.filter(F.col("category") == UNRECOGNIZED)


def unrecognized_rate(classified: DataFrame) -> DataFrame:
    """T9, second half: how many rows have no category, and the percentage."""
    missing = F.count_if(F.col("category") == UNRECOGNIZED)
    return classified.agg(
        F.count("*").alias("strategies"),
        missing.alias("unrecognized"),
        (F.round(F.try_divide(missing, F.count("*")), 4) * 100).alias("unrecognized_pct"),
    )


def classify_audited(df: DataFrame, answer: str = "answer", categories: Sequence[str] = CATEGORY_NAMES) -> tuple[DataFrame, Observation]:
    """T8 with T9: the classified rows, and how many there are and have no category, known once the rows have been written."""
    audit = Observation("unrecognized")
    missing = F.count_if(F.col("category") == UNRECOGNIZED)
    classified = classify(df, answer, categories)
    return classified.observe(audit, F.count("*").alias("strategies"), missing.alias("unrecognized")), audit
