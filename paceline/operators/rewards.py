"""Rewards that need more than the completion's own row, and the scoring job."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions import rewards as columns
from paceline.functions.numbers import INFINITY
from paceline.functions.text import extract_last_code, render_template
from paceline.operators.generation import ModelLoader, batch_generate


# What `extract_last_code` gives for an answer without a program.
NO_CODE = "No Code"


def length_reward(
    df: DataFrame, completion: str = "completion", correct: str = "is_correct", batch: str = "batch_id", name: str = "length"
) -> DataFrame:
    """Short completions of a batch are rewarded, long and wrong ones punished; unknown correctness is correct.

    Batch extremes are partial aggregates joined back, so a hot batch stays spread out.
    """
    length = F.length(completion)
    extremes = df.groupBy(batch).agg(F.min(length).alias("_min"), F.max(length).alias("_max"))
    scaled = F.lit(0.5) - F.try_divide(F.length(completion) - F.col("_min"), F.col("_max") - F.col("_min"))
    reward = F.when(F.coalesce(correct, F.lit(True)), scaled).otherwise(F.least(F.lit(0.0), scaled))
    return (
        df.join(extremes, batch)
        .withColumn(name, F.when(F.col("_max") == F.col("_min"), F.lit(0.0)).otherwise(reward))
        .drop("_min", "_max")
    )


def measured_code_reward(completions: DataFrame, measurements: DataFrame, key: str = "seq") -> DataFrame:
    """The code of each completion and its measured score, 0 where there is no result."""
    scores = measurements.select(key, F.col("score").alias("_score"))
    return (
        completions.withColumn("code", extract_last_code("completion", "cpp"))
        .join(scores, key, "left")
        .withColumn("pie_code", F.coalesce("_score", F.lit(0.0)))
        .drop("_score")
    )


def baseline_or_measure(rows: DataFrame, measured: DataFrame, key: Sequence[str]) -> DataFrame:
    """Stored baseline accuracy and runtime, the measured ones where a stored one is missing."""
    fresh = measured.select(
        *key, F.col("accuracy").alias("_accuracy"), F.col("agg_runtime").alias("_runtime")
    )
    incomplete = F.col("accuracy").isNull() | F.col("agg_runtime").isNull()
    return (
        rows.join(fresh, list(key), "left")
        .withColumn("_incomplete", incomplete)
        .withColumn("accuracy", F.when(F.col("_incomplete"), F.col("_accuracy")).otherwise(F.col("accuracy")))
        .withColumn("agg_runtime", F.when(F.col("_incomplete"), F.col("_runtime")).otherwise(F.col("agg_runtime")))
        .drop("_incomplete", "_accuracy", "_runtime")
    )


def optimizer_speedup(src_runtime: str = "src_runtime", tgt_runtime: str = "tgt_runtime", accuracy: str = "tgt_acc") -> Column:
    """Speedup one optimizer reached, 0 for a wrong or failed program."""
    failed = (F.col(accuracy) < 1) | (F.col(src_runtime) == INFINITY) | (F.col(tgt_runtime) == INFINITY)
    return F.when(failed, F.lit(0.0)).otherwise(F.try_divide(src_runtime, tgt_runtime))


def speedup_reward(results: DataFrame, key: str = "completion_id") -> DataFrame:
    """Mean speedup over optimizers: -100 for none, -1 for a slowdown, else squared."""
    mean = F.col("mean_speedup")
    return (
        results.groupBy(key)
        .agg(F.avg(optimizer_speedup()).alias("mean_speedup"))
        .withColumn("reward", F.when(mean == 0, F.lit(-100.0)).when(mean < 1, F.lit(-1.0)).otherwise(mean * mean))
    )


def optimizer_programs(
    completions: DataFrame,
    optimizers: Mapping[str, ModelLoader],
    template: str,
    key: str = "seq",
    suggestion: str = "completion",
    source: str = "org_code",
    batch: int = 100,
) -> DataFrame:
    """The program each optimizer writes for each completion: (key, `optimizer`, `code`).

    The source program and then the suggestion fill the template's `src_code` and `suggestion` holes; the last cpp block
    of the answer is the program, `No Code` without one.
    """
    holes = {"src_code": source, "suggestion": suggestion}
    asked = completions.select(key, render_template(template, holes).alias("prompt"))
    written = [
        batch_generate(asked, loader, "_optimizer", batch, extract=False).select(
            key, F.lit(name).alias("optimizer"), extract_last_code("_optimizer_resp", "cpp", NO_CODE).alias("code")
        )
        for name, loader in optimizers.items()
    ]
    return reduce(DataFrame.unionByName, written)


def optimizer_reward(
    completions: DataFrame, programs: DataFrame, measurements: DataFrame, baselines: DataFrame, key: str = "seq"
) -> DataFrame:
    """The reward of completions by what optimizers make of them: (key, `mean_speedup`, `cos_optimizer_code`).

    `completions` holds the stored `accuracy` and `agg_runtime` of each source program, `baselines` measured ones for
    where they are missing, `measurements` (key, `optimizer`, `accuracy`, `agg_runtime`) those of `programs`. What was
    never measured, or is no program, failed. Programs do not take part in a shuffle.
    """
    sources = baseline_or_measure(completions.select(key, "accuracy", "agg_runtime"), baselines, [key]).select(
        key, F.coalesce("agg_runtime", F.lit(INFINITY)).alias("src_runtime")
    )
    targets = measurements.select(
        key, "optimizer", F.col("agg_runtime").alias("tgt_runtime"), F.col("accuracy").alias("tgt_acc")
    )
    results = (
        programs.select(key, "optimizer", (F.col("code") == NO_CODE).alias("_none"))
        .join(targets, [key, "optimizer"], "left")
        .join(sources, key)
        .withColumn("tgt_runtime", F.coalesce("tgt_runtime", F.lit(INFINITY)))
        .withColumn("tgt_acc", F.when(F.col("_none"), F.lit(0.0)).otherwise(F.coalesce("tgt_acc", F.lit(0.0))))
    )
    return speedup_reward(results, key).withColumnRenamed("reward", "cos_optimizer_code")


RewardBuilder = Callable[..., Column]

# Every reward that is an expression over the completion row. `length`, `pie_code` and
# `cos_optimizer_code` need other rows: `score_completions` adds a column of that name beforehand.
REGISTRY: dict[str, RewardBuilder] = {
    "accuracy": lambda **_: columns.answer_match("completion", "gold"),
    "format": lambda **_: columns.format_reward("completion"),
    "code_format": lambda language="cpp", **_: columns.code_format_reward("completion", language),
    "tag_count": lambda **_: columns.tag_count_reward("completion"),
    "reasoning_steps": lambda **_: columns.reasoning_steps_reward("completion"),
    "cosine": lambda **options: columns.cosine_scaled_reward("completion", "is_correct", **options),
    "repetition_penalty": lambda **options: columns.repetition_penalty_reward("completion", **options),
    "soft_overlong_punishment": lambda **options: columns.soft_overlong_punishment("n_tokens", **options),
    "length": lambda **_: F.col("length"),
    "pie_code": lambda **_: F.col("pie_code"),
    "cos_optimizer_code": lambda **_: F.col("cos_optimizer_code"),
}


def score_completions(
    df: DataFrame,
    names: Sequence[str],
    weights: Sequence[float] | None = None,
    options: Mapping[str, Mapping] | None = None,
    code_scores: DataFrame | None = None,
    optimizer_rewards: DataFrame | None = None,
    key: str = "seq",
) -> DataFrame:
    """One `reward_<name>` column per reward and their weighted sum `reward`; a null reward counts as 0.

    `pie_code` needs `code_scores` (key, `score`) and `cos_optimizer_code` the rows of `optimizer_reward`, unless `df` has
    a column of that name. A completion that is missing there has a `pie_code` of 0 and no optimizer reward.
    """
    unknown = [name for name in names if name not in REGISTRY]
    if unknown:
        raise KeyError(f"unknown rewards: {', '.join(unknown)}")
    weights = list(weights or [1.0] * len(names))
    if len(weights) != len(names):
        raise ValueError(f"{len(names)} rewards but {len(weights)} weights")
    if "length" in names and "length" not in df.columns:
        df = length_reward(df)
    if "pie_code" in names and "pie_code" not in df.columns:
        if code_scores is None:
            raise ValueError("the reward pie_code needs code_scores")
        scores = code_scores.select(key, F.col("score").alias("pie_code"))
        df = df.join(scores, key, "left").withColumn("pie_code", F.coalesce("pie_code", F.lit(0.0)))
    if "cos_optimizer_code" in names and "cos_optimizer_code" not in df.columns:
        if optimizer_rewards is None:
            raise ValueError("the reward cos_optimizer_code needs optimizer_rewards")
        df = df.join(optimizer_rewards.select(key, "cos_optimizer_code"), key, "left")
    options = options or {}
    scored = df.withColumns({f"reward_{name}": REGISTRY[name](**options.get(name, {})) for name in names})
    parts = [F.coalesce(F.col(f"reward_{name}"), F.lit(0.0)) * weight for name, weight in zip(names, weights)]
    return scored.withColumn("reward", sum(parts[1:], parts[0]))
