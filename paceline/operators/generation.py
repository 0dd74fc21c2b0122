"""Resumable batch generation through a user-supplied model function."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.text import before_marker, extract_first_code_chunk, render_template
from paceline.sources import files

STEP = "_step"
# Prompts that a Python worker holds at once, whole texts; Spark's default of 10,000 lets its memory grow with the table.
PROMPT_ROWS = 256

# Loads the model in a worker and returns `prompts -> responses`; a response is a string, or a
# list of n strings where n > 1 generations are asked for.
ModelLoader = Callable[[], Callable[[Sequence[str]], Sequence]]


def one_per_id(df: DataFrame, id_col: str, last_by: str) -> DataFrame:
    """The last row of each id by a unique order column; only narrow keys are aggregated."""
    last = df.groupBy(id_col).agg(F.max(last_by).alias(last_by))
    return df.join(last.select(last_by), last_by, "left_semi")


def resume_split(
    data: DataFrame, cache: DataFrame, response: str, id_col: str = "id", order_col: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """G1: (done, remaining). Done rows are cached or already hold a response, one per id, the cache first."""
    cached = one_per_id(cache, id_col, order_col)
    fresh = data.join(cache.select(id_col), id_col, "left_anti")
    answered = one_per_id(fresh.filter(F.col(response).isNotNull()), id_col, order_col)
    done = cached.unionByName(answered)
    remaining = one_per_id(fresh.filter(F.col(response).isNull()), id_col, order_col).join(
        answered.select(id_col), id_col, "left_anti"
    )
    return done, remaining


def build_prompts(
    df: DataFrame, template: str, holes: Mapping[str, str | Column], cut_at: str | None = None
) -> DataFrame:
    """Add `prompt`, rendered and cut before a marker if one is given."""
    prompt = render_template(template, holes)
    return df.withColumn("prompt", before_marker(prompt, cut_at) if cut_at else prompt)


def generate(loader: ModelLoader, batch: int = 100, n: int = 1) -> Callable[[Column], Column]:
    """A column function that sends prompts to the model in batches.

    Only the prompt column crosses to Python; the model is loaded once per task. Null prompts
    get a null response without a call.
    """

    @F.pandas_udf("string" if n == 1 else "array<string>")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loader()
        for series in prompts:
            asked = series[series.notna()]
            responses: list = []
            for start in range(0, len(asked), batch):
                responses.extend(model(asked.iloc[start : start + batch].tolist()))
            answered = pd.Series(responses, index=asked.index, dtype=object)
            yield answered.reindex(series.index).where(series.notna(), None)

    # Generation is costly and may be random: the plan must not copy or re-order the call.
    return run.asNondeterministic()


def prompt_batches(spark: SparkSession, batch: int) -> None:
    """Bound what crosses to Python at once to about `PROMPT_ROWS` rows of this session's Python stages, whole batches of the model."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch * max(1, PROMPT_ROWS // batch)))


def batch_generate(
    df: DataFrame,
    loader: ModelLoader,
    model: str,
    batch: int = 100,
    n: int = 1,
    extract: bool = True,
    workers: int | None = None,
) -> DataFrame:
    """Add `<model>_resp` for the `prompt` column and, if asked, the extracted code as `<model>`."""
    prompt_batches(df.sparkSession, batch)
    if workers:
        df = df.repartition(workers)
    out = df.withColumn(f"{model}_resp", generate(loader, batch, n)("prompt"))
    if not extract:
        return out
    code = multi_generation_extract(f"{model}_resp") if n > 1 else extract_first_code_chunk(f"{model}_resp")
    return out.withColumn(model, code)


def generate_in_steps(
    spark: SparkSession, prompts: DataFrame, loader: ModelLoader, model: str, path: str, steps: int = 16,
    id_col: str = "id", batch: int = 100, n: int = 1, extract: bool = True, fingerprint: str = "",
) -> DataFrame:
    """G3 as a run that can be taken up again: `prompts` with their answers, saved under `path` step by step.

    Prompts are written once, dealt to `steps` by a hash of the id. Each step is a job over its own prompts whose answers
    are published when all are there, so a run that fails, or is ended, loses the answers of one step; the next run with
    the same path and `fingerprint` (which names prompts and model) asks for the missing steps only. Every step uses the
    whole cluster: choose as few steps as the loss of one allows.
    """
    dealt = prompts.withColumn(STEP, F.pmod(F.xxhash64(id_col), F.lit(steps)))
    # Dealt by more than the step, a large step's prompts are many files.
    spread = F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(spark.sparkContext.defaultParallelism))
    staged = files.materialize_once(spark, f"{path}/prompts", lambda: dealt.repartition(STEP, spread), f"{fingerprint} in {steps} steps", [STEP])
    answers = None
    for step in range(steps):
        asked = staged.filter(F.col(STEP) == step).drop(STEP)
        build = lambda asked=asked: batch_generate(asked, loader, model, batch, n, extract)
        answered = files.materialize_once(spark, f"{path}/answers", build, f"{fingerprint} step {step} of {steps}")
        answers = answered if answers is None else answers.unionByName(answered)
    return answers


def multi_generation_extract(responses: str | Column) -> Column:
    """The first code chunk of each response, nulls kept in place."""
    return F.transform(responses, extract_first_code_chunk)


def follow_suggestions(
    df: DataFrame,
    loader: ModelLoader,
    model: str,
    template: str,
    holes: Mapping[str, str | Column],
    suggestions: str = "suggestions",
    id_col: str = "id",
    cut_at: str | None = None,
    batch: int = 100,
) -> DataFrame:
    """One prompt per suggestion; responses and extracted code come back as arrays in order.

    A string column counts as one suggestion. What is regrouped is one row's own array, so a
    group is never larger than an input row was. Other columns stay out of the regrouping.
    """
    if dict(df.dtypes)[suggestions] == "string":
        df = df.withColumn(suggestions, F.array(suggestions))
    prompt_batches(df.sparkSession, batch)
    asked = df.select("*", F.posexplode(suggestions).alias("_pos", "suggestion"))
    prompts = build_prompts(asked, template, holes, cut_at).select(id_col, "_pos", "prompt")
    answered = prompts.withColumn("_resp", generate(loader, batch)("prompt"))
    grouped = answered.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("_pos", "_resp"))).alias("_answers"))
    empty = F.array().cast("array<string>")
    responses = F.coalesce(F.transform("_answers", lambda answer: answer["_resp"]), empty)
    return (
        df.join(grouped, id_col, "left")
        .withColumn(f"{model}_opt_resp", responses)
        .withColumn(f"{model}_final", multi_generation_extract(F.col(f"{model}_opt_resp")))
        .drop("_answers")
    )
