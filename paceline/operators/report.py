"""Evaluation of generated programs.

The long form (one row per source program and generation) is canonical; the wide form is made
and read only at the edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.numbers import (
    INFINITY,
    REPORT_THRESHOLDS,
    adjusted_runtime,
    floored_speedup,
    nan_to_null,
    ratio,
    threshold_name,
)
from paceline.functions.text import listed, strip
from paceline.operators.ranking import block_carries, first_rows, running_extremes, running_sums
from paceline.session import materialized

SLOW, REFERENCE = "src_code", "tgt_code"
KEY_COLUMNS = ("problem_id", "tests", "src_id", "tgt_id", "fastest_runtime", "fastest_accuracy")
# Generations scanned together, and the values of a row that has none.
GENERATION_BLOCK = 1024
BLOCK = "gen_block"
# What stands for the programs of a row.
KEY = "_key"
FAILED = {"gen": 0, "agg_runtime": INFINITY, "adjusted_runtime": INFINITY, "accuracy": 0.0}
TEST_MAPS = ("tc2time", "tc2stats")
KEY_SUFFIXES = ("_compilation", "_accuracy", "_runtime", "_tc2time")


def prepare_eval(
    df: DataFrame, list_columns: Sequence[str] = (), first_n: int | None = None, order_col: str = "seq"
) -> DataFrame:
    """Revive JSON list columns, strip the slow program, drop unchanged pairs, keep the first `first_n` by a unique column if asked.

    Text that is no list is one entry; a row without slow or reference program counts as changed.
    """
    for name in list_columns:
        df = df.withColumn(name, listed(F.col(name)))
    df = df.withColumn("slower_program", strip(SLOW)).filter(~F.col(SLOW).eqNullSafe(F.col(REFERENCE)))
    return df if first_n is None else first_rows(df, first_n, [F.col(order_col)])


def generation_arity(df: DataFrame, generations: str) -> DataFrame:
    """The largest number of generations of any row."""
    return df.agg(F.coalesce(F.max(F.size(generations)), F.lit(0)).alias("arity"))


def expand_generations(df: DataFrame, generations: str, arity: int) -> DataFrame:
    """Columns `<generations>_0 …` for the declared number of generations, null where a row has fewer."""
    return df.select("*", *[F.get(generations, F.lit(i)).alias(f"{generations}_{i}") for i in range(arity)])


def explode_generations(df: DataFrame, generations: str, pad: int | None = None) -> DataFrame:
    """E2 in the long form: one row per generation; padded with nulls to a declared number of them if asked.

    A row with more than `pad` generations keeps them all.
    """
    if pad is None:
        # Not the inner form: its filter on the array's size goes below what makes the array, which is then made several times.
        return df.select("*", F.posexplode_outer(generations).alias("gen", "code")).filter(F.col("gen").isNotNull()).drop(generations)
    wanted = F.greatest(F.coalesce(F.size(generations), F.lit(0)), F.lit(pad))
    return (
        df.withColumn("gen", F.explode(F.when(wanted > 0, F.sequence(F.lit(0), wanted - 1))))
        .withColumn("code", F.get(generations, F.col("gen")))
        .drop(generations)
    )


def melt_code(df: DataFrame, ids: Sequence[str], code_columns: Sequence[str]) -> DataFrame:
    """One row per program with its `code_type`; rows without code are dropped."""
    melted = df.unpivot(list(ids), list(code_columns), "code_type", "code")
    return melted.filter(F.col("code").isNotNull() & (F.col("code") != ""))


def split_baseline_rows(melted: DataFrame, redo: bool = False) -> tuple[DataFrame, DataFrame]:
    """(to measure, set aside). When baselines are measured again their old runtimes stay under `*_original_*`."""
    if redo:
        renames = {f"{side}_agg_runtime": f"{side}_original_agg_runtime" for side in ("src", "tgt")}
        renames |= {f"{side}_code_agg_runtime": f"{side}_original_agg_runtime" for side in ("src", "tgt")}
        return melted.withColumnsRenamed({k: v for k, v in renames.items() if k in melted.columns}), melted.limit(0)
    baseline = F.col("code_type").isin(SLOW, REFERENCE)
    return melted.filter(~baseline), melted.filter(baseline)


def restore_baseline_rows(measured: DataFrame, set_aside: DataFrame) -> DataFrame:
    """E4, the way back; columns only one side has become null on the other."""
    return measured.unionByName(set_aside, allowMissingColumns=True)


def order_tests(df: DataFrame, tests: str = "tests") -> DataFrame:
    """E5: tests in descending order."""
    return df.withColumn(tests, F.sort_array(tests, asc=False))


def join_measurements(submissions: DataFrame, measurements: DataFrame, key: Sequence[str]) -> DataFrame:
    """Measurements onto submissions by key, where position would not survive a shuffle."""
    return submissions.join(measurements, list(key), "left")


def unmelt_results(
    long: DataFrame,
    code_types: Sequence[str],
    values: Sequence[str] = ("compilation", "accuracy", "agg_runtime"),
    keys: Sequence[str] = ("src_id", "tgt_id"),
) -> DataFrame:
    """One row per (src, tgt) with `<code_type>_<value>` columns; name `tc2time` or `tc2stats` too to carry them."""
    wide = (
        long.groupBy(*keys)
        .pivot("code_type", list(code_types))
        .agg(*[F.first(value, ignorenulls=True).alias(value) for value in values])
    )
    return wide


def project_key_columns(df: DataFrame, generated: str, slow: str = SLOW, reference: str = REFERENCE) -> DataFrame:
    """Identifying columns, measured columns and programs."""
    wanted = {*KEY_COLUMNS, slow, reference}
    return df.select([c for c in df.columns if c in wanted or c.endswith(KEY_SUFFIXES) or generated in c])


def _program_key(row_id: str) -> Column:
    """A narrow stand-in for the slow and reference programs, so that shuffles carry no programs: 128 bits of a hash.

    The length in front tells glued programs apart. A row that lacks a program is the same as no other row.
    """
    programs = F.sha2(F.concat(F.length(SLOW).cast("string"), F.lit(":"), SLOW, REFERENCE), 256)
    return F.coalesce(F.unhex(F.substring(programs, 1, 32)), F.encode(F.concat(F.lit("row "), F.col(row_id).cast("string")), "UTF-8"))


def without_programs(reference: DataFrame, row_id: str = "seq") -> DataFrame:
    """Reference rows written once, their programs replaced by a key; see `complete_missing`."""
    return materialized(reference.withColumn(KEY, _program_key(row_id)).drop(SLOW, REFERENCE), "reference")


def with_blocks(results: DataFrame, width: int = GENERATION_BLOCK) -> DataFrame:
    """Add the block of each generation; see `best_at_k`."""
    return results.withColumn(BLOCK, F.col("gen") - F.col("gen") % width)


def _extremes() -> tuple[dict[str, Column], dict[str, Column]]:
    return {"best_runtime": nan_to_null("adjusted_runtime")}, {"best_accuracy": nan_to_null("accuracy")}


def complete_missing(results: DataFrame, reference: DataFrame, row_id: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Results of all reference rows; a row without any gets one failed generation.

    Rows are the same when both their programs are; the first row of the results counts, else
    the first of the reference. `results` is long (row id, `gen`, `agg_runtime`, `accuracy`, and
    what else was measured), `reference` has a row per row id. Programs end in the key.

    With `by`, both sides have these columns (the model, say) and all of this holds for each of their values. A reference
    that `without_programs` has written is read as it is.

    Both inputs are read once and written without programs: which rows have results, and the carries of their blocks,
    must be known before rows and results meet. They meet block by block, so one row with very many generations is
    spread over tasks. Adjusted results also get the carries `best_at_k` needs, on the way.
    """
    blocked = materialized(with_blocks(results), "results")
    reference = reference if KEY in reference.columns else without_programs(reference, row_id)
    extremes = _extremes() if "adjusted_runtime" in results.columns else ({}, {})
    key = [*by, row_id]
    blocks = block_carries(blocked, key, BLOCK, *extremes)
    tried = blocks.filter(~F.col("carry_any")).select(*key, F.lit(True).alias("_tried"))
    keyed = reference.select(*key, KEY).join(tried, key, "left")
    first_tried = F.min(F.when(F.col("_tried"), F.col(row_id)))
    first = keyed.groupBy(*by, KEY).agg(F.coalesce(first_tried, F.min(row_id)).alias(row_id))
    chosen = reference.drop(KEY).join(first.select(*key), key, "left_semi")
    # Rows without a block get one before they meet results, so that what goes on by block is not dealt again.
    placed = chosen.join(blocks.drop("carry_any"), key, "left").withColumn("_placed", F.col(BLOCK).isNotNull())
    placed = placed.withColumn(BLOCK, F.coalesce(F.col(BLOCK), F.lit(0)))
    other = {name: f"_result_{name}" for name in (*key, BLOCK)}
    met = reduce(and_, [F.col(name) == F.col(renamed) for name, renamed in other.items()], F.col("_placed"))
    found = blocked.withColumn("_measured", F.lit(True)).withColumnsRenamed(other)
    completed = placed.join(found, met, "left").drop("_placed", *other.values())
    missing = F.col("_measured").isNull()
    fills = {name: F.lit(value) for name, value in FAILED.items() if name in results.columns}
    # No test has a time or statistics: an empty map of the type at hand.
    fills |= {name: F.create_map().cast(results.schema[name].dataType) for name in TEST_MAPS if name in results.columns}
    return completed.withColumns({name: F.when(missing, value).otherwise(F.col(name)) for name, value in fills.items()}).drop("_measured")


def adjust_runtime(results: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Add `adjusted_runtime`, infinite without code or under the accuracy threshold."""
    return results.withColumn("adjusted_runtime", adjusted_runtime("agg_runtime", "accuracy", "code", threshold))


def fastest_generated(results: DataFrame, row_id: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Per row (and `by`) the fastest adjusted runtime over its generations."""
    # What the row id determines is part of the key: a hash aggregate, where strings as values would be sorted.
    return results.groupBy(*by, row_id, "problem_id", "src_runtime", "tgt_runtime").agg(
        F.min(nan_to_null("adjusted_runtime")).alias("fastest_runtime")
    )


def problem_best(fastest: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach the problem's fastest generated runtime, whether it is solved, and the speedup it gives.

    A grouped minimum joined back, not a window: partial minima keep a hot problem from
    gathering its rows in one task, and adaptive execution picks the side to broadcast.
    """
    best = fastest.groupBy(*by, "problem_id").agg(F.min("fastest_runtime").alias("problem_runtime"))
    return (
        fastest.join(best, [*by, "problem_id"])
        .withColumn("problem_solved", F.col("problem_runtime") < INFINITY)
        .withColumn("problem_speedup", floored_speedup("src_runtime", "problem_runtime"))
    )


def best_at_k(results: DataFrame, threshold: float = 1.0, row_id: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Per row (and `by`) and k the best runtime and accuracy of the first k generations.

    Generations are scanned in blocks of a fixed width and blocks carry over, so no task has
    to hold a row's generations, however many there are.
    """
    if "carry_more" not in results.columns:
        results = with_blocks(results)
        results = results.join(block_carries(results, [*by, row_id], BLOCK, *_extremes()), [*by, row_id, BLOCK])
    best = running_extremes(results, [*by, row_id], "gen", BLOCK, *_extremes(), "is_last")
    return (
        best.withColumn("k", F.col("gen") + 1)
        .withColumn("is_correct", F.coalesce(F.col("best_accuracy") == threshold, F.lit(False)))
        .withColumn("speedup", floored_speedup("src_runtime", "best_runtime"))
    )


def report_at_k(best: DataFrame, thresholds: Sequence[float] = REPORT_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Per k (and `by`) the means over all rows; a row with fewer generations counts with its last best.

    Rows are not padded to the largest k: those that ended before k are a running sum over k, scanned in blocks. Nor is
    each threshold counted per row: rows are summed up by k and the band their speedup falls in, and the thresholds are
    read off that table. It is written once, a row per k, so the generations are read in one pass.
    """
    band = sum([(F.col("speedup") >= t).cast("int") for t in sorted(thresholds)], F.lit(0))
    cells = best.groupBy(*by, "k", "is_last", band.alias("band")).agg(
        F.count("*").alias("n"),
        F.count("best_accuracy").alias("acc_n"),
        F.sum("best_accuracy").alias("accuracy"),
        F.sum(F.col("is_correct").cast("int")).alias("correct"),
        F.sum("speedup").alias("speedup"),
    )
    measures = {name: F.col(name) for name in ("n", "acc_n", "accuracy", "correct", "speedup")}
    measures |= {
        f"ge_{threshold_name(t)}": F.when(F.col("band") > i, F.col("n")) for i, t in enumerate(sorted(thresholds))
    }
    per_k = cells.groupBy(*by, "k").agg(
        *[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in measures.items()],
        *[F.coalesce(F.sum(F.when(F.col("is_last"), value)), F.lit(0)).alias(f"{name}_last") for name, value in measures.items()],
    )
    ended = [f"{name}_last" for name in measures]
    scanned = running_sums(per_k, by, "k", ended)
    totals = scanned.select(*by, "k", *[(F.col(name) + F.col(f"before_{name}_last")).alias(name) for name in measures])
    return totals.select(
        *by,
        "k",
        F.col("n").alias("programs"),
        F.try_divide("accuracy", "acc_n").alias("mean_accuracy"),
        F.try_divide("correct", "n").alias("mean_correct"),
        F.try_divide("speedup", "n").alias("mean_speedup"),
        *[F.try_divide(f"ge_{threshold_name(t)}", "n").alias(f"share_ge_{threshold_name(t)}") for t in thresholds],
    )


def _shares(speedup: Column, thresholds: Sequence[float]) -> list[Column]:
    return [
        F.try_divide(F.count_if(speedup >= t), F.count("*")).alias(f"share_ge_{threshold_name(t)}") for t in thresholds
    ]


def report_reference(rows: DataFrame, thresholds: Sequence[float] = REPORT_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Mean speedup of the reference program and its threshold shares, not floored."""
    speedup = nan_to_null(ratio("src_runtime", "tgt_runtime"))
    return rows.groupBy(*by).agg(F.avg(speedup).alias("mean_speedup"), *_shares(speedup, thresholds))


def report_problem_best(rows: DataFrame, thresholds: Sequence[float] = REPORT_THRESHOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose problem is solved, mean speedup of the problem's best, threshold shares."""
    return rows.groupBy(*by).agg(
        F.avg(F.col("problem_solved").cast("int")).alias("mean_solved"),
        F.avg("problem_speedup").alias("mean_speedup"),
        *_shares(F.col("problem_speedup"), thresholds),
    )


def full_report(
    outputs: DataFrame, reference: DataFrame, measurements: DataFrame, thresholds: Sequence[float] = REPORT_THRESHOLDS
) -> DataFrame:
    """From model outputs to the report, per `model`: E1, E2 long, E6, E10, E9, E13 and E14 to E16.

    `outputs` (`model`, `seq`, `codes`) is what S7 reads, `reference` has a row per model and evaluated row with runtimes
    and programs, `measurements` (`model`, `seq`, `gen`) the results of all that was run. The result is E14 with
    `reference_speedup` (E15), `solved` and `problem_speedup` (E16) of the model. Programs leave before E6.
    """
    by, key = ["model"], ["model", "seq", "gen"]
    runtimes = ["model", "seq", "problem_id", "src_runtime", "tgt_runtime"]
    # Only what the reports read travels; two of them read the reference, two the running bests.
    wanted = without_programs(prepare_eval(reference).select(*runtimes, SLOW, REFERENCE))
    tried = explode_generations(outputs.select("model", "seq", "codes"), "codes")
    # Only whether there is a program counts from here on.
    tried = tried.withColumn("code", F.when(F.col("code").isNotNull(), F.lit("")))
    measured = adjust_runtime(join_measurements(tried, measurements, key)).select(*key, "accuracy", "adjusted_runtime")
    running = best_at_k(complete_missing(measured, wanted, by=by), by=by)
    running = materialized(running.select(*runtimes, "adjusted_runtime", "k", "is_last", "best_accuracy", "is_correct", "speedup"), "running-bests")
    at_k = report_at_k(running, thresholds, by)
    best = report_problem_best(problem_best(fastest_generated(running, by=by), by), thresholds, by)
    references = report_reference(wanted, thresholds, by)
    return at_k.join(references.select("model", F.col("mean_speedup").alias("reference_speedup")), "model").join(
        best.select("model", F.col("mean_solved").alias("solved"), F.col("mean_speedup").alias("problem_speedup")), "model"
    )
