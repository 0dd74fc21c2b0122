"""Raw measurement output to accuracies, runtimes and scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.functions.numbers import INFINITY, grade_lines, submission_score
from paceline.functions.text import lines, words

TIMING_MODES = ("gem5", "binary", "both")
_NUMBER = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def grade_outputs(actual: DataFrame, expected: DataFrame, key: Sequence[str]) -> DataFrame:
    """M1: score of each program output against the expected output of its test."""
    split = actual.join(expected, list(key)).withColumns({"_got": lines("actual"), "_wanted": lines("expected")})
    return split.withColumn("score", grade_lines("_got", "_wanted")).drop("_got", "_wanted")


def accuracy_by_submission(
    expected_tests: DataFrame, graded: DataFrame, compiled: DataFrame, sub: Sequence[str] = ("seq",)
) -> DataFrame:
    """M2: mean test accuracy; tests without a score (runtime errors) and all tests of an uncompiled program are 0."""
    sub = list(sub)
    scores = expected_tests.join(graded.select(*sub, "tc_no", "score"), [*sub, "tc_no"], "left")
    per_sub = scores.groupBy(*sub).agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("_accuracy"))
    compilation = F.coalesce("compilation", F.lit(False))
    return per_sub.join(compiled.select(*sub, "compilation"), sub, "left").select(
        *sub,
        compilation.alias("compilation"),
        F.when(compilation, F.col("_accuracy")).otherwise(F.lit(0.0)).alias("accuracy"),
    )


def gate_by_accuracy(
    timings: DataFrame, accuracies: DataFrame, threshold: float = 0.95, sub: Sequence[str] = ("seq",)
) -> DataFrame:
    """M3: timings of submissions whose accuracy reaches the threshold."""
    passed = accuracies.filter(F.col("accuracy") >= threshold)
    return timings.join(passed.select(*sub), list(sub), "left_semi")


def mask_after_failure(tests: DataFrame, sub: Sequence[str] = ("seq",), order: str = "tc_no") -> DataFrame:
    """M4: every test after a submission's first failed one is a failure without a time.

    The first failure is a partial minimum joined back, so no task has to hold a submission's tests in order.
    """
    failure = F.min(F.when(~F.col("success"), F.col(order))).alias("_first_failure")
    first = tests.groupBy(*sub).agg(failure).filter("_first_failure IS NOT NULL")
    skipped = F.coalesce(F.col(order) > F.col("_first_failure"), F.lit(False))
    return (
        tests.join(first, list(sub), "left")
        .withColumn("success", F.col("success") & ~skipped)
        .withColumn("time_s", F.when(F.col("success"), F.col("time_s")))
        .drop("_first_failure")
    )


def aggregate_runtime(
    tests: DataFrame, sub: Sequence[str] = ("seq",), submissions: DataFrame | None = None
) -> DataFrame:
    """M5: sum of test times, infinite if any test failed or has no time; submissions without tests too, where they are given."""
    timed = F.col("success") & F.col("time_s").isNotNull()
    per_sub = tests.groupBy(*sub).agg(
        F.sum(F.when(timed, F.col("time_s")).otherwise(F.lit(INFINITY))).alias("agg_runtime"),
        F.count_if("success").alias("passed_tests"),
        F.count("*").alias("tests"),
    )
    if submissions is None:
        return per_sub
    return (
        submissions.select(*sub)
        .join(per_sub, list(sub), "left")
        .select(
            *sub,
            F.coalesce("agg_runtime", F.lit(INFINITY)).alias("agg_runtime"),
            F.coalesce("passed_tests", F.lit(0)).alias("passed_tests"),
            F.coalesce("tests", F.lit(0)).alias("tests"),
        )
    )


def result_maps(tests: DataFrame, sub: Sequence[str] = ("seq",), chunk_tests: int = 1000) -> DataFrame:
    """`tc2time` and `tc2success` for sinks, a row per submission and `chunk_tests` test numbers."""
    entries = F.sort_array(F.collect_list(F.struct("tc_no", "time_s", "success")))
    time = F.when(F.col("success"), F.col("time_s")).otherwise(F.lit(INFINITY))
    return (
        tests.withColumn("time_s", time)
        .groupBy(*sub, F.floor(F.col("tc_no") / F.lit(chunk_tests)).alias("chunk"))
        .agg(entries.alias("_tests"))
        .select(
            *sub,
            "chunk",
            F.map_from_entries(F.transform("_tests", lambda t: F.struct(t["tc_no"], t["time_s"]))).alias("tc2time"),
            F.map_from_entries(F.transform("_tests", lambda t: F.struct(t["tc_no"], t["success"]))).alias("tc2success"),
        )
    )


def aggregate_native_timings(timings: DataFrame, sub: Sequence[str] = ("seq",)) -> DataFrame:
    """M6: mean and population deviation of the run totals, every test cut to the shortest number of runs.

    `timings` holds one array of run times per test; a null or empty one makes the submission infinite.
    """
    size = F.coalesce(F.size("times"), F.lit(0))
    shortest = timings.groupBy(*sub).agg(F.min(F.when(size < 0, F.lit(0)).otherwise(size)).alias("_shortest"))
    runs = (
        timings.join(shortest.filter("_shortest > 0"), list(sub))
        .select(*sub, F.posexplode(F.slice("times", F.lit(1), F.col("_shortest"))).alias("run_no", "time_s"))
        .groupBy(*sub, "run_no")
        .agg(F.sum("time_s").alias("_total"))
        .groupBy(*sub)
        .agg(F.avg("_total").alias("agg_runtime"), F.stddev_pop("_total").alias("agg_stdev"))
    )
    return (
        shortest.join(runs, list(sub), "left")
        .select(
            *sub,
            F.col("_shortest").alias("runs"),
            F.coalesce("agg_runtime", F.lit(INFINITY)).alias("agg_runtime"),
            F.coalesce("agg_stdev", F.lit(INFINITY)).alias("agg_stdev"),
        )
    )


def with_native(per_version: DataFrame, native: DataFrame, key: Sequence[str] = ("seq",)) -> DataFrame:
    """M7: native timings beside simulator results, as `<value>_binary`; null where a version was not timed."""
    timed = native.select(*key, *[F.col(name).alias(f"{name}_binary") for name in ("agg_runtime", "agg_stdev")])
    return per_version.join(timed, list(key), "left")


def pair_results(per_version: DataFrame, values: Sequence[str], pair: Sequence[str] = ("pair_id",)) -> DataFrame:
    """M7: results of both versions of a pair side by side as `<value>_v0`, `<value>_v1`."""
    wide = per_version.groupBy(*pair).pivot("version", ["v0", "v1"]).agg(*[F.first(v).alias(v) for v in values])
    renamed = [F.col(f"{version}_{v}").alias(f"{v}_{version}") for v in values for version in ("v0", "v1")]
    if len(values) == 1:
        renamed = [F.col(version).alias(f"{values[0]}_{version}") for version in ("v0", "v1")]
    return wide.select(*pair, *renamed)


def complete_test_matrix(results: DataFrame, expected_tests: DataFrame, key: Sequence[str] = ("seq", "tc_no")) -> DataFrame:
    """M8: a row for every expected test, null where there is no result."""
    return expected_tests.select(*key).join(results, list(key), "left")


def parse_stats_lines(stats: DataFrame) -> DataFrame:
    """M9: `key value… # comment` lines (file, line_no, line) to one row per value.

    A repeated key counts with its last line. `value` is null for nan, infinity and text that is no number;
    `pos` counts the values of a key from 0.
    """
    kept = stats.filter(~F.contains("line", F.lit("Begin")) & ~F.contains("line", F.lit("End")))
    parsed = kept.withColumn("_parts", words(F.substring_index("line", "#", 1))).filter(F.size("_parts") > 1)
    last = (
        parsed.groupBy("file", F.col("_parts")[0].alias("key"))
        .agg(F.max(F.struct("line_no", "_parts")).alias("_last"))
    )
    values = last.select("file", "key", F.posexplode(F.slice("_last._parts", 2, 1 << 30)).alias("pos", "raw"))
    cleaned = F.replace(F.col("raw"), F.lit("%"), F.lit(""))
    return values.withColumn("value", F.when(cleaned.rlike(_NUMBER), cleaned.try_cast("double")))


def simulated_seconds(values: DataFrame) -> DataFrame:
    """M9: `sim_ticks / sim_freq` of each stats file."""

    def scalar(key: str) -> Column:
        return F.max(F.when((F.col("key") == key) & (F.col("pos") == 0), F.col("value")))

    return values.groupBy("file").agg(F.try_divide(scalar("sim_ticks"), scalar("sim_freq")).alias("sim_seconds_precise"))


def score_submissions(measurements: DataFrame) -> DataFrame:
    """Add `score`."""
    return measurements.withColumn("score", submission_score("compilation", "accuracy", "agg_runtime"))


def default_failed_results(submissions: DataFrame, measurements: DataFrame, sub: Sequence[str] = ("seq",)) -> DataFrame:
    """A submission whose evaluation was lost is not compiled, with accuracy and runtime 0."""
    return (
        submissions.select(*sub)
        .join(measurements, list(sub), "left")
        .withColumn("compilation", F.coalesce("compilation", F.lit(False)))
        .withColumn("accuracy", F.coalesce("accuracy", F.lit(0.0)))
        .withColumn("agg_runtime", F.coalesce("agg_runtime", F.lit(0.0)))
    )


def violations(code: str | Column = "code", tests: str | Column = "n_tests", mode: str | Column = "timing_mode") -> Column:
    """The reasons a submission is refused, empty for a good one."""
    code, tests, mode = (F.col(c) if isinstance(c, str) else c for c in (code, tests, mode))
    return F.array_compact(
        F.array(
            F.when(code.isNull() | (code == ""), F.lit("empty code")),
            F.when(tests.isNull() | (tests <= 0), F.lit("no tests")),
            F.when(mode.isNull() | ~mode.isin(*TIMING_MODES), F.lit("unknown timing mode")),
        )
    )


def validate_submissions(submissions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their `violations`)."""
    checked = submissions.withColumn("violations", violations())
    good = F.size("violations") == 0
    return checked.filter(good).drop("violations"), checked.filter(~good)
