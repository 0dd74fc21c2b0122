"""From raw pairs and submission metadata to submissions with users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from paceline.functions.text import as_column
from paceline.operators.ranking import dense_index


def stack_sides(pairs: DataFrame, **columns: str | Column | tuple[str | Column, str | Column]) -> DataFrame:
    """One row per side of a pair, with the named columns only: a (slow, fast) tuple, or one for both sides.

    `write_no` is unique and grows in the order of writing, the fast side after the slow one.
    """

    def side(which: int) -> Column:
        picked = {name: value[which] if isinstance(value, tuple) else value for name, value in columns.items()}
        fields = [as_column(value).alias(name) for name, value in picked.items()]
        return F.struct((F.col("seq") * 2 + which).alias("write_no"), *fields)

    return pairs.select(F.inline(F.array(side(0), side(1))))


def collect_unique_solutions(pairs: DataFrame) -> DataFrame:
    """One row per solution id over both sides of all pairs, the last write wins.

    Only (id, write number) is aggregated, with map-side maxima. The programs meet the
    winners on the unique write number, so an id in very many pairs makes no hot key.
    """
    written = stack_sides(pairs, solution_id=("src_id", "tgt_id"))
    winners = written.groupBy("solution_id").agg(F.max("write_no").alias("write_no"))
    sides = stack_sides(
        pairs,
        solution_id=("src_id", "tgt_id"),
        problem_id="problem_id",
        runtime=("src_agg_runtime", "tgt_agg_runtime"),
        code=("src_code", "tgt_code"),
    )
    return sides.join(winners.select("write_no"), "write_no", "left_semi")


def attach_users(solutions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add the user of each solution whose metadata names the same problem."""
    users = metadata.select(F.col("submission_id").alias("solution_id"), "problem_id", "user_id")
    return solutions.join(users, ["solution_id", "problem_id"])


def metadata_audit(solutions: DataFrame, metadata: DataFrame) -> DataFrame:
    """How many solutions have no metadata, metadata of another problem, or a match."""
    known = metadata.select(F.col("submission_id").alias("solution_id"), F.col("problem_id").alias("_meta_problem"))
    joined = solutions.select("solution_id", "problem_id").join(known, "solution_id", "left")
    return joined.agg(
        F.count_if(F.col("_meta_problem").isNull()).alias("not_found"),
        F.count_if(F.col("_meta_problem") != F.col("problem_id")).alias("problem_mismatch"),
        F.count_if(F.col("_meta_problem") == F.col("problem_id")).alias("matched"),
    )


def attach_users_audited(solutions: DataFrame, metadata: DataFrame) -> tuple[DataFrame, Observation]:
    """C2 with C3: the solutions with their user, and the audit's counts, which are there once the rows have been written.

    One left join does both: its rows are counted as they pass and those without a match go, so no second job runs. A
    solution has one row of metadata at most, as S3 reads it.
    """
    audit = Observation("metadata_audit")
    known = metadata.select(F.col("submission_id").alias("solution_id"), F.col("problem_id").alias("_meta_problem"), "user_id")
    same = F.col("_meta_problem") == F.col("problem_id")
    joined = solutions.join(known, "solution_id", "left").observe(
        audit,
        F.count_if(F.col("_meta_problem").isNull()).alias("not_found"),
        F.count_if(F.col("_meta_problem") != F.col("problem_id")).alias("problem_mismatch"),
        F.count_if(same).alias("matched"),
    )
    return joined.filter(same).drop("_meta_problem"), audit


def filter_active_users_audited(submissions: DataFrame, min_exclusive: int = 2) -> tuple[DataFrame, Observation]:
    """C6 with the counts of C7 that add up: solutions before and after, and the groups that stay.

    Group sizes meet the submissions once, and both sides are counted as they pass. How many distinct problems and users
    there are is no running sum: `activity_stats` says that.
    """
    activity = Observation("activity")
    groups = submissions.groupBy("problem_id", "user_id").agg(F.count("*").alias("n_solutions"), F.min("seq").alias("_first_seq"))
    kept = F.col("n_solutions") > min_exclusive
    first = F.col("seq") == F.col("_first_seq")
    counted = submissions.join(groups, ["problem_id", "user_id"]).observe(
        activity,
        F.count("*").alias("solutions_before"),
        F.count_if(kept).alias("solutions_after"),
        F.count_if(kept & first).alias("submission_sets"),
    )
    return counted.filter(kept).drop("n_solutions", "_first_seq"), activity


def build_problem_index(submissions: DataFrame, buckets: int = 16) -> DataFrame:
    """C4: problem → user → solution nesting: (problem_id, bucket, user_id) → `map<solution_id, struct>`.

    The bucket is a hash of the solution, so the key is the same at every size. A map holds about a `buckets`-th of the
    solutions of its user and problem: ask for more buckets where one user has very many.
    """
    record = F.struct("solution_id", "problem_id", "runtime", "code", "seq")
    return (
        submissions.withColumn("bucket", F.pmod(F.xxhash64("solution_id"), F.lit(buckets)))
        .groupBy("problem_id", "bucket", "user_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("solution_id", record))).alias("solutions"))
    )


def flatten_problem_index(index: DataFrame) -> DataFrame:
    """One row per solution again."""
    return (
        index.select("user_id", F.explode("solutions").alias("_id", "_record"))
        .select("user_id", "_record.*")
    )


def _group_sizes(submissions: DataFrame) -> DataFrame:
    return submissions.groupBy("problem_id", "user_id").agg(F.count("*").alias("n_solutions"))


def filter_active_users(submissions: DataFrame, min_exclusive: int = 2) -> DataFrame:
    """Submissions of (problem, user) groups with more than `min_exclusive` solutions."""
    active = _group_sizes(submissions).filter(F.col("n_solutions") > min_exclusive)
    return submissions.join(active.drop("n_solutions"), ["problem_id", "user_id"], "left_semi")


def activity_stats(submissions: DataFrame, min_exclusive: int = 1) -> DataFrame:
    """Sizes before and after C6, from the table of group sizes."""
    kept = F.col("n_solutions") > min_exclusive
    return _group_sizes(submissions).agg(
        F.countDistinct("problem_id").alias("problems_before"),
        F.countDistinct(F.when(kept, F.col("problem_id"))).alias("problems_after"),
        F.sum("n_solutions").alias("solutions_before"),
        F.coalesce(F.sum(F.when(kept, F.col("n_solutions"))), F.lit(0)).alias("solutions_after"),
        F.count_if(kept).alias("submission_sets"),
        F.countDistinct(F.when(kept, F.col("user_id"))).alias("unique_users"),
    )


def pair_id(*parts: str | Column) -> Column:
    return F.concat_ws("-", *parts)


def make_sft_pairs(pairs: DataFrame) -> DataFrame:
    """`pid-sid-tid`, both programs and their runtimes as an array."""
    return pairs.select(
        pair_id("problem_id", "src_id", "tgt_id").alias("id"),
        "seq",
        "src_code",
        "tgt_code",
        F.array("src_agg_runtime", "tgt_agg_runtime").alias("cpu_time"),
    )


def clean_test_set(pairs: DataFrame, max_tests: int = 20, prefix: str = "pie_test_") -> DataFrame:
    """Numbered test rows with the kept columns and the first `max_tests` tests of each."""
    return dense_index(pairs, "seq", "_index").select(
        F.concat(F.lit(prefix), F.col("_index").cast("string")).alias("id"),
        "problem_id",
        "src_id",
        "tgt_id",
        "src_code",
        "tgt_code",
        "fastest_code",
        F.slice("tests", 1, max_tests).alias("tests"),
    )
