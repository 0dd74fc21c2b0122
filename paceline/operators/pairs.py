"""slow→fast pairs inside one user's submissions and across users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paceline.functions.text import strip_cpp_comments
from paceline.operators.collect import pair_id
from paceline.session import materialized

GROUP = ["problem_id", "user_id"]
PARTS = ("problem_id", "src_id", "tgt_id")


def group_fastest(submissions: DataFrame) -> DataFrame:
    """Size, first-seen order and fastest submission (first on ties) of each (problem, user) group."""
    return submissions.groupBy(*GROUP).agg(
        F.count("*").alias("n_solutions"),
        F.min("seq").alias("user_first_seq"),
        F.min(F.struct("runtime", "seq")).alias("fastest"),
    )


def restrict_to_known_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs whose id is in the known set."""
    return pairs.join(known.select("id"), "id", "left_semi")


def _known_parts(known: DataFrame) -> DataFrame:
    """Problem and both solutions of known pairs; they are read off `id` only where they are no columns of their own."""
    if set(PARTS) <= set(known.columns):
        return known.select(*PARTS)
    parts = F.split("id", "-")
    unclear = F.raise_error(F.concat(F.lit("no problem and two solutions in the id "), F.col("id"))).cast("array<string>")
    parts = F.when(F.size(parts) == 3, parts).otherwise(unclear)
    return known.select(*[parts[i].alias(name) for i, name in enumerate(PARTS)])


def speed_ordered_pairs(submissions: DataFrame, known: DataFrame, min_speedup: float = 1.1) -> DataFrame:
    """P1 with P2: one user's slow→fast pairs of a known id set with a speedup of at least `min_speedup`.

    Every result row must be in the known set, so the work starts there: each known id is
    looked up on its slow and its fast side. That costs what the known set holds, where
    pairing a group with itself would cost the square of a group. `is_best` marks a fast side
    that is its group's fastest. `known` has problem_id, src_id and tgt_id, or `id` alone; such an id is
    an error unless it splits into these three.
    """
    wanted = _known_parts(known).distinct().withColumn("id", pair_id(*PARTS))
    slow = submissions.select(
        "problem_id",
        "user_id",
        F.col("solution_id").alias("src_id"),
        F.col("seq").alias("src_seq"),
        F.col("runtime").alias("src_runtime"),
    )
    fast = submissions.select(
        "problem_id",
        "user_id",
        F.col("solution_id").alias("tgt_id"),
        F.col("seq").alias("tgt_seq"),
        F.col("runtime").alias("tgt_runtime"),
    )
    best = group_fastest(submissions).select(*GROUP, F.col("fastest.seq").alias("_best_seq"))
    speed_up = F.try_divide("src_runtime", "tgt_runtime")
    ordered = F.struct("tgt_runtime", "tgt_seq") < F.struct("src_runtime", "src_seq")
    return (
        wanted.join(slow, ["problem_id", "src_id"])
        .join(fast, ["problem_id", "user_id", "tgt_id"])
        .withColumn("speed_up", speed_up)
        .filter(ordered & (F.col("speed_up") >= min_speedup))
        .join(best, GROUP)
        .withColumn("is_best", F.col("tgt_seq") == F.col("_best_seq"))
        .withColumn("cross_user", F.lit(False))
        .drop("_best_seq")
    )


def _largest_target(runtime: Column, min_speedup: float) -> Column:
    """The largest target runtime whose speedup, as floating division gives it, is `min_speedup` or more.

    Division falls as the target grows, so the targets up to this one are all that reach the speedup. It lies within a few
    places of the quotient: steps of half a place meet every number there.
    """
    near = runtime / F.lit(min_speedup)
    steps = [near + near * F.lit(k * 2.0**-53) for k in range(-6, 7)]
    return F.greatest(*[F.when(runtime / step >= min_speedup, step) for step in steps])


def pair_totals(submissions: DataFrame, min_speedup: float = 1.1, ranges: int = 256) -> DataFrame:
    """P1/P8 without a known set: `pairs` and `best_pairs` of each problem with a speedup of at least `min_speedup`, above 1.

    No pair is made. Submissions are folded to distinct runtimes of a (problem, user) group first; a source counts the
    targets up to the largest that reaches the speedup, which is a running count along sorted runtimes. Runtimes are cut
    at quantiles of all: a task scans the runtimes of one group in one range, and the few ranges of a group are put
    together, so a group with very many submissions is spread over `ranges` tasks. Submissions without a finite runtime
    above zero are in no pair.
    """
    timed = submissions.select(*GROUP, F.col("runtime").cast("double").alias("runtime")).filter((F.col("runtime") > 0) & (F.col("runtime") < float("inf")))
    fastest = timed.groupBy(*GROUP).agg(F.min("runtime").alias("fastest"))
    best = timed.join(fastest, GROUP).filter(F.col("runtime") / F.col("fastest") >= min_speedup).groupBy("problem_id").agg(F.count("*").alias("best_pairs"))
    both = F.array(
        F.struct(F.col("runtime").alias("at"), F.lit(1).alias("target"), F.lit(0).alias("source")),
        F.struct(_largest_target(F.col("runtime"), min_speedup).alias("at"), F.lit(0).alias("target"), F.lit(1).alias("source")),
    )
    folded = timed.select(*GROUP, F.inline(both)).groupBy(*GROUP, "at").agg(F.sum("target").alias("targets"), F.sum("source").alias("sources"))
    folded = materialized(folded, "runtimes")
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(folded.agg(F.percentile_approx("at", shares, 10 * ranges)).first()[0] or ())) if shares else []
    place = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("at"))) if cuts else F.lit(0)
    ranged = folded.withColumn("range", place)
    # A target counts for the sources at its own runtime too.
    upto = W.partitionBy(*GROUP, "range").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = ranged.withColumn("upto", F.sum("targets").over(upto)).groupBy(*GROUP, "range").agg(
        F.sum(F.col("sources") * F.col("upto")).alias("pairs"), F.sum("sources").alias("sources"), F.sum("targets").alias("targets")
    )
    earlier = W.partitionBy(*GROUP).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = F.col("pairs") + F.col("sources") * F.coalesce(F.sum("targets").over(earlier), F.lit(0))
    counted = inside.withColumn("pairs", whole).groupBy("problem_id").agg(F.sum("pairs").alias("pairs"))
    return counted.join(best, "problem_id", "left").select("problem_id", "pairs", F.coalesce("best_pairs", F.lit(0)).alias("best_pairs"))


def best_solution_per_problem(submissions: DataFrame) -> DataFrame:
    """The fastest submission of each problem over all users.

    A user's slowest submission is no candidate, so a user with a single one has none; with
    more, the candidate is the user's fastest. Ties go to the user seen first.
    """
    candidates = group_fastest(submissions).filter(F.col("n_solutions") > 1)
    best = candidates.groupBy("problem_id").agg(
        F.min(
            F.struct(
                F.col("fastest.runtime").alias("runtime"),
                "user_first_seq",
                F.col("fastest.seq").alias("seq"),
                "user_id",
            )
        ).alias("_best")
    )
    winners = best.select(
        "problem_id",
        F.col("_best.seq").alias("best_seq"),
        F.col("_best.user_id").alias("best_user"),
        F.col("_best.runtime").alias("best_runtime"),
    )
    names = submissions.select(F.col("seq").alias("best_seq"), F.col("solution_id").alias("best_id"))
    return winners.join(names, "best_seq")


def cross_user_pairs(own_pairs: DataFrame, best: DataFrame, max_gap: float = 2.0) -> DataFrame:
    """The slow side of each best pair, paired with the problem's best where that is not far ahead."""
    return (
        own_pairs.filter("is_best")
        .join(best, "problem_id")
        .filter(F.try_divide("tgt_runtime", "best_runtime") < max_gap)
        .select(
            pair_id("problem_id", "src_id", "best_id").alias("id"),
            "problem_id",
            F.concat_ws("|", "user_id", "best_user").alias("user_id"),
            "src_id",
            F.col("best_id").alias("tgt_id"),
            "src_seq",
            F.col("best_seq").alias("tgt_seq"),
            "src_runtime",
            F.col("best_runtime").alias("tgt_runtime"),
            F.try_divide("src_runtime", "best_runtime").alias("speed_up"),
            F.lit(True).alias("is_best"),
            F.lit(True).alias("cross_user"),
        )
    )


def full_pairs(submissions: DataFrame, known: DataFrame, min_speedup: float = 1.1, max_gap: float = 2.0) -> DataFrame:
    """Own pairs and cross-user pairs, without the programs; see `attach_codes`."""
    own = speed_ordered_pairs(submissions, known, min_speedup)
    return own.unionByName(cross_user_pairs(own, best_solution_per_problem(submissions), max_gap))


def attach_codes(pairs: DataFrame, submissions: DataFrame, clean: bool = True) -> DataFrame:
    """Add both programs, comments removed, once the pairs are settled.

    Programs are cleaned before they are joined, so each is cleaned once and not once per pair.
    """
    code = strip_cpp_comments("code") if clean else F.col("code")
    programs = submissions.select("seq", code.alias("code"))
    slow = programs.select(F.col("seq").alias("src_seq"), F.col("code").alias("src_code"))
    fast = programs.select(F.col("seq").alias("tgt_seq"), F.col("code").alias("tgt_code"))
    return (
        pairs.join(slow, "src_seq")
        .join(fast, "tgt_seq")
        .withColumn("cpu_time", F.array("src_runtime", "tgt_runtime"))
    )


def fastest_target_pairs(submissions: DataFrame) -> DataFrame:
    """P5: every submission of a group paired with the group's fastest; the last one on ties."""
    targets = (
        submissions.groupBy(*GROUP)
        .agg(F.max(F.struct((-F.col("runtime")).alias("_key"), "seq", "solution_id")).alias("_target"))
        .select(
            *GROUP,
            F.col("_target.seq").alias("tgt_seq"),
            F.col("_target.solution_id").alias("tgt_id"),
            (-F.col("_target._key")).alias("tgt_runtime"),
        )
    )
    slow = submissions.select(
        *GROUP,
        F.col("seq").alias("src_seq"),
        F.col("solution_id").alias("src_id"),
        F.col("runtime").alias("src_runtime"),
    )
    return (
        slow.join(targets, GROUP)
        .filter(F.col("src_id") != F.col("tgt_id"))
        .withColumn("id", pair_id("problem_id", "user_id", "src_id", "tgt_id"))
    )


def drop_identical_pairs(pairs: DataFrame, slow: str = "src_code", reference: str = "tgt_code") -> DataFrame:
    """Drop rows whose slow program is the reference program; a row that lacks one of them stays."""
    return pairs.filter(~F.col(slow).eqNullSafe(F.col(reference)))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """All pairs, best pairs, cross-user pairs."""
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if("is_best").alias("best_pairs"),
        F.count_if("cross_user").alias("cross_user_pairs"),
    )
