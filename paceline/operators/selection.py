"""Scoring, sampling and distributions of pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paceline.functions.numbers import SPEEDUP_BANDS
from paceline.functions.text import SCORED_CATEGORIES, bind
from paceline.operators.collect import stack_sides
from paceline.operators.ranking import first_rows, top_k_per_group

UNSCORED = -100.0


def random_order(id_col: str, seed: int) -> list[Column]:
    """A repeatable shuffle key: equal on every run and for any partitioning."""
    return [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)]


def add_speedup(df: DataFrame) -> DataFrame:
    """H1: slow over fast runtime."""
    return df.withColumn("speedup", F.try_divide(F.col("cpu_time")[0], F.col("cpu_time")[1]))


def submission_runtimes(pairs: DataFrame) -> DataFrame:
    """H2: runtime of each submission on either side of a pair, the last write wins."""
    runtimes = (F.col("cpu_time")[0], F.col("cpu_time")[1])
    return (
        stack_sides(pairs, solution_id=("src_id", "tgt_id"), runtime=runtimes)
        .groupBy("solution_id")
        .agg(F.max(F.struct("write_no", "runtime")).alias("_last"))
        .select("solution_id", "_last.runtime")
    )


def best_only(df: DataFrame) -> DataFrame:
    """H3: pairs whose fast side is the group's fastest."""
    return df.filter("is_best")


def random_sample_n(df: DataFrame, n: int, id_col: str, seed: int = 0, order: Sequence[Column] | None = None) -> DataFrame:
    """H4: exactly n rows (or all) without replacement, in no order; rows are told apart by `order`, whose default ends in the id."""
    return first_rows(df, n, order or random_order(id_col, seed))


def top_speedup_capped(df: DataFrame, n: int, cap: int = 4, id_col: str = "id", speedup: str = "speedup") -> DataFrame:
    """H5: the n best own pairs by speedup, at most `cap` per problem."""
    order = [F.desc(speedup), F.col(id_col)]
    capped = top_k_per_group(df.filter(~F.col("cross_user")), ["problem_id"], order, cap, "problem_rank", id_col)
    return capped.orderBy(*order).limit(n)


def category_frequency(df: DataFrame, categories: Sequence[str] = SCORED_CATEGORIES, col: str = "category") -> DataFrame:
    """H6: samples per category, zeros included, and their percentage.

    The category list is fixed and short, so each category is one conditional count: a single
    aggregation pass with one partial row per task, no explode and no join.
    """
    counts = df.agg(
        F.count("*").alias("_total"),
        *[F.count_if(F.array_contains(col, name)).alias(f"_{i}") for i, name in enumerate(categories)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("category"), F.col(f"_{i}").alias("frequency"))
            for i, name in enumerate(categories)
        ]
    )
    return counts.select("_total", F.inline(rows)).select(
        "ord",
        "category",
        "frequency",
        F.round(F.try_divide(F.col("frequency") * 100.0, F.col("_total")), 2).alias("pct"),
    )


def rarity_score(df: DataFrame, categories: Sequence[str] = SCORED_CATEGORIES, col: str = "category") -> DataFrame:
    """H7: mean over a sample's categories of samples / category frequency; -100 without any.

    The weights reach the rows as one scalar map of the fixed categories.
    """
    counts = [F.count_if(F.array_contains(col, name)) for name in categories]
    entries = [x for name, count in zip(categories, counts) for x in (F.lit(name), F.try_divide(F.count("*"), count))]
    weights = df.agg(F.create_map(*entries).alias("_weights")).scalar()

    def score(names: Column) -> Column:
        total = F.aggregate(names, F.lit(0.0), lambda acc, name: acc + F.col("_weights")[name])
        return F.coalesce(F.try_divide(total, F.size(names)), F.lit(UNSCORED))

    return df.withColumn("_weights", weights).withColumn("score", bind(F.array_distinct(col), score)).drop("_weights")


def unscored_count(scored: DataFrame) -> DataFrame:
    """H7: how many samples have no category."""
    return scored.agg(F.count("*").alias("samples"), F.count_if(F.col("score") == UNSCORED).alias("unscored"))


def rarity_score_audited(df: DataFrame, categories: Sequence[str] = SCORED_CATEGORIES, col: str = "category") -> tuple[DataFrame, Observation]:
    """H7 with its count: the scored rows, and how many there are and have no category, known once the rows have been written."""
    audit = Observation("unscored")
    scored = rarity_score(df, categories, col)
    return scored.observe(audit, F.count("*").alias("samples"), F.count_if(F.col("score") == UNSCORED).alias("unscored")), audit


def top_by_score(df: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """H8: the rows of the n best scores, ties by id, in no order; without a score comes last, NaN first."""
    score = F.col("score").cast("double")
    return first_rows(df, n, [score.isNull(), ~F.isnan(score), -score, F.col(id_col)])


def balanced_round_robin(
    df: DataFrame,
    n: int,
    id_col: str = "id",
    seed: int = 0,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """H9: n rows spread over problems: each problem's best row, then each second best, and so on.

    The round that no longer fits whole is filled at random. How deep the rounds go follows from the problems' sizes, so
    each problem is ranked to that depth only, on its ids and scores; the winners' other columns join at the end. Ids
    are unique.
    """
    rounds = _rounds(df, n)
    depth = rounds.agg(F.coalesce(F.max("round"), F.lit(0))).scalar()
    narrow = df.select("problem_id", "score", id_col)
    ranked = top_k_per_group(narrow, ["problem_id"], [F.desc("score"), F.col(id_col)], depth, "round", id_col)
    shuffle = order or random_order(id_col, seed)
    return df.join(ranked.select(id_col, "round"), id_col).orderBy("round", *shuffle).limit(n)


def _rounds(df: DataFrame, n: int) -> DataFrame:
    """The rounds that n rows need: `round` and the rows of the rounds before it, from a table of at most n sizes."""
    sizes = df.groupBy("problem_id").agg(F.least(F.count("*"), F.lit(n)).alias("round"))
    counts = sizes.groupBy("round").agg(F.count("*").alias("_problems"))
    every = df.sparkSession.range(1, n + 1).select(F.col("id").alias("round"))
    # A problem takes part in all rounds up to its size.
    taking = every.join(counts, "round", "left").withColumn("_rows", F.sum("_problems").over(W.orderBy(F.desc("round"))))
    before = F.sum("_rows").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, -1))
    return taking.filter("_rows > 0").withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < n).select("round", "_before")


def speedup_bands(df: DataFrame, speedup: str = "speedup", bands: Sequence[float] = SPEEDUP_BANDS) -> DataFrame:
    """Rows per speedup band, each from its margin up to the next, and a last band below all."""
    bounds = list(zip([*bands, None], [None, *bands]))

    def inside(low: float | None, high: float | None) -> Column:
        condition = F.lit(True) if low is None else F.col(speedup) >= low
        return condition if high is None else condition & (F.col(speedup) < high)

    names = [f"<{high:g}" if low is None else f">={low:g}" for low, high in bounds]
    counts = df.agg(
        F.count(speedup).alias("_total"),
        *[F.count_if(inside(low, high)).alias(f"_{i}") for i, (low, high) in enumerate(bounds)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(name).alias("band"), F.col(f"_{i}").alias("rows"))
            for i, name in enumerate(names)
        ]
    )
    return counts.select("_total", F.inline(rows)).select(
        "ord", "band", "rows", F.round(F.try_divide(F.col("rows") * 100.0, F.col("_total")), 2).alias("pct")
    )


def average_speedup(df: DataFrame, speedup: str = "speedup") -> DataFrame:
    """Mean speedup."""
    return df.agg(F.round(F.avg(speedup), 2).alias("avg_speedup"))


def select_training_rows(df: DataFrame, n: int, id_col: str = "id", seed: int = 0) -> DataFrame:
    """Best pairs, scored by rarity and balanced over problems: the steps of a selection run in one plan."""
    return balanced_round_robin(rarity_score(best_only(df)), n, id_col, seed)
