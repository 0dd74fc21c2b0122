"""Hard-negative mining: for each anchor and positive the best rows of other labels whose score lies in the positive's window.

Windows of one anchor overlap, so they are not searched one by one. The upper limits of an anchor's positives split its
scores into disjoint slots. A task that meets a part of the rows keeps the best k of each slot of its anchors, which a
second ranking puts together. A positive's answer is the first k of its own slot and all lower ones, taken in descending
order, as far as they reach its lower limit: the slots are held in that order, so each positive reads a suffix.

Scores are products of a slice of anchors with rows that pass by in ascending id: a later row of equal score never
comes first, and what a task holds is bounded by its slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table

# Anchors of one slice (a task holds them), rows of one part (they stream past a slice), and the sizes of one product.
SLICE_ANCHORS, PART_ROWS = 1 << 15, 1 << 18
STEP_ROWS, STEP_ANCHORS = 1 << 10, 1 << 12
# Whole numbers up to here are exact in double precision.
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


def usable(vectors: DataFrame, id_column: str, vector: str, label: str, scale: float) -> DataFrame:
    """(row, vec_id, label, vec): rows that take part, vectors scaled and rounded down, `row` a number of their own."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite
    whole = F.transform("vec", lambda x: F.floor(F.lit(float(scale)) * x))
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", whole.alias("vec"))


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products: doubles where these are exact, else whole numbers, cut at the ends of 64 bits."""
    if not rows.size or not anchors.size:
        return np.zeros((len(rows), len(anchors)))
    if np.abs(rows.astype(float)).max() * np.abs(anchors.astype(float)).max() * rows.shape[1] < EXACT:
        return rows.astype(float) @ anchors.astype(float).T
    return np.clip(rows.astype(object) @ anchors.astype(object).T, -LARGEST, LARGEST).astype(np.int64)


class Held:
    """The best `k` (score, id) of each of `groups` groups; offers come in ascending id."""

    def __init__(self, groups: int, k: int):
        self.k, self.groups = k, groups
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        # The score that a further offer must exceed.
        self.floor = np.full(groups, -LARGEST - 1, np.int64)

    def offer(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        better = score > self.floor[group]
        if not better.any():
            return
        group, score, ids = (np.concatenate((old, new[better])) for old, new in ((self.group, group), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        keep = rank < self.k
        self.group, self.score, self.id = group[keep], score[keep], ids[keep]
        full = rank[keep] == self.k - 1
        self.floor[self.group[full]] = self.score[full]


class Slice:
    """The anchors of one task, and what they hold of the rows that have passed."""

    def __init__(self, anchors: pa.Table, k: int):
        self.row, self.vec = anchors.column("row").to_numpy(), matrix(anchors.column("vec"))
        self.codes: dict[str, int] = {}
        self.label = self.coded(anchors.column("label").to_pylist())
        self.windows = "uppers" in anchors.column_names and anchors.column("uppers").null_count == 0
        self.slots = 1
        if self.windows:
            uppers = anchors.column("uppers").to_pylist()
            self.slots = max(map(len, uppers))
            self.upper = np.array([u + [-LARGEST - 1] * (self.slots - len(u)) for u in uppers])
            self.lower = anchors.column("lower").to_numpy()
        self.held = Held(len(self.row) * self.slots, k)

    def coded(self, labels: list[str]) -> np.ndarray:
        return np.array([self.codes.setdefault(label, len(self.codes)) for label in labels], np.int64)

    def meet(self, rows: pa.Table) -> None:
        row, ids, vec, label = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), matrix(rows.column("vec")), self.coded(rows.column("label").to_pylist())
        for lo in range(0, len(self.row), STEP_ANCHORS):
            (self.negatives if self.windows else self.positives)(lo, min(lo + STEP_ANCHORS, len(self.row)), row, ids, vec, label)

    def positives(self, lo: int, hi: int, row: np.ndarray, ids: np.ndarray, vec: np.ndarray, label: np.ndarray) -> None:
        """Other rows of the anchor's label."""
        own = self.label[lo:hi]
        for code in np.intersect1d(own, label):
            r, a = np.flatnonzero(label == code), np.flatnonzero(own == code) + lo
            score = products(vec[r], self.vec[a])
            at, to = np.nonzero((score > self.held.floor[a]) & (row[r][:, None] != self.row[a]))
            self.held.offer(a[to], score[at, to].astype(np.int64), ids[r[at]])

    def negatives(self, lo: int, hi: int, row: np.ndarray, ids: np.ndarray, vec: np.ndarray, label: np.ndarray) -> None:
        """Rows of other labels between the anchor's lowest and highest limit, by slot."""
        score = products(vec, self.vec[lo:hi])
        at, to = np.nonzero((score >= self.lower[lo:hi]) & (score <= self.upper[lo:hi, 0]) & (label[:, None] != self.label[lo:hi]))
        found, a = score[at, to].astype(np.int64), to + lo
        slot = (self.upper[a] >= found[:, None]).sum(1) - 1
        self.held.offer(a * self.slots + slot, found, ids[at])

    def result(self) -> pa.RecordBatch:
        held = self.held
        columns = [self.row[held.group // self.slots], held.group % self.slots, held.score, held.id]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "slot", "score", "vec_id"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def swept(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, k: int) -> DataFrame:
    """(anchor, slot, score, vec_id): the best k rows of each anchor and slot, from every part of the rows.

    Every slice of anchors meets every part of the rows once. Both are dealt by hash of the row number, so neither labels
    nor equal vectors make a task larger. A task gets the anchors first, then rows in ascending id.
    """
    spark = rows.sparkSession
    slices = -(-n_anchors // SLICE_ANCHORS)
    # Small tables get as many parts as there are cores: this places work and changes no result.
    parts = max(-(-n_rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, -(-n_rows // STEP_ROWS)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    carried = ["row", "vec_id", "label", "vec", "uppers", "lower"]
    asked = anchors.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices))).select("slice", every(parts).alias("part"), F.lit(0).alias("kind"), *carried)
    passing = rows.withColumns({"uppers": F.lit(None).cast("array<bigint>"), "lower": F.lit(None).cast("bigint")})
    passing = passing.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts))).select(every(slices).alias("slice"), "part", F.lit(1).alias("kind"), *carried)
    dealt = asked.union(passing).repartition(slices * parts, "slice", "part").sortWithinPartitions("slice", "part", "kind", "vec_id", "row")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, held, first = None, [], 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if first is not None:
                if waiting:
                    first.meet(pa.Table.from_batches(waiting))
                yield first.result()

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                for at in range(lo, hi, STEP_ROWS):
                    portion, (a, b, kind) = batch.slice(at, min(STEP_ROWS, hi - at)), keys[at].tolist()
                    if (a, b) != place:
                        yield from done()
                        place, waiting, held, first = (a, b), [], 0, None
                    if kind == 1 and first is None and waiting and waiting[0].column("kind")[0].as_py() == 0:
                        first, waiting, held = Slice(pa.Table.from_batches(waiting), k), [], 0
                    if kind == 1 and first is None:
                        continue  # a slice without anchors
                    waiting.append(portion)
                    held += len(portion)
                    if kind == 1 and held >= STEP_ROWS:
                        first.meet(pa.Table.from_batches(waiting))
                        waiting, held = [], 0
        yield from done()

    return dealt.mapInArrow(sweep, "anchor bigint, slot bigint, score bigint, vec_id bigint")


def percent(share: int, score: Column, up: bool = False) -> Column:
    """share / 100 of a score that is not negative, rounded down or up, without leaving 64 bits."""
    rest = F.lit(share) * (score % 100) + (99 if up else 0)
    return F.lit(share) * F.call_function("div", score, F.lit(100)) + F.call_function("div", rest, F.lit(100))


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", is_anchor: Column | None = None,
    positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """For each anchor and positive the first `k` rows of other labels between `low` and `high` percent of the positive's score.

    Columns: `anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`. A score is the inner
    product of vectors whose components are multiplied by `scale` and rounded down; higher ones come first, ties by
    smaller id. Positives are the first `positives` other rows of the anchor's label, or all. `is_anchor` is a condition on
    `vec_id`, by default divisible by 50.

    Rows with a null id, a null label, a null or empty vector, or a component that is null or not finite take no part, nor
    do vectors whose length is not the most common one (ties: the smallest). Each row counts, also where rows share an id
    or a vector: an anchor's copy is another row. A positive whose score is negative has an empty window. Scores beyond 64
    bits count as the largest of these. Without anchors or rows there are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, id_column, vector, label, scale), "negatives-rows")
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    condition = F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.filter(F.size("vec") == lengths["n"])
    asked = rows.filter(condition)
    n_rows, n_anchors = lengths["count"], asked.count()
    if not n_anchors:
        return spark.createDataFrame([], RESULT)
    near = swept(asked.withColumns({"uppers": F.lit(None).cast("array<bigint>"), "lower": F.lit(None).cast("bigint")}), rows, n_anchors, n_rows, positives)
    by_score = [F.desc("score"), F.col("vec_id")]
    # At most `positives` rows of each anchor and part reach the window, and Spark's group limit cuts them before.
    near = near.withColumn("place", F.row_number().over(W.partitionBy("anchor").orderBy(*by_score))).filter(F.col("place") <= positives)
    score = F.col("positive_score")
    windows = near.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = windows.filter(score >= 0).withColumns({"lower": percent(low, score, up=True), "upper": percent(high, score)})
    windows = checkpointed(windows.filter("lower <= upper"), "negatives-windows")
    limits = windows.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), False).alias("uppers"), F.min("lower").alias("lower"))
    limited = asked.join(limits.withColumnRenamed("anchor", "row"), "row")
    found = swept(limited, rows, n_anchors, n_rows, k)
    found = found.withColumn("place", F.row_number().over(W.partitionBy("anchor", "slot").orderBy(*by_score))).filter(F.col("place") <= k)
    # At most k rows for each of an anchor's slots, in descending order over all slots.
    held = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", (-F.col("score")).alias("below"), "vec_id"))).alias("held"))
    own = F.array_position("uppers", F.col("upper")) - 1
    suffix = F.slice(F.filter("held", lambda h: h["slot"] >= F.col("own")), 1, k)
    answered = windows.join(limits.drop("lower"), "anchor").join(held, "anchor").withColumn("own", own)
    inside = F.filter(suffix, lambda h: -h["below"] >= F.col("lower"))
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    listed = answered.join(names, "anchor").select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "negative"))
    return listed.select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("negative.vec_id").alias("negative_id"),
        "positive_score", (-F.col("negative.below")).alias("negative_score"),
    )


SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
    FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), n AS (
    SELECT p.*, s.id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS place
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""


@query("op11_hard_negatives", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))
