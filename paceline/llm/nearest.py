"""Approximate nearest neighbours: inverted lists whose members are scanned a block of dimensions at a time.

Vectors are turned by one random rotation, so that every block of columns is a fair sample of a distance. Inside a probed
list partial distances grow block by block, and a candidate is abandoned once a hypothesis test says that its whole
distance exceeds a bound of the query's k-th best. What is left is measured on the original vectors in double precision.

There are as many lists as the square root of the rows, up to a limit, and as many are probed as a recall measured on the
sample asks for. A row lies in one list and is shuffled once. A list, in parts of bounded size if it is hot, stays in its
task while the queries that probe it stream past.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table

K = 10
# Documented bounds of the index: lists, and rows of the sample on which lists and probes are fitted.
MOST_LISTS, LIST_SAMPLE, LEAST_SAMPLE = 4096, 20, 20_000
# Share of the sample's true neighbours that the probed lists hold, and sample rows that ask for theirs.
LIST_RECALL, JUDGES = 0.96, 256
# Rows that every query is compared with, for a first bound of its k-th distance.
PILOT_ROWS = 512
BLOCK = 16
# Strength of the test: after d dimensions a candidate is abandoned above (1 + EPSILON / sqrt(d)) times its fair share.
EPSILON = 2.1
# Rows of one part of a list, and queries that meet them at once.
CELL_ROWS, STEP_QUERIES = 8192, 256


def usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(row, vec_id, vec): rows whose vector is neither null nor zero and holds finite numbers only; `row` is a number of their own."""
    rows = vectors.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    return rows.filter(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec")


def list_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres**2).sum(1) - 2 * x @ centres.T


def nearest_list(x: np.ndarray, centres: np.ndarray, step: int = 4096) -> np.ndarray:
    parts = [list_distances(x[at : at + step], centres).argmin(1) for at in range(0, len(x), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def fit_lists(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of the sample."""
    rng = np.random.default_rng(11)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest_list(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """How many of the nearest lists hold that share of the neighbours that some sample rows have in the sample.

    Neighbours in the sample are farther than those in all rows, so these need no more lists.
    """
    judges = sample[np.random.default_rng(3).choice(len(sample), min(JUDGES, len(sample)), replace=False)]
    own = nearest_list(sample, centres)
    needed = []
    for judge in judges:
        distance = ((sample - judge) ** 2).sum(1)
        near = np.argpartition(distance, min(k, len(sample) - 1))[: k + 1]  # itself included
        place = np.empty(len(centres), np.int64)
        place[np.argsort(list_distances(judge[None], centres)[0])] = np.arange(len(centres))
        needed.append(place[own[near]])
    return int(np.quantile(np.concatenate(needed), recall)) + 1


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squared(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return (queries**2).sum(1)[:, None] + (rows**2).sum(1) - 2 * queries @ rows.T


class Cell:
    """Rows of one part of a list, as they are and turned, in ascending id."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, vec: np.ndarray, rotation: np.ndarray, k: int):
        order = np.lexsort((row, ids))
        self.row, self.ids, self.vec, self.k = row[order], ids[order], vec[order], k
        self.rotation, self.turned = rotation, self.vec @ rotation
        self.norms = (self.turned**2).sum(1)

    def survivors(self, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) that no test has abandoned."""
        dims, turned = self.vec.shape[1], queries @ self.rotation
        slack = 1e-9 * (self.norms.max(initial=0) + (turned**2).sum(1))  # rounding of the first block
        seen = min(BLOCK, dims)
        partial = squared(turned[:, :seen], self.turned[:, :seen])
        fair = bound * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dims + slack
        q, r = np.nonzero(partial <= fair[:, None])
        partial = partial[q, r]
        while seen < dims and len(q):
            to = min(seen + BLOCK, dims)
            difference = turned[q, seen:to] - self.turned[r, seen:to]
            partial = partial + np.einsum("ij,ij->i", difference, difference)
            seen = to
            if seen < dims:
                keep = partial <= bound[q] * (1 + EPSILON / np.sqrt(seen)) ** 2 * seen / dims + slack[q]
                q, r, partial = q[keep], r[keep], partial[keep]
        return q, r

    def scan(self, own: np.ndarray, queries: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, distance) of the k nearest rows of each query that lie within its bound (a squared distance)."""
        if not len(self.row) or not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, r = self.survivors(queries, bound)
        distance = np.empty(len(q))
        for at in range(0, len(q), 1 << 16):
            part = slice(at, at + (1 << 16))
            distance[part] = np.sqrt(((self.vec[r[part]] - queries[q[part]]) ** 2).sum(1))
        other = self.row[r] != own[q]
        q, r, distance = q[other], r[other], distance[other]
        order = np.lexsort((r, distance, q))
        q, r, distance = q[order], r[order], distance[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < self.k
        return q[keep], r[keep], distance[keep]


FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"
FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]
RESULT = "query_id bigint, rank int, vec_id bigint, score double"


def nearest(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", is_query: Column | None = None,
    k: int = K, most_lists: int = MOST_LISTS, recall: float = LIST_RECALL, pilot_rows: int = PILOT_ROWS, cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k nearest rows found, by Euclidean distance, ties to smaller ids.

    `is_query` is a condition on `vec_id`, by default divisible by 100. Every row but the query's own is a candidate, also
    one that shares its id. Null ids and null, zero or not finite vectors take no part, nor do vectors whose length is not
    the most common one (ties: the smallest). With fewer candidates than k all are returned; without usable vectors there
    are no rows. Other columns are not read. A hot list, of equal vectors say, is cut into parts of `cell_rows` rows.

    Lists are fitted on `LIST_SAMPLE` rows for each of them, and `LEAST_SAMPLE` at least; every row is in a list.
    """
    spark = vectors.sparkSession
    rows = checkpointed(usable(vectors, id_column, vector), "vectors")
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dims, total = lengths["n"], lengths["count"]
    rows = rows.filter(F.size("vec") == dims)
    lists = min(most_lists, math.isqrt(total) + 1)
    # The sample: the rows of smallest hash. Its first ones are the pilot.
    chosen = rows.orderBy(F.xxhash64("row"), "row").limit(max(LEAST_SAMPLE, LIST_SAMPLE * lists)).toArrow()
    sample = matrix(chosen.column("vec"))
    centres = fit_lists(sample, lists)
    probes = probes_for(sample, centres, k, recall)
    rotation = np.linalg.qr(np.random.default_rng(5).normal(size=(dims, dims)))[0]
    pilot_size = max(2 * k, min(pilot_rows, total // 8))
    pilot = [np.asarray(chosen.column(c))[:pilot_size] for c in ("row", "vec_id")] + [sample[:pilot_size]]
    shared = spark.sparkContext.broadcast((centres, rotation, pilot))  # `most_lists`, dims and `pilot_rows` times dims numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array(nearest_list(matrix(batch.column(2)), shared.value[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, own], ["row", "vec_id", "vec", "list"])

    placed = checkpointed(rows.select("row", "vec_id", "vec").mapInArrow(place, "row bigint, vec_id bigint, vec array<double>, list bigint"), "vector-lists")
    counts = np.zeros(len(centres), np.int64)
    for row in placed.groupBy("list").count().collect():  # one row per list
        counts[row["list"]] = row["count"]
    parts = np.maximum(1, -(-counts // cell_rows))
    asked = placed.filter(F.col("vec_id") % 100 == 0 if is_query is None else is_query).select("row", "vec_id", "vec")

    def piloted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Portions of queries with their vectors and all their distances to the pilot, their own one left out."""
        row, _, vec = shared.value[2]
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_QUERIES):
                portion = batch.slice(at, STEP_QUERIES)
                queries = matrix(portion.column(2))
                distance = np.sqrt(((queries[:, None, :] - vec) ** 2).sum(2))
                distance[portion.column(0).to_numpy()[:, None] == row] = np.inf
                yield portion, queries, distance

    def meet_pilot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest rows of the pilot."""
        row, ids, _ = shared.value[2]
        for portion, _, distance in piloted(batches):
            near = np.lexsort((np.broadcast_to(row, distance.shape), np.broadcast_to(ids, distance.shape), distance))[:, :k]
            q, n = np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
            found = np.isfinite(distance[q, n])
            q, n = q[found], n[found]
            columns = [portion.column(0).to_numpy()[q], portion.column(1).to_numpy()[q], row[n], ids[n], distance[q, n]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], FOUND_NAMES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and part of its nearest lists, with the squared distance of its k-th row of the pilot."""
        for portion, queries, distance in piloted(batches):
            bound = np.partition(distance, k - 1, axis=1)[:, k - 1] ** 2 if distance.shape[1] >= k else np.full(len(queries), np.inf)
            near = np.argsort(list_distances(queries, shared.value[0]), 1)[:, :probes]
            times = parts[near]
            q = np.repeat(np.arange(len(queries)), times.sum(1))
            own = np.repeat(near.ravel(), times.ravel())
            first = np.repeat(np.cumsum(times.ravel()) - times.ravel(), times.ravel())
            columns = [c.take(pa.array(q)) for c in portion.columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own), pa.array(np.arange(len(q)) - first), pa.array(bound[q])], ["row", "vec_id", "vec", "list", "part", "bound"])

    in_pilot = F.col("row").isin(*[int(r) for r in pilot[0]])  # they have met every query
    part_of = F.get(F.array(*[F.lit(int(n)).cast("bigint") for n in parts]), F.col("list").cast("int"))
    members = placed.filter(~in_pilot).select("list", F.pmod(F.xxhash64("row"), part_of).alias("part"), F.lit(0).alias("kind"), "row", "vec_id", "vec", F.lit(0.0).alias("bound"))
    probing = asked.mapInArrow(probe, "row bigint, vec_id bigint, vec array<double>, list bigint, part bigint, bound double")
    both = members.union(probing.select("list", "part", F.lit(1).alias("kind"), "row", "vec_id", "vec", "bound"))
    # Many small cells share a task; a task holds one of them at a time.
    dealt = both.repartition("list", "part").sortWithinPartitions("list", "part", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place_, waiting, cell = None, [], None
        rotation = shared.value[1]
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                key, kind = (int(keys[lo, 0]), int(keys[lo, 1])), int(keys[lo, 2])
                if key != place_:
                    place_, waiting, cell = key, [], None
                if kind == 0:
                    waiting.append(batch.slice(lo, hi - lo))
                    continue
                if cell is None and waiting:
                    members_ = pa.Table.from_batches(waiting)
                    cell = Cell(members_.column("row").to_numpy(), members_.column("vec_id").to_numpy(), matrix(members_.column("vec")), rotation, k)
                if cell is None:
                    continue  # a list whose rows are all in the pilot
                for at in range(lo, hi, STEP_QUERIES):
                    portion = batch.slice(at, min(STEP_QUERIES, hi - at))
                    own, ids = portion.column("row").to_numpy(), portion.column("vec_id").to_numpy()
                    q, r, distance = cell.scan(own, matrix(portion.column("vec")), portion.column("bound").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[q], ids[q], cell.row[r], cell.ids[r], distance)], FOUND_NAMES)

    found = dealt.mapInArrow(sweep, FOUND).union(asked.mapInArrow(meet_pilot, FOUND))
    order = W.partitionBy("query").orderBy("score", "vec_id", "row")
    # At most k rows per query and part reach the window, k per task after Spark's group limit.
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op7_nearest_neighbours")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
