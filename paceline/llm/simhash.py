"""SimHash near-dedup with BK-trees.

Fingerprints of 64 bits are folded to distinct ones. With r differing bits allowed, of r + 2 blocks of bits two at least
are equal, so each pair of near fingerprints shares the bits of two blocks and meets in the shard of these. A shard gets
a Burkhard-Keller tree: the children of a node are keyed by their distance to it, and a search follows the edges within
r of the query's distance. The queries of a tree are the members of its shard, so a tree stays with the task that holds
them and need not be sent anywhere. A shard above `shard_limit` is cut further by two blocks of its remaining bits:
rows grow by a constant factor, not with the square of the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table, text_batches
from paceline.llm.components import connected, local_roots

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
# Members of one tree: above 2 ** 14, the distinct values that the last cut can leave together.
SHARD_LIMIT = 20_000
# (query, node) pairs that one step of a search may hold.
FRONTIER = 1 << 21
BUFFER = 200_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64 bits: a bit is set where it is set in over half the XXH64 values of the word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(shingles), 1 << 14):
        values = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[lo : lo + (1 << 14)]], np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`keys` and `fp` of every row."""
    text_batches(docs.sparkSession)
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(values, pa.int64())], [*keys, "fp"])

    kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in picked.schema[: len(keys)])
    return picked.mapInArrow(run, f"{kinds}, fp bigint")


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cuts(free: int, radius: int) -> list[tuple[int, int]]:
    """(bits that must be equal, bits left) for each two of radius + 2 blocks of the bits in `free`."""
    bits = [b for b in range(BITS) if free >> b & 1]
    blocks = [sum(1 << int(b) for b in part) for part in np.array_split(bits, min(radius + 2, len(bits)))]
    return [(x | y, free & ~(x | y)) for x, y in combinations(blocks, 2)] or [(free, 0)]


def sharded(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (shard, free, fp) dealt into shards by two blocks of their free bits."""
    frees = [row[0] for row in rows.select("free").distinct().collect()]  # fixed set: at most 10 ** level masks
    entry = lambda equal, left: F.struct(F.lit(signed(equal)).cast("bigint").alias("equal"), F.lit(signed(left)).cast("bigint").alias("left"))
    plan = [part for f in frees for part in (F.lit(f).cast("bigint"), F.array(*[entry(*cut) for cut in cuts(f % (1 << BITS), radius)]))]
    dealt = rows.select("shard", "fp", F.explode(F.element_at(F.create_map(*plan), F.col("free"))).alias("cut")) if plan else rows.select("shard", "fp", F.struct(F.col("free").alias("equal"), F.col("free").alias("left")).alias("cut"))
    return dealt.select(F.xxhash64("shard", "cut.equal", F.col("fp").bitwiseAND(F.col("cut.equal"))).alias("shard"), F.col("cut.left").alias("free"), "fp")


def near_links(distinct: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """Links (u, v) between fingerprints of `distinct` (fp) that connect all pairs within `radius` bits."""
    rows = distinct.select(F.lit(0).cast("bigint").alias("shard"), F.lit(-1).cast("bigint").alias("free"), "fp")
    # Larger radii leave fewer equal bits per cut; at zero free bits members of a shard are one value.
    found = None
    while True:
        dealt = sharded(rows, radius)
        hot = checkpointed(dealt.groupBy("shard").count().filter(F.col("count") > shard_limit).select("shard"), "hot-shards")
        last = hot.isEmpty()
        cold = dealt if last else dealt.join(hot, "shard", "left_anti")
        links = cold.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(lambda batches: _search(batches, radius), "u bigint, v bigint")
        found = links if found is None else found.union(links)
        if last:
            return found
        rows = checkpointed(dealt.join(hot, "shard", "left_semi"), "hot-rows")


def _search(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links inside each shard of rows sorted by shard; only whole shards are searched."""
    shards, fps = [], []

    def links(whole: bool) -> Iterator[pa.RecordBatch]:
        shard, fp = np.concatenate(shards), np.concatenate(fps)
        end = len(shard) if whole else int(np.searchsorted(shard, shard[-1]))
        shards[:], fps[:] = [shard[end:]], [fp[end:]]
        u, v = shard_links(shard[:end], fp[:end], radius)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        shards.append(batch.column(0).to_numpy())
        fps.append(batch.column(1).to_numpy().view(np.uint64))  # bits of negative numbers are not counted as such
        if sum(map(len, shards)) > BUFFER:
            yield from links(False)
    if sum(map(len, shards)):
        yield from links(True)


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the components of every shard; rows are sorted by shard."""
    if len(shard) < 2:
        return fp[:0], fp[:0]
    same = shard[1:] == shard[:-1]
    keep = np.concatenate((same, [False])) | np.concatenate(([False], same))  # alone in a shard: no partner
    shard, fp = shard[keep], fp[keep]
    if not len(shard):
        return fp, fp
    first = np.concatenate(([True], shard[1:] != shard[:-1]))
    root = np.flatnonzero(first)[np.cumsum(first) - 1]
    keys, children = bk_forest(fp, root)
    size = np.diff(np.append(np.flatnonzero(first), len(fp)))[np.cumsum(first) - 1]
    label = np.arange(len(fp))
    # Queries go in portions whose searches visit a bounded number of nodes.
    for chunk in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(np.cumsum(size) // FRONTIER)) + 1):
        a, b = bk_search(fp, keys, children, chunk, root[chunk], radius)
        joined = local_roots(len(fp), np.concatenate((np.arange(len(fp)), a)), np.concatenate((label, b)))
        label = joined
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def bk_forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the trees of all shards, sorted: keys node * 65 + distance, and the child at each.

    All items sink level by level: of those with one parent and one distance the first becomes the child there.
    """
    active = np.flatnonzero(root != np.arange(len(fp)))
    parent = root[active]
    keys, children = [], []
    while len(active):
        key = parent * (BITS + 1) + np.bitwise_count(fp[active] ^ fp[parent]).astype(np.int64)
        edge, at, group = np.unique(key, return_index=True, return_inverse=True)
        keys.append(edge)
        children.append(active[at])
        rest = np.ones(len(active), bool)
        rest[at] = False
        parent, active = active[at][group][rest], active[rest]
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, child = np.concatenate(keys), np.concatenate(children)
    order = np.argsort(key)
    return key[order], child[order]


def bk_search(fp: np.ndarray, keys: np.ndarray, children: np.ndarray, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs within the radius; from a node at distance d only edges d - radius to d + radius are followed."""
    found, node, asked = [], roots, queries
    while len(asked):
        d = np.bitwise_count(fp[asked] ^ fp[node]).astype(np.int64)
        near = (d <= radius) & (asked > node)
        found.append((asked[near], node[near]))
        lo = np.searchsorted(keys, node * (BITS + 1) + np.maximum(d - radius, 0))
        hi = np.searchsorted(keys, node * (BITS + 1) + np.minimum(d + radius, BITS), "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        asked, node = np.repeat(asked, n), children[at]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def with_roots(prints: DataFrame, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(fp, root) of every distinct fingerprint of `prints`: root is the smallest fingerprint it is connected with."""
    distinct = checkpointed(prints.select("fp").distinct(), "fingerprints")
    roots = connected(near_links(distinct, radius, shard_limit))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """One row per row of `docs`: id, `fingerprint` (16 hex digits), `component_id`, the smallest id reachable over links.

    Texts without words, null ones too, have fingerprint zero and are linked like others. Repeated rows appear each. Null ids
    stay null and do not count as smallest; where all ids of a component are null, so is its component_id. Other columns
    are not read. An empty table gives no rows.
    """
    prints = checkpointed(fingerprints(docs, [id_column], text, shingle), "simhash")
    roots = with_roots(prints, radius, shard_limit)
    # Copies share a fingerprint: each one is folded to its smallest id before components are.
    named = checkpointed(prints.groupBy("fp").agg(F.min(id_column).alias("least")).join(roots, "fp"), "simhash-roots")
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(groups, "root").select("fp", "component_id"), "fp").select(id_column, fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs`, one of each component: that of the smallest id (null last), then of the smallest row digest."""
    own = "__simhash_row"
    values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]
    marked = docs.withColumn(own, F.md5(F.concat_ws("\x1f", *values)))
    prints = checkpointed(fingerprints(marked, [own, id_column], text, shingle), "simhash")
    best = F.min(F.struct(F.col(id_column).isNull().alias("last"), F.col(id_column).alias("id"), F.col(own).alias("own"))).alias("best")
    chosen = prints.groupBy("fp").agg(best).join(with_roots(prints, radius), "fp").groupBy("root").agg(F.min("best").alias("best"))
    kept = checkpointed(chosen.select(F.col("best.own").alias(own)), "simhash-kept")
    return marked.join(kept, own, "left_semi").dropDuplicates([own]).drop(own)


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
