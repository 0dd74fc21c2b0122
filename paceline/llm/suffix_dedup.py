"""Suffix-array dedup: every byte covered by a string of `min_length` bytes that also starts elsewhere goes.

Only passages that may be repeated are compared. Every window of `min_length` bytes names an anchor, the string of `gram`
bytes in it with the smallest hash; equal windows name equal anchors at equal offsets. The windows of one anchor form a
context of a few hundred bytes. Contexts found twice are repeated as a whole and folded. What is left, different contexts
around one anchor, is compared exactly: contexts of many anchors are laid out as one text of bounded size, and on its
Burrows-Wheeler transform intervals are expanded breadth first by one byte to the left, which yields the lengths of common
prefixes of neighbouring suffixes by increasing value. It stops at `min_length`: places not reached by then share that
many bytes.

An anchor with very many different contexts is cut by the offset of the window: windows of one half share more bytes,
these bytes name a smaller group, and equal parts fold. At one offset all windows of a group are equal, so the cutting
ends, and rows at most double per cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table, text_batches, text_key

MIN_LENGTH, GRAM = 400, 100
# No UTF-8 text has this byte.
SEPARATOR = 255
# Contexts of one group that is compared as a whole, and bytes of contexts in one transform.
GROUP_LIMIT = 1000
SHARD_BYTES = 1 << 20
# Contexts whose anchors are looked up at once.
VIEW_ROWS = 1 << 13
BYTE_VALUES = np.random.default_rng(17).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` consecutive bytes, put together from powers of two."""
    power, length = BYTE_VALUES[x], 1
    total, done = None, 0
    while True:
        if gram & length:
            if total is None:
                total = power
            else:
                size = len(power) - done
                total = total[:size] * np.uint64(0xD6E8FEB86659FD93 + 2 * length) + power[done:]
                total ^= total >> np.uint64(29)
            done += length
        if done == gram:
            return total
        size = len(power) - length
        power = power[:size] * np.uint64(0xA0761D6478BD642F + 2 * length) + power[length:]
        power ^= power >> np.uint64(31)
        length *= 2


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    low, length = h, 1
    while 2 * length <= width:
        low = np.minimum(low[:-length], low[length:])
        length *= 2
    rest = width - length
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def contexts(raw: bytes, min_length: int, gram: int) -> list[np.ndarray]:
    """Anchor hash, first window, number of windows and offset of the anchor in the first window, of every context of a text."""
    x = np.frombuffer(raw, np.uint8)
    h = gram_hashes(x, gram)
    width = min_length - gram + 1
    low = sliding_minimum(h, width)
    # A window that begins at its anchor is the last of its context; the next place with this hash serves later windows.
    leaves = h[: len(low)] == low
    first = np.concatenate(([0], np.flatnonzero((low[1:] != low[:-1]) | leaves[:-1]) + 1))
    last = np.append(first[1:], len(low)) - 1
    offset = last - first
    views = np.lib.stride_tricks.sliding_window_view(h, width)
    inside = np.flatnonzero(~leaves[last])
    for lo in range(0, len(inside), VIEW_ROWS):  # a portion copies `width` hashes for each of its contexts
        part = inside[lo : lo + VIEW_ROWS]
        offset[part] = views[first[part]].argmin(1)
    return [low[first].view(np.int64), first, last - first + 1, offset]


def digest(content: bytes, seed: int = 0) -> int:
    value = xxhash.xxh64_intdigest(content, seed)
    return value - (1 << 64) if value >> 63 else value


ANCHORS = "key binary, a bigint, c bigint, start bigint, windows int, offset int"


def anchors(docs: DataFrame, text: str, min_length: int, gram: int) -> DataFrame:
    """All contexts of all rows: `a` and `c` are the hashes of the anchor and of the whole context."""
    picked = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") >= min_length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, parts, hashes = [], [], []
            for n, value in enumerate(batch.column(1).to_pylist()):
                raw = encoded(value)
                part = contexts(raw, min_length, gram)
                parts.append(part)
                owner.append(np.full(len(part[0]), n))
                hashes += [digest(raw[lo : lo + size + min_length - 1]) for lo, size in zip(part[1].tolist(), part[2].tolist())]
            if parts:
                a, start, windows, offset = (np.concatenate([p[i] for p in parts]) for i in range(4))
                columns = [pa.array(a), pa.array(hashes, pa.int64()), pa.array(start), pa.array(windows, pa.int32()), pa.array(offset, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), *columns], ["key", "a", "c", "start", "windows", "offset"])

    return picked.mapInArrow(run, ANCHORS)


def packed_texts(docs: DataFrame, text: str) -> DataFrame:
    """(key, packed): one row per distinct text, compressed for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(encoded(t)) for t in batch.column(1).to_pylist()], pa.binary())], ["key", "packed"])

    rows = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).mapInArrow(run, "key binary, packed binary")
    return rows.groupBy("key").agg(F.any_value("packed").alias("packed"))


# A part of the context (a, c): its windows start at byte `at` of it, the first has the anchor at `offset`, all have it
# in [low, high); `grp` is the group it is compared in.
ITEMS = "a bigint, c bigint, at int, grp bigint, low int, high int, offset int, content binary"


def items(docs: DataFrame, text: str, wanted: DataFrame, min_length: int, gram: int) -> DataFrame:
    """The bytes of the contexts `wanted` (key, a, c, start, windows, offset)."""
    places = wanted.groupBy("key").agg(F.collect_list(F.struct("a", "c", "start", "windows", "offset")).alias("places"))  # places of one text
    joined = packed_texts(docs, text).join(places, "key").select("packed", "places")
    high = min_length - gram + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = unpack.decompress(packed)
                rows += [(p["a"], p["c"], 0, p["a"], 0, high, p["offset"], raw[p["start"] : p["start"] + p["windows"] + min_length - 1]) for p in places]
            if rows:
                yield item_batch(rows)

    return joined.mapInArrow(run, ITEMS)


def item_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["a", "c", "at", "grp", "low", "high", "offset", "content"])


def halves(a: int, c: int, at: int, grp: int, low: int, high: int, offset: int, content: bytes, min_length: int) -> Iterator[tuple]:
    """An item cut at the middle of its anchor offsets; the bytes that all windows of a half share name its group."""
    windows = len(content) - min_length + 1
    middle = (low + high) // 2
    for lo, hi in ((low, middle), (middle, high)):
        first, last = max(0, offset - hi + 1), min(windows - 1, offset - lo)
        if lo < hi and first <= last:
            shared = content[max(0, offset - lo) : offset - hi + 1 + min_length]
            yield (a, c, at + first, digest(shared, (grp ^ lo * 1_000_003 ^ hi) & 0xFFFFFFFF), lo, hi, offset - first, content[first : last + min_length])


def split_hot(hot: DataFrame, min_length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [half for row in zip(*(c.to_pylist() for c in batch.columns)) for half in halves(*row, min_length)]
            if rows:
                yield item_batch(rows)

    return hot.mapInArrow(run, ITEMS)


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of `x` in the order of their first `depth` bytes or more, by prefix doubling."""
    key, known = np.zeros(len(x), np.uint64), 8
    for at in range(known):
        key = key << np.uint64(8) | np.roll(x, -at).astype(np.uint64)
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.zeros(len(x), np.uint64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1]))).astype(np.uint64)
        if known >= depth or int(rank[order[-1]]) == len(x) - 1:
            return order
        key = rank << np.uint64(32) | np.roll(rank, -known)
        known *= 2


def shared_prefixes(x: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix order, and for every place r in it whether suffixes r - 1 and r share `min_length` bytes.

    `done[r]` says that the length at r is known. An interval holds the suffixes with one prefix; expanding it by a byte c
    to the left maps the c's of its part of the transform to the interval of the longer prefix, whose right end then has
    the present length. Only ends that were not known go on.
    """
    size = len(x)
    order = suffix_order(x, min_length)
    transform = x[order - 1]
    by_symbol = np.argsort(transform, kind="stable")
    to = np.empty(size, np.int64)
    to[by_symbol] = np.arange(size)
    same = transform[by_symbol[1:]] == transform[by_symbol[:-1]]
    after, before = np.full(size, size), np.full(size, -1)
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    done = np.zeros(size + 1, bool)
    done[[0, size]] = True
    left, right = np.array([0]), np.array([size])
    for _ in range(min_length):
        if not len(left):
            break
        width = right - left
        at = np.arange(width.sum()) + np.repeat(left - (np.cumsum(width) - width), width)
        ends = to[at[after[at] >= np.repeat(right, width)]] + 1
        starts = to[at[before[at] < np.repeat(left, width)]]
        ends.sort()  # intervals of one length are disjoint, so sorted starts and ends belong together
        starts.sort()
        fresh = ~done[ends]
        done[ends[fresh]] = True
        left, right = starts[fresh], ends[fresh]
    return order, ~done[:size]


def repeated_windows(contents: list[bytes], min_length: int) -> list[list[tuple[int, int]]]:
    """For each content the runs [first, last] of window starts whose window occurs at another place of the contents."""
    mark = bytes([SEPARATOR])
    x = np.frombuffer(mark + mark.join(contents) + mark, np.uint8)
    begins = np.cumsum([1, *(len(c) + 1 for c in contents)])
    order, shared = shared_prefixes(x, min_length)
    places = np.unique(np.concatenate((order[shared], order[np.flatnonzero(shared) - 1])))
    owner = np.searchsorted(begins, places, "right") - 1
    inside = (owner >= 0) & (owner < len(contents)) & (places + min_length < begins[np.clip(owner + 1, 0, len(contents))])
    places, owner = places[inside], owner[inside]
    result: list[list[tuple[int, int]]] = [[] for _ in contents]
    if len(places):
        cut = np.flatnonzero((np.diff(places) != 1) | (np.diff(owner) != 0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(places)]):
            begin = begins[owner[lo]]
            result[owner[lo]].append((int(places[lo] - begin), int(places[hi - 1] - begin)))
    return result


RANGES = "a bigint, c bigint, low int, high int"


def compared(parts: DataFrame, min_length: int) -> DataFrame:
    """Ranges of repeated bytes in contexts, from items whose groups are small."""
    volume = parts.agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(1, -(-volume // SHARD_BYTES))

    def run(group: pa.Table) -> pa.Table:
        a, c, at = (group.column(name).to_numpy() for name in ("a", "c", "at"))
        found = [(a[n], c[n], at[n] + lo, at[n] + hi + min_length) for n, runs in enumerate(repeated_windows(group.column("content").to_pylist(), min_length)) for lo, hi in runs]
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["a", "c", "low", "high"])

    dealt = parts.select("a", "c", "at", "content", F.pmod(F.xxhash64("grp"), F.lit(shards)).alias("shard"))
    # A partition for each shard, which adaptive execution leaves apart: tasks hold as much at any size of the input.
    return dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, RANGES)


def repeated_ranges(parts: DataFrame, min_length: int, group_limit: int) -> DataFrame:
    """Ranges of repeated bytes in all contexts of `parts`; groups above the limit are cut until none is."""
    found = None
    while True:
        hot = checkpointed(parts.groupBy("grp").count().filter(F.col("count") > group_limit).select("grp"), "hot-anchors")
        last = hot.isEmpty()
        ranges = checkpointed(compared(parts if last else parts.join(hot, "grp", "left_anti"), min_length), "suffix-ranges")
        found = ranges if found is None else found.union(ranges)
        if last:
            return found
        cut = checkpointed(split_hot(parts.join(hot, "grp", "left_semi").select("a", "c", "at", "grp", "low", "high", "offset", "content"), min_length), "suffix-halves")
        cut = cut.withColumn("same", F.unhex(F.md5("content")))
        # Equal halves of different contexts are repeated; one of them stands for all from here on.
        counts = cut.groupBy("grp", "same").agg(F.count("*").alias("n"), F.min(F.struct("a", "c", "at")).alias("one"))
        counted = checkpointed(cut.join(counts, ["grp", "same"]), "suffix-folded")
        found = found.union(counted.filter("n > 1").select("a", "c", F.col("at").alias("low"), (F.col("at") + F.length("content")).alias("high")))
        kinds = counts.groupBy("grp").count().filter(F.col("count") > 1).select("grp")
        parts = counted.filter((F.col("one.a") == F.col("a")) & (F.col("one.c") == F.col("c")) & (F.col("one.at") == F.col("at"))).join(kinds, "grp", "left_semi")
        parts = checkpointed(parts.select("a", "c", "at", "grp", "low", "high", "offset", "content"), "suffix-halves")


def repeated_spans(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(key, spans): for every distinct text with repeated bytes their ranges [low, high), unordered and overlapping."""
    text_batches(docs.sparkSession)
    every = checkpointed(anchors(docs, text, min_length, gram), "anchors")
    repeated = every.groupBy("a").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).filter("n > 1")
    # Written first, so that both sides of the join are shuffled for it and a hot anchor may be split.
    repeated = checkpointed(repeated.select("a", (F.col("least") != F.col("most")).alias("mixed")), "repeated-anchors")
    shared = checkpointed(every.join(repeated, "a"), "shared-anchors")
    place = F.struct("key", "start", "windows", "offset")
    kinds = checkpointed(shared.groupBy("a", "c", "mixed").agg(F.count("*").alias("n"), F.min(place).alias("place")), "contexts")
    mixed = kinds.filter("mixed").select("a", "c", "place.*")
    parts = checkpointed(items(docs, text, mixed, min_length, gram), "context-bytes")
    whole = kinds.filter("n > 1").select("a", "c", F.lit(0).alias("low"), (F.col("place.windows") + min_length - 1).alias("high"))
    ranges = whole.union(repeated_ranges(parts, min_length, group_limit)).groupBy("a", "c").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))  # ranges of one context
    # Written like the anchors: a passage that very many texts share is a hot key of this join.
    spans = shared.select("a", "c", "key", "start").distinct().join(checkpointed(ranges, "context-ranges"), ["a", "c"])
    moved = F.transform("ranges", lambda r: F.struct((F.col("start") + r["low"]).alias("low"), (F.col("start") + r["high"]).alias("high")))
    return spans.select("key", moved.alias("ranges")).groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("spans"))  # places of one text


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans or ()):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(high for _, high in runs)]
    starts = [*(low for low, _ in runs), len(raw)]
    return b"".join(raw[lo:hi] for lo, hi in zip(ends, starts))


def dedup_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per row of `docs`: id, `n_bytes`, `n_removed`, `n_spans`, `kept_sha256`, `kept_text`.

    Texts are UTF-8 bytes, a null one is empty; matches never cross rows, and are judged on the input. Repeated rows are
    copies of each other, so long ones lose all bytes. `kept_text` lacks what is left of characters that a cut divides;
    the digest covers all bytes kept. A null id stays null; other columns are not read; an empty table gives no rows.
    """
    spans = checkpointed(repeated_spans(docs, text, min_length, gram, group_limit), "suffix-spans")
    texts = packed_texts(docs, text).join(spans, "key", "left").select("key", "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw, runs = unpack.decompress(packed), merged(found)
                kept = kept_bytes(raw, runs)
                rows.append((len(raw), sum(high - low for low, high in runs), len(runs), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    report = texts.mapInArrow(run, "key binary, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text string")
    return docs.select(F.col(id_column), text_key(F.col(text)).alias("key")).join(report, "key").drop("key")


def without_repeats(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """`docs` with repeated bytes cut out of `text`; a cut inside a character drops what is left of it. Null texts stay null."""
    spans = checkpointed(repeated_spans(docs, text, min_length, gram, group_limit), "suffix-spans")

    names, own = docs.columns, "__suffix_key"
    at, ranges = names.index(text), len(names) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[1:ranges])
            found = batch.column(ranges).to_pylist()
            texts = [v if spans is None or v is None else kept_bytes(encoded(v), merged(spans)).decode("utf-8", "ignore") for v, spans in zip(columns[at].to_pylist(), found)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    # The joined columns go by place, so names of `docs` cannot clash with the two of the join.
    marked = docs.select(text_key(F.col(f"`{text}`")).alias(own), *[F.col(f"`{c}`").alias(f"_{n}") for n, c in enumerate(names)])
    joined = marked.join(spans.select(F.col("key").alias(own), "spans"), own, "left")
    return joined.mapInArrow(run, docs.schema)


@query("op9_suffix_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))
