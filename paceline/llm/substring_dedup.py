"""Substring dedup: words covered by a window of words that also starts in an earlier document go.

Suffix automata of reference shards decide: a passage streams through the automaton of its shard, which yields the length
of the longest match that ends at each word (matching statistics); spans at or above the threshold are repeated. A shard
takes its passages by ascending document, each after it has been matched, so a match always lies in an earlier document.

A passage can match only where its anchor is. Every window names an anchor, the string of `gram` words in it with the
smallest hash, and windows of one anchor in a row are one passage. Anchors of a single document cannot repeat across
documents; only the passages of the others go to a shard, all passages of an anchor to the same one. Equal passages are
folded in their block and in their shard, and keep the smallest document. Windows of an anchor with very many passages
are dealt by their own words, so no shard grows with a hot passage.

An automaton of the whole corpus for every document would cost documents times shards. Here each passage meets one shard,
and the shard stays in the task to which its passages are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.blocks import BLOCK_BYTES, grouped_texts, numbers, pack_numbers, packed_texts, squeezed, unpacked_texts, unsqueezed
from paceline.llm.common import checkpointed, query, table

MIN_WORDS = 13
# Anchors that are counted in one task, and passages of one shard on average.
BUCKET_ANCHORS, SHARD_PASSAGES = 1 << 20, 1 << 14
# Passages of one anchor from which on its windows are dealt one by one.
HOT_PASSAGES = 1 << 10
# Words whose hashes a worker keeps.
TABLE_WORDS = 1_000_000


class WordHashes(dict):
    """64-bit hash of each word met so far."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > TABLE_WORDS:
            self.clear()
        return np.array(list(map(self.__getitem__, words)), np.uint64)


HASHES = WordHashes()


def default_gram(min_words: int) -> int:
    """Words of an anchor: two fifths of a window, and so many that a passage has at most 63 windows."""
    return max(1, 2 * min_words // 5, min_words - 62)


class Words:
    """The words of a block's texts in one row, and its passages: (anchor hash, first window, windows, text)."""

    def __init__(self, texts: list[bytes]):
        split = [text.split() for text in texts]  # exactly the blanks 0x20 and 0x09 to 0x0D
        self.counts = np.array([len(words) for words in split], np.int64)
        self.words = [word for words in split for word in words]
        self.ends = np.cumsum(self.counts)

    def passages(self, min_words: int, gram: int, taking_part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        hashes = HASHES.of(self.words)
        size = len(hashes) - min_words + 1
        if size <= 0:
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        grams = hashes
        for at in range(1, gram):
            grams = (grams[:-1] ^ (grams[:-1] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + hashes[at:]
        grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
        least, place = grams[:size].copy(), np.zeros(size, np.int64)
        for at in range(1, min_words - gram + 1):
            other = grams[at : at + size]
            lower = other < least
            least[lower] = other[lower]
            place[lower] = at
        limit = np.repeat(np.where(taking_part, self.ends, -1), self.counts)[:size]
        windows = np.flatnonzero(np.arange(size) + min_words <= limit)
        if not len(windows):
            return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
        anchor = windows + place[windows]
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(windows) != 1))))
        start = windows[first]
        return least[start], start, np.diff(np.append(first, len(windows))), np.searchsorted(self.ends, start, "right")


def by_anchor(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors in order, the order of the passages, and the first place of each anchor in that order."""
    order = np.argsort(anchors, kind="stable")
    ordered = anchors[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], order, first


BLOCKS = "block bigint, ids binary, present binary, packed binary, lengths binary, n_anchors bigint, anchors binary, found binary"
BLOCK_SCHEMA = pa.schema([(part.split()[0], pa.int64() if part.endswith("bigint") else pa.binary()) for part in BLOCKS.split(", ")])


def in_blocks(docs: DataFrame, id_column: str, text: str, min_words: int, gram: int, block_bytes: int) -> DataFrame:
    """Blocks of whole texts with the sorted anchors of each, and how many passages and documents hold them there."""
    picked = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in grouped_texts(batches, block_bytes):
            present = np.array([i is not None for i in ids])
            doc_ids = np.array([i if i is not None else 0 for i in ids], np.int64)
            anchors, _, _, text_of = Words(texts).passages(min_words, gram, present)
            distinct, order, first = by_anchor(anchors)
            total = np.diff(np.append(first, len(order)))
            owner = doc_ids[text_of[order]]
            # Rows that share an id are one document.
            several = (np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)) if len(first) else np.zeros(0, bool)
            found = np.minimum(total, 127).astype(np.uint8) | (several.astype(np.uint8) << 7)
            row = [block, doc_ids.tobytes(), present.tobytes(), *packed_texts(texts), len(distinct), distinct.tobytes(), found.tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(BLOCK_SCHEMA.names, row))], schema=BLOCK_SCHEMA)

    return picked.mapInArrow(run, BLOCKS)


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash, so the anchors of a block are in the order of their buckets."""
    return np.minimum((anchors >> np.uint64(32)).astype(np.int64) * buckets >> 32, buckets - 1)


def candidates(blocks: DataFrame, hot: int) -> DataFrame:
    """(block, bucket, n, wanted, hot): for the anchors of each block, in order, whether several documents hold them, and very many passages.

    An anchor comes once from each block, however many of its documents hold it.
    """
    total = blocks.agg(F.sum("n_anchors")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_ANCHORS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, anchors, found in zip(*(column.to_pylist() for column in batch.columns)):
                anchors, found = np.frombuffer(anchors, np.uint64), np.frombuffer(found, np.uint8)
                cuts = np.searchsorted(bucket_of(anchors, buckets), np.arange(buckets + 1)).tolist()
                rows = [(b, block, anchors[lo:hi].tobytes(), found[lo:hi].tobytes()) for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if lo < hi]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["bucket", "block", "anchors", "found"])

    def count(key: tuple, group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(a, np.uint64) for a in group.column("anchors").to_pylist()]
        _, order, first = by_anchor(np.concatenate(parts))
        found = np.concatenate([np.frombuffer(f, np.uint8) for f in group.column("found").to_pylist()])[order]
        sizes = np.diff(np.append(first, len(order)))
        passages = np.add.reduceat((found & 127).astype(np.int64), first)
        several = (sizes > 1) | (np.maximum.reduceat(found, first) > 127)
        flags = np.empty((2, len(order)), bool)
        flags[0, order] = np.repeat(several, sizes)
        flags[1, order] = np.repeat(several & (passages >= hot), sizes)
        cuts = np.cumsum([0, *map(len, parts)]).tolist()
        columns = [group.column("block"), pa.array([key[0].as_py()] * len(parts), pa.int64()), pa.array(list(map(len, parts)), pa.int64())]
        columns.append(pa.array([int(flags[0, lo:hi].sum()) for lo, hi in zip(cuts, cuts[1:])], pa.int64()))
        columns += [pa.array([np.packbits(f[lo:hi]).tobytes() for lo, hi in zip(cuts, cuts[1:])], pa.binary()) for f in flags]
        return pa.table(columns, ["block", "bucket", "n", "n_wanted", "wanted", "hot"])

    dealt = blocks.select("block", "anchors", "found").mapInArrow(deal, "bucket bigint, block bigint, anchors binary, found binary")
    counted = dealt.repartition(buckets, "bucket").groupBy("bucket")
    return counted.applyInArrow(count, "block bigint, bucket bigint, n bigint, n_wanted bigint, wanted binary, hot binary")


# Items of a block for one shard: distinct passages, one behind another, and the smallest document of each. The row of shard
# -1 has the places: item, text, first window in the block and windows of every passage.
ITEMS = "block bigint, shard bigint, content binary, first binary, places binary"
ITEM_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int64()), ("content", pa.binary()), ("first", pa.binary()), ("places", pa.binary())])


def passages(blocks: DataFrame, flags: DataFrame, min_words: int, gram: int, shards: int) -> DataFrame:
    """The passages of all blocks that may repeat, with their words."""
    found = flags.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "wanted", "hot")).alias("flags"))  # as many as the block has buckets
    joined = blocks.select("block", "ids", "present", "packed", "lengths").join(found, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, ids, present, packed, lengths, parts = (batch.column(i)[row].as_py() for i in range(6))
                yield from block_items(block, np.frombuffer(ids, np.int64), np.frombuffer(present, bool), unpacked_texts(packed, lengths), sorted(parts, key=lambda p: p["bucket"]))

    def block_items(block: int, ids: np.ndarray, present: np.ndarray, texts: list[bytes], parts: list[dict]) -> Iterator[pa.RecordBatch]:
        block_words = Words(texts)
        anchors, start, windows, text_of = block_words.passages(min_words, gram, present)
        _, order, first = by_anchor(anchors)
        sizes = np.diff(np.append(first, len(order)))
        flag = np.zeros((2, len(order)), bool)
        for n, name in enumerate(("wanted", "hot")):
            flag[n, order] = np.repeat(np.concatenate([np.unpackbits(np.frombuffer(p[name], np.uint8), count=p["n"]) for p in parts]).astype(bool), sizes)
        words, owners = block_words.words, ids[text_of]
        shard_of_anchor = ((anchors * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % shards
        items: dict[int, dict[bytes, int]] = {}
        firsts: dict[int, list[int]] = {}
        places: list[tuple[int, int, int, int, int]] = []
        wanted = np.flatnonzero(flag[0])
        for at, size, owner, text, shard, single in zip(*(x[wanted].tolist() for x in (start, windows, owners, text_of, shard_of_anchor, flag[1]))):
            for lo, width in ((window, 1) for window in range(at, at + size)) if single else ((at, size),):
                content = b" ".join(words[lo : lo + width + min_words - 1])
                if single:
                    shard = (xxhash.xxh64_intdigest(content) >> 1) % shards
                own = items.setdefault(shard, {})
                item = own.get(content)
                if item is None:
                    item = own[content] = len(own)
                    firsts.setdefault(shard, []).append(owner)
                elif owner < firsts[shard][item]:
                    firsts[shard][item] = owner
                places.append((shard, item, text, lo, width))
        base, rows = 0, []
        offset = {}
        for shard in sorted(items):
            offset[shard] = base
            base += len(items[shard])
            rows.append((block, shard, squeezed(b"\n".join(items[shard])), np.array(firsts[shard], np.int64).tobytes(), None))
        if places:
            table = np.array([(offset[shard] + item, text, lo, width) for shard, item, text, lo, width in places], np.int64)
            rows.append((block, -1, None, None, pack_numbers(table)))
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 256]], field.type) for i, field in enumerate(ITEM_SCHEMA)], schema=ITEM_SCHEMA)

    return joined.mapInArrow(run, ITEMS)


class SuffixAutomaton:
    """All substrings of the strings taken so far, whose symbols are numbers."""

    def __init__(self):
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def matches(self, string: list[int], least: int) -> list[int]:
        """Places at which a substring of `least` symbols that the automaton holds begins: matching statistics at or above it."""
        to, link, length = self.to, self.link, self.length
        state, matched, found = 0, 0, []
        for at, symbol in enumerate(string):
            follow = to[state].get(symbol)
            while follow is None and state:
                state = link[state]
                matched = length[state]
                follow = to[state].get(symbol)
            if follow is not None:
                state = follow
                matched += 1
                if matched >= least:
                    found.append(at - least + 1)
        return found

    def take(self, string: list[int]) -> None:
        """Add a string; what it shares with earlier ones is not added again."""
        to, link, length = self.to, self.link, self.length
        last = 0
        for symbol in string:
            known = to[last].get(symbol)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                new = len(to)
                to.append({})
                link.append(0)
                length.append(length[last] + 1)
                state = last
                while state >= 0 and symbol not in to[state]:
                    to[state][symbol] = new
                    state = link[state]
                if state < 0:
                    last = new
                    continue
                known = to[state][symbol]
                if length[known] == length[state] + 1:
                    link[new] = known
                    last = new
                    continue
            else:
                new, state = None, last
            twin = len(to)
            to.append(dict(to[known]))
            link.append(link[known])
            length.append(length[state] + 1)
            link[known] = twin
            while state >= 0 and to[state].get(symbol) == known:
                to[state][symbol] = twin
                state = link[state]
            if new is not None:
                link[new] = twin
            last = twin if new is None else new


def judged(contents: list[bytes], first: list[int], min_words: int) -> list[int]:
    """For each distinct passage the windows, as bits, that also start in a document before its first one."""
    symbols: dict[bytes, int] = {}
    strings = [[symbols.setdefault(word, len(symbols)) for word in content.split(b" ")] for content in contents]
    automaton, result = SuffixAutomaton(), [0] * len(contents)
    order = sorted(range(len(contents)), key=first.__getitem__)
    at = 0
    while at < len(order):
        to = at
        while to < len(order) and first[order[to]] == first[order[at]]:
            to += 1
        fresh = []
        for n in order[at:to]:
            string = strings[n]
            found = automaton.matches(string, min_words)
            windows = len(string) - min_words + 1
            if found:
                result[n] = sum(1 << w for w in found)
            if len(found) < windows:  # the span from the first to the last window that is new
                new = sorted(set(range(windows)) - set(found)) if found else (0, windows - 1)
                fresh.append(string[new[0] : new[-1] + min_words])
        for string in fresh:  # passages of one document do not match each other
            automaton.take(string)
        at = to
    return result


RESULTS = "block bigint, shard bigint, first binary, earlier binary"


def matched(items: DataFrame, min_words: int, shards: int) -> DataFrame:
    """For the items of each block and shard the first document of all blocks, and the windows that lie in a document before it."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        sizes, kinds, first, kind_of = [], {}, [], []
        for content, firsts in zip(group.column("content").to_pylist(), group.column("first").to_pylist()):
            own = unsqueezed(content).split(b"\n")
            sizes.append(len(own))
            for passage, doc in zip(own, np.frombuffer(firsts, np.int64).tolist()):
                kind = kinds.setdefault(passage, len(kinds))
                kind_of.append(kind)
                if kind == len(first):
                    first.append(doc)
                elif doc < first[kind]:
                    first[kind] = doc
        earlier = np.array(judged(list(kinds), first, min_words), np.uint64)[kind_of]
        firsts, cuts = np.array(first, np.int64)[kind_of], np.cumsum([0, *sizes]).tolist()
        parts = [pa.array([squeezed(values[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:])], pa.binary()) for values in (firsts, earlier)]
        return pa.table([group.column("block"), group.column("shard"), *parts], ["block", "shard", "first", "earlier"])

    wanted = items.filter("shard >= 0").select("block", "shard", "content", "first")
    return wanted.repartition(shards, "shard").groupBy("shard").applyInArrow(run, RESULTS)


def removed_words(size: int, ids: np.ndarray, places: np.ndarray, first: np.ndarray, earlier: np.ndarray, min_words: int) -> np.ndarray:
    """Which of the `size` words of a block stand in a window that starts in an earlier document too."""
    starts = np.zeros(size + 1, np.int64)
    item, text, at, width = places.T
    later = ids[text] > first[item]
    for window in range(int(width.max(initial=0))):
        hit = (width > window) & (later | ((earlier[item] >> np.uint64(window)) & np.uint64(1)).astype(bool))
        starts[at[hit] + window] = 1
    sums = np.concatenate(([0], np.cumsum(starts)))
    ends = np.arange(1, size + 1)
    return sums[ends] > sums[np.maximum(ends - min_words, 0)]


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, gram: int | None = None, block_bytes: int = BLOCK_BYTES, hot: int = HOT_PASSAGES) -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `n_removed`, `kept_sha256` of the words kept, one blank between, and `kept_text`.

    `kept_text` is these words, or the text as it was written where none goes.

    Words are what stands between ASCII blanks. A word goes if a window of `min_words` words that covers it also starts in
    a document with a smaller id; windows are judged on the input. Ids are whole numbers. Rows that share an id are one
    document to each other and take nothing from each other; a row with a null id neither loses words nor takes any. A null
    text is empty; whole texts of any length are read; an empty table gives no rows. Other columns are not read. Equality
    is that of the words themselves.
    """
    gram = gram or default_gram(min_words)
    blocks = checkpointed(in_blocks(docs, id_column, text, min_words, gram, block_bytes), "substring-blocks")
    flags = checkpointed(candidates(blocks, hot), "substring-anchors")
    shards = max(1, -(-(flags.agg(F.sum("n_wanted")).first()[0] or 0) // SHARD_PASSAGES))
    items = checkpointed(passages(blocks, flags.filter("n > 0"), min_words, gram, shards), "substring-passages")
    verdicts = checkpointed(matched(items, min_words, shards), "substring-matches")
    found = verdicts.groupBy("block").agg(F.collect_list(F.struct("shard", "first", "earlier")).alias("verdicts"))  # one per shard of the block's passages
    joined = blocks.select("block", "ids", "present", "packed", "lengths").join(items.filter("shard = -1").select("block", "places"), "block", "left").join(found, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                _, ids, present, packed, lengths, places, parts = (batch.column(i)[row].as_py() for i in range(7))
                ids, present, texts = np.frombuffer(ids, np.int64), np.frombuffer(present, bool), unpacked_texts(packed, lengths)
                block = Words(texts)
                gone = np.zeros(len(block.words), bool)
                if places is not None:
                    parts.sort(key=lambda p: p["shard"])
                    first, earlier = (np.concatenate([numbers(p[name], kind) for p in parts]) for name, kind in (("first", np.int64), ("earlier", np.uint64)))
                    gone = removed_words(len(block.words), ids, numbers(places).reshape(-1, 4), first, earlier, min_words)
                ends = block.ends.tolist()
                rows = []
                for lo, hi, whole in zip([0, *ends], ends, texts):
                    drop = gone[lo:hi]
                    removed = int(drop.sum())
                    kept = b" ".join(compress(block.words[lo:hi], ~drop) if removed else block.words[lo:hi])
                    rows.append((hi - lo, removed, hashlib.sha256(kept).hexdigest(), kept if removed else whole))
                doc_ids = pa.array(ids, pa.int64(), mask=~present)
                for at in range(0, len(rows), 256):
                    part = rows[at : at + 256]
                    columns = [pa.array([r[i] for r in part], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([doc_ids.slice(at, len(part)), *columns, pa.array([r[3].decode("utf-8", "surrogatepass") for r in part], pa.string())], RESULT_NAMES)

    return joined.mapInArrow(run, RESULT).withColumnRenamed("doc_id", id_column)


RESULT_NAMES = [part.split()[0] for part in RESULT.split(", ")]

SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
    SELECT n, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, words FROM d
), g AS (
    SELECT n, doc_id, pos, word, CASE WHEN pos + 12 <= len(words) THEN md5(array_to_string(words[pos : pos + 12], ' ')) END AS win FROM w
), f AS (
    SELECT win, min(doc_id) AS first FROM g WHERE win IS NOT NULL GROUP BY win
), m AS (
    SELECT n, pos, word, max(coalesce(first < g.doc_id, false)) OVER (PARTITION BY n ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
    FROM g LEFT JOIN f ON g.win = f.win
), k AS (
    SELECT n, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone), '') AS kept_text FROM m GROUP BY n
)
SELECT doc_id, len(words) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256,
    CASE WHEN n_removed > 0 THEN kept_text ELSE text END AS kept_text
FROM d LEFT JOIN k ON d.n = k.n
"""


@query("op12_substring_dedup", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
