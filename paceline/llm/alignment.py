"""Cross-tokenizer alignment: groups of tokens of two tokenizers that cover the same bytes, and how often ids overlap in the corpus.

The ends of both tokenisations are merged into one path. Diagonals cut it into pieces of equal work: a binary search on
each finds how many ends of either side lie before it, so pieces know all they need and are merged independently. A piece
emits its overlaps and counts the common ends in it; a group that crosses a cut is stitched by the sum of these counts.

Neither tokenizer has a token across a single blank that a visible character follows, so a chunk up to there is encoded
once for each block that holds it (once for a worker, if its table holds it), and new chunks are laid end to end on one
path. A document is a row of chunk numbers.

Blocks count their distinct id pairs; partial sums of these are all that is shuffled for the corpus-wide counts, and each
block gets the counts of its own pairs back.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from paceline.llm.blocks import grouped_texts, numbers, pack_numbers
from paceline.llm.common import checkpointed, query, table
from paceline.llm.packing import byte_characters
from paceline.llm.piece_encoding import MARK, cuts_are_safe

# Ends of one piece of the path, bytes of text of a block, and chunks that the table of a worker holds before it starts anew.
PIECE_ENDS = 1 << 16
BLOCK_BYTES = 4 << 20
TABLE_CHUNKS = 100_000
# Chunks of more characters are not kept in the table.
LONG_CHUNK = 64
# Chunks, and characters of them, that are encoded at once: the libraries' own results are far larger than the ids.
PORTION_CHUNKS, PORTION_CHARACTERS = 1 << 13, 1 << 18
# White space to some versions of Unicode only.
FORMER_SPACE = "᠎"
_PAIRS: dict[tuple[str, str], "TokenizerPair"] = {}


def split_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of `a` are among the first so many elements of the merge of two sorted rows, of equal ones those of `a` first."""
    low, high = np.maximum(0, diagonals - len(b)), np.minimum(diagonals, len(a))
    while (low < high).any():
        open_ = low < high
        middle = (low + high) // 2
        before = np.zeros(len(low), bool)
        before[open_] = a[middle[open_]] <= b[diagonals[open_] - middle[open_] - 1]
        low, high = np.where(open_ & before, middle + 1, low), np.where(open_ & ~before, middle, high)
    return low


def merged_piece(a: np.ndarray, b: np.ndarray, cut: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """One piece of the path: overlapping tokens (two rows), groups of the tokens that end here counted from the cut, common ends."""
    i0, i1, j0, j1 = cut
    before = max(a[i0 - 1] if i0 else 0, b[j0 - 1] if j0 else 0)
    values = np.concatenate((a[i0:i1], b[j0:j1]))
    order = np.argsort(values, kind="stable")
    values, from_a = values[order], order < i1 - i0
    # An end that is there for the second time is common to both.
    common = values == np.concatenate(([before], values[:-1]))
    done_a = np.cumsum(from_a) - from_a
    done_b = np.arange(len(values)) - done_a
    group = np.cumsum(common) - common
    return i0 + done_a[~common], j0 + done_b[~common], group[from_a], group[~from_a], int(common.sum())


def aligned(a: np.ndarray, b: np.ndarray, piece: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps of two tokenisations of the same bytes, given their ends: (token of a, token of b) rows, and the group of each token."""
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, piece), total)
    i = split_path(a, b, diagonals)
    j = diagonals - i
    pieces = [merged_piece(a, b, cut) for cut in zip(i.tolist(), i[1:].tolist(), j.tolist(), j[1:].tolist())]
    stitch = np.cumsum([0, *(p[4] for p in pieces)])
    parts = [(p[0], p[1], p[2] + s, p[3] + s) for p, s in zip(pieces, stitch)]
    return tuple(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in range(4))


class Aligned:
    """Chunks side by side: token counts, groups, overlaps and the text of the groups; `good` where the tokens give the bytes back."""

    def __init__(self, size: int):
        self.counts = np.zeros((size, 4), np.int64)
        self.good = np.zeros(size, bool)
        self.links: list[bytes] = [b""] * size
        self.groups: list[bytes] = [b""] * size

    def put(self, at: int, entry: tuple | None) -> None:
        if entry is not None:
            self.good[at] = True
            self.counts[at], self.links[at], self.groups[at] = entry


class TokenizerPair:
    """Entries of chunks: (tokens of A, tokens of B, groups, overlaps), id pairs of the overlaps, text of the groups; None where bytes differ."""

    def __init__(self, file_a: str, file_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        self.may_cut = cuts_are_safe(file_b)
        byte_of = {c: b for b, c in byte_characters().items()}
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for entry, own in vocabulary.items():
            self.bytes_a[own] = bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode()
        self.bytes_b = []
        for own in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(own)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(own) else piece.replace(MARK, " ").encode())
        self.lengths = [np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b)]
        # Decimal ids with the mark that follows: inside a side of a group, or behind it.
        self.marked = [[b"%d%b" % (n, mark) for mark in (b",", last) for n in range(len(side))] for side, last in ((self.bytes_a, b"|"), (self.bytes_b, b";"))]
        self.table: dict[str, tuple | None] = {}

    @classmethod
    def of(cls, file_a: str, file_b: str) -> "TokenizerPair":
        if (file_a, file_b) not in _PAIRS:
            _PAIRS[file_a, file_b] = cls(file_a, file_b)
        return _PAIRS[file_a, file_b]

    def aligned_chunks(self, chunks: list[str]) -> Aligned:
        result, new, characters = Aligned(len(chunks)), [], 0
        for at, chunk in enumerate(chunks):
            if chunk in self.table:
                result.put(at, self.table[chunk])
                continue
            new.append(at)
            characters += len(chunk)
            if len(new) >= PORTION_CHUNKS or characters >= PORTION_CHARACTERS:
                self.learn(chunks, new, result)
                new, characters = [], 0
        self.learn(chunks, new, result)
        return result

    def learn(self, chunks: list[str], new: list[int], result: Aligned) -> None:
        """Encode the chunks at these places; the table keeps those it meets first, which are the frequent ones."""
        for at, entry in zip(new, self.entries([chunks[at] for at in new])):
            result.put(at, entry)
            if len(self.table) < TABLE_CHUNKS and len(chunks[at]) <= LONG_CHUNK:
                self.table[chunks[at]] = entry

    def entries(self, chunks: list[str]) -> list[tuple | None]:
        """Encode chunks, each behind a blank, and align them on one path."""
        sides = [[e.ids for e in self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)] if chunks else [], self.b.encode(chunks, num_threads=1) if chunks else []]
        wanted = [(" " + c).encode("utf-8", "surrogatepass") for c in chunks]
        good = [n for n, w in enumerate(wanted) if all(b"".join([of[i] for i in side[n]]) == w for side, of in zip(sides, (self.bytes_a, self.bytes_b)))]
        if not good:
            return [None] * len(chunks)
        counts = [np.array([len(side[n]) for n in good]) for side in sides]
        ids = [np.fromiter((i for n in good for i in side[n]), np.int64, int(c.sum())) for side, c in zip(sides, counts)]
        link_a, link_b, *groups = aligned(*(np.cumsum(of[i]) for of, i in zip(self.lengths, ids)))
        ends = [np.cumsum(c) for c in counts]
        last_group = groups[0][ends[0] - 1] + 1  # every chunk ends with a common end
        n_groups = np.diff(np.concatenate(([0], last_group)))
        link_ends = np.searchsorted(link_a, ends[0])
        pairs = ids[1][link_b] << 32 | ids[0][link_a]
        in_group = [np.bincount(g, minlength=int(last_group[-1])) for g in groups]
        before_b, upto_a = np.cumsum(in_group[1]) - in_group[1], np.cumsum(in_group[0])
        places = [np.arange(len(ids[0])) + before_b[groups[0]], np.arange(len(ids[1])) + upto_a[groups[1]]]
        texts = np.empty(len(ids[0]) + len(ids[1]), object)
        for side in range(2):
            group = groups[side]
            last = np.concatenate((group[1:] != group[:-1], [True]))
            marked = self.marked[side]
            texts[places[side]] = [marked[i] for i in (ids[side] + last * len(self.lengths[side])).tolist()]
        texts, cuts = texts.tolist(), (ends[0] + ends[1]).tolist()
        result: list[tuple | None] = [None] * len(chunks)
        rows = np.stack((counts[0], counts[1], n_groups, np.diff(np.concatenate(([0], link_ends)))), 1)
        for at, row, lo, hi, first, to in zip(good, rows.tolist(), [0, *cuts], cuts, [0, *link_ends.tolist()], link_ends.tolist()):
            result[at] = (row, pairs[first:to].tobytes(), b"".join(texts[lo:hi]))
        return result


class Chunks(dict):
    """Numbers of chunks in the order in which they are met; `edge` tells those before which no text may be cut."""

    def __init__(self):
        self.names: list[str] = []
        self.edge: list[bool] = []

    def __missing__(self, chunk: str) -> int:
        own = self[chunk] = len(self.names)
        self.names.append(chunk)
        self.edge.append(not chunk or chunk[0].isspace() or chunk[0] == FORMER_SPACE)
        return own


def joined_chunks(chunks: list[str], edge: list[bool]) -> list[str]:
    """Chunks put together again where a token may cross: before white space, and behind one of several blanks."""
    runs = [[chunks[0]]]
    for before, chunk, at_edge in zip(chunks, chunks[1:], edge[1:]):
        if at_edge or not before:
            runs[-1].append(chunk)
        else:
            runs.append([chunk])
    return [" ".join(run) for run in runs]


def chunk_rows(texts: list[str], may_cut: bool) -> tuple[list[str], list[np.ndarray]]:
    """The distinct chunks of a block, and each text as a row of their numbers; texts without tokens have none."""
    chunks, rows = Chunks(), []
    for text in texts:
        if not text or MARK in text:  # a mark would come back as a blank
            rows.append(np.zeros(0, np.int64))
            continue
        parts = text.split(" ") if may_cut else [text]
        row = [chunks[c] for c in parts]
        edge = [chunks.edge[n] for n in row]
        if any(edge) and len(parts) > 1:
            row = [chunks[c] for c in joined_chunks(parts, edge)]
        rows.append(np.array(row, np.int64))
    return chunks.names, rows


BLOCKS = "block bigint, ids array<{kind}>, counts binary, groups binary, sizes binary, chunks binary, link_sizes binary, links binary, pairs binary, pair_counts binary"


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these sizes, empty ones too."""
    ends = np.cumsum(sizes)
    total = np.concatenate((np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, 0)))
    return total[ends] - total[ends - sizes]


def aligned_blocks(docs: DataFrame, file_a: str, file_b: str, id_column: str, text: str, block_bytes: int) -> DataFrame:
    """Blocks of documents: finished columns of each, its chunks, and the distinct id pairs of the block with their overlaps."""
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TokenizerPair.of(file_a, file_b)
        for block, ids, raws in grouped_texts(batches, block_bytes):
            distinct, rows = chunk_rows([raw.decode("utf-8", "surrogatepass") for raw in raws], pair.may_cut)
            used = np.unique(np.concatenate(rows)) if rows else np.zeros(0, np.int64)
            number = np.zeros(len(distinct), np.int64)
            number[used] = np.arange(len(used))
            chunks = pair.aligned_chunks([distinct[n] for n in used.tolist()])
            rows = [number[row] for row in rows]
            rows = [row if chunks.good[row].all() else row[:0] for row in rows]
            sizes, flat = np.array([len(row) for row in rows], np.int64), np.concatenate(rows)
            digests = b"".join(hashlib.sha256(b"".join([chunks.groups[n] for n in row.tolist()])[:-1]).digest() if len(row) else bytes(32) for row in rows)
            link_sizes = chunks.counts[:, 3]
            pairs, links = np.unique(np.frombuffer(b"".join(chunks.links), np.int64), return_inverse=True)
            times = np.repeat(np.bincount(flat, minlength=len(used)), link_sizes)
            pair_counts = np.bincount(links, times, minlength=len(pairs)).astype(np.int64)
            columns = [pack_numbers(sums(chunks.counts[flat], sizes)), digests, pack_numbers(sizes), pack_numbers(flat, np.uint32), pack_numbers(link_sizes, np.uint32), pack_numbers(links, np.uint32)]
            columns += [pack_numbers(pairs), pack_numbers(pair_counts)]
            values = [pa.array([block], pa.int64()), pa.array([ids], pa.list_(id_type)), *(pa.array([c], pa.binary()) for c in columns)]
            yield pa.RecordBatch.from_arrays(values, names)

    id_type = to_arrow_type(picked.schema[0].dataType)
    names = [part.split()[0] for part in BLOCKS.split(", ")]
    return picked.mapInArrow(run, BLOCKS.format(kind=picked.schema[0].dataType.simpleString()))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, place, pair, n): the distinct id pairs of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, counts in zip(*(column.to_pylist() for column in batch.columns)):
                pairs, counts = numbers(pairs), numbers(counts)
                for at in range(0, len(pairs), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    size = len(pairs[part])
                    columns = [np.full(size, block), np.arange(at, at + size, dtype=np.int32), pairs[part], counts[part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "place", "pair", "n"])

    return blocks.select("block", "pairs", "pair_counts").mapInArrow(run, "block bigint, place int, pair bigint, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, total, best): the overlaps of each id pair in the corpus, and whether they are the most for its B id."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("total"))
    totals = checkpointed(totals, "alignment-counts").withColumn("b", F.shiftright("pair", 32))
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


RESULT = "doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(docs: DataFrame, file_a: str, file_b: str, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`.

    `file_a` is a byte-level tokenizer, which gets a blank before the text, `file_b` a sentencepiece model, which adds one;
    strings of special tokens are plain text. A pair's count is the number of overlaps in all rows. Null and empty texts,
    and those that either side does not give back byte by byte, have no tokens: zeros and an empty digest. Repeated rows
    count each; a null id stays null; whole texts of any length are read; an empty table gives no rows. Other columns are
    not read. Both files must be readable on the workers.
    """
    blocks = checkpointed(aligned_blocks(docs, file_a, file_b, id_column, text, block_bytes), "alignment-blocks")
    pairs = checkpointed(block_pairs(blocks), "alignment-pairs")
    # The pairs of one block, which its bytes bound, go back to it.
    known = pairs.join(pair_counts(pairs), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "total", "best")).alias("known"))
    joined = blocks.drop("pairs", "pair_counts").join(known, "block", "left")
    order = ["ids", "counts", "groups", "sizes", "chunks", "link_sizes", "links", "known"]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0).slice(row, 1).flatten()
                counts, digests, sizes, chunks, link_sizes, links = (batch.column(n)[row].as_py() for n in range(1, 7))
                counts, sizes, link_sizes = numbers(counts).reshape(-1, 4), numbers(sizes), numbers(link_sizes, np.uint32).astype(np.int64)
                links, chunks = numbers(links, np.uint32), numbers(chunks, np.uint32)
                scores = np.zeros((0, 2), np.int64)
                if len(links):
                    found = batch.column(7).slice(row, 1).flatten()
                    place, total, best = (found.field(n).to_numpy(zero_copy_only=False) for n in range(3))
                    scores = np.zeros((len(place), 2), np.int64)
                    scores[place, 0], scores[place, 1] = best, total
                # Per overlap, then per chunk, then per document.
                per_doc = sums(sums(scores[links], link_sizes)[chunks], sizes)
                digest = [digests[32 * n : 32 * n + 32].hex() if size else "" for n, size in enumerate(sizes.tolist())]
                columns = [*counts.T, *per_doc.T]
                values = [ids, *(pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays(values, names)

    kind = docs.schema[id_column].dataType.simpleString()
    return joined.select(*order).mapInArrow(run, RESULT.format(kind=kind)).withColumnRenamed("doc_id", id_column)


@query("op13_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
