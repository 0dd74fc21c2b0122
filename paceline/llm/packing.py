"""Packing: documents cut and dealt into sequences of bounded length with balanced attention cost.

Texts are tokenised once; the pieces, at most one sequence long, are written to shared storage. Whole pieces fill a
sequence each. The others are dealt by row number into groups of bounded size, which are packed side by side: pieces go
in descending order to the sequence of lowest cost (linear plus quadratic in the lengths of its pieces) that has room.
A group gets as few sequences as its tokens need; a piece that fits nowhere is cut, so that only the last free places
of a group are padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from paceline.llm.common import checkpointed, query, table, text_batches

CAPACITY = 4096
END = 2
# Tokens of one group: a thousand sequences, 16 MB of ids at most.
GROUP_TOKENS = 1 << 22
# Words that the table of a worker holds before it starts anew: about 200 bytes each.
TABLE_WORDS = 900_000
# Chunks of these characters need no normalisation but lower case, and split into runs of letters and of other marks.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?()\-]+")
RUNS = re.compile(r"[a-zß-öø-ÿ]+|[.,;:!?()\-]+")
# The normalisation and the splitting for which words stand alone, as tokenizer files write them.
WORD_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
WORD_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
WORD_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
_TOKENIZERS: dict[str, "WordTokenizer"] = {}


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def words_stand_alone(file: str) -> bool:
    """Whether the file's tokenizer lower-cases, drops white space and splits words as `WordTokenizer` does."""
    with open(file, encoding="utf-8") as text:
        spec = json.load(text)
    model = spec["model"]
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
    return plain and spec["normalizer"] == WORD_NORMALIZER and spec["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [WORD_SPLIT, WORD_BYTES]}


class WordTokenizer:
    """Ids of texts under a tokenizer that drops white space, each distinct word tokenised once.

    Splitting at ASCII blanks is safe for such a tokenizer; a chunk of plain letters and marks goes run by run to the
    model, any other chunk to the whole tokenizer. Under any other tokenizer whole texts go to it.
    """

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.safe = words_stand_alone(file)
        self.model = self.tokenizer.model
        self.bytes = byte_characters()
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, list[int]] = {}

    @classmethod
    def of(cls, file: str) -> "WordTokenizer":
        if file not in _TOKENIZERS:
            _TOKENIZERS[file] = cls(file)
        return _TOKENIZERS[file]

    def run(self, run: str) -> list[int]:
        ids = self.runs.get(run)
        if ids is None:
            ids = [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.bytes))]
            self.runs[run] = ids
        return ids

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            ids = [i for run in RUNS.findall(word.lower()) for i in self.run(run)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.array(ids, self.dtype).tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of a text as machine integers of `dtype`."""
        if not self.safe:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if len(self.words) > TABLE_WORDS:
            self.words.clear()
        if len(self.runs) > TABLE_WORDS:
            self.runs.clear()
        words, parts = self.words, []
        for word in re.split(r"[ \n\t\r]+", text) if "\t" in text or "\r" in text else text.replace("\n", " ").split(" "):
            found = words.get(word)
            if found is None:
                found = words[word] = self.word(word) if word else b""
            parts.append(found)
        return b"".join(parts)


PIECES = "doc_id {kind}, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, ids binary"


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, tokenizer_file: str, id_column: str, text: str, capacity: int) -> DataFrame:
    """Consecutive pieces of every document, all but its last `capacity` ids long; only the shorter ones carry ids."""
    text_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.of(tokenizer_file)
        for batch in batches:
            owner, rows = [], []
            for at, value in enumerate(batch.column(1).to_pylist()):
                ids = np.frombuffer(tokenizer.ids(value or "") + np.array([END], tokenizer.dtype).tobytes(), tokenizer.dtype)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    owner.append(at)
                    rows.append((start, len(piece), len(ids), crc(piece), piece.tobytes() if len(piece) < capacity else None))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    return picked.mapInArrow(run, PIECES.format(kind=picked.schema[0].dataType.simpleString()))


def assign(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) with every token placed in one of ceil(total / capacity) sequences."""
    sequences = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(sequences, capacity), np.zeros(sequences)
    placed = []
    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            fitting = np.flatnonzero(room >= left)
            # Cut only what fits nowhere, at the sequence with most room.
            at = int(fitting[cost[fitting].argmin()]) if len(fitting) else int(room.argmax())
            length = min(left, int(room[at]))
            placed.append((piece, start, length, at, capacity - int(room[at])))
            room[at] -= length
            cost[at] += linear * length + quadratic * length * length
            start, left = start + length, left - length
    return placed


def pack(
    docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1.0 / 1024, group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: id, `start`, `length`, `ids_crc32`, `doc_tokens`, `sequence_id`, `offset`.

    Each id of a document, with the end id behind its text, lies in exactly one piece. A null text is empty: its end id
    alone. Repeated rows are packed each; a null id stays null; ties of length keep their order in the group; an empty
    table gives no rows. Other columns are not read. Less than `capacity` places per group are padding.
    """
    cut = checkpointed(pieces(docs, tokenizer_file, id_column, text, capacity), "packing-pieces")
    total = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    dtype = WordTokenizer.of(tokenizer_file).dtype
    # Written rows have fixed numbers, so a task that runs again deals them alike.
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def pack_group(key: tuple, group: pa.Table) -> pa.Table:
        base = key[0].as_py() << 32
        length = group.column("length").to_numpy()
        crcs = group.column("ids_crc32").to_numpy()
        start = group.column("start").to_numpy()
        whole = np.flatnonzero(length == capacity)
        short = np.flatnonzero(length < capacity)
        ids = group.column("ids")
        rows = [(at, start[at], capacity, crcs[at], base + n, 0) for n, at in enumerate(whole.tolist())]
        for piece, first, size, sequence, offset in assign(length[short], capacity, linear, quadratic):
            at = int(short[piece])
            value = crcs[at] if size == length[at] else crc(np.frombuffer(ids[at].as_py(), dtype)[first : first + size])
            rows.append((at, start[at] + first, size, value, base + len(whole) + sequence, offset))
        owner = pa.array([row[0] for row in rows], pa.int64())
        column = lambda i: pa.array([int(row[i]) for row in rows], pa.int64())
        return pa.table([group.column("doc_id").take(owner), column(1), column(2), column(3), group.column("doc_tokens").take(owner), column(4), column(5)], names)

    kind = cut.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("grp").applyInArrow(pack_group, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in names[1:]))
    return packed.withColumnRenamed("doc_id", id_column)


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
