"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the vocabulary has a character before a blank mark, no merge crosses the place before a mark, and a
text may be cut there: each chunk, marks and the word behind them, is segmented alone. Every block of texts is turned
into positions over its distinct chunks; chunks that the table does not hold yet are segmented and decoded once, in
one call of the library, and each text joins its ids back by position. The table outlives the block in its worker,
up to a bound, so frequent words are segmented once per worker. A table shared by all workers would have to be
shuffled: see the README for what that costs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from sentencepiece import sentencepiece_model_pb2 as model_format

from paceline.llm.common import query, table, text_batches

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
# Chunks that the table of a worker holds before it starts anew: about 350 bytes each.
TABLE_CHUNKS = 600_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_CODECS: dict[str, "ChunkCodec"] = {}


def cuts_are_safe(model_file: str) -> bool:
    """Whether texts may be cut before blank marks: plain normalisation, no piece over a mark, none forced by the user."""
    model = model_format.ModelProto()
    with open(model_file, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces
    kinds = {NORMAL, UNKNOWN, CONTROL, BYTE}
    return plain and model.trainer_spec.byte_fallback and all(p.type in kinds and not re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)


class ChunkCodec:
    """Keys are chunks without their first mark; values (decimal ids, number of ids, decoded chunk with its blank)."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.safe = cuts_are_safe(model_file)
        self.end = self.model.eos_id()
        self.table: dict[str, tuple[str, int, str]] = {}

    @classmethod
    def of(cls, model_file: str) -> "ChunkCodec":
        if model_file not in _CODECS:
            _CODECS[model_file] = cls(model_file)
        return _CODECS[model_file]

    @staticmethod
    def keys(text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [chunk[1:] for chunk in CHUNK.findall(MARK + text.replace(" ", MARK))]

    def learn(self, chunks: set[str]) -> None:
        """Segment and decode chunks that the table lacks."""
        if len(self.table) + len(chunks) > TABLE_CHUNKS:
            self.table.clear()
        new = [chunk for chunk in chunks if chunk not in self.table]
        # An empty key is a mark alone, which the library would take for an empty text.
        ids = [row if key else [self.model.piece_to_id(MARK)] for key, row in zip(new, self.model.encode(new, num_threads=1))]
        decoded = self.model.decode(ids, num_threads=1) if ids else []
        # Decoding drops the one blank that encoding puts before a text.
        self.table.update((key, (" ".join(map(str, row)), len(row), " " + back)) for key, row, back in zip(new, ids, decoded))

    def block(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, decimal ids joined by blanks, decoded text) of each text, the end id included."""
        if not self.safe:
            rows = [[*row, self.end] for row in self.model.encode(texts, num_threads=1)]
            return [(len(row), " ".join(map(str, row)), back) for row, back in zip(rows, self.model.decode(rows, num_threads=1))]
        positions = [self.keys(text) for text in texts]
        self.learn({key for keys in positions for key in keys})
        result = []
        for keys in positions:
            found = [self.table[key] for key in keys]
            result.append((sum([f[1] for f in found]) + 1, " ".join([*[f[0] for f in found], str(self.end)]), "".join([f[2] for f in found])[1:]))
        return result


def encode(docs: DataFrame, model_file: str, id_column: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of `docs`: id, `n_tokens` (end id included), `ids_sha256`, `decoded_sha256`, and with `with_text` `ids` (decimal, one blank between) and `decoded`.

    A null text is empty: the end id alone. Whole texts are encoded; repeated rows are encoded each; a null id stays null;
    an empty table gives no rows; other columns are not read. `model_file` must be readable on the workers.
    """
    text_batches(docs.sparkSession)
    picked = docs.select(id_column, text)
    extra = ["ids", "decoded"] if with_text else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec.of(model_file)
        digest = lambda value: hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            rows = codec.block([value or "" for value in batch.column(1).to_pylist()])
            counts, ids, decoded = ([row[i] for row in rows] for i in range(3))
            columns = [pa.array(counts, pa.int64()), pa.array(map(digest, ids), pa.string()), pa.array(map(digest, decoded), pa.string())]
            columns += [pa.array(ids, pa.string()), pa.array(decoded, pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_column, "n_tokens", "ids_sha256", "decoded_sha256", *extra])

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + "".join(f", {c} string" for c in extra))


@query("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_text=False)
