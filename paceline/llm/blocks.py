"""Documents in blocks of bounded bytes: a row per block moves through shuffles instead of a row per document or word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

# Bytes of text at which a block ends; a longer text is a block with what came before it.
BLOCK_BYTES = 4 << 20
# Rows of an Arrow batch that are turned into Python objects at once.
PORTION_ROWS = 256


def portions(batches: Iterable[pa.RecordBatch], rows: int = PORTION_ROWS) -> Iterator[pa.RecordBatch]:
    """Zero-copy parts of batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def grouped_texts(batches: Iterable[pa.RecordBatch], block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, ids, texts) from batches of (id, text); a null text is an empty one.

    The block's number is made of the partition's and a counter, so a task that runs again numbers alike.
    """
    base, n, size = TaskContext.get().partitionId() << 32, 0, 0
    ids: list = []
    texts: list[bytes] = []
    for portion in portions(batches):
        for own, text in zip(portion.column(0).to_pylist(), portion.column(1).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            ids.append(own)
            texts.append(raw)
            size += len(raw)
            if size >= block_bytes:
                yield base + n, ids, texts
                ids, texts, n, size = [], [], n + 1, 0
    if ids:
        yield base + n, ids, texts


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_texts(texts: list[bytes]) -> tuple[bytes, bytes]:
    """All texts as one compressed string, and their lengths."""
    return squeezed(b"".join(texts)), np.array([len(t) for t in texts], np.int64).tobytes()


def unpacked_texts(packed: bytes, lengths: bytes) -> list[bytes]:
    data, ends = unsqueezed(packed), np.cumsum(np.frombuffer(lengths, np.int64)).tolist()
    return [data[lo:hi] for lo, hi in zip([0, *ends], ends)]


def numbers(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(unsqueezed(data), kind)


def pack_numbers(values: np.ndarray, kind: type = np.int64) -> bytes:
    return squeezed(np.ascontiguousarray(values, kind).tobytes())
