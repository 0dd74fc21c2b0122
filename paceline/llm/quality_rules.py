"""Quality rules: per-text measures, and lines that too many documents of one host share.

Texts are read once in Python, which leaves narrow rows: measures, and hash and word count of each distinct line. All
that crosses documents is done on those. Copies of a text count as one document of its host, so they are folded
before lines are counted; counts are combined before the shuffle, and frequent lines meet documents in an equi-join
whose hot keys adaptive execution may split.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table, text_batches, text_key

SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Numbers count as one, so that dates and page numbers do not tell lines apart.
NUMBER = re.compile(rb"[0-9]+")
WINDOW = 5


def line_hash(line: bytes) -> int:
    """Signed 64 bits of a line in ASCII lower case with single blanks and numbers as zero."""
    value = xxhash.xxh64_intdigest(b" ".join(NUMBER.sub(b"0", line.lower()).split()))
    return value - (1 << 64) if value >> 63 else value


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 5-word window found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def measure(text: str | None) -> tuple[tuple[int, ...], list[dict]]:
    """The measures, and hash and words of each distinct line."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup_lines, line_words = set(), 0, Counter()
    for line in raw.split(b"\n"):
        n = len(line.split())
        if n:
            dup_lines += line in seen
            seen.add(line)
            line_words[line_hash(line)] += n
    blanks = sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(raw.count(bytes([s])) for s in SYMBOLS)
    return (len(words), len(text) - blanks, symbols, dup_lines, repeat_words(words)), [{"h": h, "w": w} for h, w in line_words.items()]


def host_name(host: Column) -> Column:
    """A null host is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))


def measured(docs: DataFrame, id_column: str, text: str, host: str) -> DataFrame:
    """Id, host, text key, measures and lines of every row."""
    text_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column), host_name(F.col(host)).alias("host"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t) for t in batch.column(3).to_pylist()]
            columns = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns, pa.array([r[1] for r in rows], LINES)], [id_column, "host", "key", *MEASURES, "lines"])

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_column}` {kind}, host string, key binary, {', '.join(f'{m} bigint' for m in MEASURES)}, lines array<struct<h:bigint,w:bigint>>")


def frequent_lines(texts: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h) of lines in more than `min_docs` and more than `share` of the distinct texts of a host."""
    counts = texts.select("host", F.explode("lines.h").alias("h")).groupBy("host", "h").count().filter(F.col("count") > min_docs)
    hosts = texts.groupBy("host").agg(F.count("*").alias("texts"))
    return counts.join(hosts, "host").filter(F.col("count") > share * F.col("texts")).select("host", "h")


def quality_rules(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = 20, share: float = 0.05, max_removed: float = 0.6, min_left: int = 5, min_words: int = 10, max_repeat: int = 20,
) -> DataFrame:
    """One row per row of `docs`: id, measures, `base_failed`, `removed_words`, `frequent` (hashes of its lines above the limit), `kept`, and `host` and `key`, which name its text.

    A line is above the limit where more than `min_docs` distinct texts of the host and more than `share` of them hold
    it. A document is depleted where over `max_removed` of its words, or all but `min_left` - 1, stand in such lines and
    at least one does. A null text is empty and fails the base rule; a null host is a host of its own; repeated rows and
    copies get the same verdict each, and count as one text. Whole texts of any length are read; an empty table gives no
    rows. Other columns are not read.
    """
    rows = checkpointed(measured(docs, id_column, text, host), "quality-rows")
    # `lines` is a function of the text, so any value of a group is the same.
    texts = rows.groupBy("host", "key").agg(F.any_value("lines").alias("lines"))
    frequent = frequent_lines(texts, min_docs, share)
    removed = (
        texts.select("host", "key", F.inline("lines"))
        .join(frequent, ["host", "h"])
        .groupBy("host", "key")
        .agg(F.sum("w").alias("removed_words"), F.collect_set("h").alias("frequent"))  # at most the lines of one text
    )
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((F.col("removed_words") > max_removed * F.col("n_words")) | (left < min_left))
    result = rows.drop("lines").join(removed, ["host", "key"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    return result.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(text: str | None, frequent: list[int] | None) -> str | None:
    """A text without the lines whose hash is in `frequent`."""
    if text is None or not frequent:
        return text
    drop = set(frequent)
    return "\n".join(line for line in text.split("\n") if not line.split() or line_hash(line.encode("utf-8", "surrogatepass")) not in drop)


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept", "removed_words")
