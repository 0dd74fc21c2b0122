"""Language ID by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes long is counted over a bounded sample of labelled texts and
then frozen. A symbol seen in a context costs -log2(count / (total + kinds)); else an escape, -log2(kinds / (total +
kinds)), is paid and the next shorter context decides, down to a uniform byte. The language whose tree codes the text in
the fewest bits is predicted. The trees are laid out as one table, (longest known context, symbol) -> bits for all
languages, so that scoring is two array lookups per byte.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.common import query, table, text_batches

UNKNOWN = "und"
ORDER = 3
SLICE = 1 << 20
_TABLES: dict[str, "CodeTable"] = {}


@dataclass
class Counts:
    """Frozen statistics: for each language the 4-byte strings of its sample and how often they occur."""

    langs: list[str]
    grams: list[np.ndarray]  # uint32, oldest byte highest
    counts: list[np.ndarray]
    token: str = field(default_factory=lambda: uuid.uuid4().hex)


def gram_codes(raw: bytes) -> np.ndarray:
    """Each byte with the three before it, as one number; zeros stand before the text."""
    x = np.frombuffer(b"\0" * ORDER + raw, np.uint8).astype(np.uint32)
    return (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]


class CodeTable:
    """Bits of every (context, symbol) in every language."""

    def __init__(self, model: Counts):
        self.langs = model.langs
        used = np.unique(np.concatenate([(g[:, None] >> np.array([24, 16, 8, 0], np.uint32)) & 255 for g in model.grams]).ravel())
        self.size = size = len(used) + 1  # the last symbol is any byte no sample has
        self.symbols = np.full(256, len(used), np.int64)
        self.symbols[used] = np.arange(len(used))
        grams = [self._symbol_digits(g) for g in model.grams]
        pairs = np.unique(np.concatenate([d[1] * size + d[2] for d in grams]))
        triples = np.unique(np.concatenate([(d[0] * size + d[1]) * size + d[2] for d in grams]))
        # Rows of the table: one-byte contexts, then two-byte, then three-byte contexts that some language has.
        row2 = np.tile(np.arange(size), size)
        row2[pairs] = size + np.arange(len(pairs))
        self.rows = np.tile(row2, size).astype(np.int32)
        self.rows[triples] = size + len(pairs) + np.arange(len(triples))
        bits = np.empty((size + len(pairs) + len(triples), size, len(grams)), np.float32)
        for k, (digits, counts) in enumerate(zip(grams, model.counts)):
            a, b, c, s = digits
            flat = self._level(np.full((1, size), 1 / 256), np.zeros(size, np.int64) * 0 + 0, np.zeros(len(s), np.int64), s, counts, 1)
            one = self._level(flat, np.zeros(size, np.int64), c, s, counts, size)
            two = self._level(one, pairs % size, np.searchsorted(pairs, b * size + c), s, counts, len(pairs))
            below = np.searchsorted(pairs, triples % (size * size))
            three = self._level(two, below, np.searchsorted(triples, (a * size + b) * size + c), s, counts, len(triples))
            bits[:, :, k] = -np.log2(np.concatenate([one, two, three]))
        self.bits = bits.reshape(-1, len(grams))

    def _symbol_digits(self, grams: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(self.symbols[(grams >> shift) & 255] for shift in (24, 16, 8, 0))

    def _level(self, shorter: np.ndarray, below: np.ndarray, context: np.ndarray, symbol: np.ndarray, counts: np.ndarray, contexts: int) -> np.ndarray:
        """Probabilities of one context length from those of the next shorter one; `below` names each context's shorter one."""
        seen = np.zeros((contexts, self.size))
        np.add.at(seen, (context, symbol), counts)
        total, kinds = seen.sum(1), (seen > 0).sum(1)
        escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
        inherited = shorter[below[:contexts] if len(shorter) > 1 else np.zeros(contexts, np.int64)] * escape[:, None]
        return np.where(seen > 0, seen / np.maximum(total + kinds, 1)[:, None], inherited)

    def bits_of(self, raw: bytes) -> np.ndarray:
        """Code length of a whole text in each language."""
        total = np.zeros(len(self.langs))
        s = self.symbols[np.frombuffer(b"\0" * ORDER + raw, np.uint8)]
        for lo in range(0, len(raw), SLICE):
            part = s[lo : lo + SLICE + ORDER]
            context = self.rows[(part[:-3] * self.size + part[1:-2]) * self.size + part[2:-1]]
            total += self.bits[context.astype(np.int64) * self.size + part[3:]].sum(0, dtype=np.float64)
        return total


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = 300, where: Column | None = None) -> Counts:
    """Learn from at most `docs_per_lang` ids of each language, those of smallest hash, in whole texts.

    Only rows with an id, a text and a language, outside the held-out fold, or `where` instead of that. What reaches the
    driver is bounded by the distinct 4-byte strings of this sample.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(~held_out(F.col("id")) if where is None else where)
    rows = rows.filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = rows.select("id", "lang").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= docs_per_lang).select("id", "lang").distinct()
    sample = rows.join(picked, ["id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(name, []).append(gram_codes(value.encode("utf-8", "surrogatepass")))
            for name, codes in by_lang.items():
                grams, counts = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

    text_batches(docs.sparkSession)
    found = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    parts = [found[found["lang"] == name].sort_values("gram") for name in langs]
    return Counts(langs, [p["gram"].to_numpy().astype(np.uint32) for p in parts], [p["n"].to_numpy().astype(np.int64) for p in parts])


def predict(model: Counts, spark: SparkSession):
    """A function of a text column: struct of `lang_pred`, `score` and `bits_per_byte`.

    A text that is null or has no letter, and every text where nothing was learned, is `und` with score 0 and no bits.
    Ties go to the language first in order. `score` is the posterior of the winner under equal priors.
    """
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits_per_byte double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        if counts.langs and counts.token not in _TABLES:
            _TABLES.clear()
            _TABLES[counts.token] = CodeTable(counts)
        codes = _TABLES.get(counts.token)
        for batch in texts:
            rows = []
            for value in batch:
                if codes is None or value is None or not any(map(str.isalpha, value)):
                    rows.append((UNKNOWN, 0.0, None))
                    continue
                raw = value.encode("utf-8", "surrogatepass")
                bits = codes.bits_of(raw)
                best = int(bits.argmin())
                rows.append((codes.langs[best], float(1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum()), float(bits[best] / len(raw))))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "bits_per_byte"])

    return score


def identify(docs: DataFrame, model: Counts, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, `held_out`, `lang_pred`, `score`, `bits_per_byte`. Other columns are not read.

    A null id is not held out; repeated rows get the same result each; whole texts of any length are scored; an empty table
    gives no rows.
    """
    score = predict(model, docs.sparkSession)
    rows = docs.select(F.col(id_column), held_out(F.col(id_column)).alias("held_out"), score(F.col(text)).alias("found"))
    return rows.select(id_column, "held_out", "found.*")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
