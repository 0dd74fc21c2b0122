"""License scans: exact phrases, and a fuzzy search for short notices.

A notice with at most k edits keeps one of k + 1 pieces of it unchanged (pigeonhole). The pieces are searched as plain
byte strings; around each hit the regex library's bounded-error match decides, counts the edits and gives the span.
All work is per row: nothing is shuffled and a hot source or a group of copies costs no more than other rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from paceline.llm.common import query, table, text_batches

# Base phrases and their labels: fixed values of the query.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# (label, notice, most edits in characters).
NOTICES = (
    ("mit", "released under the mit license", 3),
    ("apache", "licensed under the apache license version 2 0", 4),
    ("gpl", "licensed under the gnu general public license", 4),
    ("cc-by-nc", "licensed under cc by nc 4 0", 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 6),
)
SPANS = "array<struct<label:string,first_word:bigint,last_word:bigint,errors:int>>"
# Letters and digits as they are, A-Z lowered, other ASCII to blanks; bytes of other characters belong to words.
WORD_BYTES = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def seeds(notice: str, errors: int) -> list[tuple[int, str]]:
    """`errors + 1` pieces of about the same length with their offsets."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(lo, notice[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


class NoticeSearch:
    def __init__(self, notices: Sequence[tuple[str, str, int]], phrases: dict[str, str]):
        self.notices = [
            (label, notice, errors, seeds(notice, errors), [piece.encode() for _, piece in seeds(notice, errors)], regex.compile(f"(?:{regex.escape(notice)}){{e<={errors}}}", regex.BESTMATCH))
            for label, notice, errors in notices
        ]
        self.phrases = {phrase.encode(): label for phrase, label in phrases.items()}
        # One look-ahead for all phrases: a place may lie inside another.
        self.exact = re.compile(b"(?<= )(?=(" + b"|".join(map(re.escape, self.phrases)) + b") )")
        self.last_words = {phrase.rpartition(b" ")[2] for phrase in self.phrases}

    def fuzzy(self, words: bytes) -> list[dict]:
        found, text = {}, None
        for label, notice, errors, pieces, raw, pattern in self.notices:
            if not any(piece in words for piece in raw):
                continue
            text = text if text is not None else words.decode()
            for offset, piece in pieces:
                at = text.find(piece)
                while at >= 0:
                    lo = max(0, at - offset - errors)
                    hit = pattern.search(text, lo, min(len(text), at - offset + len(notice) + errors))
                    if hit:
                        start, end = hit.span()
                        first = text.count(" ", 0, start + (text[start : start + 1] == " ")) - 1
                        last = text.count(" ", 0, end - (text[end - 1 : end] == " ")) - 1
                        kept = found.get((label, first))
                        if kept is None or sum(hit.fuzzy_counts) < kept["errors"]:
                            found[label, first] = {"label": label, "first_word": first, "last_word": last, "errors": sum(hit.fuzzy_counts), "length": len(notice)}
                    at = text.find(piece, at + 1)
        return [found[key] for key in sorted(found, key=lambda key: (key[1], key[0]))]

    def scan(self, text: str | None) -> dict:
        tokens = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        words = b" " + b" ".join(tokens) + b" "
        base = []
        if any(word in words for word in self.last_words):
            base = [(words.count(b" ", 0, m.start()) - 1, self.phrases[m[1]]) for m in self.exact.finditer(words)]
        spans = self.fuzzy(words)
        labels = {label for _, label in base}
        score = max([1.0] * bool(base) + [1 - s["errors"] / s["length"] for s in spans] + [0.0])
        return {
            "n_words": len(tokens),
            "n_base": len(base),
            "first_word": min((at for at, _ in base), default=None),
            "last_word": max((at for at, _ in base), default=None),
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {s["label"] for s in spans})),
            "score": score,
            "spans": [{k: s[k] for k in ("label", "first_word", "last_word", "errors")} for s in spans],
        }


RESULT = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"
ARROW = pa.schema(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32())]))),
    ]
)


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row per row of `docs`: the id, word count, exact places, labels, score and the spans of fuzzy notices.

    A null text is empty: no words, no labels (empty strings), score 0, null first and last word. Whole texts are read.
    Repeated rows give repeated results; a null id stays null; an empty table gives no rows; other columns are not read. `score` is 1 for an exact
    place, else 1 - edits / length of the best notice, else 0. Of two matches of a notice that start at one word the one
    with fewer edits stays.
    """
    text_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = NoticeSearch(notices, phrases)
        for batch in batches:
            rows = pa.RecordBatch.from_pylist([search.scan(t) for t in batch.column(1).to_pylist()], ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows.columns], [id_column, *ARROW.names])

    picked = docs.select(id_column, text)
    return picked.mapInArrow(scan, f"`{id_column}` {picked.schema[0].dataType.simpleString()}, {RESULT}")


@query("op3_license_scans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
