"""License scans, quality rules, language ID, encoding and packing against plain loops over whole texts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paceline.llm import language_id, license_scans, packing, piece_encoding, quality_rules

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(params=["documents", "odd_documents", "no_documents"])
def docs(request):
    return request.getfixturevalue(request.param)


def same_rows(frame, columns, wanted):
    got = Counter(tuple(row[c] for c in columns) for row in frame.select(*columns).collect())
    assert got == Counter(wanted)


# License scans


def license_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def test_license_base_places(docs):
    wanted = []
    for row in docs.collect():
        words, places = license_words(row.text), []
        for phrase, label in license_scans.PHRASES.items():
            n = len(phrase.split())
            places += [(i, label) for i in range(len(words)) if words[i : i + n] == phrase.split()]
        at = [i for i, _ in places]
        wanted.append((row.doc_id, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    same_rows(license_scans.scan_licenses(docs), ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"], wanted)


def test_license_edits_and_spans():
    search = license_scans.NoticeSearch(license_scans.NOTICES, license_scans.PHRASES)
    found = search.scan("See it. Relased under the MIT Licence, (c) X")
    assert (found["labels"], found["base_labels"], found["n_base"]) == ("mit", "", 0)
    assert [(s["first_word"], s["last_word"], s["errors"]) for s in found["spans"]] == [(2, 6, 2)]
    assert 0.9 < found["score"] < 1
    assert search.scan("released under the xyz licence")["labels"] == ""
    assert search.scan("mit license mit license")["n_base"] == 2
    assert search.scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"


@pytest.mark.parametrize("edits", range(6))
def test_license_search_finds_all_within_the_bound(edits):
    import random

    rng = random.Random(edits)
    label, notice, most = license_scans.NOTICES[0]
    search = license_scans.NoticeSearch([(label, notice, most)], license_scans.PHRASES)
    for _ in range(30):
        chars = list(notice)
        for at in rng.sample(range(len(chars)), edits):
            chars[at] = "q"
        hit = bool(search.fuzzy(b" aa " + "".join(chars).encode() + b" bb "))
        assert hit == (edits <= most)


# Quality rules


def quality_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_measures(docs):
    wanted = []
    for row in docs.collect():
        m = quality_measures(row.text)
        wanted.append((row.doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    same_rows(quality_rules.quality_rules(docs), ["doc_id", *quality_rules.MEASURES, "base_failed"], wanted)


def test_lines_of_many_documents_of_a_host(spark):
    fill = lambda i: " ".join(f"w{i}x{chr(97 + j)}" for j in range(14))
    rows = [(i, f"Read more on page {i} now\n{fill(chr(97 + i % 26) * (i // 26 + 1))}", "a") for i in range(40)]
    rows += [(100 + i, "Read more on page 7 now\nshort", "a") for i in range(3)]  # copies: one text
    rows += [(200, "Read more on page 1 now and then\n" + "Read more on page 1 now\n" * 1 + "tail of ten other words that stay here a b c", "b")]
    rows += [(300 + i, "copied line of a large group\n" + fill("zz"), "c") for i in range(50)]
    rows += [(400, "Read more on page 3 now\nRead  more on PAGE 4 now\n" + "a b c d e f", "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(found[i].removed_words == 6 and found[i].kept for i in range(40))
    assert found[100].base_failed is True and found[200].removed_words == 0
    assert all(found[300 + i].removed_words == 0 and found[300 + i].kept for i in range(50))
    assert found[400].removed_words == 12 and not found[400].kept and not found[400].base_failed
    cleaned = quality_rules.without_lines(rows[-1][1], found[400].frequent)
    assert cleaned == "a b c d e f"


# Language ID


def ppm_bits(counts, alphabet, raw):
    """Straight recursion over one language's 4-byte strings."""
    tables = [defaultdict(Counter) for _ in range(4)]
    for gram, n in counts.items():
        for order in range(4):
            tables[order][gram[3 - order : 3]][gram[3:]] += n
    def p(order, context, symbol):
        if order < 0:
            return 1 / 256
        seen = tables[order].get(context)
        if not seen:
            return p(order - 1, context[1:], symbol)
        total, kinds = sum(seen.values()), len(seen)
        if symbol in seen:
            return seen[symbol] / (total + kinds)
        return kinds / (total + kinds) * p(order - 1, context[1:], symbol)
    padded = b"\0\0\0" + raw
    return -sum(np.log2(p(3, padded[i : i + 3], padded[i + 3 : i + 4])) for i in range(len(raw)))


def test_code_lengths_are_those_of_the_tree():
    samples = {"a": [b"the and of the thing", b"other"], "b": ["über die öde".encode(), b"und die und"]}
    grams = {k: Counter() for k in samples}
    for k, texts in samples.items():
        for t in texts:
            padded = b"\0\0\0" + t
            grams[k].update(padded[i : i + 4] for i in range(len(t)))
    model = language_id.Counts(
        sorted(samples), [np.array(sorted(int.from_bytes(g) for g in grams[k]), np.uint32) for k in sorted(samples)], [np.array([grams[k][g] for g in sorted(grams[k])]) for k in sorted(samples)]
    )
    codes = language_id.CodeTable(model)
    for raw in (b"the", b"die und the", "öü zzz 日".encode(), b""):
        got = codes.bits_of(raw)
        assert got == pytest.approx([ppm_bits(grams[k], None, raw) for k in sorted(samples)], rel=1e-5)


def test_long_texts_are_scored_in_slices(monkeypatch):
    model = language_id.Counts(["a"], [np.unique(language_id.gram_codes(b"abcabcabd"))], [np.ones(7, np.int64)[: len(np.unique(language_id.gram_codes(b"abcabcabd")))]])
    codes = language_id.CodeTable(model)
    whole = codes.bits_of(b"abcabd" * 50)
    monkeypatch.setattr(language_id, "SLICE", 7)
    assert codes.bits_of(b"abcabd" * 50) == pytest.approx(whole)


def test_held_out_accuracy_and_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, language_id.train(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(odd_documents, no_documents):
    rows = language_id.identify(odd_documents, language_id.train(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    texts = odd_documents.select("doc_id", "text").collect()
    letterless = Counter(r.doc_id for r in texts if r.text is None or not any(map(str.isalpha, r.text)))
    assert Counter(r.doc_id for r in rows if r.lang_pred == "und") == letterless
    nothing = language_id.train(no_documents)
    assert language_id.identify(no_documents, nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd_documents, nothing).collect()} == {"und"}


# Encoding


def test_encoding_is_that_of_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    digest = lambda value: hashlib.sha256(value.encode()).hexdigest()
    wanted = []
    for row in docs.collect():
        ids = [*model.encode(row.text or ""), model.eos_id()]
        wanted.append((row.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(model.decode(ids))))
    same_rows(piece_encoding.encode(docs, PIECE_FILE), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], wanted)


def test_chunks_and_a_small_table(monkeypatch):
    monkeypatch.setattr(piece_encoding, "TABLE_CHUNKS", 3)
    codec = piece_encoding.ChunkCodec(PIECE_FILE)
    assert codec.safe
    texts = ["", " ", "   ", "a", " a", "a ", "a  b   c", "▁▁x▁ y", "\n\n a\n", "日本 語", "\x00 b", "<s> </s> <0x41>", "12 345 ▁"]
    rows = codec.block(texts) + [row for text in texts for row in codec.block([text])]
    for text, (n, ids, decoded) in zip(texts * 2, rows):
        wanted = [*codec.model.encode(text), codec.end]
        assert (n, ids, decoded) == (len(wanted), " ".join(map(str, wanted)), codec.model.decode(wanted))


# Packing


def test_packing_places_every_id_once(docs):
    tokenizer = Tokenizer.from_file(WORD_FILE)
    ids_of = Counter()
    for row in docs.collect():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        ids_of[row.doc_id, tuple(ids)] += 1
    rows = packing.pack(docs, WORD_FILE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= packing.CAPACITY
    total = sum(len(ids) * n for (_, ids), n in ids_of.items())
    assert sum(r.length for r in rows) == total
    assert len(by_sequence) == -(-total // packing.CAPACITY) or len(by_sequence) - total / packing.CAPACITY < 2
    wanted = defaultdict(list)
    for (doc, ids), n in ids_of.items():
        wanted[doc] += [ids] * n
    for doc, found in by_doc.items():
        if len(wanted[doc]) == 1:
            ids, end = wanted[doc][0], 0
            for r in sorted(found, key=lambda r: r.start):
                assert r.start == end and r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[end : end + r.length], "<u4").tobytes())
                end += r.length
            assert end == len(ids)
        else:
            assert sum(r.length for r in found) == sum(map(len, wanted[doc]))


def test_another_tokenizer_goes_by_whole_texts(odd_documents):
    """Case and blanks count for a byte-level tokenizer, so its words do not stand alone."""
    file = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.words_stand_alone(WORD_FILE) and not packing.words_stand_alone(file)
    tokenizer = Tokenizer.from_file(file)
    docs = odd_documents.filter("doc_id IS NOT NULL AND length(coalesce(text, '')) < 1000").dropDuplicates(["doc_id", "text"])
    wanted = Counter()
    for row in docs.collect():
        ids = np.array([*tokenizer.encode(row.text or "", add_special_tokens=False).ids, packing.END], "<u4")
        wanted[row.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = packing.pack(docs, file).filter("length = doc_tokens").collect()
    assert Counter((r.doc_id, r.length, r.ids_crc32) for r in got) == wanted


def test_costs_are_balanced():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 2000, 3000)
    placed = packing.assign(lengths, 4096, 1.0, 1 / 1024)
    cost = Counter()
    for _, _, length, sequence, _ in placed:
        cost[sequence] += length + length * length / 1024
    naive = Counter()
    fill, at = 0, 0
    for n in lengths.tolist():
        at, fill = (at + 1, n) if fill + n > 4096 else (at, fill + n)
        naive[at] += n + n * n / 1024
    assert np.std(list(cost.values())) < 0.5 * np.std(list(naive.values()))
    assert sum(p[2] for p in placed) == lengths.sum()
