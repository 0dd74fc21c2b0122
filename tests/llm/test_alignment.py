"""Alignment of two tokenizers against whole-text encoding and a loop over bytes."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from paceline.llm import alignment as L
from paceline.llm.catalogue import QUERIES

FILE_A, FILE_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(FILE_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILE_B)


def tokens(encoders, text):
    """(id, bytes) of both sides for a whole text; none where the bytes differ."""
    a, b = encoders
    if not text:
        return None
    table = {c: i for i, c in L.byte_characters().items()}
    left = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    right = [(i, piece(i)) for i in b.encode(text)]
    wanted = (" " + text).encode()
    return (left, right) if all(b"".join(x for _, x in side) == wanted for side in (left, right)) else None


def by_loop(left, right):
    """Overlapping id pairs, and groups as text."""
    spans = []
    for side in (left, right):
        at, own = 0, []
        for i, raw in side:
            own.append((i, at, at + len(raw)))
            at += len(raw)
        spans.append(own)
    links, i, j = [], 0, 0
    while i < len(spans[0]) and j < len(spans[1]):
        links.append((spans[0][i][0], spans[1][j][0]))
        e, f = spans[0][i][2], spans[1][j][2]
        i, j = i + (e <= f), j + (f <= e)
    common = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
    groups, low = [], 0
    for high in common:
        groups.append("|".join(",".join(str(t) for t, lo, hi in own if low < hi <= high) for own in spans))
        low = high
    return links, groups


def brute(encoders, rows):
    counts, found = Counter(), []
    for own, text in rows:
        sides = tokens(encoders, text)
        links, groups = by_loop(*sides) if sides else ([], [])
        counts.update(links)
        found.append((own, sides, links, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    for own, sides, links, groups in found:
        if not sides:
            yield own, 0, 0, 0, 0, 0, 0, ""
        else:
            text = ";".join(groups)
            yield own, len(sides[0]), len(sides[1]), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()


def check(docs, encoders, **options):
    wanted = Counter(brute(encoders, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    got = L.align(docs, FILE_A, FILE_B, **options)
    assert got.columns == NAMES
    assert Counter(map(tuple, got.collect())) == wanted
    return wanted


@pytest.mark.parametrize("name", ["odd_documents", "no_documents"])
def test_odd_tables(name, request, encoders):
    check(request.getfixturevalue(name), encoders)


def test_query(spark, sf_dir, documents, encoders):
    wanted = Counter(brute(encoders, [(r.doc_id, r.text) for r in documents.collect()]))
    got = QUERIES["op13_tokenizer_alignment"](spark, sf_dir).select(NAMES)
    assert Counter(map(tuple, got.collect())) == wanted


SIGNS = ["a", "B", "word", "Wörter", " ", " ", " ", "  ", "\n", "\t", "\r\n", " ", "　", " ", "᠎", " ", "\x85", "\x1c", "​", "'s", "'", "12", "²", "½", "!", "...", "日本", "é", "é", "😀", "▁", "<|endoftext|>", "<s>", "</s>", "<0x41>", "<unk>", "﻿", "ﬁ", " "]


@pytest.mark.parametrize("seed, block_bytes", [(1, 1 << 20), (2, 200)])
def test_white_space_and_special_strings(spark, encoders, seed, block_bytes):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randint(1, 14))), "x") for i in range(700)]
    wanted = check(spark.createDataFrame(rows, "doc_id bigint, text string, block string"), encoders, block_bytes=block_bytes)
    assert sum(row[1] > 0 for row in wanted) > 400


def test_small_table(spark, documents, encoders, monkeypatch):
    monkeypatch.setattr(L, "TABLE_CHUNKS", 50)
    monkeypatch.setattr(L, "PORTION_CHUNKS", 13)
    monkeypatch.setattr(L, "PIECE_ENDS", 7)
    check(documents.limit(20), encoders, block_bytes=3000)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64, 1 << 16])
def test_pieces_of_the_path(piece):
    """Whatever the cuts, overlaps and groups are those of the whole path."""
    rng = np.random.default_rng(piece)
    for _ in range(50):
        size = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < rng.random()) + 1, size) for _ in range(2))
        link_a, link_b, group_a, group_b = L.aligned(a, b, piece)
        # Every byte belongs to one token of each side.
        of = [np.searchsorted(x, np.arange(1, size + 1)) for x in (a, b)]
        assert list(zip(link_a.tolist(), link_b.tolist())) == list(dict.fromkeys(zip(of[0].tolist(), of[1].tolist())))
        common = np.intersect1d(a, b)
        assert group_a.tolist() == np.searchsorted(common, a).tolist() and group_b.tolist() == np.searchsorted(common, b).tolist()


def test_equal_work_and_diagonals():
    a, b = np.arange(10, 1000, 10), np.arange(1, 1000)
    diagonals = np.arange(0, len(a) + len(b) + 1, 50)
    i = L.split_path(a, b, diagonals)
    merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
    assert i.tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals.tolist()]
    assert set(np.diff(diagonals - i + i)) == {50}
