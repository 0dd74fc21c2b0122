"""Suffix-array dedup against a table of all strings of the minimum length."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from paceline.llm import suffix_dedup as S


def brute(texts, length):
    """Bytes, removed bytes, removed runs and what is left of every text."""
    raws = [(t or "").encode() for t in texts]
    starts = Counter(raw[i : i + length] for raw in raws for i in range(len(raw) - length + 1))
    for raw in raws:
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if starts[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        yield len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), kept


def check(docs, length, **options):
    rows = docs.select("doc_id", "text").collect()
    wanted = Counter((r.doc_id, *b[:3], hashlib.sha256(b[3]).hexdigest(), b[3].decode("utf-8", "ignore")) for r, b in zip(rows, brute([r.text for r in rows], length)))
    got = S.dedup_report(docs, min_length=length, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in got) == wanted
    return sum(r.n_removed for r in got)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_whole_tables(name, request):
    removed = check(request.getfixturevalue(name), 400)
    assert removed or name == "no_documents"


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(120)
    texts = [text(rng.randint(0, 60)) + passage[rng.randint(0, 20) :] + text(rng.randint(0, 30)) for _ in range(25)]
    for _ in range(15):  # near copies
        chars = list(base)
        for _ in range(rng.randint(0, 4)):
            chars[rng.randrange(len(chars))] = "#"
        texts.append("".join(chars))
    texts += ["ab" * 200, "x" + "ab" * 90, "a" * 500, "a" * 39, "a" * 41, base, base, "", None, passage + passage, passage[:45] + "|" + passage[:45]]
    return texts


@pytest.mark.parametrize("seed, limit", [(1, 1000), (2, 1000), (3, 3), (4, 1)])
def test_passages_copies_and_periodic_texts(spark, seed, limit):
    rows = [(i, t, "x") for i, t in enumerate(made_up(seed))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    assert check(docs, 40, gram=12, group_limit=limit)


def brute_contexts(raw, length, gram):
    """Windows in order; each goes to the first of its strings of `gram` bytes with the smallest hash."""
    h = S.gram_hashes(np.frombuffer(raw, np.uint8), gram).tolist()
    found = []
    for w in range(len(raw) - length + 1):
        part = h[w : w + length - gram + 1]
        at = w + part.index(min(part))
        if found and found[-1][0] == at:
            found[-1][2] += 1
        else:
            found.append([at, w, 1])
    return [(h[at], w, n, at - w) for at, w, n in found]


@pytest.mark.parametrize("portion", [1, 1 << 13])
def test_contexts_of_periodic_texts(monkeypatch, portion):
    monkeypatch.setattr(S, "VIEW_ROWS", portion)
    rng = random.Random(3)
    raws = [b"a" * 300, b"abc" * 90, b"x" * 40, b"y" * 100 + b"ab" * 60, *(bytes(rng.choices(b"abc"[:kinds], k=200)) for kinds in (2, 3))]
    for raw in raws:
        hashes, first, windows, offset = S.contexts(raw, 40, 12)
        assert list(zip(hashes.view(np.uint64).tolist(), first.tolist(), windows.tolist(), offset.tolist())) == brute_contexts(raw, 40, 12)


def test_lengths_of_shared_prefixes():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.integers(97, 100, 400), [S.SEPARATOR])).astype(np.uint8)
    for least in (1, 3, 6, 12):
        order, shared = S.shared_prefixes(x, least)
        twice = np.concatenate((x, x))
        wanted = [r > 0 and bool((twice[order[r - 1] : order[r - 1] + least] == twice[order[r] : order[r] + least]).all()) for r in range(len(x))]
        assert shared.tolist() == wanted


def test_texts_without_repeats(spark):
    texts = made_up(5)
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, spans string, __suffix_key string")
    got = {r.doc_id: r for r in S.without_repeats(docs, min_length=40, gram=12).collect()}
    partly = 0
    for (i, t), (size, removed, _, kept) in zip(enumerate(texts), brute(texts, 40)):
        assert got[i].text == (None if t is None else kept.decode("utf-8", "ignore"))
        assert got[i].spans == "x" and got[i]["__suffix_key"] == "y"
        partly += 0 < removed < size
    assert partly > 10
