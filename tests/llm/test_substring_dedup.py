"""Substring dedup against a table of all windows, and the automaton against all substrings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from paceline.llm import substring_dedup as S
from paceline.llm.catalogue import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, least=13):
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, words in split:
        for at in range(len(words) - least + 1) if i is not None else ():
            window = tuple(words[at : at + least])
            first[window] = min(i, first.get(window, i))
    for (i, text), (_, words) in zip(rows, split):
        gone = set()
        for at in range(len(words) - least + 1) if i is not None else ():
            if first[tuple(words[at : at + least])] < i:
                gone.update(range(at, at + least))
        kept = " ".join(w for n, w in enumerate(words) if n not in gone)
        yield i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else text or ""


def check(docs, least=13, **options):
    wanted = Counter(brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], least))
    got = S.substring_dedup(docs, min_words=least, **options)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    assert Counter(map(tuple, got.collect())) == wanted
    return sum(row[2] for row in wanted)


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_whole_tables(name, request):
    removed = check(request.getfixturevalue(name))
    assert removed or name == "no_documents"


def test_query(spark, sf_dir, documents):
    wanted = Counter(row[:4] for row in brute([(r.doc_id, r.text) for r in documents.collect()]))
    got = QUERIES["op12_substring_dedup"](spark, sf_dir).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == wanted


def made_up(seed):
    """Few kinds of words, shared passages with changes, copies, periods, ids that repeat or are null."""
    rng = random.Random(seed)
    text = lambda n: [rng.choice(("a", "b", "c", "dé", "e")) for _ in range(n)]
    passage, base = text(30), text(80)
    texts = [text(rng.randint(0, 40)) + passage[rng.randint(0, 12) :] + text(rng.randint(0, 30)) for _ in range(30)]
    for _ in range(20):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "#"
        texts.append(words)
    texts += [["a"] * 60, ["a"] * 6, ["a"] * 7, ["a", "b"] * 30, base, base, [], passage * 3]
    rows = [(rng.randint(-5, 60) if rng.random() < 0.9 else None, rng.choice((" ", "\n", " \t ")).join(words), "x") for words in texts]
    return [*rows, (3, None, "x"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"hot": 1}), (3, {"hot": 4, "block_bytes": 300}), (4, {"gram": 1}), (5, {"gram": 6, "block_bytes": 1})])
def test_passages_copies_and_periods(spark, monkeypatch, seed, options):
    monkeypatch.setattr(S, "BUCKET_ANCHORS", 40)
    monkeypatch.setattr(S, "SHARD_PASSAGES", 50)
    docs = spark.createDataFrame(made_up(seed), "doc_id bigint, text string, block string").repartition(3)
    assert check(docs, 6, **options) > 100


def test_wide_windows(spark):
    """Windows so long that a passage has as many as fit in a mask."""
    docs = spark.createDataFrame(made_up(6), "doc_id bigint, text string, block string")
    assert S.default_gram(13) == 5 and S.default_gram(200) == 138
    assert check(docs, 70, hot=3) > 0


def test_automaton():
    rng = random.Random(8)
    for _ in range(60):
        strings = [[rng.randrange(3) for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        automaton = S.SuffixAutomaton()
        for string in strings:
            automaton.take(string)
        held = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        probe = [rng.randrange(4) for _ in range(25)]
        for least in (1, 2, 4, 7):
            assert automaton.matches(probe, least) == [i for i in range(len(probe) - least + 1) if tuple(probe[i : i + least]) in held]
        # At most twice as many states as symbols.
        assert len(automaton.to) <= 2 * sum(map(len, strings)) + 1
