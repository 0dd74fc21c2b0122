"""Every stage against its operator, on given and on odd documents."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest

from paceline.llm import language_id, quality_rules, simhash
from paceline.llm.catalogue import ORACLES, QUERIES
from paceline.llm.common import checkpointed


def rows_of(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_stages(name, request, spark, sf_dir):
    docs = request.getfixturevalue(name)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    language = checkpointed(stages["language"](spark, docs, sf_dir), "t")
    found = language_id.identify(docs, language_id.train(docs)).select("doc_id", "lang_pred", "score").collect()
    assert Counter(r.doc_id for r in language.collect()) == Counter(r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5)
    quality = checkpointed(stages["quality"](spark, language, sf_dir), "t")
    kept = quality_rules.quality_rules(language).filter("kept").collect()
    assert Counter(r.doc_id for r in quality.collect()) == Counter(r.doc_id for r in kept)
    assert not rows_of(quality) - rows_of(docs)
    near = checkpointed(stages["near_duplicates"](spark, quality, sf_dir), "t")
    assert near.count() == simhash.near_duplicates(quality).select("component_id").distinct().count()
    assert not rows_of(near) - rows_of(quality)
    repeated = checkpointed(stages["repeated_strings"](spark, near, sf_dir), "t")
    assert language.columns == quality.columns == near.columns == repeated.columns == columns
    assert Counter(r.doc_id for r in repeated.collect()) == Counter(r.doc_id for r in near.collect())
    packed = stages["packing"](spark, repeated, sf_dir)
    assert Counter(r.doc_id for r in packed.filter("start = 0").collect()) == Counter(r.doc_id for r in repeated.collect())


def test_passages_of_over_50_words_go(spark, documents, sf_dir):
    """Passages of 51 to 60 words of the given texts, each planted in two otherwise different documents."""
    rng = random.Random(9)
    words = [w for r in documents.select("text").limit(60).collect() for w in (r.text or "").split()]
    own = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    passages = [" ".join(rng.sample(words, rng.randint(51, 60))) for _ in range(40)]
    assert any(len(p.encode()) < 400 for p in passages)
    rows = [(2 * n + i, f"{own(20)} {p} {own(20)}", None) for n, p in enumerate(passages) for i in range(2)]
    docs = spark.createDataFrame([*rows, (1000, own(300), None), (1001, None, None)], "doc_id bigint, text string, n_chars bigint")
    left = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["repeated_strings"](spark, docs, sf_dir).collect()}
    for n, passage in enumerate(passages):
        for doc in (2 * n, 2 * n + 1):
            # The byte before or behind a passage may be equal too.
            assert passage not in left[doc].text and abs(len(rows[doc][1]) - len(left[doc].text) - len(passage)) <= 4
            assert left[doc].n_chars == len(left[doc].text)
    assert left[1000].text == docs.filter("doc_id = 1000").first().text and left[1001].text is None


def test_queries_of_all_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES) and len(corpus_pipeline.STAGES) == 5
