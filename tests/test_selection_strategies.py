from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paceline.operators import selection, strategies

CATEGORIES = ("A", "B", "C")
SCHEMA = "id bigint, problem_id string, speedup double, cross_user boolean, is_best boolean, category array<string>, score double"


def samples(n=120, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        names = rng.choice([["A"], ["A", "A", "B"], ["B"], [], ["A", "B"]])
        problem = "hot" if rng.random() < 0.4 else f"p{rng.randrange(6)}"
        rows.append((i, problem, float(rng.randrange(10, 120)) / 10, rng.random() < 0.3, rng.random() < 0.7, names, float(rng.randrange(5))))
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(samples(), SCHEMA)


def test_category_frequency_counts_samples_and_keeps_zeros(frame):
    got = {r["category"]: (r["frequency"], r["pct"]) for r in selection.category_frequency(frame, CATEGORIES).collect()}
    for name in CATEGORIES:
        count = sum(name in set(row[5]) for row in samples())
        assert got[name] == (count, pytest.approx(round(count / len(samples()) * 100, 2)))
    assert got["C"][0] == 0


def test_rarity_score_against_loops(frame):
    rows = samples()
    frequency = Counter(name for row in rows for name in set(row[5]))
    got = {r["id"]: r["score"] for r in selection.rarity_score(frame.drop("score"), CATEGORIES).collect()}
    for row in rows:
        names = set(row[5])
        wanted = sum(len(rows) / frequency[n] for n in names) / len(names) if names else -100.0
        assert got[row[0]] == pytest.approx(wanted)
    counted = selection.unscored_count(selection.rarity_score(frame.drop("score"), CATEGORIES)).first()
    assert counted["unscored"] == sum(not row[5] for row in rows)


@pytest.mark.parametrize("n", [0, 7, 40, 119, 500])
def test_round_robin_is_balanced_whole_and_exact(frame, n):
    rows = samples()
    chosen = selection.balanced_round_robin(frame, n).collect()
    assert len(chosen) == min(n, len(rows)) == len({r["id"] for r in chosen})
    sizes = Counter(row[1] for row in rows)
    taken = Counter(r["problem_id"] for r in chosen)
    open_problems = [taken[p] for p in sizes if taken[p] < sizes[p]]
    if open_problems:
        # Nobody still holding rows is more than one round behind anybody else.
        assert max(taken.values(), default=0) - min(open_problems) <= 1
    for problem, count in taken.items():
        ranked = sorted((r for r in rows if r[1] == problem), key=lambda r: (-r[6], r[0]))
        assert {r["id"] for r in chosen if r["problem_id"] == problem} == {r[0] for r in ranked[:count]}


def test_round_robin_is_repeatable_and_seeded(frame):
    def ids(seed, parts):
        return {r["id"] for r in selection.balanced_round_robin(frame.repartition(parts), 30, seed=seed).collect()}

    assert ids(1, 2) == ids(1, 7)
    assert len({frozenset(ids(seed, 3)) for seed in range(4)}) > 1


def test_random_sample_is_exact_repeatable_and_without_replacement(frame):
    def ids(seed, parts=3):
        return sorted(r["id"] for r in selection.random_sample_n(frame.repartition(parts), 20, "id", seed).collect())

    assert len(ids(1)) == len(set(ids(1))) == 20 and ids(1) == ids(1, 5) and ids(1) != ids(2)


def test_top_by_score_is_that_of_the_sort(spark):
    scores = [None, float("nan"), 2.0, 2.0, -100.0, float("inf"), None, 0.5]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id bigint, score double")
    wanted = [r["id"] for r in frame.orderBy(F.desc("score"), "id").collect()]
    for n in range(len(scores) + 1):
        assert sorted(r["id"] for r in selection.top_by_score(frame, n).collect()) == sorted(wanted[:n])


def test_top_speedup_caps_problems_and_skips_cross_user_rows(frame):
    wanted = []
    taken = Counter()
    for row in sorted((r for r in samples() if not r[3]), key=lambda r: (-r[2], r[0])):
        if taken[row[1]] < 4:
            taken[row[1]] += 1
            wanted.append(row[0])
    assert [r["id"] for r in selection.top_speedup_capped(frame, 15).collect()] == wanted[:15]
    assert selection.top_speedup_capped(frame, 1000).count() == len(wanted)


def test_bands_cover_every_row(spark, frame):
    bands = selection.speedup_bands(frame).collect()
    assert sum(r["rows"] for r in bands) == len(samples()) and [r["ord"] for r in bands] == list(range(8))
    edge = spark.createDataFrame([(10.0,), (1.1,), (1.0,), (4.9999,)], "speedup double")
    assert {r["band"]: r["rows"] for r in selection.speedup_bands(edge).collect() if r["rows"]} == {">=10": 1, ">=1.1": 1, "<1.1": 1, ">=4": 1}


def test_speedup_and_runtimes(spark):
    pairs = spark.createDataFrame(
        [(0, "a", "b", [6.0, 3.0]), (1, "b", "a", [2.0, 0.0])], "seq bigint, src_id string, tgt_id string, cpu_time array<double>"
    )
    assert [r["speedup"] for r in selection.add_speedup(pairs).orderBy("seq").collect()] == [2.0, None]
    assert {tuple(r) for r in selection.submission_runtimes(pairs).collect()} == {("a", 0.0), ("b", 2.0)}


def test_selection_runs_end_to_end(frame):
    chosen = selection.select_training_rows(frame.withColumn("category", F.array(F.lit("Branching Efficiency"))).drop("score"), 10)
    assert chosen.count() == 10 and chosen.filter("NOT is_best").count() == 0


def test_strategy_frequency_keeps_the_first_seen_suggestion(spark):
    rows = [
        (1, 5, "- **[A]**: late"),
        (0, 9, "- **[B]**: b first\n- **[A]**: a first"),
        (1, 2, "- **[B]**: b later\n- **[C]**: c\n- **[B]**: b last"),
        (1, 3, "nothing"),
    ]
    cleaned = strategies.clean_responses(spark.createDataFrame(rows, "run int, seq int, resp string"))
    assert "resp" not in cleaned.columns
    frequencies = strategies.strategy_frequency(strategies.explode_strategies(cleaned, ["run", "seq"]))
    ordered = strategies.by_frequency(frequencies).select("strategy", "frequency", "suggestion").collect()
    assert [tuple(r) for r in ordered] == [("B", 2, "b first"), ("A", 2, "a first"), ("C", 1, "c")]
    assert tuple(strategies.strategy_totals(frequencies).first()) == (5, 3)


def test_classification(spark):
    frame = spark.createDataFrame([("T", "do it", "A is it"), ("U", "x", "?")], "strategy string, suggestion string, answer string")
    prompts = strategies.classification_prompts(frame, "{{  category  }}#{{  strategy  }}", {"A": "first", "B": "second"})
    assert prompts.first()["prompt"] == "A: first\n\nB: second\n\n#T: do it"
    classified = strategies.classify(frame, categories=["A", "B"])
    assert [r["strategy"] for r in strategies.unrecognized(classified).collect()] == ["U"]
    assert tuple(strategies.unrecognized_rate(classified).first()) == (2, 1, 50.0)
