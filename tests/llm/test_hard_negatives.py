"""Hard negatives against a loop over all rows."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paceline.llm import hard_negatives as H
from paceline.llm.catalogue import QUERIES

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, every=50, positives=5, k=3, low=50, high=95, scale=256):
    good = [(i, str(label), [math.floor(scale * float(x)) for x in vec]) for i, label, vec in rows if None not in (i, label, vec) and vec and all(x is not None and math.isfinite(x) for x in vec)]
    sizes = Counter(len(v) for _, _, v in good)
    if good:
        size = min(sizes, key=lambda n: (-sizes[n], n))
        good = [r for r in good if len(r[2]) == size]
    for at, (anchor, label, vec) in enumerate(good):
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(vec, other)), i, kind) for n, (i, kind, other) in enumerate(good) if n != at)
        for best, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fitting = [(i, -s) for s, i, kind in scored if kind != label and low * -best <= 100 * -s <= high * -best]
            for rank, (i, score) in enumerate(fitting[:k], 1):
                yield anchor, positive, rank, i, -best, score


def check(frame, **options):
    rows = [(r.vec_id, r.label, r.embedding) for r in frame.select("vec_id", "label", "embedding").collect()]
    wanted = Counter(brute(rows, **options))
    every = options.pop("every", None)
    got = H.hard_negatives(frame, is_anchor=F.col("vec_id") % every == 0 if every else None, **options)
    assert got.columns == COLUMNS
    assert Counter(map(tuple, got.collect())) == wanted
    return len(wanted)


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    wanted = Counter(brute(rows))
    assert wanted and Counter(map(tuple, QUERIES["op11_hard_negatives"](spark, sf_dir).select(COLUMNS).collect())) == wanted


def odd_rows(seed, n=400, dims=5):
    """Few distinct vectors, so scores tie; a hot label and a hot vector; nulls, copies, odd numbers and lengths."""
    rng = random.Random(seed)
    vector = lambda: [rng.choice((-0.5, -0.25, 0.0, 0.3, 0.7, 1.0)) for _ in range(dims)]
    common = vector()
    rows = [(rng.randint(0, 300), rng.choice((0, 0, 0, 1, 2, None)), common if rng.random() < 0.3 else vector()) for _ in range(n)]
    rows += [(None, 1, common), (7, 1, None), (8, 1, []), (9, 1, [1.0] * (dims + 1)), (10, 1, [0.5, None, 1.0, 1.0, 1.0]), (0, 0, [float("nan")] * dims), (20, 0, [float("inf")] * dims)]
    return rows + [rows[0], rows[0], (0, 0, [0.0] * dims), (10, 1, [-1.0] * dims)]


SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, slot string, score string, part int"


@pytest.mark.parametrize("seed, step, anchors, size", [(1, 1024, 4096, 1 << 15), (2, 16, 4096, 1 << 15), (3, 8, 2, 4)])
def test_ties_copies_and_odd_rows(spark, monkeypatch, seed, step, anchors, size):
    monkeypatch.setattr(H, "STEP_ROWS", step)
    monkeypatch.setattr(H, "STEP_ANCHORS", anchors)
    monkeypatch.setattr(H, "SLICE_ANCHORS", size)
    monkeypatch.setattr(H, "PART_ROWS", 64)
    frame = spark.createDataFrame([(*r, "a", "b", "c", 1) for r in odd_rows(seed)], SCHEMA).repartition(5)
    assert check(frame, every=10) > 50
    assert check(frame, every=10, positives=9, k=1, low=0, high=100)


def test_empty_and_single(spark):
    for rows in ([], [(50, 1, [1.0, 2.0])], [(51, 1, [1.0, 2.0]), (52, 2, [1.0, 2.0])], [(None, None, None)]):
        assert check(spark.createDataFrame([(*r, "a", "b", "c", 1) for r in rows], SCHEMA)) == 0


def test_scores_beyond_doubles(spark):
    """Products above 53 bits stay exact; above 64 bits they count as the largest."""
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randint(1 << 22, 1 << 23)) for _ in range(4)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    assert check(frame, every=10, low=10, high=99, scale=16)
    huge = spark.createDataFrame([(0, 0, [1e300]), (1, 0, [1e300]), (2, 1, [1.0]), (3, 1, [1e300])], "vec_id bigint, label int, embedding array<double>")
    got = H.hard_negatives(huge, low=0, high=100).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, H.LARGEST, H.LARGEST), (0, 1, 2, 3, H.LARGEST, H.LARGEST)]


def test_held_needs_ascending_ids_only():
    held = H.Held(2, 2)
    import numpy as np

    held.offer(np.array([0, 0, 1]), np.array([5, 7, 1]), np.array([1, 2, 1]))
    held.offer(np.array([0, 0, 1]), np.array([5, 6, 1]), np.array([3, 4, 2]))
    assert list(zip(held.group.tolist(), held.score.tolist(), held.id.tolist())) == [(0, 7, 2), (0, 6, 4), (1, 1, 1), (1, 1, 2)]
