"""SimHash groups and nearest neighbours against brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash

from paceline.llm import components, nearest, simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    values = np.array(sorted(set(values)), np.uint64)
    close = np.bitwise_count(values[:, None] ^ values[None]) <= radius
    label = np.arange(len(values))
    for _ in range(len(values)):
        new = np.where(close, label[None], len(values)).min(1)
        if (new == label).all():
            break
        label = new
    return dict(zip(values.tolist(), label.tolist()))


@pytest.mark.parametrize("name", ["documents", "odd_documents", "no_documents"])
def test_groups(name, request):
    docs = request.getfixturevalue(name)
    rows = docs.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    group = brute_components(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[group[p]] = min(least.get(group[p], r.doc_id), r.doc_id)
    wanted = Counter((r.doc_id, f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == wanted
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(group[brute_fingerprint(r.text)] for r in kept.collect()) == sorted(set(group.values()))


@pytest.mark.parametrize("limit", [20_000, 6])
def test_links_of_clusters_and_hot_shards(spark, limit):
    rng = np.random.default_rng(1)
    values = []
    for centre in rng.integers(0, 2**64, 25, dtype=np.uint64).tolist():
        for _ in range(30):
            value = centre
            for bit in rng.choice(64, rng.integers(0, 7), replace=False).tolist():
                value ^= 1 << bit
            values.append(value)
    frame = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp bigint")
    got = {np.int64(r.fp).astype(np.uint64).item(): r.root for r in simhash.with_roots(frame, 3, limit).collect()}
    wanted = brute_components(values)
    pairs = lambda labels: Counter(frozenset(v for v in labels if labels[v] == x) for x in set(labels.values()))
    assert pairs(got) == pairs(wanted)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    got = dict(components.connected(spark.createDataFrame(edges, "u int, v int")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 103)}, **{i: 200 for i in range(200, 251)}}


def brute_nearest(rows, k=10):
    """(query id, [(id, distance)]) for each row whose id is divisible by 100, against all other rows."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if i != q][:k]
        yield int(ids[q]), [(int(ids[i]), float(d[i])) for i in order]


@pytest.mark.parametrize("folder", ["sf0.1", "check_s"])
def test_recall_and_scores_at_two_sizes(spark, folder):
    """At 2,000 and at 10,000 rows, with lists and probes as the rows ask for."""
    frame = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    rows = [(r.vec_id, np.float32(r.embedding)) for r in frame.collect() if r.embedding is not None and np.isfinite(np.float32(r.embedding)).all() and np.any(r.embedding)]
    got = {}
    for r in nearest.nearest(frame).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    vectors = dict(rows)
    hits = total = 0
    for q, wanted in brute_nearest(rows):
        found = [got[q][i] for i in range(1, 11)]
        assert found == sorted(found, key=lambda f: (f[1], f[0])) and len(got[q]) == 10
        assert all(abs(score - np.sqrt(((vectors[v].astype(float) - vectors[q].astype(float)) ** 2).sum())) < 1e-12 for v, score in found)
        hits += len({v for v, _ in found} & {v for v, _ in wanted})
        total += 10
    assert hits >= 0.9 * total


SCHEMA = "vec_id bigint, embedding array<double>, list string, part string, row string"


def test_odd_vectors_shared_ids_and_hot_lists(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(60)]
    # Rows that share an id, with the same vector and with another, are rows each.
    rows += rows[:50] + [(0, [9.0, 9.0, 9.0]), (1000, [0.5, 0.5, 0.5]), (1001, [0.1, 0.2, 0.3])]
    odd = [(None, [1.0, 1.0, 1.0]), (2000, None), (2001, [0.0, 0.0, 0.0]), (2002, [1.0, None, 1.0]), (2003, [float("nan"), 1.0, 1.0]), (2100, [float("inf"), 1.0, 1.0]), (2200, []), (2300, [1.0, 2.0])]
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows + odd], SCHEMA).repartition(4)
    found = Counter((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest.nearest(frame, recall=1.0, pilot_rows=20, cell_rows=40).collect())
    wanted = Counter((q, n + 1, v, round(d, 9)) for q, near in brute_nearest(rows) for n, (v, d) in enumerate(near))
    assert found == wanted
    few = spark.createDataFrame([(0, [1.0], "", "", ""), (7, [2.0], "", "", ""), (100, [4.0], "", "", "")], SCHEMA)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(few).collect()) == [(0, 1, 7, 1.0), (0, 2, 100, 3.0), (100, 1, 7, 2.0), (100, 2, 0, 3.0)]
    assert nearest.nearest(frame.filter("false")).count() == 0


def test_tests_abandon_far_rows_and_keep_near_ones():
    rng = np.random.default_rng(4)
    rows, queries = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    rows[:200] = np.repeat(queries, 10, 0) + 0.3 * rng.normal(size=(200, 64))
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    cell = nearest.Cell(np.arange(2000), np.arange(2000), rows, rotation, 10)
    bound = np.full(20, 0.3**2 * 64 * 1.5)
    q, r = cell.survivors(queries, bound)
    assert len(q) < 0.05 * 20 * 2000 and {(a, b) for a in range(20) for b in range(10 * a, 10 * a + 10)} <= set(zip(q.tolist(), r.tolist()))
    own, at, distance = cell.scan(np.full(20, -1), queries, bound)
    assert own.tolist() == np.repeat(np.arange(20), 10).tolist() and np.allclose(distance, np.sqrt(((rows[at] - queries[own]) ** 2).sum(1)))


def test_no_cross_join(spark):
    frame = spark.createDataFrame([(5,), (6,)], "fp bigint")
    plan = simhash.near_links(frame)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
