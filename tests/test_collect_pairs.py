from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paceline.operators import collect, pairs
from paceline.operators.ranking import block_carries, dense_index, first_rows, running_extremes, top_k_per_group

SUBS = "seq bigint, solution_id string, problem_id string, user_id string, runtime double, code string"


def submissions(n=160, seed=7):
    """Few problems, users and runtimes: ties, singletons and one group with a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        hot = rng.random() < 0.34
        problem = "p0" if hot else f"p{rng.randrange(4)}"
        user = "u0" if hot else f"u{rng.randrange(12)}"
        rows.append((seq, f"s{seq}", problem, user, float(rng.randrange(1, 9)), f"code {seq} // c"))
    rng.shuffle(rows)
    return rows


def by_group(rows):
    groups = defaultdict(list)
    for row in sorted(rows):
        groups[row[2], row[3]].append(row)
    return {key: sorted(group, key=lambda r: r[4]) for key, group in groups.items()}


@pytest.fixture(scope="module")
def subs(spark):
    return spark.createDataFrame(submissions(), SUBS)


def own_pairs(rows, known):
    wanted = set()
    for (problem, user), group in by_group(rows).items():
        for i, fast in enumerate(group):
            for slow in group[i + 1 :]:
                identity = f"{problem}-{slow[1]}-{fast[1]}"
                if slow[4] / fast[4] >= 1.1 and identity in known:
                    wanted.add((identity, user, slow[4], fast[4], slow[4] / fast[4], i == 0))
    return wanted


def every_pair(rows):
    """All ordered pairs of a group, and some ids that fit no group."""
    known = {f"{p}-{a[1]}-{b[1]}" for (p, _), group in by_group(rows).items() for a in group for b in group if a != b}
    return known | {"p0-s1-nobody", "p9-s1-s2"}


def best_per_problem(rows):
    best = {}
    first_seen = {}
    for row in sorted(rows):
        first_seen.setdefault((row[2], row[3]), row[0])
    groups = by_group(rows)
    for key in sorted(groups, key=first_seen.get):
        for row in groups[key][:-1]:
            if key[0] not in best or best[key[0]][4] > row[4]:
                best[key[0]] = row
    return best


def test_speed_ordered_pairs_against_loops(spark, subs):
    rows = submissions()
    rng = random.Random(1)
    for known in (every_pair(rows), set(rng.sample(sorted(every_pair(rows)), 200))):
        frame = spark.createDataFrame([(k,) for k in known], "id string")
        got = pairs.speed_ordered_pairs(subs, frame).select(
            "id", "user_id", "src_runtime", "tgt_runtime", "speed_up", "is_best"
        )
        collected = [tuple(r) for r in got.collect()]
        assert len(collected) == len(set(collected))
        assert set(collected) == own_pairs(rows, known)


def test_best_solution_and_cross_user_pairs_against_loops(spark, subs):
    rows = submissions()
    best = best_per_problem(rows)
    got = {r["problem_id"]: r["best_id"] for r in pairs.best_solution_per_problem(subs).collect()}
    assert got == {problem: row[1] for problem, row in best.items()}
    known = every_pair(rows)
    frame = spark.createDataFrame([(k,) for k in known], "id string")
    own = pairs.speed_ordered_pairs(subs, frame)
    wanted = sorted(
        (f"{i.split('-')[0]}-{i.split('-')[1]}-{b[1]}", f"{user}|{b[3]}", slow, b[4])
        for i, user, slow, fast, _, is_best in own_pairs(rows, known)
        for b in [best[i.split("-")[0]]]
        if is_best and fast / b[4] < 2
    )
    cross = pairs.cross_user_pairs(own, pairs.best_solution_per_problem(subs))
    assert sorted(tuple(r) for r in cross.select("id", "user_id", "src_runtime", "tgt_runtime").collect()) == wanted
    summary = pairs.pair_summary(pairs.full_pairs(subs, frame)).first()
    assert summary["pairs"] == len(own_pairs(rows, known)) + len(wanted)
    assert summary["cross_user_pairs"] == len(wanted)


def test_a_single_submission_is_no_candidate(spark):
    rows = [(0, "a", "p", "u", 1.0, ""), (1, "b", "p", "v", 5.0, ""), (2, "c", "p", "v", 6.0, "")]
    got = pairs.best_solution_per_problem(spark.createDataFrame(rows, SUBS)).first()
    assert got["best_id"] == "b"


def test_fastest_target_takes_the_last_tie(subs):
    wanted = set()
    for (problem, user), group in by_group(submissions()).items():
        target = [row for row in group if row[4] == group[0][4]][-1]
        wanted |= {f"{problem}-{user}-{row[1]}-{target[1]}" for row in group if row != target}
    assert {r["id"] for r in pairs.fastest_target_pairs(subs).collect()} == wanted


def test_attach_codes_cleans_both_sides(spark, subs):
    frame = spark.createDataFrame([(k,) for k in every_pair(submissions())], "id string")
    row = pairs.attach_codes(pairs.speed_ordered_pairs(subs, frame), subs).first()
    assert row["src_code"] == f"code {row['src_seq']}" and row["tgt_code"] == f"code {row['tgt_seq']}"


def test_unique_solutions_last_write_wins(spark):
    schema = "seq bigint, src_id string, tgt_id string, problem_id string, src_agg_runtime double, tgt_agg_runtime double, src_code string, tgt_code string"
    rows = [(0, "a", "b", "p", 9.0, 5.0, "a0", "b0"), (1, "b", "a", "p", 4.0, 8.0, "b1", "a1"), (2, "c", "c", "p", 1.0, 2.0, "c2", "c2t")]
    got = collect.collect_unique_solutions(spark.createDataFrame(rows, schema))
    assert {(r["solution_id"], r["runtime"], r["code"]) for r in got.collect()} == {("a", 8.0, "a1"), ("b", 4.0, "b1"), ("c", 2.0, "c2t")}


def test_index_round_trip_with_a_hot_problem(subs):
    index = collect.build_problem_index(subs, buckets=4)
    keys = [tuple(r) for r in index.select("problem_id", "bucket", "user_id").collect()]
    assert len(keys) == len(set(keys)) and {bucket for _, bucket, _ in keys} <= set(range(4))
    flat = collect.flatten_problem_index(index).select(*subs.columns)
    assert sorted(map(tuple, flat.collect())) == sorted(submissions())
    # The rows of a key do not depend on what else is there.
    part = collect.build_problem_index(subs.filter("problem_id = 'p0'"), buckets=4)
    order = lambda rows: sorted((r["bucket"], r["user_id"], sorted(r["solutions"])) for r in rows)
    assert order(part.collect()) == order(index.filter("problem_id = 'p0'").collect())


@pytest.mark.parametrize("limit", [1, 2])
def test_active_users(subs, limit):
    groups = by_group(submissions())
    wanted = {row[0] for group in groups.values() if len(group) > limit for row in group}
    assert {r["seq"] for r in collect.filter_active_users(subs, limit).collect()} == wanted
    stats = collect.activity_stats(subs, limit).first()
    kept = [key for key, group in groups.items() if len(group) > limit]
    assert stats["solutions_after"] == len(wanted)
    assert stats["submission_sets"] == len(kept)
    assert stats["unique_users"] == len({user for _, user in kept})
    assert stats["problems_after"] == len({problem for problem, _ in kept})


def test_dense_index_over_gaps_and_negative_values(spark):
    values = [-70, -9, -1, 0, 3, 9, 10, 11, 500, 501, 100000]
    frame = spark.createDataFrame([(v,) for v in reversed(values)], "seq bigint")
    got = {r["seq"]: r["i"] for r in dense_index(frame, "seq", "i", ranges=4).collect()}
    assert got == {v: i for i, v in enumerate(values)}
    names = spark.createDataFrame([(f"{v * 7919 % 1000}-x",) for v in range(300)], "name string").repartition(5)
    got = dense_index(names, "name", "i", ranges=9)
    assert [r["i"] for r in got.orderBy("name").collect()] == list(range(300))
    # What reads the positions neither orders nor shuffles rows again.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan
    assert dense_index(names.limit(0), "name", "i").count() == 0 and dense_index(names, "name", "i").count() == 300


@pytest.mark.parametrize("cuts, small", [(64, 4096), (3, 1), (7, 20)])
def test_first_rows_are_exact_for_any_refinement(spark, cuts, small):
    rng = random.Random(cuts)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.choice((None, nan, inf, -inf, 0.0, 1.5, -2.0)), rng.choice((None, "a", "b", "é"))) for i in range(200)]
    frame = spark.createDataFrame(rows, "id bigint, x double, name string").repartition(5)
    for keys in ([F.col("x"), F.col("id")], [F.col("name"), -F.col("x"), -F.col("id")], [F.col("id")]):
        wanted = [r["id"] for r in frame.orderBy(*keys).select("id").collect()]
        for n in (0, 1, 7, 100, 199, 200, 500):
            got = first_rows(frame, n, keys, cuts, small)
            assert sorted(r["id"] for r in got.collect()) == sorted(wanted[:n]), (keys, n)
    with pytest.raises(ValueError, match="tell them apart"):
        first_rows(spark.range(50).selectExpr("1 AS x"), 7, [F.col("x")], cuts, small)


def test_a_million_first_rows_stay_partitioned(spark):
    frame = spark.range(0, 1_500_000, numPartitions=8).selectExpr("id", "hash(id) AS score")
    chosen = first_rows(frame, 1_000_000, [F.col("score"), F.col("id")])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("TakeOrdered", "GlobalLimit", "Exchange", "Sort"))
    assert chosen.rdd.getNumPartitions() == 8
    sizes = [r["count"] for r in chosen.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1_000_000 and max(sizes) < 150_000
    last = chosen.agg(F.max("score")).first()[0]
    assert frame.filter(F.col("score") < last).count() <= 1_000_000 <= frame.filter(F.col("score") <= last).count()


@pytest.mark.parametrize("k", [1, 3, 50])
def test_top_k_is_exact_for_any_salting(subs, k):
    order = [F.desc("runtime"), F.col("seq")]
    got = top_k_per_group(subs, ["problem_id"], order, k, "rank", "seq", salts=3).select("problem_id", "seq", "rank")
    wanted = []
    for problem in {r[2] for r in submissions()}:
        ranked = sorted((r for r in submissions() if r[2] == problem), key=lambda r: (-r[4], r[0]))
        wanted += [(problem, r[0], i + 1) for i, r in enumerate(ranked[:k])]
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_running_extremes_do_not_depend_on_the_block_width(spark, width):
    rng = random.Random(3)
    rows = [(key, i, rng.choice([None, 1.0, 2.0, 3.0, 4.0])) for key, n in (("a", 1), ("b", 10), ("hot", 60)) for i in range(n)]
    frame = spark.createDataFrame(rows, "key string, gen int, value double").withColumn("block", F.col("gen") - F.col("gen") % width)
    extremes = {"low": F.col("value")}, {"high": F.col("value")}
    carried = frame.join(block_carries(frame, ["key"], "block", *extremes), ["key", "block"])
    got = running_extremes(carried, ["key"], "gen", "block", *extremes, "is_last").select("key", "gen", "low", "high", "is_last")
    wanted = []
    for key in ("a", "b", "hot"):
        values = [v for k, _, v in rows if k == key]
        for i in range(len(values)):
            seen = [v for v in values[: i + 1] if v is not None]
            wanted.append((key, i, min(seen, default=None), max(seen, default=None), i == len(values) - 1))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == sorted(wanted, key=lambda r: r[:2])


def test_metadata_audit(spark):
    solutions = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "solution_id string, problem_id string")
    metadata = spark.createDataFrame([("a", "p", "u"), ("b", "q", "u")], "submission_id string, problem_id string, user_id string")
    assert tuple(collect.metadata_audit(solutions, metadata).first()) == (1, 1, 1)
    assert [tuple(r) for r in collect.attach_users(solutions, metadata).collect()] == [("a", "p", "u")]


def test_clean_test_set_keeps_twenty_tests(spark):
    schema = "seq bigint, problem_id string, src_id string, tgt_id string, src_code string, tgt_code string, fastest_code string, tests array<int>, extra int"
    rows = [(7, "p", "a", "b", "x", "y", "z", list(range(30)), 1), (3, "p", "c", "d", "x", "y", "z", [5], 1)]
    got = {r["id"]: r for r in collect.clean_test_set(spark.createDataFrame(rows, schema)).collect()}
    assert got["pie_test_0"]["src_id"] == "c" and got["pie_test_1"]["tests"] == list(range(20))
    assert "extra" not in got["pie_test_0"].asDict()


def test_drop_identical_pairs(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "b")], "src_code string, tgt_code string")
    assert pairs.drop_identical_pairs(frame).count() == 1


@pytest.mark.parametrize("ranges, least", [(1, 1.1), (5, 1.1), (256, 2.0)])
def test_pair_totals_against_all_pairs(spark, ranges, least):
    """Ties, a hot group, runtimes whose ratios are at the threshold or a place beside it, and runtimes that count for nothing."""
    rng = random.Random(ranges)
    times = [1.0, 1.1, 1.21, 2.0, 2.2, 3.3, 0.1, 0.11, 1e-310, 1e300, None, 0.0, -1.0, float("inf"), float("nan")]
    times += [math.nextafter(x * least, y) for x in (0.1, 0.3, 0.7, 1.0, 3.3) for y in (-9, 9)] + [x * least for x in (0.1, 0.3, 0.7, 3.3)] + [0.3, 0.7, 3.3]
    rows = [(n, f"p{rng.randint(0, 3)}", "hot" if rng.random() < 0.5 else f"u{rng.randint(0, 4)}", rng.choice(times)) for n in range(500)]
    wanted = defaultdict(lambda: [0, 0])
    groups = defaultdict(list)
    for seq, problem, user, time in rows:
        if time is not None and 0 < time < float("inf"):
            groups[problem, user].append((time, seq))
    for (problem, _), group in groups.items():
        group.sort()
        wanted[problem][0] += sum(s / t >= least for j, (s, _) in enumerate(group) for t, _ in group[:j])
        wanted[problem][1] += sum(s / group[0][0] >= least for s, _ in group)
    frame = spark.createDataFrame(rows, "seq bigint, problem_id string, user_id string, runtime double")
    got = {r["problem_id"]: [r["pairs"], r["best_pairs"]] for r in pairs.pair_totals(frame, least, ranges).collect()}
    assert got == wanted and sum(p for p, _ in got.values()) > 1000
    assert pairs.pair_totals(frame.limit(0), least, ranges).count() == 0
