from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from paceline.functions import numbers
from paceline.operators import ranking, report
from paceline.session import materialized

INF = float("inf")
NAN = float("nan")
GENS = "seq bigint, gen int, code string, agg_runtime double, accuracy double"
ROWS = "seq bigint, problem_id string, src_code string, tgt_code string, src_runtime double, tgt_runtime double"


def test_ratio_and_floor_follow_ieee(spark):
    cases = [(4.0, 2.0), (1.0, 2.0), (4.0, 0.0), (0.0, 0.0), (INF, INF), (INF, 2.0), (3.0, INF), (NAN, 1.0), (1.0, NAN)]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a double, b double")
    got = frame.select(numbers.ratio("a", "b").alias("r"), numbers.floored_speedup("a", "b").alias("f"), "i").orderBy("i")
    ratios, floored = zip(*[(r["r"], r["f"]) for r in got.collect()])
    assert ratios[:3] == (2.0, 0.5, INF) and math.isnan(ratios[3]) and math.isnan(ratios[4])
    assert ratios[5:7] == (INF, 0.0) and math.isnan(ratios[7]) and math.isnan(ratios[8])
    # As max(1.0, x), where a NaN comparison is false.
    assert floored == (2.0, 1.0, INF, 1.0, 1.0, INF, 1.0, 1.0, 1.0)


def test_adjusted_runtime_is_infinite_on_either_condition(spark):
    rows = [(0, 0, None, 1.0, 1.0), (1, 0, "x", 2.0, 0.5), (2, 0, "x", 3.0, 1.0), (3, 0, None, 4.0, NAN), (4, 0, "x", 5.0, NAN)]
    got = report.adjust_runtime(spark.createDataFrame(rows, GENS)).orderBy("seq").collect()
    assert [r["adjusted_runtime"] for r in got] == [INF, INF, 3.0, INF, 5.0]


def test_complete_missing_counts_each_program_pair_once(spark):
    reference = spark.createDataFrame(
        [
            (1, "p", "a", "b", 9.0, 3.0),
            (2, "p", "a", "b", 8.0, 4.0),  # the pair of row 1; this one has results
            (3, "p", "c", "d", 7.0, 2.0),  # no results
            (4, "q", "e", "f", 6.0, 1.0),
            (5, "q", "e", "f", 5.0, 1.0),  # repeats row 4, which has results too
            (6, "q", "c", "d", 4.0, 1.0),  # repeats row 3, neither has results
        ],
        ROWS,
    )
    results = spark.createDataFrame(
        [(2, 0, "x", 1.0, 1.0), (2, 1, None, 2.0, 1.0), (4, 0, "y", 1.5, 1.0), (5, 0, "z", 0.5, 1.0)], GENS
    )
    got = report.complete_missing(results, reference)
    rows = sorted((r["seq"], r["gen"], r["code"], r["agg_runtime"], r["accuracy"], r["src_runtime"]) for r in got.collect())
    assert rows == [
        (2, 0, "x", 1.0, 1.0, 8.0),
        (2, 1, None, 2.0, 1.0, 8.0),
        (3, 0, None, INF, 0.0, 7.0),
        (4, 0, "y", 1.5, 1.0, 6.0),
    ]


def evaluation(seed=5, n=25):
    rng = random.Random(seed)
    rows = [(i, f"p{i % 4}", f"s{i}", f"t{i}", float(rng.randrange(1, 20)), float(rng.randrange(1, 10))) for i in range(n)]
    gens = []
    for i in range(n):
        # One row with many generations, some with none.
        count = 40 if i == 3 else rng.randrange(0, 5)
        for gen in range(count):
            code = None if rng.random() < 0.2 else f"g{gen}"
            gens.append((i, gen, code, float(rng.randrange(1, 20)), rng.choice([1.0, 1.0, 0.5, 0.0])))
    return rows, gens


def padded(rows, gens, threshold=1.0):
    """Best at k by the plain definition: every row padded to the largest k."""
    arity = max(g[1] for g in gens) + 1
    table = {}
    for seq, problem, _, _, slow, fast in rows:
        mine = sorted(g for g in gens if g[0] == seq) or [(seq, 0, None, INF, 0.0)]
        adjusted = [INF if g[2] is None or g[4] < threshold else g[3] for g in mine]
        for k in range(1, arity + 1):
            best = min(adjusted[:k])
            accuracy = max(g[4] for g in mine[:k])
            speedup = slow / best
            table[seq, k] = (best, accuracy, accuracy == threshold, max(1.0, speedup), k <= len(mine), problem, slow)
    return arity, table


def test_best_at_k_and_report_against_the_padded_definition(spark):
    rows, gens = evaluation()
    results = report.adjust_runtime(spark.createDataFrame(gens, GENS)).drop("code")
    completed = report.complete_missing(results, spark.createDataFrame(rows, ROWS))
    best = report.best_at_k(completed)
    arity, table = padded(rows, gens)
    got = {(r["seq"], r["k"]): (r["best_runtime"], r["best_accuracy"], r["is_correct"], r["speedup"]) for r in best.collect()}
    assert got == {key: value[:4] for key, value in table.items() if value[4]}
    summary = {r["k"]: r for r in report.report_at_k(best).collect()}
    assert sorted(summary) == list(range(1, arity + 1))
    for k, row in summary.items():
        at_k = [value for (_, kk), value in table.items() if kk == k]
        assert row["programs"] == len(rows)
        assert row["mean_accuracy"] == pytest.approx(sum(v[1] for v in at_k) / len(rows))
        assert row["mean_correct"] == pytest.approx(sum(v[2] for v in at_k) / len(rows))
        assert row["mean_speedup"] == pytest.approx(sum(v[3] for v in at_k) / len(rows))
        for threshold in numbers.REPORT_THRESHOLDS:
            share = sum(v[3] >= threshold for v in at_k) / len(rows)
            assert row[f"share_ge_{numbers.threshold_name(threshold)}"] == pytest.approx(share)
    speedups = [summary[k]["mean_speedup"] for k in sorted(summary)]
    assert speedups == sorted(speedups)
    # Without the carries of complete_missing the result is the same.
    plain = report.best_at_k(completed.drop(*[c for c in completed.columns if c.startswith("carry_") or c == report.BLOCK]))
    assert {(r["seq"], r["k"]): r["speedup"] for r in plain.collect()} == {key: value[3] for key, value in got.items()}


def test_problem_best_against_loops(spark):
    rows, gens = evaluation(seed=9)
    adjusted = report.adjust_runtime(spark.createDataFrame(gens, GENS)).drop("code")
    completed = report.complete_missing(adjusted, spark.createDataFrame(rows, ROWS))
    best = report.problem_best(report.fastest_generated(completed))
    arity, table = padded(rows, gens)
    fastest = {}
    for (seq, k), value in table.items():
        if k == arity:
            fastest[value[5]] = min(fastest.get(value[5], INF), value[0])
    for row in best.collect():
        problem = fastest[row["problem_id"]]
        assert row["problem_runtime"] == problem and row["problem_solved"] == (problem < INF)
        assert row["problem_speedup"] == max(1.0, row["src_runtime"] / problem)
    summary = report.report_problem_best(best).first()
    assert summary["mean_solved"] == pytest.approx(sum(fastest[r[1]] < INF for r in rows) / len(rows))


def test_report_reference_skips_undefined_speedups(spark):
    rows = [(1, "p", "a", "b", 4.0, 2.0), (2, "p", "a", "b", 1.0, 2.0), (3, "p", "a", "b", INF, INF)]
    got = report.report_reference(spark.createDataFrame(rows, ROWS)).first()
    assert got["mean_speedup"] == pytest.approx(1.25) and got["share_ge_2"] == pytest.approx(1 / 3)


def test_prepare_eval(spark):
    rows = [(2, " a ", "b", '["x","y"]'), (1, "c", "c", None), (3, "d", "e", "[]")]
    frame = spark.createDataFrame(rows, "seq int, src_code string, tgt_code string, model string")
    got = report.prepare_eval(frame, ["model"]).orderBy("seq").collect()
    assert [(r["slower_program"], r["model"]) for r in got] == [("a", ["x", "y"]), ("d", [])]
    assert [r["seq"] for r in report.prepare_eval(frame, first_n=1).collect()] == [2]


def test_expand_melt_and_unmelt_round_trip(spark):
    frame = spark.createDataFrame([(1, 7, ["a", "b"]), (2, 7, ["c"]), (3, 8, [])], "src_id int, tgt_id int, model array<string>")
    assert report.generation_arity(frame, "model").first()[0] == 2
    wide = report.expand_generations(frame, "model", 2)
    melted = report.melt_code(wide, ["src_id", "tgt_id"], ["model_0", "model_1"])
    assert sorted(map(tuple, melted.collect())) == [(1, 7, "model_0", "a"), (1, 7, "model_1", "b"), (2, 7, "model_0", "c")]
    back = report.unmelt_results(melted.withColumn("accuracy", F.length("code")), ["model_0", "model_1"], ["code", "accuracy"])
    assert {tuple(r) for r in back.select("src_id", "model_0_code", "model_1_code").collect()} == {(1, "a", "b"), (2, "c", None)}
    padded_rows = report.explode_generations(frame, "model", pad=2)
    assert padded_rows.count() == 6
    assert report.explode_generations(frame, "model").count() == 3
    assert report.explode_generations(frame.filter("src_id = 3"), "model", pad=0).count() == 0
    assert report.explode_generations(frame, "model", pad=1).count() == 4


def test_generations_are_not_made_again_for_a_filter_on_their_number(spark):
    """A filter that Spark infers from an inner explode goes below costly arrays, such as parsed ones, and makes them again."""
    texts = spark.createDataFrame([(1, '["a", null]'), (2, "[]"), (3, None)], "seq int, text string")
    long = report.explode_generations(texts.select("seq", F.from_json("text", "array<string>").alias("model")), "model")
    assert set(map(tuple, long.collect())) == {(1, 0, "a"), (1, 1, None)}
    assert long._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_unmelt_keeps_both_targets_of_a_source(spark):
    rows = [(1, 7, "m", 0.5), (1, 8, "m", 1.0)]
    frame = spark.createDataFrame(rows, "src_id int, tgt_id int, code_type string, accuracy double")
    got = report.unmelt_results(frame, ["m", "n"], ["accuracy", "accuracy"][:1])
    assert got.count() == 2


def test_baselines_are_set_aside_or_kept_under_another_name(spark):
    rows = [("src_code", "a", 1.0), ("tgt_code", "b", 1.0), ("model", "c", 1.0)]
    frame = spark.createDataFrame(rows, "code_type string, code string, src_agg_runtime double")
    to_measure, aside = report.split_baseline_rows(frame)
    assert [r["code"] for r in to_measure.collect()] == ["c"] and aside.count() == 2
    restored = report.restore_baseline_rows(to_measure.withColumn("accuracy", F.lit(1.0)), aside)
    assert restored.count() == 3 and restored.filter("accuracy IS NULL").count() == 2
    everything, nothing = report.split_baseline_rows(frame, redo=True)
    assert everything.count() == 3 and nothing.count() == 0
    assert "src_original_agg_runtime" in everything.columns


def test_key_columns_keep_tests_and_src_id(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "tests int, src_id int, model_0 int, x_accuracy int, other int, src_code int")
    assert report.project_key_columns(frame, "model").columns == ["tests", "src_id", "model_0", "x_accuracy", "src_code"]


def test_order_tests(spark):
    frame = spark.createDataFrame([([1, 3, 2],)], "tests array<int>")
    assert report.order_tests(frame).first()["tests"] == [3, 2, 1]


def test_running_sums_against_loops_and_without_a_window_over_all_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), k, rng.choice((None, 0, 1, 5)), float(k)) for k in sorted(rng.sample(range(-40, 400), 150))]
    frame = spark.createDataFrame(rows, "model string, k bigint, n bigint, x double").repartition(3)
    for width in (1, 7, 64, 5000):
        got = ranking.running_sums(frame, ["model"], "k", ["n", "x"], width)
        assert got.columns == ["model", "k", "n", "x", "before_n", "before_x"]
        for row in got.collect():
            earlier = [r for r in rows if r[0] == row["model"] and r[1] < row["k"]]
            assert (row["before_n"], row["before_x"]) == (sum(r[2] or 0 for r in earlier), sum(r[3] for r in earlier))
        assert got.count() == len(rows)
    plain = ranking.running_sums(frame.drop("model"), [], "k", ["n"], 64)
    assert plain.count() == len(rows) and plain.agg(F.max("before_n")).first()[0] == sum(r[2] or 0 for r in sorted(rows, key=lambda r: r[1])[:-1])
    assert ranking.running_sums(frame.limit(0), ["model"], "k", ["n"]).count() == 0
    windows = [line for line in plain._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window [" in line]
    # Rows are ordered inside their block only; what is ordered as a whole are the blocks.
    assert len(windows) == 2 and sum("_block" in line.split("windowspecdefinition")[0] or "[_block" in line for line in windows) == 2


def test_inputs_of_the_report_are_scanned_once(spark, tmp_path):
    """The executed plans of completion, problem best and best at k read each given table in one scan."""
    rows, gens = evaluation(seed=2)
    spark.createDataFrame(gens, GENS).write.parquet(f"{tmp_path}/gens")
    spark.createDataFrame(rows, ROWS).write.parquet(f"{tmp_path}/rows")
    opened = []

    def counted(name, schema):
        def note(batches):
            for batch in batches:
                with open(f"{tmp_path}/{name}.log", "a") as log:
                    log.write(f"{batch.num_rows}\n")
                yield batch

        opened.append(name)
        return spark.read.parquet(f"{tmp_path}/{name}").coalesce(1).mapInArrow(note, schema)

    def reads(name):
        lines = (tmp_path / f"{name}.log").read_text().split()
        (tmp_path / f"{name}.log").write_text("")
        return sum(map(int, lines))

    for build in (lambda c: report.problem_best(report.fastest_generated(c)), lambda c: report.report_at_k(report.best_at_k(c)), lambda c: c):
        adjusted = report.adjust_runtime(counted("gens", GENS)).drop("code")
        build(report.complete_missing(adjusted, counted("rows", ROWS))).collect()
        assert reads("gens") == len(gens) and reads("rows") == len(rows)


def test_full_report_moves_neither_programs_nor_test_times(spark, monkeypatch):
    reference = spark.createDataFrame(
        [("m", i, "p1", f"slow {i}", "fast", 4.0, 2.0, f"s{i}", f"t{i}") for i in range(3)],
        "model string, seq int, problem_id string, src_code string, tgt_code string, src_runtime double, tgt_runtime double, src_id string, tgt_id string",
    )
    outputs = spark.createDataFrame([("m", 0, ["a", None]), ("m", 1, ["b"])], "model string, seq int, codes array<string>")
    measured = spark.createDataFrame(
        [("m", 0, 0, 1.0, 2.0, {"1": 1.0}), ("m", 0, 1, 1.0, 1.0, {"1": 1.0}), ("m", 1, 0, 0.5, 1.0, {})],
        "model string, seq int, gen int, accuracy double, agg_runtime double, tc2time map<string, double>",
    )
    written = {}

    def noting(df, name):
        written[name] = df.schema
        return materialized(df, name)

    monkeypatch.setattr(report, "materialized", noting)
    rows = sorted(map(tuple, report.full_report(outputs, reference, measured).select("k", "programs", "mean_accuracy", "mean_speedup", "solved").collect()))
    assert rows == [(1, 3, 0.5, pytest.approx(4 / 3), 1.0), (2, 3, 0.5, pytest.approx(4 / 3), 1.0)]
    moved = {name for schema in written.values() for name in schema.names}
    assert not moved & {"src_code", "tgt_code", "code", "tc2time", "src_id", "tgt_id"}
    assert written["reference"]["_key"].dataType.simpleString() == "binary"


def test_glued_programs_and_missing_ones_have_keys_of_their_own(spark):
    rows = [("ab", "c"), ("a", "bc"), ("ab", "c"), (None, "c"), (None, "c")]
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "seq int, src_code string, tgt_code string")
    keys = [bytes(r["_key"]) for r in report.without_programs(frame).orderBy("seq").collect()]
    assert len(set(keys)) == 4 and keys[0] == keys[2] and all(len(key) == 16 for key in keys[:3])


def test_results_without_a_generation_number_stay_apart(spark):
    results = spark.createDataFrame([(1, 0, 2.0), (1, None, 3.0)], "seq int, gen int, agg_runtime double")
    reference = spark.createDataFrame([(1, "a", "b")], "seq int, src_code string, tgt_code string")
    got = report.complete_missing(results, reference).select("gen", "agg_runtime").collect()
    assert sorted(map(tuple, got)) == [(0, 2.0), (0, float("inf"))]
