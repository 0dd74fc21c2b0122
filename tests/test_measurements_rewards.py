from __future__ import annotations

import math
import statistics

import pytest
from pyspark.sql import functions as F

from paceline.functions import numbers
from paceline.functions import rewards as columns
from paceline.functions.text import lines
from paceline.operators import measurements, rewards

INF = float("inf")


def grade(spark, cases):
    frame = spark.createDataFrame([(i, *case) for i, case in enumerate(cases)], "i int, actual string, expected string")
    graded = measurements.grade_outputs(frame.select("i", "actual"), frame.select("i", "expected"), ["i"])
    return [r["score"] for r in graded.orderBy("i").collect()]


def test_grade_outputs(spark):
    cases = [
        ("1\n2", "1\n2"),
        (" 1\n2.0004 \n", "1\n2"),
        ("1", "1\n2"),
        ("1\n2\n3", "1\n2"),
        ("x", "y"),
        ("nan", "1"),
        ("", "1"),
        ("anything", "  "),
        ("1e0\r\n2", "1\n2"),
    ]
    assert grade(spark, cases) == [1.0, 1.0, 0.5, 1.0, 0.0, 0.0, 0.0, None, 1.0]


def test_lines_feed_the_grader(column):
    assert column(F.size(lines("text")), ["a\r\n\r\nb", ""]) == [3, 0]


def test_accuracy_counts_missing_and_uncompiled_as_zero(spark):
    expected = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in (1, 2)], "seq int, tc_no int")
    graded = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (2, 1, 1.0), (3, 1, 1.0), (3, 2, 1.0)], "seq int, tc_no int, score double")
    compiled = spark.createDataFrame([(1, True), (2, True), (3, False)], "seq int, compilation boolean")
    accuracies = measurements.accuracy_by_submission(expected, graded, compiled)
    assert {r["seq"]: r["accuracy"] for r in accuracies.collect()} == {1: 0.75, 2: 0.5, 3: 0.0}
    timings = spark.createDataFrame([(1, 1.0), (2, 1.0)], "seq int, time_s double")
    assert [r["seq"] for r in measurements.gate_by_accuracy(timings, accuracies, 0.6).collect()] == [1]


TESTS = "seq int, tc_no int, success boolean, time_s double"


def test_failures_mask_later_tests_and_make_the_sum_infinite(spark):
    rows = [(1, 1, True, 1.0), (1, 2, True, 2.0), (2, 1, True, 1.0), (2, 2, False, 9.0), (2, 3, True, 4.0)]
    tests = spark.createDataFrame(rows, TESTS)
    masked = measurements.mask_after_failure(tests)
    got = {(r["seq"], r["tc_no"]): (r["success"], r["time_s"]) for r in masked.collect()}
    assert got == {(1, 1): (True, 1.0), (1, 2): (True, 2.0), (2, 1): (True, 1.0), (2, 2): (False, None), (2, 3): (False, None)}
    submissions = spark.createDataFrame([(1,), (2,), (3,)], "seq int")
    runtimes = measurements.aggregate_runtime(masked, submissions=submissions)
    assert {r["seq"]: (r["agg_runtime"], r["passed_tests"]) for r in runtimes.collect()} == {1: (3.0, 2), 2: (INF, 1), 3: (INF, 0)}
    maps = {r["seq"]: r for r in measurements.result_maps(masked).collect()}
    assert maps[2]["tc2time"] == {1: 1.0, 2: INF, 3: INF} and maps[1]["tc2success"] == {1: True, 2: True}


def test_native_timings_are_cut_to_the_shortest_test(spark):
    rows = [
        (1, 1, [1.0, 2.0, 3.0]),
        (1, 2, [10.0, 20.0]),
        (2, 1, [1.0]),
        (2, 2, None),
        (3, 1, []),
        (4, 1, [5.0, 7.0, 9.0]),
    ]
    frame = spark.createDataFrame(rows, "seq int, tc_no int, times array<double>")
    got = {r["seq"]: (r["agg_runtime"], r["agg_stdev"]) for r in measurements.aggregate_native_timings(frame).collect()}
    assert got[1] == (16.5, statistics.pstdev([11.0, 22.0]))
    assert got[2] == (INF, INF) and got[3] == (INF, INF)
    assert got[4] == (7.0, pytest.approx(statistics.pstdev([5.0, 7.0, 9.0])))


def test_pair_results_and_test_matrix(spark):
    frame = spark.createDataFrame([(1, "v0", 2.0), (1, "v1", 1.0), (2, "v0", 3.0)], "pair_id int, version string, agg_runtime double")
    got = measurements.pair_results(frame, ["agg_runtime"]).orderBy("pair_id")
    assert [tuple(r) for r in got.collect()] == [(1, 2.0, 1.0), (2, 3.0, None)]
    expected = spark.createDataFrame([(1, 1), (1, 2)], "seq int, tc_no int")
    results = spark.createDataFrame([(1, 2, True, 1.0), (9, 9, True, 1.0)], TESTS)
    matrix = measurements.complete_test_matrix(results, expected).orderBy("tc_no")
    assert [tuple(r) for r in matrix.collect()] == [(1, 1, None, None), (1, 2, True, 1.0)]


def test_stats_lines(spark):
    text = [
        "---------- Begin Simulation Statistics ----------",
        "sim_ticks   500   # ticks",
        "",
        "sim_freq  1000",
        "ipc nan",
        "rate 12.5% # share",
        "dist 1 50% x",
        "orphan # comment",
        "neg -inf",
        "sim_ticks   700",
        "---------- End Simulation Statistics ----------",
    ]
    frame = spark.createDataFrame([("f", i, line) for i, line in enumerate(text)], "file string, line_no int, line string")
    values = measurements.parse_stats_lines(frame)
    got = {(r["key"], r["pos"]): (r["raw"], r["value"]) for r in values.collect()}
    assert got == {
        ("sim_ticks", 0): ("700", 700.0),
        ("sim_freq", 0): ("1000", 1000.0),
        ("ipc", 0): ("nan", None),
        ("rate", 0): ("12.5%", 12.5),
        ("dist", 0): ("1", 1.0),
        ("dist", 1): ("50%", 50.0),
        ("dist", 2): ("x", None),
        ("neg", 0): ("-inf", None),
    }
    assert measurements.simulated_seconds(values).first()["sim_seconds_precise"] == 0.7


def test_scores_and_lost_evaluations(spark):
    rows = [(1, True, 1.0, 2.0), (2, True, 0.5, INF), (3, False, 1.0, 1.0), (4, True, 1.0, 0.0)]
    frame = spark.createDataFrame(rows, "seq int, compilation boolean, accuracy double, agg_runtime double")
    assert {r["seq"]: r["score"] for r in measurements.score_submissions(frame).collect()} == {1: 0.75, 2: 0.25, 3: 0.0, 4: None}
    submissions = spark.createDataFrame([(1,), (9,)], "seq int")
    filled = {r["seq"]: tuple(r)[1:] for r in measurements.default_failed_results(submissions, frame).collect()}
    assert filled == {1: (True, 1.0, 2.0), 9: (False, 0.0, 0.0)}


def test_validate_submissions(spark):
    rows = [(1, "x", 3, "gem5"), (2, "", 3, "both"), (3, None, 0, "fast"), (4, "x", None, None)]
    frame = spark.createDataFrame(rows, "seq int, code string, n_tests int, timing_mode string")
    accepted, rejected = measurements.validate_submissions(frame)
    assert [r["seq"] for r in accepted.collect()] == [1]
    assert {r["seq"]: len(r["violations"]) for r in rejected.collect()} == {2: 1, 3: 3, 4: 2}


GOOD = "<think>\nwhy\n</think>\n<answer>\nso ```cpp\nint a;\n```\n</answer>"


def test_format_rewards(column):
    samples = [GOOD, GOOD + "\nmore", "x" + GOOD, GOOD + "x", GOOD.replace("```cpp", "```"), "<think>\n</think>\n"]
    assert column(columns.format_reward("text"), samples) == [1.0, 1.0, 0.0, 0.0, 1.0, 0.0]
    assert column(columns.code_format_reward("text"), samples) == [1.0, 1.0, 0.0, 0.0, 0.0, 0.0]
    assert column(columns.tag_count_reward("text"), [GOOD, GOOD * 2, "<think>\nx", ""]) == [1.0, 0.0, 0.25, 0.0]


def test_reasoning_steps(column):
    samples = ["1. a\n2. b", "Step 1: a\n- b\n* c\nFirst, d", "Next, x", "First\nnext"]
    assert column(columns.reasoning_steps_reward("text"), samples) == [pytest.approx(v) for v in (1 / 3, 1.0, 1 / 3, 0.0)]


def test_answer_match(spark):
    rows = [
        (0, r"\boxed{1} then \boxed{ 4 }", "4"),
        (1, r"\boxed{4.0}", "4"),
        (2, r"\boxed{5}", "4"),
        (3, "none", "4"),
        (4, r"\boxed{4}", "  "),
        (5, r"\boxed{a b}", "ab"),
    ]
    frame = spark.createDataFrame(rows, "i int, completion string, gold string")
    got = frame.select(columns.answer_match("completion", "gold").alias("v"), "i").orderBy("i")
    assert [r["v"] for r in got.collect()] == [1.0, 1.0, 0.0, 0.0, None, 1.0]


def test_repetition_penalty(column):
    samples = ["a b c a b c a b c", "one two", "", "a b c d", "A b　a B a"]

    def wanted(s, n=3):
        tokens = s.lower().split()
        if len(tokens) < n:
            return 0.0
        grams = [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]
        return -(1 - len(set(grams)) / len(grams))

    assert column(columns.repetition_penalty_reward("text"), samples) == [pytest.approx(wanted(s)) for s in samples]
    with pytest.raises(ValueError):
        columns.repetition_penalty_reward("text", max_penalty=0.5)


def test_cosine_and_overlong(spark):
    rows = [(0, "x" * 10, True), (1, "x" * 10, False), (2, "x" * 10, None), (3, "", True)]
    frame = spark.createDataFrame(rows, "i int, completion string, is_correct boolean")
    reward = columns.cosine_scaled_reward("completion", "is_correct", max_len=40)
    got = [r["v"] for r in frame.select(reward.alias("v"), "i").orderBy("i").collect()]
    cosine = math.cos(math.pi / 4)
    assert got == [pytest.approx(v) for v in (0.5 + 0.25 * (1 + cosine), -0.5 + 0.25 * (1 + cosine), 1.0, 1.0)]
    lengths = spark.createDataFrame([(n,) for n in (6, 8, 10, 11)], "n int")
    punished = lengths.select(columns.soft_overlong_punishment("n", 10, 4).alias("v"))
    assert [r["v"] for r in punished.collect()] == [0.0, -0.5, -1.0, -1.0]


def test_length_reward(spark):
    rows = [("a", "x", True), ("a", "xxx", True), ("a", "xxx", False), ("a", "x", False), ("a", "xx", None), ("b", "x", True), ("b", "y", False)]
    frame = spark.createDataFrame(rows, "batch_id string, completion string, is_correct boolean")
    got = sorted((r["batch_id"], r["completion"], str(r["is_correct"]), r["length"]) for r in rewards.length_reward(frame).collect())
    assert got == sorted(
        [
            ("a", "x", "True", 0.5),
            ("a", "xxx", "True", -0.5),
            ("a", "xxx", "False", -0.5),
            ("a", "x", "False", 0.0),
            ("a", "xx", "None", 0.0),
            ("b", "x", "True", 0.0),
            ("b", "y", "False", 0.0),
        ]
    )


def test_speedup_reward_counts_every_optimizer(spark):
    rows = [
        (1, 0, 8.0, 2.0, 1.0),
        (1, 1, 8.0, 4.0, 1.0),
        (2, 0, 8.0, 2.0, 0.5),
        (2, 1, INF, 2.0, 1.0),
        (3, 0, 1.0, 2.0, 1.0),
        (4, 0, 8.0, INF, 1.0),
    ]
    frame = spark.createDataFrame(rows, "completion_id int, optimizer int, src_runtime double, tgt_runtime double, tgt_acc double")
    assert {r["completion_id"]: r["reward"] for r in rewards.speedup_reward(frame).collect()} == {1: 9.0, 2: -100.0, 3: -1.0, 4: -100.0}


def test_measured_reward_and_baselines(spark):
    completions = spark.createDataFrame([(1, "```cpp\na\n```"), (2, "none")], "seq int, completion string")
    scores = spark.createDataFrame([(1, 0.75)], "seq int, score double")
    got = {r["seq"]: (r["code"], r["pie_code"]) for r in rewards.measured_code_reward(completions, scores).collect()}
    assert got == {1: ("a\n", 0.75), 2: ("No Code", 0.0)}
    rows = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0), (3, 1.0, None)], "seq int, accuracy double, agg_runtime double")
    measured = spark.createDataFrame([(i, 0.5, 9.0) for i in (1, 2, 3)], "seq int, accuracy double, agg_runtime double")
    chosen = rewards.baseline_or_measure(rows, measured, ["seq"])
    assert {r["seq"]: (r["accuracy"], r["agg_runtime"]) for r in chosen.collect()} == {1: (1.0, 2.0), 2: (0.5, 9.0), 3: (0.5, 9.0)}


def test_score_completions(spark):
    rows = [(1, GOOD, "", True), (1, "Next, x", "1", False)]
    frame = spark.createDataFrame(rows, "batch_id int, completion string, gold string, is_correct boolean")
    scored = rewards.score_completions(frame, ["accuracy", "format", "length"], [1.0, 2.0, 4.0])
    got = {r["completion"]: (r["reward_accuracy"], r["reward"]) for r in scored.collect()}
    assert got[GOOD] == (None, 2.0 + 4.0 * -0.5) and got["Next, x"] == (0.0, 0.0)
    with pytest.raises(KeyError, match="nonsense"):
        rewards.score_completions(frame, ["nonsense"])
    with pytest.raises(ValueError):
        rewards.score_completions(frame, ["format"], [1.0, 2.0])


def test_threshold_names():
    assert [numbers.threshold_name(t) for t in (1.1, 1.25, 2.0, 10.0)] == ["1_1", "1_25", "2", "10"]
