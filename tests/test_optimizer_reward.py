"""The reward of what optimizers make of completions, from stored and measured results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.operators import measurements, pairs, report, rewards


def test_reward_takes_baselines_measurements_and_missing_programs(spark):
    rows = [(1, 1.0, 6.0), (2, None, None), (3, None, None), (4, 1.0, 6.0), (5, 1.0, 3.0)]
    completions = spark.createDataFrame(rows, "seq int, accuracy double, agg_runtime double")
    baselines = spark.createDataFrame([(1, 1.0, 100.0), (2, 1.0, 8.0)], "seq int, accuracy double, agg_runtime double")
    programs = spark.createDataFrame([(i, o, "No Code" if i == 4 else "x") for i in range(1, 6) for o in "ab"], "seq int, optimizer string, code string")
    measured = [(i, o, 1.0, t) for i in (1, 2, 3, 4) for o, t in (("a", 2.0), ("b", 4.0))] + [(5, "a", 0.5, 1.0), (5, "b", 1.0, 4.0)]
    measurements_ = spark.createDataFrame(measured, "seq int, optimizer string, accuracy double, agg_runtime double")
    got = {r["seq"]: r["cos_optimizer_code"] for r in rewards.optimizer_reward(completions, programs, measurements_, baselines).collect()}
    # 3 has no baseline, 4 no program; 5 is (0 + 0.75) / 2.
    assert got == {1: 2.25 * 2.25, 2: 9.0, 3: -100.0, 4: -100.0, 5: -1.0}


def test_programs_of_every_optimizer_and_of_null_completions(spark):
    rows = spark.createDataFrame([(1, "s", "how"), (2, "s", None)], "seq int, org_code string, completion string")
    def echo():
        return lambda prompts: [f"```cpp\n{p}\n```" for p in prompts]
    got = rewards.optimizer_programs(rows, {"a": echo, "b": echo}, "{{  src_code  }}|{{  suggestion  }}").collect()
    assert sorted(map(tuple, got)) == [(1, "a", "s|how\n"), (1, "b", "s|how\n"), (2, "a", "No Code"), (2, "b", "No Code")]


def test_scores_name_the_table_they_lack(spark):
    rows = spark.createDataFrame([(1, "x")], "seq int, completion string")
    for name, needs in (("pie_code", "code_scores"), ("cos_optimizer_code", "optimizer_rewards")):
        with pytest.raises(ValueError, match=needs):
            rewards.score_completions(rows, [name])
    scores = spark.createDataFrame([(2, 0.5)], "seq int, score double")
    assert rewards.score_completions(rows, ["pie_code"], code_scores=scores).first()["reward"] == 0.0


def test_unclear_pair_ids_fail_and_columns_may_hold_hyphens(spark):
    subs = spark.createDataFrame([(0, "a-1", "p", "u", 9.0), (1, "b", "p", "u", 3.0)], "seq int, solution_id string, problem_id string, user_id string, runtime double")
    known = spark.createDataFrame([("p", "a-1", "b")], "problem_id string, src_id string, tgt_id string")
    assert [r["id"] for r in pairs.speed_ordered_pairs(subs, known).collect()] == ["p-a-1-b"]
    with pytest.raises(Exception, match="no problem and two solutions"):
        pairs.speed_ordered_pairs(subs, spark.createDataFrame([("p-a-1-b",)], "id string")).collect()


def test_native_timings_stand_beside_simulator_results(spark):
    both = spark.createDataFrame([(0, 1, "v0", 2.0), (1, 1, "v1", 3.0)], "seq int, pair_id int, version string, agg_runtime double")
    native = spark.createDataFrame([(0, 0.5, 0.1)], "seq int, agg_runtime double, agg_stdev double")
    got = measurements.pair_results(measurements.with_native(both, native), ["agg_runtime", "agg_runtime_binary"]).first()
    assert (got["agg_runtime_v0"], got["agg_runtime_v1"], got["agg_runtime_binary_v0"], got["agg_runtime_binary_v1"]) == (2.0, 3.0, 0.5, None)


def test_completed_rows_get_empty_test_maps(spark):
    results = spark.createDataFrame([(1, 0, 2.0, 1.0)], "seq int, gen int, agg_runtime double, accuracy double").withColumn("tc2time", F.create_map(F.lit("t"), F.lit(1.0)))
    reference = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "seq int, src_code string, tgt_code string")
    assert {r["seq"]: r["tc2time"] for r in report.complete_missing(results, reference).collect()} == {1: {"t": 1.0}, 2: {}}
