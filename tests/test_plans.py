"""What the plans must not contain, and what must reach the scans."""

from __future__ import annotations

import re

import pytest
from bench import HEADLINES

from paceline.operators import ranking, selection
from paceline.plans.catalogue import ORACLES, QUERIES
from paceline.plans.views import VIEWS, Inputs

SF_DIR = "/root/testdata/sf0.001"
# They write files or run a stream before they return their result.
EAGER = {name for name in QUERIES if re.match(r"s\d*_|g6_|g3_generate_in_steps|e_full_report", name)}
PYTHON = {"g3_batch_generate", "g4_multi_generation_extract", "g5_follow_suggestions", "r_optimizer_programs", "r_optimizer_reward"}


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python_outside_generation(name, spark):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ("ArrowEvalPython" in plan) == (name in PYTHON)
    assert "BatchEvalPython" not in plan and "MapInPandas" not in plan


def test_bench_queries_resolve_with_spread_inputs(spark):
    spark.conf.set("spark.paceline.inputPartitions", "3")
    try:
        for name in HEADLINES:
            assert QUERIES[name](spark, SF_DIR).columns, name
        assert "REPARTITION_BY_NUM" in plan_of(QUERIES["m9_parse_stats_files"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.paceline.inputPartitions")


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_queries_read_whole_tables():
    """No view keeps a part of its table by id, modulo, prefix or count."""
    for name, text in VIEWS.items():
        conditions = " ".join(re.findall(r"WHERE (.*?)(?:\n|$)", text))
        assert "%" not in conditions, name
        assert not re.search(r"\bLIMIT\b|\bsubstr\(text|TABLESAMPLE", text), name


def test_rounds_of_5000_rows_rank_narrow_rows_and_positions_of_sparse_ids_many_ranges(spark):
    wide = spark.range(20_000).selectExpr("id", "concat('p', id % 41) AS problem_id", "hash(id) / 7.0D AS score", "repeat('x', 9) AS program")
    chosen = selection.balanced_round_robin(wide, 5000, "id")
    assert chosen.count() == 5000 and chosen.groupBy("problem_id").count().agg({"count": "max"}).first()[0] <= 122
    ranked = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert not any("program" in line for line in ranked.splitlines() if "row_number" in line)
    sparse = spark.range(1000).selectExpr("id * id * 1000003 AS seq")
    sizes = ranking.dense_index(sparse, "seq", "i", ranges=10).selectExpr("i", "seq", "CAST(sqrt(seq / 1000003) + 0.5 AS BIGINT) AS want")
    assert sizes.filter("i <> want").count() == 0 and sizes.count() == 1000


def test_tests_of_a_pair_are_dealt_once(spark):
    """Each step read and dealt the measured tests anew, with all columns that number them."""
    plan = plan_of(QUERIES["m7_pair_results"](spark, SF_DIR))
    assert "l_extendedprice" not in plan and "Window" not in plan
    # What is dealt are the orders and, by pair, the results of submissions; no test.
    dealt = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert dealt and not any("tc_no" in line for line in dealt)


def test_a_saved_view_is_read_by_the_views_over_it(spark):
    inputs = Inputs(spark, SF_DIR)
    before = inputs("untimed_results").count()
    inputs.save("test_results", lambda build: build().filter("seq % 2 = 0"))
    assert 0 < inputs("untimed_results").count() < before
    assert inputs("untimed_results").filter("seq % 2 = 1").count() == 0
    assert Inputs(spark, SF_DIR)("untimed_results").count() == before


def test_programs_are_pruned_from_the_pair_scan(spark):
    plan = plan_of(QUERIES["p1_speed_ordered_pairs"](spark, SF_DIR))
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan


def test_winners_of_the_last_write_are_found_without_programs(spark):
    plan = QUERIES["c1_collect_unique_solutions"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    winners = plan[plan.index("Join LeftSemi") :]
    side = winners[winners.rindex("Aggregate [solution_id") :]
    assert "o_orderpriority" not in side.split("Relation")[0]


def test_filters_and_columns_reach_the_scan(spark):
    views = Inputs(spark, SF_DIR)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(views("subs").filter("seq > 100").select("seq", "runtime"))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(o_orderkey,100\)", plan)
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
