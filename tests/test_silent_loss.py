"""Input that must not be lost or read wrongly: nulls, glued texts, brackets, plus signs, malformed lines."""

from __future__ import annotations

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paceline.functions.text import listed
from paceline.operators import assembly, measurements, pairs, report
from paceline.session import scratch_path
from paceline.sources import files

# Which of them is raised depends on where in a job the error arises.
ERRORS = (PySparkException, Py4JJavaError)
ROWS = "seq int, problem_id string, src_code string, tgt_code string, src_runtime double, tgt_runtime double"


def test_lists_are_whole_lists(column):
    texts = ['["a","b"]', "[1] see note", '["x"] tail', "[1] see [2]", "[]", "plain", None]
    assert column(listed(F.col("text")), texts) == [["a", "b"], ["[1] see note"], ['["x"] tail'], ["[1] see [2]"], [], ["plain"], None]


def test_rows_without_a_program_stay(spark):
    rows = spark.createDataFrame([(1, "a", None, "t"), (2, "a", "a", "[x"), (3, None, "b", '["u","v"]'), (4, "a", "b", None)], "seq int, src_code string, tgt_code string, tags string")
    assert sorted(r["seq"] for r in pairs.drop_identical_pairs(rows).collect()) == [1, 3, 4]
    assert {r["seq"]: r["tags"] for r in report.prepare_eval(rows, ["tags"]).collect()} == {1: ["t"], 3: ["u", "v"], 4: None}


def test_rows_are_the_same_only_with_both_programs(spark):
    rows = [(1, "p", "ab", "c", 9.0, 3.0), (2, "p", "a", "bc", 8.0, 4.0), (3, "p", None, "x", 7.0, 2.0), (4, "p", None, "x", 6.0, 1.0), (5, "p", "x", None, 6.0, 1.0)]
    results = spark.createDataFrame([], "seq int, gen int, code string, agg_runtime double, accuracy double")
    completed = report.complete_missing(results, spark.createDataFrame(rows, ROWS))
    assert sorted(r["seq"] for r in completed.collect()) == [1, 2, 3, 4, 5]


def test_a_passed_test_without_time_is_no_fast_one(spark):
    tests = spark.createDataFrame([(1, 0, True, None), (1, 1, True, 2.0), (2, 0, True, 1.0)], "seq int, tc_no int, success boolean, time_s double")
    assert {r["seq"]: r["agg_runtime"] for r in measurements.aggregate_runtime(tests).collect()} == {1: float("inf"), 2: 1.0}


def test_a_missing_problem_is_an_error_whatever_is_read(spark):
    examples = spark.createDataFrame([("p1-a-b",), ("p2-a-b",)], "id string")
    tests = spark.createDataFrame([("p1", ["t"])], "problem_id string, testcases array<string>")
    with pytest.raises(ERRORS, match="p2"):
        assembly.attach_testcases(examples, tests).select("id").collect()


def test_model_names_with_a_plus_and_malformed_lines(spark, tmp_path):
    (tmp_path / "gpt+cot.jsonl").write_text('{"seq": 1, "gpt+cot_resp": "[1] note", "gpt+cot": "x"}\n')
    read = lambda: files.read_model_outputs(spark, str(tmp_path), "seq int").collect()
    assert [tuple(r) for r in read()] == [("gpt+cot", 1, ["[1] note"], ["x"])]
    (tmp_path / "bad.jsonl").write_text('{"seq": 1\n')
    with pytest.raises(ERRORS):
        read()
    with pytest.raises(ERRORS):
        files.read_records(spark, str(tmp_path / "bad.jsonl"), "seq int").collect()


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("submission_id,problem_id,user_id\ns1,p1,u1\n")
    (tmp_path / "b.csv").write_text("user_id,submission_id,problem_id\nu2,s2,p2\n")
    got = files.read_submission_metadata(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [("s1", "p1", "u1"), ("s2", "p2", "u2")]


def test_no_machine_local_scratch_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session, "x")
