"""Counts that come with the write: the same as those of a pass of their own, and no input is read again."""

from __future__ import annotations

import pytest

from paceline.operators import collect, selection, strategies


@pytest.fixture
def once(spark, tmp_path):
    """A table whose rows are logged as they are read, and a check that each was read once."""
    logs = {}

    def table(name, rows, schema):
        log = logs[f"{tmp_path}/{name}.log"] = len(rows)
        path = f"{tmp_path}/{name}.log"

        def note(batches):
            for batch in batches:
                with open(path, "a") as file:
                    file.write("row\n" * batch.num_rows)
                yield batch

        assert log == len(rows)
        return spark.createDataFrame(rows, schema).mapInArrow(note, schema)

    def reads():
        return {path.rpartition("/")[2]: open(path).read().count("row") / size for path, size in logs.items()}

    table.reads = reads
    return table


def test_users_are_attached_and_audited_in_one_pass(spark, once, tmp_path):
    solutions = once("solutions", [(f"s{i}", f"p{i % 3}", float(i)) for i in range(30)], "solution_id string, problem_id string, runtime double")
    metadata = once("metadata", [(f"s{i}", f"p{i % 2}", f"u{i}") for i in range(0, 40, 2)], "submission_id string, problem_id string, user_id string")
    rows, audit = collect.attach_users_audited(solutions, metadata)
    rows.write.parquet(f"{tmp_path}/out")
    counts = audit.get
    assert once.reads() == {"solutions.log": 1, "metadata.log": 1}
    written = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, written.select("solution_id", "user_id").collect())) == sorted(map(tuple, collect.attach_users(solutions, metadata).select("solution_id", "user_id").collect()))
    assert counts == collect.metadata_audit(solutions, metadata).first().asDict() == {"not_found": 15, "problem_mismatch": 10, "matched": 5}


def test_active_users_are_counted_as_they_are_kept(spark, tmp_path):
    rows = [(i, f"p{i % 4}", f"u{i % 7 if i % 7 < 4 else i}") for i in range(90)]
    frame = spark.createDataFrame(rows, "seq int, problem_id string, user_id string")
    kept, activity = collect.filter_active_users_audited(frame, 2)
    kept.write.parquet(f"{tmp_path}/out")
    assert kept.columns == ["problem_id", "user_id", "seq"]
    plain = collect.activity_stats(frame, 2).first()
    assert all(activity.get[name] == plain[name] for name in ("solutions_before", "solutions_after", "submission_sets"))
    assert {r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {r["seq"] for r in collect.filter_active_users(frame, 2).collect()}


def test_unrecognized_and_unscored_rows_are_counted_with_the_write(spark, once, tmp_path):
    answers = once("answers", [("Branching Efficiency",), ("nothing known",), ("see Branching Efficiency",), (" ",)], "answer string")
    classified, audit = strategies.classify_audited(answers)
    classified.write.parquet(f"{tmp_path}/classified")
    assert audit.get == {"strategies": 4, "unrecognized": 2} and once.reads() == {"answers.log": 1}
    samples = spark.createDataFrame([(1, ["Branching Efficiency"]), (2, []), (3, None)], "id int, category array<string>")
    scored, unscored = selection.rarity_score_audited(samples)
    scored.write.parquet(f"{tmp_path}/scored")
    assert unscored.get == {"samples": 3, "unscored": selection.unscored_count(selection.rarity_score(samples)).first()["unscored"]}
