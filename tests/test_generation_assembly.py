from __future__ import annotations

import hashlib
import random

import pyarrow.parquet as pq
import pytest
import stubs
from pyspark.sql import functions as F

from paceline.operators import assembly, generation
from paceline.streaming.incremental import STATE_SETTINGS, incremental_generation


def test_resume_split_gives_each_id_once_and_the_cache_wins(spark):
    data = spark.createDataFrame(
        [("a", 1, "own"), ("b", 2, None), ("c", 3, "own"), ("d", 4, None), ("d", 5, None), ("e", 6, None), ("e", 7, "own")],
        "id string, seq int, resp string",
    )
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "cached"), ("b", 3, "cached")], "id string, seq int, resp string")
    done, remaining = generation.resume_split(data, cache, "resp")
    assert {(r["id"], r["resp"]) for r in done.collect()} == {("a", "cached"), ("b", "cached"), ("c", "own"), ("e", "own")}
    assert done.count() == 4 and [r["id"] for r in remaining.collect()] == ["d"]


def test_batches_nulls_and_extraction(spark):
    frame = spark.createDataFrame([(i, None if i == 3 else f"p{i}") for i in range(10)], "i int, prompt string").coalesce(1)
    sized = generation.batch_generate(frame, stubs.batch_sizes, "m", batch=4, extract=False).orderBy("i").collect()
    assert [r["m_resp"] for r in sized] == ["4", "4", "4", None, "4", "4", "4", "4", "4", "1"]
    echoed = generation.batch_generate(frame, stubs.echo, "m", workers=3).orderBy("i").collect()
    assert [r["m"] for r in echoed] == [r["prompt"] for r in echoed]
    many = generation.batch_generate(frame, stubs.pairs_of_answers, "m", n=2).orderBy("i").collect()
    assert many[0]["m"] == ["p0", None] and many[3]["m_resp"] is None


def test_workers_hold_a_bounded_number_of_prompts(spark):
    prompts = spark.range(3000).selectExpr("id AS i", "'p' AS prompt").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch, rows in ((100, 200), (7, 252), (400, 400)):
        sizes = generation.batch_generate(prompts, stubs.batch_sizes, "m", batch, extract=False)
        assert {r["m_resp"] for r in sizes.collect()} <= {str(batch), str(3000 % batch)}
        # A model with a larger batch of its own is given all that crossed at once.
        held = prompts.select(generation.generate(stubs.batch_sizes, 10_000)("prompt").alias("n")).distinct().collect()
        assert max(int(r["n"]) for r in held) == rows
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    asked = spark.range(3000).selectExpr("id", "array('a') AS suggestions").coalesce(1)
    generation.follow_suggestions(asked, stubs.echo, "m", "{{  s  }}", {"s": "suggestion"})
    held = prompts.select(generation.generate(stubs.batch_sizes, 10_000)("prompt").alias("n")).distinct().collect()
    assert max(int(r["n"]) for r in held) == 200


def test_a_run_in_steps_is_taken_up_where_it_failed(spark, tmp_path):
    prompts = spark.createDataFrame([(f"id{i}", None if i == 7 else f"p{i}") for i in range(60)], "id string, prompt string")
    log = tmp_path / "asked.log"

    def run(failing=None, name="m"):
        return generation.generate_in_steps(spark, prompts, stubs.Noting(str(log), failing), "m", f"{tmp_path}/run", steps=4, batch=5, fingerprint=name)

    step = F.pmod(F.xxhash64("id"), F.lit(4))
    failing = prompts.filter((step == 2) & F.col("prompt").isNotNull()).first()["prompt"]
    first_steps = {r["prompt"] for r in prompts.filter(step < 2).collect()} - {None}
    with pytest.raises(Exception, match="model is down"):
        run(failing)
    log.unlink()
    answered = sorted((r["id"], r["m"]) for r in run().collect())
    assert answered == sorted((f"id{i}", None if i == 7 else f"p{i}") for i in range(60))
    asked = log.read_text().split()
    # The steps before the failure are not asked for again, and nothing is asked twice.
    assert len(asked) == len(set(asked)) == 59 - len(first_steps) < 59 and not first_steps & set(asked)
    log.unlink()
    assert run(failing).count() == 60 and not log.exists()
    # Another model is another run.
    assert run(name="other").count() == 60 and len(log.read_text().split()) == 59
    plan = spark.read.parquet(str(next((tmp_path / "run" / "prompts").glob("version-*")))).filter("_step = 2")
    assert "PartitionFilters: [isnotnull(_step" in plan._jdf.queryExecution().executedPlan().toString()


def test_build_prompts_cuts_at_the_marker(spark):
    frame = spark.createDataFrame([("x",)], "code string")
    got = generation.build_prompts(frame, "do {{  code  }} END rest", {"code": "code"}, "END").first()
    assert got["prompt"] == "do x "


def test_follow_suggestions_keeps_order_and_empty_rows(spark):
    rows = [(1, ["b", "a", "c"]), (2, []), (3, None), (4, ["z"])]
    frame = spark.createDataFrame(rows, "id int, suggestions array<string>")
    followed = generation.follow_suggestions(frame, stubs.echo, "m", "use {{  s  }}", {"s": "suggestion"})
    got = {r["id"]: (r["m_final"], len(r["m_opt_resp"])) for r in followed.collect()}
    assert got == {1: (["use b", "use a", "use c"], 3), 2: ([], 0), 3: ([], 0), 4: (["use z"], 1)}
    single = spark.createDataFrame([(1, "abc")], "id int, suggestions string")
    followed = generation.follow_suggestions(single, stubs.echo, "m", "{{  s  }}", {"s": "suggestion"})
    assert followed.first()["m_final"] == ["abc"]


class Stream:
    """Deliveries of JSON files and runs of the generation over them."""

    schema = "id string, seq bigint, prompt string, note array<string>"

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def deliver(self, rows):
        rows = [(*row, ["x", None]) for row in rows]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").json(f"{self.folder}/source")

    def run(self, checkpoint="checkpoint", model=stubs.echo, **options):
        query = incremental_generation(
            self.spark, f"{self.folder}/source", self.schema, f"{self.folder}/sink", f"{self.folder}/{checkpoint}", model, "m", **options
        )
        query.awaitTermination()
        return query

    def answers(self):
        return sorted((r["id"] or "", r["m"]) for r in self.spark.read.parquet(f"{self.folder}/sink").collect())


def test_incremental_generation_survives_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.deliver([("a", 2, "second"), ("a", 1, "first"), ("b", 3, "b"), (None, 9, "no id")])
    stream.run(max_files=1)
    assert stream.answers() == [("", "no id"), ("a", "first"), ("b", "b")]
    stream.deliver([("b", 0, "again"), ("c", 5, "c"), (None, 1, "no id again")])
    stream.run(max_files=1)
    stream.run(max_files=1)
    wanted = [("", "no id"), ("a", "first"), ("b", "b"), ("c", "c")]
    assert stream.answers() == wanted
    # A job without its progress starts from the ids in the sink: it repeats nothing and removes nothing.
    stream.run("another")
    assert stream.answers() == wanted
    stream.deliver([("d", 6, "d"), ("a", 0, "again")])
    stream.run("another")
    assert stream.answers() == [*wanted, ("d", "d")]
    kept = spark.read.parquet(f"{tmp_path}/sink")
    assert kept.filter("id = 'a'").first()["note"] == ["x", None]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_SETTINGS["spark.sql.streaming.stateStore.providerClass"]


def test_micro_batches_do_not_read_the_sink(spark, tmp_path):
    """With its progress at hand a run opens no file of the sink; without, the sink is read once, whatever the batches."""
    stream = Stream(spark, tmp_path)
    stream.deliver([("a", 1, "a"), ("b", 2, "b")])
    stream.run()
    broken = next((tmp_path / "sink").glob("run=*/batch_id=0")) / "part-broken.parquet"
    broken.write_text("not a parquet file")
    for n in range(3):
        stream.deliver([(f"new{n}", 3 + n, "x"), ("a", 9, "again")])
    query = stream.run(max_files=1)
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [2, 2, 2]
    # The state grows by the new id of each batch only.
    assert [p["stateOperators"][0]["numRowsTotal"] for p in batches] == [3, 4, 5]
    with pytest.raises(Exception, match="part-broken"):
        stream.run("another")
    broken.unlink()
    assert [i for i, _ in stream.answers()] == ["a", "b", "new0", "new1", "new2"]


def test_a_failed_batch_is_repeated_from_the_state_before_it(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.deliver([("a", 1, "a")])
    stream.run()
    stream.deliver([("a", 2, "again"), ("b", 3, "b"), ("c", 4, "c")])
    with pytest.raises(Exception, match="model is down"):
        stream.run(model=stubs.down)
    assert stream.answers() == [("a", "a")]
    stream.run()
    assert stream.answers() == [("a", "a"), ("b", "b"), ("c", "c")]
    # A first batch that fails leaves no commit: the repeated one still knows what other runs have answered.
    stream.deliver([("d", 5, "d")])
    with pytest.raises(Exception, match="model is down"):
        stream.run("another", model=stubs.down)
    stream.run("another")
    assert stream.answers() == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "d")]


def test_attach_testcases_fails_on_a_problem_without_any(spark):
    examples = spark.createDataFrame([("p1-a-b",), ("p2-c-d",)], "id string")
    cases = spark.createDataFrame([("p1", ["t"])], "problem_id string, testcases array<string>")
    good = assembly.attach_testcases(examples.filter("id LIKE 'p1%'"), cases).first()
    assert (good["problem_id"], good["testcases"]) == ("p1", ["t"])
    assert [r["problem_id"] for r in assembly.missing_testcases(examples, cases).collect()] == ["p2"]
    with pytest.raises(Exception, match="no testcases for problem p2"):
        assembly.attach_testcases(examples, cases).collect()


def test_attached_testcases_are_written_once_per_part(spark, tmp_path):
    """A text above Parquet's default dictionary of 1 MB, which 200 examples repeat, and does not compress."""
    text = random.Random(1).randbytes(750_000).hex()
    examples = spark.createDataFrame([(f"p{i % 2}-{i}-x",) for i in range(400)], "id string")
    cases = spark.createDataFrame([("p0", text), ("p1", text[::-1])], "problem_id string, testcases string")
    attached = assembly.attach_testcases(examples, cases)
    attached.write.parquet(str(tmp_path / "attached"))
    assert sum(f.stat().st_size for f in (tmp_path / "attached").glob("*.parquet")) < 2 * assembly.PROBLEM_PARTS * len(text)
    written = spark.read.parquet(str(tmp_path / "attached")).select("id", F.md5("testcases").alias("digest")).collect()
    digests = [hashlib.md5(t.encode()).hexdigest() for t in (text, text[::-1])]
    assert sorted(map(tuple, written)) == sorted((f"p{i % 2}-{i}-x", digests[i % 2]) for i in range(400))


def test_attached_testcases_are_dealt_to_many_tasks_and_not_compared(spark, tmp_path):
    """Small examples get long texts: as few tasks as the examples fill left cores idle, and each text was compared with the extremes."""
    examples = spark.createDataFrame([(f"p{i % 5}-{i}-x",) for i in range(400)], "id string")
    cases = spark.createDataFrame([(f"p{i}", f"{i}," * 1000) for i in range(5)], "problem_id string, testcases string")
    attached = assembly.attach_testcases(examples, cases)
    placed = attached.select("problem_id", F.pmod(F.xxhash64("id"), F.lit(assembly.PROBLEM_PARTS)).alias("part"), F.spark_partition_id().alias("task")).distinct().collect()
    # Each problem and part is in one task, and few of them share one.
    assert len({(r["problem_id"], r["part"]) for r in placed}) == len(placed) == 5 * assembly.PROBLEM_PARTS
    assert len({r["task"] for r in placed}) > 4 * 2
    attached.write.parquet(str(tmp_path / "attached"))
    for file in (tmp_path / "attached").glob("*.parquet"):
        meta = pq.read_metadata(file)
        has = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i).is_stats_set for i in range(meta.num_columns)} if meta.num_row_groups else {}
        assert not has or (has["id"] and not has["testcases"])


def test_attach_testcases_keeps_repeats_and_sends_no_broadcast(spark):
    examples = spark.createDataFrame([(f"p{i % 3}-{i % 5}-x", i) for i in range(60)], "id string, n int")
    cases = spark.createDataFrame([("p0", ["a"]), ("p0", ["b"]), ("p1", []), ("p2", None), ("p9", ["c"])], "problem_id string, testcases array<string>")
    attached = assembly.attach_testcases(examples, cases)
    assert attached.columns == ["problem_id", "id", "n", "testcases"]
    known = {"p0": [["a"], ["b"]], "p1": [[]], "p2": [None]}
    wanted = [(f"p{i % 3}", f"p{i % 3}-{i % 5}-x", i, tests) for i in range(60) for tests in known[f"p{i % 3}"]]
    assert sorted(map(tuple, attached.collect()), key=str) == sorted(wanted, key=str)
    assert "Broadcast" not in attached._jdf.queryExecution().executedPlan().toString()


def test_original_code_is_added_only_when_absent(spark):
    frame = spark.createDataFrame([("x ```cpp\nint a;\n```",), ("none",)], "instruction string")
    assert [r["org_code"] for r in assembly.add_original_code(frame).collect()] == ["int a;\n", ""]
    kept = assembly.add_original_code(frame.withColumn("org_code", F.lit("own")))
    assert {r["org_code"] for r in kept.collect()} == {"own"}


def test_split_is_stable_and_whole(spark):
    frame = spark.range(3000)
    assert {r["split"] for r in assembly.split_dataset(frame).collect()} == {"train"}
    split = assembly.split_dataset(frame, (0.8, 0.1, 0.1))
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 3000 and abs(sizes["train"] - 2400) < 120 and abs(sizes["val"] - 300) < 80
    again = assembly.split_dataset(frame.repartition(7), (0.8, 0.1, 0.1))
    assert set(map(tuple, split.collect())) == set(map(tuple, again.collect()))


@pytest.mark.parametrize("prompt, full, limit", [(3, 7, 10), (3, 7, 5), (6, 8, 4), (0, 2, 9), (4, 4, 9)])
def test_mask_prompt_labels(spark, prompt, full, limit):
    ids = list(range(100, 100 + full))
    frame = spark.createDataFrame([(ids[:prompt], ids)], "prompt_ids array<bigint>, full_ids array<bigint>")
    got = assembly.mask_prompt_labels(frame, "prompt_ids", "full_ids", limit).first()
    assert got["input_ids"] == ids[:limit]
    assert got["labels"] == ([-100] * prompt + ids[prompt:])[:limit]
    assert got["attention_mask"] == [1] * min(full, limit)


def test_format_examples(spark):
    frame = spark.createDataFrame([("i", "o")], "instruction string, output string")
    got = assembly.format_examples(frame, {"prompt": "instruction", "response": "output"}).first()
    assert got.asDict() == {"prompt": "i", "response": "o", "system_prompt": ""}
