"""Queries of the selection (H), generation (G) and assembly (A) operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from paceline.functions.numbers import SPEEDUP_BANDS
from paceline.functions.text import SCORED_CATEGORIES, category_names
from paceline.operators import assembly, collect, generation, selection
from paceline.plans.extraction import MARKER, NAMES, RENDERED, TEMPLATE
from paceline.plans.registry import joined, query, r6, written_with_counts
from paceline.session import scratch_path
from paceline.streaming.incremental import incremental_generation

SAMPLE = 200
# A shuffle key that both engines compute; the default key is a 64-bit hash.
SHUFFLE_SQL = "(doc_id * 7919) % 10007, doc_id"


def shuffle_key():
    return [(F.col("doc_id") * 7919) % 10007, F.col("doc_id")]


def _categorised(v):
    return v("category_resp").withColumn("category", category_names("resp")).drop("resp")


@query(
    "h1_add_speedup",
    "SELECT doc_id, CASE WHEN cpu_time[2] <> 0 THEN cpu_time[1] / cpu_time[2] END AS speedup FROM @category_resp",
)
def _(v):
    return selection.add_speedup(v("category_resp").select("doc_id", "cpu_time")).select("doc_id", "speedup")


@query(
    "h2_submission_runtimes",
    """SELECT solution_id, arg_max(runtime, write_no) AS runtime FROM (
  SELECT src_id AS solution_id, seq * 2 AS write_no, src_agg_runtime AS runtime FROM @raw_pairs
  UNION ALL SELECT tgt_id, seq * 2 + 1, tgt_agg_runtime FROM @raw_pairs) w GROUP BY solution_id""",
)
def _(v):
    pairs = v("raw_pairs").select("seq", "src_id", "tgt_id", F.array("src_agg_runtime", "tgt_agg_runtime").alias("cpu_time"))
    return selection.submission_runtimes(pairs)


@query("h3_best_only", "SELECT doc_id, problem_id, speedup FROM @category_resp WHERE is_best")
def _(v):
    return selection.best_only(v("category_resp")).select("doc_id", "problem_id", "speedup")


@query("h4_random_sample_n", f"SELECT doc_id, problem_id FROM @category_resp ORDER BY {SHUFFLE_SQL} LIMIT {SAMPLE}")
def _(v):
    rows = v("category_resp").select("doc_id", "problem_id")
    return selection.random_sample_n(rows, SAMPLE, "doc_id", order=shuffle_key())


@query(
    "h5_top_speedup_capped",
    f"""SELECT doc_id, problem_id, speedup, problem_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY speedup DESC, doc_id) AS problem_rank
  FROM @category_resp WHERE NOT cross_user) x
WHERE problem_rank <= 4 ORDER BY speedup DESC, doc_id LIMIT {SAMPLE}""",
)
def _(v):
    rows = v("category_resp").select("doc_id", "problem_id", "speedup", "cross_user")
    capped = selection.top_speedup_capped(rows, SAMPLE, 4, "doc_id").drop("cross_user")
    return capped.withColumn("problem_rank", F.col("problem_rank").cast("bigint"))


_ORD = ", ".join(f"({i}, '{name}')" for i, name in enumerate(SCORED_CATEGORIES))
FREQUENCY = f"""SELECT c.ord, c.name AS category, count(n.name) AS frequency FROM (VALUES {_ORD}) AS c(ord, name)
LEFT JOIN (SELECT DISTINCT doc_id, name FROM ({NAMES}) x) n ON n.name = c.name GROUP BY c.ord, c.name"""


@query(
    "h6_category_frequency",
    f"""SELECT ord, category, frequency,
  round(frequency * CAST(100 AS DOUBLE) / (SELECT count(*) FROM @category_resp), 2) AS pct FROM ({FREQUENCY}) f""",
)
def _(v):
    return selection.category_frequency(_categorised(v))


SCORED = f"""SELECT r.doc_id, r.problem_id, r.speedup, r.is_best, coalesce(s.score, CAST(-100 AS DOUBLE)) AS score FROM @category_resp r LEFT JOIN (
  SELECT n.doc_id, avg((SELECT count(*) FROM @category_resp) / CAST(f.frequency AS DOUBLE)) AS score
  FROM (SELECT DISTINCT doc_id, name FROM ({NAMES}) x) n JOIN ({FREQUENCY}) f ON f.category = n.name GROUP BY n.doc_id) s
ON s.doc_id = r.doc_id"""


def _scored(v):
    return selection.rarity_score(_categorised(v)).select("doc_id", "problem_id", "speedup", "is_best", "score")


@query("h7_rarity_score", f"SELECT doc_id, round(score, 6) AS score FROM ({SCORED}) s")
def _(v):
    return _scored(v).select("doc_id", r6("score").alias("score"))


@query(
    "h7_unscored_count",
    f"SELECT count(*) AS samples, count(*) FILTER (WHERE score = -100) AS unscored FROM ({SCORED}) s",
)
def _(v):
    return selection.unscored_count(_scored(v))


@query(
    "h7_rarity_score_audited",
    f"SELECT count(*) AS rows_written, count(*) AS samples, count(*) FILTER (WHERE score = -100) AS unscored FROM ({SCORED}) s",
)
def _(v):
    return written_with_counts(*selection.rarity_score_audited(_categorised(v)), "scored")


@query(
    "h8_top_by_score",
    f"SELECT doc_id, round(score, 6) AS score FROM ({SCORED}) s ORDER BY s.score DESC, doc_id LIMIT {SAMPLE}",
)
def _(v):
    return selection.top_by_score(_scored(v), SAMPLE, "doc_id").select("doc_id", r6("score").alias("score"))


@query(
    "h9_balanced_round_robin",
    f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, doc_id) AS "round" FROM ({SCORED}) s)
SELECT doc_id, problem_id, "round" FROM ranked ORDER BY "round", {SHUFFLE_SQL} LIMIT {SAMPLE}""",
)
def _(v):
    chosen = selection.balanced_round_robin(_scored(v), SAMPLE, "doc_id", order=shuffle_key())
    return chosen.select("doc_id", "problem_id", F.col("round").cast("bigint").alias("round"))


_BANDS = list(zip([*SPEEDUP_BANDS, None], [None, *SPEEDUP_BANDS]))
_BAND_SQL = " UNION ALL ".join(
    f"SELECT {i} AS ord, '{'<' if low is None else '>='}{(high if low is None else low):g}' AS band, "
    f"count(*) FILTER (WHERE {'true' if low is None else f'speedup >= {low}'} AND {'true' if high is None else f'speedup < {high}'}) AS \"rows\", "
    f"count(*) AS n FROM @category_resp"
    for i, (low, high) in enumerate(_BANDS)
)


@query("h10_speedup_bands", f'SELECT ord, band, "rows", round("rows" * CAST(100 AS DOUBLE) / n, 2) AS pct FROM ({_BAND_SQL}) b')
def _(v):
    return selection.speedup_bands(v("category_resp"))


@query("h11_average_speedup", "SELECT round(avg(speedup), 2) AS avg_speedup FROM @category_resp")
def _(v):
    return selection.average_speedup(v("category_resp"))


# Generation. The stubs answer with their prompt in a fence, so the results are known without a model.
# They are made inside a function so that they travel to the workers whole, not by module name.
def stub_model(answer: Callable[[str], str | list[str]]):
    def load():
        return lambda prompts: [answer(prompt) for prompt in prompts]

    return load


fenced_echo = stub_model(lambda prompt: f"Sure:\n```cpp\n{prompt}\n```")
two_answers = stub_model(lambda prompt: [f"```\n{prompt}\n```", "no code"])


RESUME_DATA = """SELECT solution_id AS id, seq, CASE WHEN runtime < 150 THEN 'r' || CAST(seq AS STRING) END AS resp FROM @subs"""
RESUME_CACHE = """SELECT 's' || CAST(seq AS STRING) AS id, seq * 100 + gen AS seq, code AS resp FROM @gens WHERE accuracy < 1"""


@query(
    "g1_resume_split",
    f"""WITH d AS ({RESUME_DATA}), c AS ({RESUME_CACHE})
SELECT id, seq, resp, 'done' AS state FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM c) x WHERE rn = 1
UNION ALL SELECT id, seq, resp, CASE WHEN resp IS NULL THEN 'remaining' ELSE 'done' END FROM d WHERE id NOT IN (SELECT id FROM c)""",
)
def _(v):
    done, remaining = generation.resume_split(v.sql(RESUME_DATA), v.sql(RESUME_CACHE), "resp")
    return done.withColumn("state", F.lit("done")).unionByName(remaining.withColumn("state", F.lit("remaining")))


@query("g2_build_prompts", f"SELECT seq, split_part({RENDERED}, '{MARKER}', 1) AS prompt FROM @programs")
def _(v):
    holes = {"src_code": "src_code", "tgt_code": "tgt_code"}
    return generation.build_prompts(v("programs"), TEMPLATE, holes, MARKER).select("seq", "prompt")


@query(
    "g3_batch_generate",
    "SELECT seq, 'Sure:' || chr(10) || '```cpp' || chr(10) || tgt_code || chr(10) || '```' AS echo_resp, tgt_code AS echo FROM @programs",
)
def _(v):
    prompts = v("programs").select("seq", F.col("tgt_code").alias("prompt"))
    return generation.batch_generate(prompts, fenced_echo, "echo").select("seq", "echo_resp", "echo")


@query(
    "g3_generate_in_steps",
    "SELECT seq, 'Sure:' || chr(10) || '```cpp' || chr(10) || tgt_code || chr(10) || '```' AS echo_resp, tgt_code AS echo FROM @programs",
)
def _(v):
    prompts = v("programs").select("seq", F.col("tgt_code").alias("prompt"))
    path = scratch_path(v.spark, "steps")
    # The second run finds all steps answered and asks its own model for nothing.
    for model in (fenced_echo, two_answers):
        answers = generation.generate_in_steps(v.spark, prompts, model, "echo", path, 4, "seq")
    return answers.select("seq", "echo_resp", "echo")


@query(
    "g4_multi_generation_extract",
    """SELECT seq, 0 AS pos, tgt_code AS code FROM @programs UNION ALL SELECT seq, 1, NULL FROM @programs""",
)
def _(v):
    prompts = v("programs").select("seq", F.col("tgt_code").alias("prompt"))
    answered = generation.batch_generate(prompts, two_answers, "pair", n=2)
    return answered.select("seq", F.posexplode("pair").alias("pos", "code"))


@query(
    "g5_follow_suggestions",
    """SELECT seq, CASE k WHEN 0 THEN 0 ELSE 1 END AS pos, 'Use: ' || CASE k WHEN 0 THEN src_code ELSE tgt_code END AS code
FROM @programs, (VALUES (0), (1)) AS n(k)""",
)
def _(v):
    rows = v("programs").select("seq", F.array("src_code", "tgt_code").alias("suggestions"))
    followed = generation.follow_suggestions(
        rows, fenced_echo, "echo", "Use: {{  suggestion  }}", {"suggestion": "suggestion"}, id_col="seq"
    )
    return followed.select("seq", F.posexplode("echo_final").alias("pos", "code"))


@query(
    "g6_incremental_generation",
    """SELECT CAST(seq AS STRING) AS id, tgt_code AS echo FROM @programs""",
)
def _(v):
    base = scratch_path(v.spark, "incremental")
    prompts = v("programs").select(F.col("seq").cast("string").alias("id"), "seq", F.col("tgt_code").alias("prompt"))
    fast, slow = prompts.filter("seq % 2 = 0"), prompts
    schema = "id string, seq bigint, prompt string"
    # Two deliveries, the second repeating ids of the first, which must not be asked again.
    for delivery in (fast, slow):
        delivery.write.mode("append").json(f"{base}/source")
        incremental_generation(
            v.spark, f"{base}/source", schema, f"{base}/sink", f"{base}/checkpoint", fenced_echo, "echo"
        ).awaitTermination()
    return v.spark.read.parquet(f"{base}/sink").select("id", "echo")


EXAMPLES = """SELECT problem_id || '-' || src_id || '-' || tgt_id AS id, seq, src_code FROM @raw_pairs"""
TESTCASES = """SELECT problem_id, @series(1, count(*)) AS testcases FROM @subs GROUP BY problem_id"""


@query(
    "a1_attach_testcases",
    f"""SELECT e.id, t.problem_id, array_to_string(t.testcases, ',') AS testcases
FROM ({EXAMPLES}) e JOIN ({TESTCASES}) t ON t.problem_id = split_part(e.id, '-', 1)""",
)
def _(v):
    # Written as text once for each problem, before its examples meet it.
    tests = v.sql(TESTCASES).withColumn("testcases", joined("testcases"))
    return assembly.attach_testcases(v.sql(EXAMPLES), tests).select("id", "problem_id", "testcases")


@query(
    "a2_add_original_code",
    r"""SELECT seq, coalesce(regexp_extract_all(completion, '(?s)```cpp\n(.*?)```', 1)[-1], '') AS org_code FROM @completions""",
)
def _(v):
    return assembly.add_original_code(v("completions"), "completion").select("seq", "org_code")


@query(
    "a3_split_dataset",
    """SELECT doc_id, CASE WHEN (doc_id * 7919) % 10000 < 8000 THEN 'train' WHEN (doc_id * 7919) % 10000 < 9000 THEN 'val'
  ELSE 'test' END AS split FROM @documents""",
)
def _(v):
    step = (F.col("doc_id") * 7919) % 10000
    return assembly.split_dataset(v.table("documents"), (0.8, 0.1, 0.1), step=step).select("doc_id", "split")


TOKENS = """SELECT l_orderkey AS seq, l_linenumber AS line, l_partkey AS part,
  @series(1, CAST(l_quantity AS BIGINT)) AS prompt_ids,
  @series(1, CAST(l_quantity AS BIGINT)) || @series(CAST(1001 AS BIGINT), CAST(1000 + l_linenumber * 5 AS BIGINT)) AS full_ids FROM @lineitem"""


@query(
    "a4_mask_prompt_labels",
    f"""SELECT seq, line, part, array_to_string(full_ids[1:40], ',') AS input_ids,
  array_to_string(list_transform(full_ids[1:40], lambda x: 1), ',') AS attention_mask,
  array_to_string((list_transform(prompt_ids, lambda x: CAST(-100 AS BIGINT)) || full_ids[len(prompt_ids) + 1:])[1:40], ',') AS labels
FROM ({TOKENS}) t""",
)
def _(v):
    masked = assembly.mask_prompt_labels(v.sql(TOKENS), "prompt_ids", "full_ids", 40)
    return masked.select("seq", "line", "part", *[joined(name).alias(name) for name in ("input_ids", "attention_mask", "labels")])


@query(
    "a_selected_training_rows",
    f"""WITH b AS (SELECT * FROM @category_resp WHERE is_best),
n AS (SELECT DISTINCT x.doc_id, x.name FROM ({NAMES}) x JOIN b ON b.doc_id = x.doc_id),
f AS (SELECT name, count(*) AS frequency FROM n GROUP BY name),
s AS (SELECT b.doc_id, b.problem_id, coalesce(avg((SELECT count(*) FROM b) / CAST(f.frequency AS DOUBLE)), CAST(-100 AS DOUBLE)) AS score
  FROM b LEFT JOIN n ON n.doc_id = b.doc_id LEFT JOIN f ON f.name = n.name GROUP BY b.doc_id, b.problem_id),
r AS (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY score DESC, doc_id) AS place FROM s)
SELECT doc_id, problem_id, CAST(place AS BIGINT) AS "round", round(score, 6) AS score FROM r ORDER BY place, {SHUFFLE_SQL} LIMIT {SAMPLE}""",
)
def _(v):
    scored = selection.rarity_score(selection.best_only(_categorised(v)))
    chosen = selection.balanced_round_robin(scored, SAMPLE, "doc_id", order=shuffle_key())
    return chosen.select("doc_id", "problem_id", F.col("round").cast("bigint").alias("round"), r6("score").alias("score"))
