"""Queries of the measurement (M) and reward (R) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import rewards as reward_columns
from paceline.functions.text import words
from paceline.operators import measurements, rewards
from paceline.plans.registry import query, r6
from paceline.session import materialized, scratch_path, setting, spread
from paceline.sources import files

_INF = "CAST('Infinity' AS DOUBLE)"
_LINES = r"string_split(regexp_replace({}, '^\s+|\s+$', '', 'g'), chr(10))"
GRADED = f"""SELECT seq, tc_no, CAST(count(*) FILTER (WHERE got = want OR abs(try_cast(got AS DOUBLE) - try_cast(want AS DOUBLE)) < 0.001) AS DOUBLE)
  / count(*) AS score FROM (
  SELECT seq, tc_no, unnest(w) AS want, unnest(a[:len(w)] || CASE WHEN len(a) < len(w) THEN list_resize([NULL], len(w) - len(a)) ELSE [] END) AS got
  FROM (SELECT seq, tc_no, {_LINES.format("expected")} AS w, {_LINES.format("actual")} AS a FROM @outputs) x) y GROUP BY seq, tc_no"""


def _graded(v):
    outputs = v("outputs")
    # A result is graded against the expected output of its test, which is another table.
    return measurements.grade_outputs(
        outputs.select("seq", "tc_no", "actual"), outputs.select("seq", "tc_no", "expected"), ["seq", "tc_no"]
    )


@query("m1_grade_outputs", f"SELECT seq, tc_no, round(score, 6) AS score FROM ({GRADED}) g")
def _(v):
    return _graded(v).select("seq", "tc_no", r6("score").alias("score"))


EXPECTED_TESTS = "SELECT seq, tc_no FROM @test_results UNION ALL SELECT seq, max(tc_no) + 1 AS tc_no FROM @test_results GROUP BY seq"
COMPILED = "SELECT o_orderkey AS seq, o_orderstatus <> 'P' AS compilation FROM @orders"
ACCURACY = f"""SELECT e.seq, c.compilation, CASE WHEN c.compilation THEN avg(coalesce(g.score, 0)) ELSE CAST(0 AS DOUBLE) END AS accuracy
FROM ({EXPECTED_TESTS}) e LEFT JOIN ({GRADED}) g ON g.seq = e.seq AND g.tc_no = e.tc_no JOIN ({COMPILED}) c ON c.seq = e.seq
GROUP BY e.seq, c.compilation"""


def _accuracy(v):
    return measurements.accuracy_by_submission(v.sql(EXPECTED_TESTS), _graded(v), v.sql(COMPILED))


@query("m2_accuracy_by_submission", f"SELECT seq, compilation, round(accuracy, 6) AS accuracy FROM ({ACCURACY}) a")
def _(v):
    return _accuracy(v).select("seq", "compilation", r6("accuracy").alias("accuracy"))


@query(
    "m3_gate_by_accuracy",
    f"""SELECT t.seq, t.tc_no, t.time_s FROM @test_results t JOIN ({ACCURACY}) a ON a.seq = t.seq WHERE a.accuracy >= 0.7""",
)
def _(v):
    gated = measurements.gate_by_accuracy(v("test_results"), _accuracy(v), 0.7)
    return gated.select("seq", "tc_no", "time_s")


MASKED = """SELECT seq, tc_no, success AND NOT failed_before AS success, CASE WHEN success AND NOT failed_before THEN time_s END AS time_s FROM (
  SELECT *, coalesce(bool_or(NOT success) OVER (PARTITION BY seq ORDER BY tc_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS failed_before
  FROM @test_results) x"""


@query("m4_mask_after_failure", MASKED)
def _(v):
    return measurements.mask_after_failure(v("test_results")).select("seq", "tc_no", "success", "time_s")


RUNTIME = f"""SELECT s.seq, CASE WHEN count(t.seq) = 0 OR count(*) FILTER (WHERE NOT t.success) > 0 THEN {_INF} ELSE sum(t.time_s) END AS agg_runtime,
  count(*) FILTER (WHERE t.success) AS passed_tests, count(t.seq) AS tests
FROM @subs s LEFT JOIN ({MASKED}) t ON t.seq = s.seq GROUP BY s.seq"""


def _runtime(v):
    return measurements.aggregate_runtime(measurements.mask_after_failure(v("test_results")), submissions=v("subs"))


@query("m5_aggregate_runtime", f"SELECT seq, round(agg_runtime, 6) AS agg_runtime, passed_tests, tests FROM ({RUNTIME}) r")
def _(v):
    return _runtime(v).withColumn("agg_runtime", r6("agg_runtime"))


@query(
    "m5_missing_times",
    f"""SELECT seq, CASE WHEN count(*) FILTER (WHERE NOT success OR time_s IS NULL) > 0 THEN {_INF} ELSE round(sum(time_s), 6) END AS agg_runtime,
  count(*) FILTER (WHERE success) AS passed_tests, count(*) AS tests FROM @untimed_results GROUP BY seq""",
)
def _(v):
    return measurements.aggregate_runtime(v("untimed_results")).withColumn("agg_runtime", r6("agg_runtime"))


NATIVE = f"""WITH s AS (SELECT seq, min(coalesce(len(times), 0)) AS shortest FROM @native_times GROUP BY seq),
runs AS (SELECT seq, unnest(times) AS time_s, generate_subscripts(times, 1) AS run_no FROM @native_times),
totals AS (SELECT r.seq, r.run_no, sum(r.time_s) AS total FROM runs r JOIN s ON s.seq = r.seq AND r.run_no <= s.shortest GROUP BY r.seq, r.run_no)
SELECT s.seq, CAST(s.shortest AS BIGINT) AS runs, coalesce(round(avg(t.total), 6), {_INF}) AS agg_runtime,
  coalesce(round(stddev_pop(t.total), 6), {_INF}) AS agg_stdev FROM s LEFT JOIN totals t ON t.seq = s.seq GROUP BY s.seq, s.shortest"""


@query("m6_aggregate_native_timings", NATIVE)
def _(v):
    native = measurements.aggregate_native_timings(v("native_times"))
    return native.select(
        "seq",
        F.col("runs").cast("bigint").alias("runs"),
        r6("agg_runtime").alias("agg_runtime"),
        r6("agg_stdev").alias("agg_stdev"),
    )


# Tests of one bucket, on average at most.
TEST_BUCKET_ROWS = 1 << 20
# Simulator and native values of a version.
PAIRED = ["accuracy", "agg_runtime", "agg_runtime_binary", "agg_stdev_binary"]


@query(
    "m7_pair_results",
    f"""SELECT seq // 2 AS pair_id, {", ".join(f"max({name}) FILTER (WHERE seq % 2 = {i}) AS {name}_v{i}" for name in PAIRED for i in (0, 1))}
FROM (SELECT a.seq, round(a.accuracy, 6) AS accuracy, round(r.agg_runtime, 6) AS agg_runtime, n.agg_runtime AS agg_runtime_binary, n.agg_stdev AS agg_stdev_binary
  FROM ({ACCURACY}) a JOIN ({RUNTIME}) r ON r.seq = a.seq LEFT JOIN ({NATIVE}) n ON n.seq = a.seq) x GROUP BY seq // 2""",
)
def _(v):
    # All steps read the tests by submission: they are dealt once, in buckets, and not for each step anew.
    path = scratch_path(v.spark, "tests")
    v.save("test_results", lambda build: files.bucketed_once(v.spark, path, build, ["seq"], 8, bucket_rows=TEST_BUCKET_ROWS, dealt=True))
    native = measurements.aggregate_native_timings(v("native_times"))
    # Grading joins by submission and test; rows that are dealt by submission alone need no shuffle for that.
    with setting(v.spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        accuracy = materialized(_accuracy(v), "accuracy")
    both = measurements.with_native(accuracy.join(_runtime(v), "seq"), native).select(
        F.floor(F.col("seq") / 2).alias("pair_id"),
        F.when(F.col("seq") % 2 == 0, "v0").otherwise("v1").alias("version"),
        *[r6(name).alias(name) for name in PAIRED],
    )
    return measurements.pair_results(both, PAIRED)


@query(
    "m8_complete_test_matrix",
    f"""SELECT e.seq, e.tc_no, t.success, t.time_s FROM ({EXPECTED_TESTS}) e
LEFT JOIN @test_results t ON t.seq = e.seq AND t.tc_no = e.tc_no""",
)
def _(v):
    results = v("test_results").select("seq", "tc_no", "success", "time_s")
    return measurements.complete_test_matrix(results, v.sql(EXPECTED_TESTS))


STATS = r"""SELECT file, parts[1] AS key, unnest(parts[2:]) AS raw, generate_subscripts(parts[2:], 1) - 1 AS pos FROM (
  SELECT file, regexp_split_to_array(regexp_replace(regexp_replace(line, '#.*', ''), '^\s+|\s+$', '', 'g'), '\s+') AS parts FROM (
    SELECT file, unnest(string_split(content, chr(10))) AS line FROM @stats_text) l
  WHERE trim(line) <> '' AND NOT contains(line, 'Begin') AND NOT contains(line, 'End')) p WHERE len(parts) > 1"""
STATS_VALUES = f"""SELECT file, key, pos, raw, CASE WHEN raw IN ('nan', 'inf', '-inf') THEN NULL
  ELSE try_cast(replace(raw, '%', '') AS DOUBLE) END AS value FROM ({STATS}) s"""


def _stats(v):
    lines = spread(v("stats_text"), ["file"]).select("file", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return measurements.parse_stats_lines(lines)


@query("m9_parse_stats_files", f"SELECT file, key, CAST(pos AS BIGINT) AS pos, raw, value FROM ({STATS_VALUES}) v")
def _(v):
    return _stats(v).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "m9_simulated_seconds",
    f"""SELECT file, max(value) FILTER (WHERE key = 'sim_ticks') / max(value) FILTER (WHERE key = 'sim_freq') AS sim_seconds_precise
FROM ({STATS_VALUES}) v GROUP BY file""",
)
def _(v):
    return measurements.simulated_seconds(_stats(v))


SCORES = f"""SELECT a.seq, CASE WHEN NOT a.compilation THEN 0 ELSE 0.5 * a.accuracy + CASE WHEN r.agg_runtime = 0 THEN NULL
  WHEN r.agg_runtime = {_INF} THEN 0 ELSE 0.5 / r.agg_runtime END END AS score
FROM ({ACCURACY}) a JOIN ({RUNTIME}) r ON r.seq = a.seq"""


def _scores(v):
    return measurements.score_submissions(_accuracy(v).join(_runtime(v), "seq"))


@query("m10_submission_score", f"SELECT seq, round(score, 6) AS score FROM ({SCORES}) s")
def _(v):
    return _scores(v).select("seq", r6("score").alias("score"))


@query(
    "m11_default_failed_results",
    f"""SELECT s.seq, coalesce(a.compilation, false) AS compilation, coalesce(round(a.accuracy, 6), 0) AS accuracy,
  coalesce(round(a.agg_runtime, 6), 0) AS agg_runtime FROM @subs s
LEFT JOIN (SELECT a.seq, a.compilation, a.accuracy, r.agg_runtime FROM ({ACCURACY}) a JOIN ({RUNTIME}) r ON r.seq = a.seq) a ON a.seq = s.seq""",
)
def _(v):
    evaluated = _accuracy(v).join(_runtime(v).select("seq", "agg_runtime"), "seq")
    filled = measurements.default_failed_results(v("subs"), evaluated)
    return filled.withColumn("accuracy", r6("accuracy")).withColumn("agg_runtime", r6("agg_runtime"))


SUBMITTED = """SELECT g.seq, g.gen, g.code, s.n_tests, CASE WHEN s.n_tests = 2 THEN 'fast' WHEN g.gen % 2 = 0 THEN 'gem5' ELSE 'both' END AS timing_mode
FROM @gens g LEFT JOIN (SELECT seq, count(*) AS n_tests FROM @test_results WHERE success GROUP BY seq) s ON s.seq = g.seq"""


@query(
    "m12_validate_submissions",
    f"""SELECT seq, gen, coalesce(CASE WHEN code IS NULL THEN 'empty code;' END, '')
  || coalesce(CASE WHEN n_tests IS NULL THEN 'no tests;' END, '') || coalesce(CASE WHEN timing_mode = 'fast' THEN 'unknown timing mode;' END, '') AS violations
FROM ({SUBMITTED}) s""",
)
def _(v):
    accepted, rejected = measurements.validate_submissions(v.sql(SUBMITTED))
    reasons = F.array_join(F.transform("violations", lambda reason: F.concat(reason, F.lit(";"))), "")
    return accepted.select("seq", "gen", F.lit("").alias("violations")).unionByName(
        rejected.select("seq", "gen", reasons.alias("violations"))
    )


# Rewards.
BOXED = r"regexp_extract_all(completion, '\\boxed\{([^{}]*)\}', 1)[-1]"
ANSWER = f"""CASE WHEN trim(gold) = '' THEN NULL WHEN coalesce(trim({BOXED}) = trim(gold), false) THEN 1 ELSE 0 END"""
FORMAT = r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?\n</answer>(\n|$)"
CODE_FORMAT = r"(?s)^<think>\n.*?\n</think>\n<answer>\n.*?```cpp.*?```.*?\n</answer>(\n|$)"


def _flag_sql(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(completion, '{pattern}') THEN 1 ELSE 0 END"


@query("r1_answer_match", f"SELECT seq, CAST({ANSWER} AS DOUBLE) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", reward_columns.answer_match("completion", "gold").alias("reward"))


@query("r2_format_reward", f"SELECT seq, CAST({_flag_sql(FORMAT)} AS DOUBLE) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", reward_columns.format_reward("completion").alias("reward"))


_TAGS = ("'<think>' || chr(10)", "chr(10) || '</think>' || chr(10)", "chr(10) || '<answer>' || chr(10)", "chr(10) || '</answer>'")
TAGS = " + ".join(
    f"CASE WHEN length(completion) - length(replace(completion, {tag}, '')) = length({tag}) THEN 0.25 ELSE 0 END" for tag in _TAGS
)


@query("r3_tag_count_reward", f"SELECT seq, CAST({TAGS} AS DOUBLE) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", reward_columns.tag_count_reward("completion").alias("reward"))


STEPS = r"least(1, len(regexp_extract_all(completion, '(Step \d+:|^\d+\.|\n-|\n\*|First,|Second,|Next,|Finally,)')) / CAST(3 AS DOUBLE))"


@query("r4_reasoning_steps_reward", f"SELECT seq, round({STEPS}, 6) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", r6(reward_columns.reasoning_steps_reward("completion")).alias("reward"))


LENGTH = """SELECT seq, CASE WHEN hi = lo THEN 0 WHEN is_correct THEN x ELSE least(0, x) END AS reward FROM (
  SELECT seq, is_correct, lo, hi, 0.5 - (n - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE) AS x FROM (
    SELECT seq, is_correct, length(completion) AS n, min(length(completion)) OVER (PARTITION BY batch_id) AS lo,
      max(length(completion)) OVER (PARTITION BY batch_id) AS hi FROM @completions) a) b"""


@query("r5_length_reward", f"SELECT seq, round(CAST(reward AS DOUBLE), 6) AS reward FROM ({LENGTH}) l")
def _(v):
    return rewards.length_reward(v("completions")).select("seq", r6("length").alias("reward"))


COSINE = """CASE WHEN is_correct THEN 0.5 + 0.5 * 0.5 * (1 + cos(pi() * length(completion) / 1000.0))
  ELSE -0.5 + 0.5 * 0.5 * (1 + cos(pi() * length(completion) / 1000.0)) END"""


@query("r6_cosine_scaled_reward", f"SELECT seq, round(CAST({COSINE} AS DOUBLE), 6) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", r6(reward_columns.cosine_scaled_reward("completion", "is_correct")).alias("reward"))


_REPETITION = r"""SELECT seq, CASE WHEN len(w) < 3 THEN 0 ELSE
  len(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) / CAST(len(w) - 2 AS DOUBLE) - 1 END AS reward
FROM (SELECT seq, regexp_split_to_array(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '\s+') AS w FROM ({}) d) x"""
REPETITION = _REPETITION.format("SELECT doc_id AS seq, text FROM @documents")


@query("r7_repetition_penalty_reward", f"SELECT seq, round(CAST(reward AS DOUBLE), 6) AS reward FROM ({REPETITION}) r")
def _(v):
    penalty = reward_columns.repetition_penalty_reward("text")
    return v.table("documents").select(F.col("doc_id").alias("seq"), r6(penalty).alias("reward"))


@query("r8_code_format_reward", f"SELECT seq, CAST({_flag_sql(CODE_FORMAT)} AS DOUBLE) AS reward FROM @completions")
def _(v):
    return v("completions").select("seq", reward_columns.code_format_reward("completion").alias("reward"))


_N_TOKENS = r"len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'))"


@query(
    "r9_soft_overlong_punishment",
    f"""SELECT doc_id, round(CAST(CASE WHEN n <= 200 THEN 0 WHEN n <= 500 THEN (200 - n) / CAST(300 AS DOUBLE) ELSE -1 END AS DOUBLE), 6) AS reward
FROM (SELECT doc_id, {_N_TOKENS} AS n FROM @documents) d""",
)
def _(v):
    n_tokens = F.size(words("text"))
    punishment = reward_columns.soft_overlong_punishment(n_tokens, 500, 300)
    return v.table("documents").select("doc_id", r6(punishment).alias("reward"))


@query(
    "r10_measured_code_reward",
    rf"""SELECT c.seq, coalesce(regexp_extract_all(c.completion, '(?s)```cpp\n(.*?)```', 1)[-1], 'No Code') AS code,
  coalesce(round(s.score, 6), 0) AS pie_code FROM @completions c LEFT JOIN ({SCORES}) s ON s.seq = c.seq""",
)
def _(v):
    scored = rewards.measured_code_reward(v("completions"), _scores(v))
    return scored.select("seq", "code", r6("pie_code").alias("pie_code"))


@query(
    "r11_speedup_reward",
    f"""SELECT completion_id, round(m, 6) AS mean_speedup, round(CAST(CASE WHEN m = 0 THEN -100 WHEN m < 1 THEN -1 ELSE m * m END AS DOUBLE), 6) AS reward FROM (
  SELECT completion_id, avg(CASE WHEN tgt_acc < 1 OR tgt_runtime = {_INF} THEN 0 ELSE src_runtime / tgt_runtime END) AS m
  FROM @optimizer_results GROUP BY completion_id) x""",
)
def _(v):
    rewarded = rewards.speedup_reward(v("optimizer_results"))
    return rewarded.select("completion_id", r6("mean_speedup").alias("mean_speedup"), r6("reward").alias("reward"))


@query(
    "r12_baseline_or_measure",
    """SELECT b.seq, b.gen, CASE WHEN b.accuracy IS NULL THEN m.accuracy ELSE b.accuracy END AS accuracy,
  CASE WHEN b.accuracy IS NULL THEN m.agg_runtime ELSE b.agg_runtime END AS agg_runtime
FROM @baselines b LEFT JOIN @measured m ON m.seq = b.seq AND m.gen = b.gen""",
)
def _(v):
    return rewards.baseline_or_measure(v("baselines"), v("measured"), ["seq", "gen"]).select(
        "seq", "gen", "accuracy", "agg_runtime"
    )


REWARD_NAMES = ["accuracy", "format", "code_format", "tag_count", "reasoning_steps", "cosine", "length"]
REWARD_WEIGHTS = [1.0, 0.5, 0.5, 1.0, 0.25, 2.0, 1.5]


@query(
    "r13_score_completions",
    f"""SELECT c.seq, CAST({ANSWER} AS DOUBLE) AS reward_accuracy, round(CAST(coalesce({ANSWER}, 0) + 0.5 * {_flag_sql(FORMAT)} + 0.5 * {_flag_sql(CODE_FORMAT)}
  + {TAGS} + 0.25 * {STEPS} + 2 * ({COSINE}) + 1.5 * l.reward AS DOUBLE), 5) AS reward FROM @completions c JOIN ({LENGTH}) l ON l.seq = c.seq""",
)
def _(v):
    scored = rewards.score_completions(v("completions"), REWARD_NAMES, REWARD_WEIGHTS)
    return scored.select("seq", "reward_accuracy", F.round("reward", 5).alias("reward"))


# The reward of what two optimizers make of each completion. Stored baselines have gaps, as have the measured ones.
OPTIMIZER_TEMPLATE = "Improve:\n```cpp\n{{  src_code  }}\n```\nHow: {{  suggestion  }}"
SOURCES = """SELECT batch_id, seq, completion, 'int src; // ' || role AS org_code, CASE WHEN seq % 2 = 0 THEN CAST(1 AS DOUBLE) END AS accuracy,
  CASE WHEN seq % 2 = 0 THEN CAST(60 AS DOUBLE) END AS agg_runtime FROM @completions"""
SOURCES_MEASURED = "SELECT seq, CAST(1 AS DOUBLE) AS accuracy, CAST(50 AS DOUBLE) AS agg_runtime FROM @completions WHERE role <> 'user'"
PROGRAMS_MEASURED = """SELECT c.seq, CASE g.gen WHEN 0 THEN 'alpha' ELSE 'beta' END AS optimizer, g.accuracy,
  CASE WHEN g.code IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE g.agg_runtime END AS agg_runtime
FROM @completions c JOIN @gens g ON g.seq = c.batch_id WHERE g.gen < 2"""


def stub_optimizers():
    """The first answers with its prompt, the second without a program in every other case."""
    def alpha():
        return lambda prompts: [f"```cpp\n{prompt}\n```" for prompt in prompts]

    def beta():
        return lambda prompts: ["none" if "Step 1" in prompt else "```cpp\n1\n```\n```cpp\n2\n```" for prompt in prompts]

    return {"alpha": alpha, "beta": beta}


def _programs(v):
    return rewards.optimizer_programs(v.sql(SOURCES), stub_optimizers(), OPTIMIZER_TEMPLATE)


_PROMPT = "'Improve:' || chr(10) || '```cpp' || chr(10) || org_code || chr(10) || '```' || chr(10) || 'How: ' || completion"
WRITTEN = rf"""SELECT seq, 'alpha' AS optimizer, coalesce(regexp_extract_all('```cpp' || chr(10) || {_PROMPT} || chr(10) || '```', '(?s)```cpp\n(.*?)```', 1)[-1], 'No Code') AS code
FROM ({SOURCES}) s UNION ALL SELECT seq, 'beta', CASE WHEN strpos(completion, 'Step 1') > 0 THEN 'No Code' ELSE '2' || chr(10) END FROM ({SOURCES}) s"""


@query("r_optimizer_programs", WRITTEN)
def _(v):
    return _programs(v)


OPTIMIZED = f"""SELECT seq, m AS mean_speedup, CAST(CASE WHEN m = 0 THEN -100 WHEN m < 1 THEN -1 ELSE m * m END AS DOUBLE) AS cos_optimizer_code FROM (
  SELECT w.seq, avg(CASE WHEN w.code = 'No Code' OR t.seq IS NULL OR t.accuracy < 1 OR t.agg_runtime = {_INF} OR coalesce(s.agg_runtime, b.agg_runtime) IS NULL THEN 0
    ELSE coalesce(s.agg_runtime, b.agg_runtime) / t.agg_runtime END) AS m
  FROM ({WRITTEN}) w JOIN ({SOURCES}) s ON s.seq = w.seq LEFT JOIN ({SOURCES_MEASURED}) b ON b.seq = w.seq
  LEFT JOIN ({PROGRAMS_MEASURED}) t ON t.seq = w.seq AND t.optimizer = w.optimizer GROUP BY w.seq) x"""
ALL_REWARDS = {
    "accuracy": 1.0, "format": 0.5, "code_format": 0.5, "tag_count": 1.0, "reasoning_steps": 0.25, "cosine": 2.0, "repetition_penalty": 0.5,
    "soft_overlong_punishment": 1.0, "length": 1.5, "pie_code": 1.0, "cos_optimizer_code": 0.1,
}
_COMPLETION_TOKENS = _N_TOKENS.replace("text", "completion")
REWARD_SQL = {
    "accuracy": ANSWER,
    "format": _flag_sql(FORMAT),
    "code_format": _flag_sql(CODE_FORMAT),
    "tag_count": TAGS,
    "reasoning_steps": STEPS,
    "cosine": COSINE,
    "repetition_penalty": "p.reward",
    "soft_overlong_punishment": f"CASE WHEN {_COMPLETION_TOKENS} <= 20 THEN 0 WHEN {_COMPLETION_TOKENS} <= 50 THEN (20 - {_COMPLETION_TOKENS}) / CAST(30 AS DOUBLE) ELSE -1 END",
    "length": "l.reward",
    "pie_code": "coalesce(s.score, 0)",
    "cos_optimizer_code": "o.cos_optimizer_code",
}


@query(
    "r_optimizer_reward",
    f"""SELECT seq, mean_speedup, {", ".join(f"round(reward_{name}, 5) AS reward_{name}" for name in ALL_REWARDS)},
  round({" + ".join(f"{weight} * coalesce(reward_{name}, 0)" for name, weight in ALL_REWARDS.items())}, 4) AS reward FROM (
  SELECT c.seq, round(o.mean_speedup, 5) AS mean_speedup, {", ".join(f"CAST({sql} AS DOUBLE) AS reward_{name}" for name, sql in REWARD_SQL.items())}
  FROM @completions c JOIN ({LENGTH}) l ON l.seq = c.seq JOIN ({_REPETITION.format("SELECT seq, completion AS text FROM @completions")}) p ON p.seq = c.seq
  LEFT JOIN ({SCORES}) s ON s.seq = c.seq JOIN ({OPTIMIZED}) o ON o.seq = c.seq) x""",
)
def _(v):
    sources = v.sql(SOURCES)
    rewarded = rewards.optimizer_reward(sources, _programs(v), v.sql(PROGRAMS_MEASURED), v.sql(SOURCES_MEASURED))
    rows = v("completions").withColumn("n_tokens", F.size(words("completion")))
    options = {"soft_overlong_punishment": {"max_length": 50, "cache": 30}}
    scored = rewards.score_completions(
        rows, list(ALL_REWARDS), list(ALL_REWARDS.values()), options, code_scores=_scores(v), optimizer_rewards=rewarded
    )
    both = scored.join(rewarded.select("seq", "mean_speedup"), "seq")
    named = [F.round(f"reward_{name}", 5).alias(f"reward_{name}") for name in ALL_REWARDS]
    return both.select("seq", F.round("mean_speedup", 5).alias("mean_speedup"), *named, F.round("reward", 4).alias("reward"))
