"""Queries of the evaluation report (E) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions.numbers import REPORT_THRESHOLDS, threshold_name
from paceline.operators import report
from paceline.plans.registry import joined, query, r6

INFINITE = "CAST('Infinity' AS DOUBLE)"


@query(
    "e1_prepare_eval",
    r"""SELECT seq, regexp_replace(src_code, '^\s+|\s+$', '', 'g') AS slower_program, 'x' AS second_tag FROM @programs
WHERE src_code <> tgt_code""",
)
def _(v):
    rows = v("programs").withColumn("tags", F.concat(F.lit('["'), "problem_id", F.lit('","x"]')))
    prepared = report.prepare_eval(rows, ["tags"])
    return prepared.select("seq", "slower_program", F.col("tags")[1].alias("second_tag"))


@query(
    "e1_missing_programs",
    r"""SELECT seq, regexp_replace(src_code, '^\s+|\s+$', '', 'g') AS slower_program FROM @odd_programs WHERE src_code IS DISTINCT FROM tgt_code""",
)
def _(v):
    return report.prepare_eval(v("odd_programs")).select("seq", "slower_program")


def _generation_arrays(v):
    """One array of generated programs per row, as model output files hold them."""
    ordered = F.sort_array(F.collect_list(F.struct("gen", "code")))
    return v("gens").groupBy("seq").agg(F.transform(ordered, lambda g: g["code"]).alias("model"))


@query("e2_expand_generations", "SELECT seq, gen, code FROM @gens")
def _(v):
    long = report.explode_generations(_generation_arrays(v), "model")
    return long.select("seq", F.col("gen").cast("bigint").alias("gen"), "code")


# The wide form has a declared number of columns: an order has at most so many lines.
GENERATIONS = 7


def _wide_sql(value: str, name: str) -> str:
    return ", ".join(f"max({value}) FILTER (WHERE gen = {i}) AS {name.format(i)}" for i in range(GENERATIONS))


@query("e2_expand_generations_wide", f"""SELECT seq, {_wide_sql("code", "model_{}")} FROM @gens GROUP BY seq""")
def _(v):
    return report.expand_generations(_generation_arrays(v), "model", GENERATIONS).drop("model")


MELTED = """SELECT seq, 'src_code' AS code_type, src_code AS code FROM @programs
UNION ALL SELECT seq, 'tgt_code', tgt_code FROM @programs
UNION ALL SELECT seq, 'model', CASE WHEN seq % 3 = 0 THEN tgt_code END FROM @programs WHERE seq % 3 = 0"""


def _melted(v):
    model = F.when(F.col("seq") % 3 == 0, F.col("tgt_code")).when(F.col("seq") % 3 == 1, F.lit(""))
    return report.melt_code(v("programs").withColumn("model", model), ["seq"], ["src_code", "tgt_code", "model"])


@query("e3_melt_code", MELTED)
def _(v):
    return _melted(v)


@query(
    "e4_split_baseline_rows",
    f"""SELECT seq, code_type, CASE WHEN code_type = 'model' THEN CAST(length(code) AS BIGINT) END AS measured FROM ({MELTED}) m""",
)
def _(v):
    to_measure, set_aside = report.split_baseline_rows(_melted(v))
    measured = to_measure.withColumn("measured", F.length("code").cast("bigint"))
    return report.restore_baseline_rows(measured, set_aside).select("seq", "code_type", "measured")


@query("e5_order_tests", "SELECT seq, array_to_string(list_reverse_sort(tests), ',') AS tests FROM @test_pairs")
def _(v):
    return report.order_tests(v("test_pairs")).select("seq", joined("tests").alias("tests"))


def with_test_times(results):
    """Results with the times of two tests each."""
    half = F.col("agg_runtime") / 2
    return results.withColumn("tc2time", F.create_map(F.lit("1"), half, F.lit("2"), half + 1))


@query(
    "e6_join_measurements",
    """SELECT g.seq, g.gen, g.code, m.compilation, m.accuracy, m.agg_runtime, m.agg_runtime / 2 AS time_1, m.agg_runtime / 2 + 1 AS time_2
FROM @gens g LEFT JOIN @measured m ON m.seq = g.seq AND m.gen = g.gen""",
)
def _(v):
    measured = with_test_times(v("measured"))
    both = report.join_measurements(v("gens").select("seq", "gen", "code"), measured, ["seq", "gen"])
    return both.select("*", F.col("tc2time")["1"].alias("time_1"), F.col("tc2time")["2"].alias("time_2")).drop("tc2time")


@query(
    "e7_unmelt_results",
    f"""SELECT src_id, tgt_id, {_wide_sql("accuracy", "model_{}_accuracy")}, {_wide_sql("agg_runtime", "model_{}_agg_runtime")},
  {_wide_sql("code", "model_{}_code")}, {_wide_sql("agg_runtime / 2 + 1", "model_{}_time_2")} FROM @eval_results GROUP BY src_id, tgt_id""",
)
def _(v):
    results = with_test_times(v("eval_results").withColumn("code_type", F.concat(F.lit("model_"), F.col("gen").cast("string"))))
    names = [f"model_{i}" for i in range(GENERATIONS)]
    wide = report.unmelt_results(results, names, ["accuracy", "agg_runtime", "code", "tc2time"])
    times = [F.col(f"{name}_tc2time")["2"].alias(f"{name}_time_2") for name in names]
    return wide.select("*", *times).drop(*[f"{name}_tc2time" for name in names])


@query("e8_project_key_columns", "SELECT problem_id, src_id, tgt_id, src_code, tgt_code, src_runtime, tgt_runtime FROM @eval_rows")
def _(v):
    return report.project_key_columns(v("eval_rows"), "model")


COMPLETED = f"""SELECT r.seq, r.problem_id, r.src_id, r.tgt_id, r.src_runtime, r.tgt_runtime, coalesce(g.gen, 0) AS gen, g.code, g.seq IS NOT NULL AS measured,
  CASE WHEN g.seq IS NULL THEN {INFINITE} ELSE g.agg_runtime END AS agg_runtime,
  CASE WHEN g.seq IS NULL THEN CAST(0 AS DOUBLE) ELSE g.accuracy END AS accuracy
FROM @eval_rows r LEFT JOIN @gens g ON g.seq = r.seq"""
ADJUSTED = f"""SELECT *, CASE WHEN code IS NULL OR accuracy < 1 THEN {INFINITE} ELSE agg_runtime END AS adjusted_runtime FROM ({COMPLETED}) c"""


def _adjusted(v):
    # Adjusted before it is completed: only numbers travel, not the generated programs.
    adjusted = report.adjust_runtime(v("gens")).drop("code")
    return report.complete_missing(adjusted, v("eval_rows"))


@query(
    "e9_complete_missing",
    f"""SELECT seq, CAST(gen AS BIGINT) AS gen, code, agg_runtime, accuracy, CASE WHEN measured THEN 2 ELSE 0 END AS times,
  CASE WHEN measured THEN agg_runtime / 2 END AS time_1 FROM ({COMPLETED}) c""",
)
def _(v):
    completed = report.complete_missing(with_test_times(v("gens")), v("eval_rows"))
    return completed.select(
        "seq", F.col("gen").cast("bigint").alias("gen"), "code", "agg_runtime", "accuracy",
        F.size("tc2time").alias("times"), F.try_element_at("tc2time", F.lit("1")).alias("time_1"),
    )


# Rows are the same when both programs are; rows that lack one are like no other.
@query(
    "e9_glued_programs",
    f"""WITH r AS (SELECT *, seq IN (SELECT seq FROM @twin_results) AS tried FROM @twin_rows),
c AS (SELECT *, CASE WHEN src_code IS NULL OR tgt_code IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY src_code, tgt_code ORDER BY tried DESC, seq) END AS place FROM r)
SELECT c.seq, CAST(coalesce(g.gen, 0) AS BIGINT) AS gen, CASE WHEN g.seq IS NULL THEN {INFINITE} ELSE g.agg_runtime END AS agg_runtime
FROM c LEFT JOIN @twin_results g ON g.seq = c.seq WHERE place = 1""",
)
def _(v):
    completed = report.complete_missing(v("twin_results").drop("code"), v("twin_rows"))
    return completed.select("seq", F.col("gen").cast("bigint").alias("gen"), "agg_runtime")


@query("e10_adjust_runtime", f"SELECT seq, CAST(gen AS BIGINT) AS gen, adjusted_runtime FROM ({ADJUSTED}) a")
def _(v):
    return _adjusted(v).select("seq", F.col("gen").cast("bigint").alias("gen"), "adjusted_runtime")


FASTEST = f"""SELECT seq, min(problem_id) AS problem_id, min(src_runtime) AS src_runtime, min(tgt_runtime) AS tgt_runtime,
  min(adjusted_runtime) AS fastest_runtime FROM ({ADJUSTED}) a GROUP BY seq"""


def _fastest(v):
    return report.fastest_generated(_adjusted(v))


@query("e11_fastest_generated", f"SELECT seq, problem_id, src_runtime, tgt_runtime, fastest_runtime FROM ({FASTEST}) f")
def _(v):
    return _fastest(v)


def floored_sql(slow: str, fast: str) -> str:
    return f"CASE WHEN {fast} = {INFINITE} THEN CAST(1 AS DOUBLE) WHEN {slow} / {fast} < 1 THEN CAST(1 AS DOUBLE) ELSE {slow} / {fast} END"


PROBLEM_BEST = f"""SELECT *, problem_runtime < {INFINITE} AS problem_solved, {floored_sql("src_runtime", "problem_runtime")} AS problem_speedup
FROM (SELECT *, min(fastest_runtime) OVER (PARTITION BY problem_id) AS problem_runtime FROM ({FASTEST}) f) p"""


@query("e12_problem_best", f"SELECT seq, problem_id, problem_runtime, problem_solved, problem_speedup FROM ({PROBLEM_BEST}) p")
def _(v):
    return report.problem_best(_fastest(v)).select(
        "seq", "problem_id", "problem_runtime", "problem_solved", "problem_speedup"
    )


BEST_AT_K = f"""SELECT seq, CAST(gen + 1 AS BIGINT) AS k, best_runtime, best_accuracy, best_accuracy = 1 AS is_correct,
  {floored_sql("src_runtime", "best_runtime")} AS speedup FROM (
  SELECT *, min(adjusted_runtime) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM ({ADJUSTED}) a
  WINDOW w AS (PARTITION BY seq ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b"""


@query("e13_best_at_k", BEST_AT_K)
def _(v):
    return report.best_at_k(_adjusted(v)).select(
        "seq", F.col("k").cast("bigint").alias("k"), "best_runtime", "best_accuracy", "is_correct", "speedup"
    )


def share_sql(speedup: str) -> str:
    return ", ".join(
        f"round(count(*) FILTER (WHERE {speedup} >= {t}) / CAST(count(*) AS DOUBLE), 6) AS share_ge_{threshold_name(t)}"
        for t in REPORT_THRESHOLDS
    )


def rounded(df, keep=()):
    return df.select(*keep, *[r6(name).alias(name) for name in df.columns if name not in keep])


# Padded to the largest k row by row, which the operator avoids.
REPORT = f"""WITH b AS ({BEST_AT_K}), n AS (SELECT seq, max(k) AS last FROM b GROUP BY seq),
ks AS (SELECT unnest(generate_series(1, (SELECT max(k) FROM b))) AS k),
padded AS (SELECT ks.k, b.* EXCLUDE (k) FROM n JOIN ks ON true JOIN b ON b.seq = n.seq AND b.k = least(n.last, ks.k))
SELECT k, count(*) AS programs, round(avg(best_accuracy), 6) AS mean_accuracy, round(avg(CAST(is_correct AS INTEGER)), 6) AS mean_correct,
  round(avg(speedup), 6) AS mean_speedup, {share_sql("speedup")} FROM padded GROUP BY k"""


@query("e14_report_at_k", REPORT)
def best_at_k_report(v):
    rows = report.report_at_k(report.best_at_k(_adjusted(v)))
    rows = rows.withColumn("k", F.col("k").cast("bigint"))
    return rounded(rows, ("k", "programs"))


@query(
    "e15_report_reference",
    f"""SELECT round(avg(src_runtime / tgt_runtime), 6) AS mean_speedup, {share_sql("src_runtime / tgt_runtime")} FROM @eval_rows""",
)
def _(v):
    return rounded(report.report_reference(v("eval_rows")))


@query(
    "e16_report_problem_best",
    f"""SELECT round(avg(CAST(problem_solved AS INTEGER)), 6) AS mean_solved, round(avg(problem_speedup), 6) AS mean_speedup,
  {share_sql("problem_speedup")} FROM ({PROBLEM_BEST}) p""",
)
def _(v):
    return rounded(report.report_problem_best(report.problem_best(_fastest(v))))
