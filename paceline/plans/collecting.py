"""Queries of the collection (C) and pair (P) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.operators import collect, pairs
from paceline.plans.registry import joined, query, written_with_counts

SOLUTIONS = """SELECT solution_id, problem_id, runtime, code FROM (
  SELECT *, row_number() OVER (PARTITION BY solution_id ORDER BY write_no DESC) AS rn FROM (
    SELECT seq * 2 AS write_no, src_id AS solution_id, problem_id, src_agg_runtime AS runtime, src_code AS code FROM @raw_pairs
    UNION ALL
    SELECT seq * 2 + 1, tgt_id, problem_id, tgt_agg_runtime, tgt_code FROM @raw_pairs) w) x WHERE rn = 1"""


@query("c1_collect_unique_solutions", SOLUTIONS)
def _(v):
    return collect.collect_unique_solutions(v("raw_pairs")).drop("write_no")


@query(
    "c2_attach_users",
    f"""WITH sol AS ({SOLUTIONS})
SELECT s.solution_id, s.problem_id, s.runtime, m.user_id FROM sol s
JOIN @metadata m ON m.submission_id = s.solution_id AND m.problem_id = s.problem_id""",
)
def _(v):
    solutions = collect.collect_unique_solutions(v("raw_pairs"))
    return collect.attach_users(solutions, v("metadata")).select("solution_id", "problem_id", "runtime", "user_id")


@query(
    "c3_metadata_audit",
    f"""WITH sol AS ({SOLUTIONS})
SELECT count(*) FILTER (WHERE m.problem_id IS NULL) AS not_found,
  count(*) FILTER (WHERE m.problem_id <> s.problem_id) AS problem_mismatch,
  count(*) FILTER (WHERE m.problem_id = s.problem_id) AS matched
FROM sol s LEFT JOIN @metadata m ON m.submission_id = s.solution_id""",
)
def _(v):
    return collect.metadata_audit(collect.collect_unique_solutions(v("raw_pairs")), v("metadata"))


@query(
    "c3_attach_users_audited",
    f"""WITH sol AS ({SOLUTIONS})
SELECT count(*) FILTER (WHERE m.problem_id = s.problem_id) AS rows_written, count(*) FILTER (WHERE m.problem_id IS NULL) AS not_found,
  count(*) FILTER (WHERE m.problem_id <> s.problem_id) AS problem_mismatch, count(*) FILTER (WHERE m.problem_id = s.problem_id) AS matched
FROM sol s LEFT JOIN @metadata m ON m.submission_id = s.solution_id""",
)
def _(v):
    rows, audit = collect.attach_users_audited(collect.collect_unique_solutions(v("raw_pairs")), v("metadata"))
    return written_with_counts(rows, audit, "attached")


@query(
    "c4_build_problem_index",
    """SELECT problem_id, user_id, solution_id AS entry, problem_id AS record_problem, runtime, code, seq FROM @subs""",
)
def _(v):
    # Every entry of every map; the bucket is a hash that the other engine does not have.
    entries = collect.build_problem_index(v("subs")).select("problem_id", "user_id", F.explode("solutions").alias("entry", "record"))
    return entries.select(
        "problem_id", "user_id", "entry", F.col("record.problem_id").alias("record_problem"), "record.runtime", "record.code", "record.seq"
    )


@query("c5_flatten_problem_index", "SELECT seq, solution_id, problem_id, user_id, runtime, code FROM @subs")
def _(v):
    flat = collect.flatten_problem_index(collect.build_problem_index(v("subs")))
    return flat.select("seq", "solution_id", "problem_id", "user_id", "runtime", "code")


@query(
    "c6_filter_active_users",
    """SELECT seq, solution_id, problem_id, user_id FROM (
  SELECT *, count(*) OVER (PARTITION BY problem_id, user_id) AS n FROM @subs) x WHERE n > 2""",
)
def _(v):
    return collect.filter_active_users(v("subs"), 2).select("seq", "solution_id", "problem_id", "user_id")


@query(
    "c7_activity_stats",
    """WITH g AS (SELECT problem_id, user_id, count(*) AS n FROM @subs GROUP BY 1, 2)
SELECT count(DISTINCT problem_id) AS problems_before, count(DISTINCT problem_id) FILTER (WHERE n > 1) AS problems_after,
  CAST(sum(n) AS BIGINT) AS solutions_before, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS solutions_after,
  count(*) FILTER (WHERE n > 1) AS submission_sets, count(DISTINCT user_id) FILTER (WHERE n > 1) AS unique_users FROM g""",
)
def _(v):
    return collect.activity_stats(v("subs"), 1)


@query(
    "c7_filter_active_users_audited",
    """WITH g AS (SELECT problem_id, user_id, count(*) AS n FROM @subs GROUP BY 1, 2)
SELECT CAST(sum(n) FILTER (WHERE n > 2) AS BIGINT) AS rows_written, CAST(sum(n) AS BIGINT) AS solutions_before,
  CAST(sum(n) FILTER (WHERE n > 2) AS BIGINT) AS solutions_after, count(*) FILTER (WHERE n > 2) AS submission_sets FROM g""",
)
def _(v):
    return written_with_counts(*collect.filter_active_users_audited(v("subs"), 2), "active")


@query(
    "c8_make_sft_pairs",
    """SELECT problem_id || '-' || src_id || '-' || tgt_id AS id, seq, src_code, tgt_code,
  src_agg_runtime AS src_time, tgt_agg_runtime AS tgt_time FROM @raw_pairs""",
)
def _(v):
    sft = collect.make_sft_pairs(v("raw_pairs"))
    return sft.select(
        "id", "seq", "src_code", "tgt_code", F.col("cpu_time")[0].alias("src_time"), F.col("cpu_time")[1].alias("tgt_time")
    )


@query(
    "c9_clean_test_set",
    """SELECT 'pie_test_' || CAST(row_number() OVER (ORDER BY seq) - 1 AS STRING) AS id, problem_id, src_id, tgt_id,
  src_code, tgt_code, fastest_code, array_to_string(tests[1:20], ',') AS tests
FROM @test_pairs""",
)
def _(v):
    cleaned = collect.clean_test_set(v("test_pairs"))
    return cleaned.select(
        "id", "problem_id", "src_id", "tgt_id", "src_code", "tgt_code", "fastest_code",
        joined("tests").alias("tests"),
    )


# Every faster i and slower j of a group, then the known ids: the definition, not the operator's way.
OWN = """SELECT s.problem_id || '-' || s.solution_id || '-' || t.solution_id AS id, s.problem_id, s.user_id,
  s.solution_id AS src_id, t.solution_id AS tgt_id, s.runtime AS src_runtime, t.runtime AS tgt_runtime,
  s.runtime / t.runtime AS speed_up, t.rk = 1 AS is_best, false AS cross_user
FROM @ranked_subs s JOIN @ranked_subs t ON s.problem_id = t.problem_id AND s.user_id = t.user_id AND t.rk < s.rk
WHERE s.runtime / t.runtime >= 1.1
  AND s.problem_id || '-' || s.solution_id || '-' || t.solution_id IN (SELECT id FROM @known_pairs)"""
BEST = """SELECT problem_id, solution_id AS best_id, user_id AS best_user, runtime AS best_runtime FROM (
  SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY runtime, first_seq, seq) AS place FROM (
    SELECT *, count(*) OVER (PARTITION BY problem_id, user_id) AS n, min(seq) OVER (PARTITION BY problem_id, user_id) AS first_seq
    FROM @ranked_subs) a WHERE rk < n) b WHERE place = 1"""
CROSS = f"""SELECT o.problem_id || '-' || o.src_id || '-' || b.best_id AS id, o.problem_id, o.user_id || '|' || b.best_user AS user_id,
  o.src_id, b.best_id AS tgt_id, o.src_runtime, b.best_runtime AS tgt_runtime, o.src_runtime / b.best_runtime AS speed_up,
  true AS is_best, true AS cross_user
FROM ({OWN}) o JOIN ({BEST}) b ON o.problem_id = b.problem_id WHERE o.is_best AND o.tgt_runtime / b.best_runtime < 2"""
FULL = f"{OWN} UNION ALL {CROSS}"
PAIR_COLUMNS = (
    "id", "problem_id", "user_id", "src_id", "tgt_id", "src_runtime", "tgt_runtime", "speed_up", "is_best", "cross_user",
)


@query("p1_speed_ordered_pairs", OWN)
def _(v):
    return pairs.speed_ordered_pairs(v("subs"), v("known_pairs")).select(*PAIR_COLUMNS)


@query(
    "p2_restrict_to_known_pairs",
    """SELECT id, seq FROM @known_pairs WHERE id IN (
  SELECT problem_id || '-' || src_id || '-' || tgt_id FROM @eval_rows)""",
)
def _(v):
    fastest = v("eval_rows").select(collect.pair_id("problem_id", "src_id", "tgt_id").alias("id"))
    return pairs.restrict_to_known_pairs(v("known_pairs").select("id", "seq"), fastest)


@query("p3_best_solution_per_problem", BEST)
def _(v):
    return pairs.best_solution_per_problem(v("subs")).select("problem_id", "best_id", "best_user", "best_runtime")


@query("p4_cross_user_pairs", CROSS)
def _(v):
    subs = v("subs")
    own = pairs.speed_ordered_pairs(subs, v("known_pairs"))
    return pairs.cross_user_pairs(own, pairs.best_solution_per_problem(subs)).select(*PAIR_COLUMNS)


@query(
    "p5_fastest_target_pairs",
    """SELECT s.problem_id || '-' || s.user_id || '-' || s.solution_id || '-' || t.solution_id AS id,
  s.runtime AS src_runtime, t.runtime AS tgt_runtime
FROM @subs s JOIN (SELECT *, row_number() OVER (PARTITION BY problem_id, user_id ORDER BY runtime, seq DESC) AS place FROM @subs) t
  ON s.problem_id = t.problem_id AND s.user_id = t.user_id AND t.place = 1 WHERE s.solution_id <> t.solution_id""",
)
def _(v):
    return pairs.fastest_target_pairs(v("subs")).select("id", "src_runtime", "tgt_runtime")


@query(
    "p6_strip_cpp_comments",
    r"""SELECT seq, regexp_replace(regexp_replace(regexp_replace(src_code, '(?s)/\*.*?\*/', '', 'g'), '//.*', '', 'g'),
  '^\s+|\s+$', '', 'g') AS src_code FROM @programs""",
)
def _(v):
    return v("programs").select("seq", pairs.strip_cpp_comments("src_code").alias("src_code"))


@query("p7_drop_identical_pairs", "SELECT seq, problem_id FROM @programs WHERE src_code <> tgt_code")
def _(v):
    return pairs.drop_identical_pairs(v("programs")).select("seq", "problem_id")


@query("p7_missing_programs", "SELECT seq, problem_id FROM @odd_programs WHERE src_code IS DISTINCT FROM tgt_code")
def _(v):
    return pairs.drop_identical_pairs(v("odd_programs")).select("seq", "problem_id")


@query(
    "p8_pair_summary",
    f"""SELECT count(*) AS pairs, count(*) FILTER (WHERE is_best) AS best_pairs,
  count(*) FILTER (WHERE cross_user) AS cross_user_pairs FROM ({FULL}) f""",
)
def _(v):
    return pairs.pair_summary(pairs.full_pairs(v("subs"), v("known_pairs")))


# Every pair of every group, as the definition has it.
@query(
    "p8_pair_totals",
    """SELECT s.problem_id, count(*) FILTER (WHERE s.runtime / t.runtime >= 1.1) AS pairs,
  count(*) FILTER (WHERE s.runtime / t.runtime >= 1.1 AND t.rk = 1) AS best_pairs
FROM @ranked_subs s LEFT JOIN @ranked_subs t ON s.problem_id = t.problem_id AND s.user_id = t.user_id AND t.rk < s.rk
WHERE s.runtime > 0 GROUP BY s.problem_id""",
)
def _(v):
    return pairs.pair_totals(v("subs"))


_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace({}.code, '(?s)/\*.*?\*/', '', 'g'), '//.*', '', 'g'), '^\s+|\s+$', '', 'g')"
)


@query(
    "p_full_pairs_with_code",
    f"""SELECT f.id, f.cross_user, f.speed_up, {_CLEAN.format("s")} AS src_code, {_CLEAN.format("t")} AS tgt_code
FROM ({FULL}) f JOIN @subs s ON s.solution_id = f.src_id JOIN @subs t ON t.solution_id = f.tgt_id""",
)
def full_pairs_with_code(v):
    subs = v("subs")
    full = pairs.full_pairs(subs, v("known_pairs"))
    return pairs.attach_codes(full, subs).select("id", "cross_user", "speed_up", "src_code", "tgt_code")
