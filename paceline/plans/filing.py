"""Queries of the source and sink (S) operators: each writes what it reads to the scratch folder first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.operators import measurements, report
from paceline.plans.measuring import STATS_VALUES
from paceline.plans.registry import query
from paceline.plans.reporting import INFINITE, REPORT, best_at_k_report, floored_sql, rounded, share_sql, with_test_times
from paceline.session import materialized, scratch_path
from paceline.sources import files

PAIR_SCHEMA = (
    "seq bigint, src_id string, tgt_id string, problem_id string, src_agg_runtime double, tgt_agg_runtime double, "
    "src_code string, tgt_code string"
)


@query("s1_read_records", "SELECT * FROM @raw_pairs")
def _(v):
    path = scratch_path(v.spark, "records")
    v("raw_pairs").write.json(path)
    return files.read_records(v.spark, path, PAIR_SCHEMA)


@query("s2_write_records", "SELECT seq, src_code, CASE WHEN seq % 7 = 0 THEN NULL ELSE tgt_code END AS tgt_code FROM @programs")
def _(v):
    rows = v("programs").select("seq", "src_code", F.when(F.col("seq") % 7 != 0, F.col("tgt_code")).alias("tgt_code"))
    path = files.write_records(rows, scratch_path(v.spark, "responses") + ".jsonl", cleaned=True)
    return files.read_records(v.spark, path, "seq bigint, src_code string, tgt_code string")


@query("s3_read_submission_metadata", "SELECT submission_id, problem_id, user_id FROM @metadata")
def _(v):
    folder = scratch_path(v.spark, "metadata")
    rows = v("metadata_rows").select("submission_id", "problem_id", "user_id", F.lit("x").alias("language"), "seq")
    # Older rows are in the file that is read first, whose columns stand in another order.
    orders = (["submission_id", "problem_id", "user_id", "language"], ["user_id", "language", "submission_id", "problem_id"])
    for name, part, columns in (("p1", rows.filter("seq < 0"), orders[0]), ("p2", rows.filter("seq >= 0"), orders[1])):
        part.select(columns).write.csv(f"{folder}/{name}.csv", header=True)
    return files.read_submission_metadata(v.spark, f"{folder}/p*.csv")


@query(
    "s4_read_problem_statements",
    """SELECT p.problem_id, coalesce(g.html, '') AS instruction FROM (SELECT DISTINCT problem_id FROM @subs) p
LEFT JOIN @pages g ON 'p' || CAST(g.page_id * 2 AS STRING) = p.problem_id""",
)
def _(v):
    folder = scratch_path(v.spark, "statements")
    name = F.concat(F.lit("p"), (F.col("page_id") * 2).cast("string"), F.lit(".html"))
    files.write_named_texts(v.table("pages").select(name.alias("file"), "html"), "file", "html", folder)
    # The writer ends each row with a line break that the page did not have.
    written = files.read_problem_statements(v.spark, f"{folder}/*")
    statements = written.withColumn("instruction", F.regexp_replace("instruction", r"\n\z", ""))
    # Written first, so that it is known how few they are.
    problems = materialized(v("subs").select("problem_id").distinct(), "problems")
    return files.attach_statements(problems, statements)


@query("s5_load_registered_dataset", "SELECT seq, src_code AS prompt, tgt_code AS response FROM @raw_pairs")
def _(v):
    base = scratch_path(v.spark, "registered")
    registry = {"pairs": {"file_name": "pairs.jsonl", "columns": {"prompt": "src_code", "response": "tgt_code"}}}
    v("raw_pairs").write.json(f"{base}/pairs.jsonl")
    return files.load_registered_dataset(v.spark, registry, "pairs", base, "seq bigint, src_code string, tgt_code string")


@query("s6_materialize_once", "SELECT problem_id, count(*) AS submissions, count(DISTINCT user_id) AS users FROM @subs GROUP BY problem_id")
def _(v):
    path = scratch_path(v.spark, "materialized")
    counted = v("subs").groupBy("problem_id").agg(F.count("*").alias("submissions"))
    files.materialize_once(v.spark, path, lambda: counted, "submissions")
    # A build of another fingerprint replaces the first one's result; the third call must read the second one's.
    both = v("subs").groupBy("problem_id").agg(F.count("*").alias("submissions"), F.countDistinct("user_id").alias("users"))
    files.materialize_once(v.spark, path, lambda: both, "submissions, users")
    return files.materialize_once(v.spark, path, lambda: both.limit(0), "submissions, users")


@query(
    "s6_bucketed_once",
    """SELECT g.seq, count(*) AS generations, count(m.accuracy) AS measured, round(avg(m.accuracy), 6) AS accuracy
FROM @gens g LEFT JOIN @measured m ON m.seq = g.seq AND m.gen = g.gen GROUP BY g.seq""",
)
def _(v):
    base = scratch_path(v.spark, "bucketed")
    # By the row id, so that both the join and the group by it find their rows together.
    saved = {name: files.bucketed_once(v.spark, f"{base}/{name}", lambda name=name: v(name), ["seq"], 8) for name in ("gens", "measured")}
    joined = saved["gens"].alias("g").join(saved["measured"].alias("m"), (F.col("g.seq") == F.col("m.seq")) & (F.col("g.gen") == F.col("m.gen")), "left")
    return joined.groupBy(F.col("g.seq")).agg(
        F.count("*").alias("generations"), F.count("m.accuracy").alias("measured"), F.round(F.avg("m.accuracy"), 6).alias("accuracy")
    )


@query(
    "s7_read_model_outputs",
    """SELECT seq, gen, 'alpha' AS model, 'resp ' || code AS response, code FROM @gens
UNION ALL SELECT seq, CAST(0 AS BIGINT), 'beta-2.5', 'one', code FROM @gens WHERE gen = 0""",
)
def _(v):
    folder = scratch_path(v.spark, "outputs")
    gens = v("gens")
    ordered = F.sort_array(F.collect_list(F.struct("gen", "code")))
    arrays = gens.groupBy("seq").agg(ordered.alias("_gens")).select(
        "seq",
        F.transform("_gens", lambda g: F.concat(F.lit("resp "), g["code"])).alias("alpha_resp"),
        F.transform("_gens", lambda g: g["code"]).alias("alpha"),
    )
    arrays.write.json(f"{folder}/alpha.jsonl")
    first = gens.filter("gen = 0").select("seq", F.lit("one").alias("beta-2.5_resp"), F.col("code").alias("beta-2.5"))
    first.write.option("ignoreNullFields", False).json(f"{folder}/beta-2.5.jsonl")
    outputs = files.read_model_outputs(v.spark, folder, "seq bigint")
    answered = outputs.select("seq", "model", "codes", F.posexplode("responses").alias("gen", "response"))
    return answered.select(
        "seq", F.col("gen").cast("bigint").alias("gen"), "model", "response", F.get("codes", F.col("gen")).alias("code")
    )


@query(
    "s8_write_report",
    f"""SELECT r.*, t.rows_written, t.problems, t.runtime FROM ({REPORT}) r,
  (SELECT count(*) AS rows_written, count(DISTINCT problem_id) AS problems, round(sum(src_runtime), 4) AS runtime FROM @eval_rows) t""",
)
def _(v):
    path = scratch_path(v.spark, "report")
    summary = best_at_k_report(v)
    files.write_report(summary, v("eval_rows"), path)
    # The row file must hold every row the summary was made from.
    rows = v.spark.read.schema("problem_id string, src_runtime double").json(f"{path}/rows")
    return v.spark.read.schema(summary.schema).csv(f"{path}/summary", header=True).select(
        "*",
        rows.agg(F.count("*")).scalar().alias("rows_written"),
        rows.agg(F.countDistinct("problem_id")).scalar().alias("problems"),
        rows.agg(F.round(F.sum("src_runtime"), 4)).scalar().alias("runtime"),
    )


# Two models over all evaluated rows; the second has one answer and left every other row out.
MODELS = ("alpha", "beta+2.5")
_TRIED = f"""SELECT seq, '{MODELS[0]}' AS model, gen, code, accuracy, agg_runtime FROM @gens
UNION ALL SELECT seq, '{MODELS[1]}', gen, code, accuracy, agg_runtime + 1 FROM @gens WHERE gen = 0 AND code IS NOT NULL AND seq % 2 = 0"""
_EVALUATED = f"SELECT r.*, m.model FROM @eval_rows r, (VALUES ('{MODELS[0]}'), ('{MODELS[1]}')) AS m(model) WHERE r.src_code <> r.tgt_code"
_RUN = f"""SELECT r.*, coalesce(g.gen, 0) AS gen, CASE WHEN g.seq IS NULL THEN CAST(0 AS DOUBLE) ELSE g.accuracy END AS accuracy,
  CASE WHEN g.code IS NULL OR g.accuracy < 1 THEN {INFINITE} ELSE g.agg_runtime END AS adjusted_runtime
FROM ({_EVALUATED}) r LEFT JOIN ({_TRIED}) g ON g.seq = r.seq AND g.model = r.model"""
FULL_REPORT = f"""WITH a AS ({_RUN}),
b AS (SELECT *, {floored_sql("src_runtime", "best_runtime")} AS speedup FROM (SELECT model, seq, gen + 1 AS k, src_runtime,
  min(adjusted_runtime) OVER w AS best_runtime, max(accuracy) OVER w AS best_accuracy FROM a
  WINDOW w AS (PARTITION BY model, seq ORDER BY gen ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) x),
n AS (SELECT model, seq, max(k) AS last FROM b GROUP BY model, seq),
ks AS (SELECT model, unnest(generate_series(1, max(k))) AS k FROM b GROUP BY model),
p AS (SELECT b.* EXCLUDE (k), ks.k FROM n JOIN ks ON ks.model = n.model JOIN b ON b.model = n.model AND b.seq = n.seq AND b.k = least(n.last, ks.k)),
f AS (SELECT model, problem_id, seq, src_runtime, min(adjusted_runtime) AS fastest FROM a GROUP BY model, problem_id, seq, src_runtime),
s AS (SELECT *, min(fastest) OVER (PARTITION BY model, problem_id) AS problem_runtime FROM f),
s16 AS (SELECT model, avg(CAST(problem_runtime < {INFINITE} AS INTEGER)) AS solved, avg({floored_sql("src_runtime", "problem_runtime")}) AS problem_speedup FROM s GROUP BY model),
s15 AS (SELECT model, avg(src_runtime / tgt_runtime) AS reference_speedup FROM ({_EVALUATED}) e GROUP BY model)
SELECT p.model, CAST(p.k AS BIGINT) AS k, count(*) AS programs, round(avg(best_accuracy), 6) AS mean_accuracy,
  round(avg(CAST(best_accuracy = 1 AS INTEGER)), 6) AS mean_correct, round(avg(speedup), 6) AS mean_speedup, {share_sql("speedup")},
  round(min(s15.reference_speedup), 6) AS reference_speedup, round(min(s16.solved), 6) AS solved, round(min(s16.problem_speedup), 6) AS problem_speedup
FROM p JOIN s15 ON s15.model = p.model JOIN s16 ON s16.model = p.model GROUP BY p.model, p.k"""


@query("e_full_report", FULL_REPORT)
def _(v):
    folder = scratch_path(v.spark, "evaluation")
    # Numbered and written once: outputs, measurements and the report's rows are made of them.
    gens = materialized(v("gens"), "generations")
    columns = ["seq", "model", "gen", "code", "accuracy", "agg_runtime"]
    single = gens.filter("gen = 0 AND code IS NOT NULL AND seq % 2 = 0").withColumn("agg_runtime", F.col("agg_runtime") + 1)
    tried = reduce(DataFrame.union, [part.withColumn("model", F.lit(name)).select(columns) for name, part in zip(MODELS, (gens, single))])
    for name in MODELS:
        codes = F.transform(F.sort_array(F.collect_list(F.struct("gen", "code"))), lambda g: g["code"])
        answers = tried.filter(F.col("model") == name).groupBy("seq").agg(codes.alias(name))
        answers.write.json(f"{folder}/outputs/{name}.jsonl", compression="gzip")
    outputs = files.read_model_outputs(v.spark, f"{folder}/outputs", "seq bigint")
    reference = v("eval_rows").withColumn("model", F.explode(F.array(*[F.lit(name) for name in MODELS])))
    measured = with_test_times(tried.drop("code"))
    summary = rounded(report.full_report(outputs, reference, measured).withColumn("k", F.col("k").cast("bigint")), ("model", "k", "programs"))
    files.write_report(summary, measured.select("model", "seq", "gen", "tc2time"), f"{folder}/report", "gzip")
    return v.spark.read.schema(summary.schema).csv(f"{folder}/report/summary", header=True)


@query("s_read_stats_files", f"SELECT key, CAST(pos AS BIGINT) AS pos, count(*) AS files, round(sum(value), 4) AS total FROM ({STATS_VALUES}) v GROUP BY key, pos")
def _(v):
    folder = scratch_path(v.spark, "stats")
    # A dump per priority: repeated keys in one file, of which the last line counts, so the key carries the order's id.
    lines = v("stats_text").select("file", F.explode(F.split("content", "\n")).alias("line"))
    keyed = F.when(F.col("line").rlike(r"^[a-z]"), F.concat("file", F.lit(":"), "line")).otherwise(F.col("line"))
    lines.select(keyed).write.text(folder)
    values = measurements.parse_stats_lines(files.read_stats_files(v.spark, folder))
    plain = values.withColumn("key", F.substring_index("key", ":", -1))
    return plain.groupBy("key", F.col("pos").cast("bigint").alias("pos")).agg(
        F.count("*").alias("files"), F.round(F.sum("value"), 4).alias("total")
    )
