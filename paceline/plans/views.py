"""Input views over the given tables, in SQL that Spark and DuckDB both run.

A name after `@` is another view or a given table. `@array`, `@series` and `@size` are the few
functions the two engines name differently.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession

from paceline.functions.text import CATEGORY_NAMES
from paceline.session import apply_settings, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# Tables of long texts and their unique keys.
TEXT_KEYS = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}

SPARK_NAMES = {"array": "array", "series": "sequence", "size": "size"}
DUCKDB_NAMES = {"array": "list_value", "series": "generate_series", "size": "len"}

VIEWS: dict[str, str] = {
    # One submission per order; a user is a customer with a few submissions per problem.
    "subs": """
SELECT o_orderkey AS seq, 's' || CAST(o_orderkey AS STRING) AS solution_id,
  'p' || CAST((o_custkey + o_orderkey % 3) % 41 AS STRING) AS problem_id,
  'u' || CAST(o_custkey AS STRING) AS user_id,
  o_totalprice / CAST(1000 AS DOUBLE) AS runtime,
  '  int main(){ /* ' || o_orderpriority || chr(10) || ' */ // ' || o_orderstatus || chr(10) || 'return '
    || CAST(o_orderkey AS STRING) || '; }' || chr(10) AS code
FROM @orders""",
    # Each submission with the next faster one of its user's.
    "raw_pairs": """
SELECT * FROM (
  SELECT seq, solution_id AS src_id, lag(solution_id) OVER w AS tgt_id, problem_id,
    runtime AS src_agg_runtime, lag(runtime) OVER w AS tgt_agg_runtime, code AS src_code, lag(code) OVER w AS tgt_code
  FROM @subs WINDOW w AS (PARTITION BY problem_id, user_id ORDER BY runtime, seq)) p
WHERE tgt_id IS NOT NULL""",
    "ranked_subs": """
SELECT *, row_number() OVER (PARTITION BY problem_id, user_id ORDER BY runtime, seq) AS rk FROM @subs""",
    # Neighbours, and each submission with its user's fastest.
    "known_pairs": """
SELECT problem_id || '-' || src_id || '-' || tgt_id AS id, problem_id, src_id, tgt_id, seq FROM (
  SELECT seq, problem_id, src_id, tgt_id FROM @raw_pairs
  UNION SELECT seq, problem_id, src_id, tgt_id FROM @eval_rows WHERE src_id <> tgt_id) k""",
    "test_pairs": """
SELECT p.*, p.tgt_code AS fastest_code,
  @series(1, CAST(floor(p.src_agg_runtime) AS BIGINT) % 30 + 1) AS tests FROM @raw_pairs p""",
    # Orders in progress have no metadata; low priority ones name another problem; finished ones an older row too.
    "metadata_rows": """
SELECT o_orderkey AS seq, 's' || CAST(o_orderkey AS STRING) AS submission_id,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'p999'
    ELSE 'p' || CAST((o_custkey + o_orderkey % 3) % 41 AS STRING) END AS problem_id,
  'u' || CAST(o_custkey AS STRING) AS user_id
FROM @orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT o_orderkey - 1000000000, 's' || CAST(o_orderkey AS STRING), 'p000', 'u000' FROM @orders WHERE o_orderstatus = 'F'""",
    "metadata": """
SELECT m.submission_id, m.problem_id, m.user_id FROM @metadata_rows m
JOIN (SELECT submission_id, max(seq) AS seq FROM @metadata_rows GROUP BY submission_id) l
  ON m.submission_id = l.submission_id AND m.seq = l.seq""",
    # Whole documents as programs with comments and fences.
    "programs": """
SELECT doc_id AS seq, 'p' || CAST(doc_id % 41 AS STRING) AS problem_id,
  'int a; /* ' || text || ' */ int b; // ' || lang || chr(10) || ' return; ' || chr(10) AS src_code,
  CASE WHEN doc_id % 7 = 0 THEN 'int a; /* ' || text || ' */ int b; // ' || lang || chr(10) || ' return; ' || chr(10)
    ELSE 'int b; // ' || text END AS tgt_code
FROM @documents""",
    # Programs that lack one or both sides.
    "odd_programs": """
SELECT seq, problem_id, CASE WHEN seq % 13 = 0 THEN NULL ELSE src_code END AS src_code,
  CASE WHEN seq % 17 = 0 THEN NULL ELSE tgt_code END AS tgt_code FROM @programs""",
    "bullets": """
SELECT doc_id, doc_id % 2 AS run,
  CASE WHEN doc_id % 11 = 0 THEN 'no bullets here ' || text ELSE
  'Intro' || chr(10)
  || '- **[Title ' || CAST(doc_id % 9 AS STRING) || ']**: ' || text || chr(10)
  || '- **[Title ' || CAST(doc_id % 4 AS STRING) || ']**: second ' || lang || chr(10) || 'continued line'
  || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'By following these suggestions, done' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN ' Here is how the student starts' ELSE '' END END AS resp
FROM @documents""",
    "category_resp": """
SELECT doc_id, 'p' || CAST(doc_id % 41 AS STRING) AS problem_id,
  (n_chars % 97 + 11) / CAST(10 AS DOUBLE) AS speedup,
  @array((n_chars % 97 + 11) / CAST(2 AS DOUBLE), CAST(5 AS DOUBLE)) AS cpu_time,
  doc_id % 3 = 0 AS cross_user, doc_id % 4 <> 1 AS is_best,
  'Preamble' || chr(10) || '- **'
  || CASE WHEN doc_id % 5 = 0 THEN 'Loop Efficiency Techniques' WHEN doc_id % 5 < 3 THEN 'Data Structure Selection' ELSE 'Unknown Thing' END
  || '**: ' || text || chr(10) || '- **'
  || CASE WHEN doc_id % 3 = 0 THEN 'Branching Efficiency' WHEN doc_id % 7 = 0 THEN 'Other' ELSE 'Loop Efficiency Techniques' END
  || '**: second' || chr(10) || chr(10) || '[End of Optimization Suggestions]' || chr(10) || '- **Memory Usage and Allocation**: after end' AS resp
FROM @documents""",
    "answers": """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Loop Efficiency Techniques ' || chr(10) || text
  WHEN 1 THEN 'Category: Branching Efficiency or Data Structure Selection. ' || text WHEN 2 THEN 'N/A' ELSE text END AS answer
FROM @documents""",
    "gens": """
SELECT l_orderkey AS seq,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS BIGINT) AS gen,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'g' || CAST(l_partkey AS STRING) END AS code,
  l_extendedprice / CAST(1000 AS DOUBLE) AS agg_runtime,
  CASE WHEN l_returnflag = 'R' THEN l_discount * 5 ELSE CAST(1 AS DOUBLE) END AS accuracy
FROM @lineitem""",
    "test_results": """
SELECT l_orderkey AS seq,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS tc_no,
  l_tax < CAST(0.075 AS DOUBLE) AS success, l_quantity / CAST(100 AS DOUBLE) AS time_s, l_returnflag AS flag
FROM @lineitem""",
    "native_times": """
SELECT seq, tc_no, CASE (seq + tc_no) % 4
  WHEN 0 THEN @array(time_s, time_s + CAST(0.001 AS DOUBLE))
  WHEN 1 THEN @array(time_s, time_s + CAST(0.001 AS DOUBLE), time_s + CAST(0.002 AS DOUBLE))
  WHEN 2 THEN @array(time_s, time_s + CAST(0.003 AS DOUBLE), time_s + CAST(0.002 AS DOUBLE), time_s)
  ELSE CASE WHEN flag = 'R' AND seq % 7 = 0 THEN NULL ELSE @array(time_s, time_s, time_s, time_s, time_s) END END AS times
FROM @test_results""",
    "outputs": """
SELECT seq, tc_no,
  CAST(seq AS STRING) || chr(10) || CAST(time_s AS STRING) || chr(10) || 'end' AS expected,
  CASE WHEN seq % 5 = 0 THEN CAST(seq AS STRING) || chr(10) || CAST(time_s + CAST(0.0005 AS DOUBLE) AS STRING)
       WHEN seq % 5 = 1 THEN CAST(seq + 1 AS STRING) || chr(10) || CAST(time_s AS STRING) || chr(10) || 'end' || chr(10) || 'extra'
       ELSE ' ' || CAST(seq AS STRING) || chr(10) || CAST(time_s AS STRING) || chr(10) || 'end' || chr(10) END AS actual
FROM @test_results""",
    # One statistics file per order, as its whole text.
    "stats_text": """
SELECT 'f' || CAST(o_orderkey AS STRING) AS file,
  '---------- Begin Simulation Statistics ----------' || chr(10)
  || 'sim_ticks   ' || CAST(o_orderkey * 1000 + 7 AS STRING) || '   # Number of ticks' || chr(10)
  || 'sim_freq   1000000   # Ticks per second' || chr(10)
  || 'price   ' || CAST(o_totalprice AS STRING) || chr(10)
  || 'ipc   nan   # undefined' || chr(10)
  || 'dist   1   50%   2   50%   # histogram' || chr(10)
  || 'orphan' || chr(10) || chr(10)
  || '---------- End Simulation Statistics   ----------' AS content
FROM @orders""",
    "completions": """
SELECT conv_id AS batch_id, conv_id * 1000000 + turn AS seq, text, role,
  CASE WHEN turn % 3 = 0 THEN '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || '<answer>' || chr(10)
         || 'so ' || chr(92) || 'boxed{' || CAST(conv_id % 6 AS STRING) || '} ' || '```cpp' || chr(10) || 'int a;' || chr(10) || '```' || chr(10)
         || '```cpp' || chr(10) || 'int ' || role || ';' || chr(10) || '```' || chr(10) || '</answer>'
       WHEN turn % 3 = 1 THEN 'Step 1: ' || text || chr(10) || '- First, x' || chr(10) || '[SUGG/] ' || text || ' [/SUGG] tail'
       ELSE text END AS completion,
  CASE WHEN conv_id % 9 = 8 THEN ' ' ELSE CAST(conv_id % 4 AS STRING) END AS gold, turn % 2 = 0 AS is_correct
FROM @conversations""",
    "optimizer_results": """
SELECT seq AS completion_id, gen AS optimizer, CAST(60 AS DOUBLE) AS src_runtime,
  CASE WHEN code IS NULL THEN CAST('Infinity' AS DOUBLE) ELSE agg_runtime END AS tgt_runtime, accuracy AS tgt_acc
FROM @gens""",
    # The evaluated rows: a submission as source, its user's fastest program as reference.
    "eval_rows": """
SELECT seq, problem_id, solution_id AS src_id, first_value(solution_id) OVER w AS tgt_id, code AS src_code,
  first_value(code) OVER w AS tgt_code, runtime AS src_runtime, first_value(runtime) OVER w AS tgt_runtime
FROM @subs WINDOW w AS (PARTITION BY problem_id, user_id ORDER BY runtime, seq)""",
    # Of each evaluated row: a pair whose glued programs agree with another's, a true copy of it, and one that lacks a program.
    "twin_rows": """
SELECT seq * 4 AS seq, problem_id, src_id, tgt_id, src_code || 'x' AS src_code, tgt_code, src_runtime, tgt_runtime FROM @eval_rows
UNION ALL SELECT seq * 4 + 1, problem_id, src_id, tgt_id, src_code, 'x' || tgt_code, src_runtime, tgt_runtime FROM @eval_rows
UNION ALL SELECT seq * 4 + 2, problem_id, src_id, tgt_id, src_code || 'x', tgt_code, src_runtime, tgt_runtime FROM @eval_rows
UNION ALL SELECT seq * 4 + 3, problem_id, src_id, tgt_id, NULL, tgt_code, src_runtime, tgt_runtime FROM @eval_rows""",
    "twin_results": """
SELECT seq * 4 + seq % 2 * 2 AS seq, gen, code, agg_runtime, accuracy FROM @gens""",
    "untimed_results": """
SELECT seq, tc_no, success, CASE WHEN (seq + tc_no) % 11 = 0 THEN NULL ELSE time_s END AS time_s FROM @test_results""",
    "eval_results": """
SELECT r.*, g.gen, g.code, g.agg_runtime, g.accuracy FROM @eval_rows r JOIN @gens g ON r.seq = g.seq""",
    "baselines": """
SELECT seq, CASE WHEN gen % 4 = 3 THEN NULL ELSE accuracy END AS accuracy, agg_runtime, gen FROM @gens""",
    "measured": """
SELECT seq, gen, accuracy, agg_runtime + 1 AS agg_runtime, code IS NOT NULL AS compilation FROM @gens""",
    "categories": "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{name}')" for i, name in enumerate(CATEGORY_NAMES))
    + ") AS c(ord, name)",
}

_REFERENCE = re.compile(r"@(\w+)")


def _needed(name: str, seen: list[str], saved: Collection[str]) -> None:
    """Append `name` and the views it reads to `seen`, readers last; not those that are saved."""
    if name in seen or name in saved or name not in VIEWS:
        return
    for inner in _REFERENCE.findall(VIEWS[name]):
        _needed(inner, seen, saved)
    seen.append(name)


def _with_views(body: str, names: dict[str, str], table: Callable[[str], str] = str, saved: Collection[str] = ()) -> str:
    needed: list[str] = []
    for name in _REFERENCE.findall(body):
        _needed(name, needed, saved)

    def word(match: re.Match) -> str:
        name = match.group(1)
        return table(name) if name in TABLES or name in saved else names.get(name, name)

    def spell(text: str) -> str:
        return _REFERENCE.sub(word, text)

    views = ",\n".join(f"{name} AS ({spell(VIEWS[name])}\n)" for name in needed)
    body = spell(body).strip()
    if not views:
        return body
    # A body with common table expressions of its own continues the list.
    return f"WITH {views},\n{body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views}\n{body}"


def oracle(body: str) -> str:
    """DuckDB text of a query over views."""
    return _with_views(body, DUCKDB_NAMES)


class Inputs:
    """The views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = apply_settings(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._tables: dict[str, str] = {}
        self._saved: set[str] = set()

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._registered(name))

    def _registered(self, name: str) -> str:
        """The temporary view of a table; tables whose text is worked on are spread over the cores."""
        if name not in self._tables:
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if name in TEXT_KEYS:
                frame = spread(frame, TEXT_KEYS[name])
            self._tables[name] = f"paceline_{name}"
            frame.createOrReplaceTempView(self._tables[name])
        return self._tables[name]

    def save(self, name: str, save: Callable[[Callable[[], DataFrame]], DataFrame]) -> None:
        """From here on a view is read from where `save` has written its rows, also by the views over it."""
        saved = save(lambda: self(name))
        self._tables[name] = f"paceline_{name}"
        saved.createOrReplaceTempView(self._tables[name])
        self._saved.add(name)

    def sql(self, body: str) -> DataFrame:
        return self.spark.sql(_with_views(body, SPARK_NAMES, self._registered, self._saved))

    def __call__(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM @{name}")
