"""Queries of the text (X) and strategy (T) operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from paceline.functions import text
from paceline.operators import strategies
from paceline.plans.registry import query, written_with_counts

TEMPLATE = "Make this program faster.\n\n```cpp\n{{  src_code  }}\n```\n\n**Answer:**\n\n```cpp\n{{  tgt_code  }}\n```"
MARKER = "**Answer:**"


def sql_text(value: str) -> str:
    """A literal both engines read alike."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in value.split("\n"))


STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
RENDERED = f"""replace(replace({sql_text(TEMPLATE)}, '{{{{  src_code  }}}}', src_code), '{{{{  tgt_code  }}}}', tgt_code)"""


@query("x1_render_template", f"SELECT seq, {RENDERED} AS prompt FROM @programs")
def _(v):
    return v("programs").select(
        "seq", text.render_template(TEMPLATE, {"src_code": "src_code", "tgt_code": "tgt_code"}).alias("prompt")
    )


@query(
    "x2_split_at_marker",
    f"""SELECT seq, CASE WHEN strpos(p, '{MARKER}') > 0 THEN substr(p, 1, strpos(p, '{MARKER}') - 1) ELSE p END AS instruction,
  CASE WHEN strpos(p, '{MARKER}') > 0 THEN substr(p, strpos(p, '{MARKER}')) END AS response
FROM (SELECT seq, CASE WHEN seq % 5 = 0 THEN src_code ELSE {RENDERED} END AS p FROM @programs) x""",
)
def _(v):
    rendered = text.render_template(TEMPLATE, {"src_code": "src_code", "tgt_code": "tgt_code"})
    prompts = v("programs").select("seq", F.when(F.col("seq") % 5 == 0, F.col("src_code")).otherwise(rendered).alias("p"))
    return prompts.select(
        "seq",
        text.before_marker("p", MARKER).alias("instruction"),
        text.from_marker("p", MARKER).alias("response"),
    )


FIRST = r"(?s)```(?:cpp)?\n(.*?)\n```"
LAST = r"(?s)```cpp\n(.*?)```"
TRIMMED = r"(?s)```cpp\s*(.*?)```"
TAGGED = r"(?s)\[SUGG/\](.*?)\[/SUGG\]"


@query(
    "x3_extract_first_code_chunk",
    f"""SELECT seq, CASE WHEN regexp_matches(completion, '{FIRST}') THEN regexp_extract(completion, '{FIRST}', 1) END AS code
FROM @completions""",
)
def _(v):
    return v("completions").select("seq", text.extract_first_code_chunk("completion").alias("code"))


@query(
    "x4_extract_last_code",
    f"""SELECT seq, coalesce(regexp_extract_all(completion, '{LAST}', 1)[-1], 'No Code') AS code,
  coalesce(regexp_extract_all(completion, '{LAST}', 1)[-1], '') AS code_or_empty FROM @completions""",
)
def _(v):
    return v("completions").select(
        "seq",
        text.extract_last_code("completion").alias("code"),
        text.extract_last_code("completion", "cpp", "").alias("code_or_empty"),
    )


@query(
    "x5_extract_fenced_trimmed",
    f"""SELECT seq, CASE WHEN regexp_matches(completion, '{TRIMMED}') THEN regexp_extract(completion, '{TRIMMED}', 1)
  ELSE '' END AS code FROM @completions""",
)
def _(v):
    return v("completions").select("seq", text.extract_fenced_trimmed("completion").alias("code"))


@query(
    "x6_extract_tag_block",
    f"""SELECT seq, CASE WHEN regexp_matches(completion, '{TAGGED}')
  THEN {STRIP.format(f"regexp_extract(completion, '{TAGGED}', 1)")} END AS suggestion FROM @completions""",
)
def _(v):
    return v("completions").select("seq", text.extract_tag_block("completion").alias("suggestion"))


@query("x7_truncate_at_stop", "SELECT seq, split_part(completion, '[/SUGG]', 1) AS completion FROM @completions")
def _(v):
    return v("completions").select("seq", text.truncate_at_stop("completion").alias("completion"))


@query(
    "x8_build_messages",
    """SELECT seq, CASE WHEN role = 'user' THEN 2 ELSE 3 END AS messages, 'system: Be brief.|'
  || CASE WHEN role = 'user' THEN '' ELSE 'system: ' || role || '|' END || 'user: ' || completion AS joined FROM @completions""",
)
def _(v):
    row_system = F.when(F.col("role") != "user", F.col("role"))
    return (
        v("completions")
        .withColumn("messages", text.build_messages("completion", row_system, "Be brief."))
        .select(
            "seq",
            F.size("messages").alias("messages"),
            F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "|").alias("joined"),
        )
    )


def _cut_sql(value: str, marker: str) -> str:
    pattern = "(?s)^(.*)" + marker.replace("\n", r"\n")
    return f"CASE WHEN regexp_matches({value}, '{pattern}') THEN regexp_extract({value}, '{pattern}', 1) ELSE {value} END"


_FROM_BULLET = "CASE WHEN strpos(resp, '- **[') > 0 THEN substr(resp, strpos(resp, '- **[')) ELSE '' END"
SECTIONS = f"""SELECT doc_id, run, {_cut_sql("b", text.SECTION_ENDS[1])} AS suggestion FROM (
  SELECT doc_id, run, {_cut_sql("a", text.SECTION_ENDS[0])} AS b FROM (SELECT doc_id, run, {_FROM_BULLET} AS a FROM @bullets) x) y"""
ENTRIES = rf"""SELECT doc_id, run, title, min(pos) AS pos, arg_max(content, pos) AS content FROM (
  SELECT doc_id, run, pos, {STRIP.format("regexp_extract(item, '(?s)^(.*?)\\]\\*\\*: (.+)', 1)")} AS title,
    {STRIP.format("regexp_extract(item, '(?s)^(.*?)\\]\\*\\*: (.+)', 2)")} AS content FROM (
    SELECT doc_id, run, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
      SELECT doc_id, run, string_split(chr(10) || {STRIP.format("suggestion")}, chr(10) || '- **[')[2:] AS items FROM ({SECTIONS}) s) i) j
  WHERE regexp_matches(item, '(?s)^(.*?)\]\*\*: (.+)')) k GROUP BY doc_id, run, title"""


@query("t1_relevant_section", f"SELECT doc_id, suggestion FROM ({SECTIONS}) s")
def _(v):
    return v("bullets").select("doc_id", text.relevant_section("resp").alias("suggestion"))


@query("t2_title_content_map", f"SELECT doc_id, title, content FROM ({ENTRIES}) e")
def _(v):
    sections = v("bullets").select("doc_id", text.relevant_section("resp").alias("suggestion"))
    return sections.select("doc_id", F.explode(text.title_content_map("suggestion")).alias("title", "content"))


@query(
    "t3_clean_responses",
    f"""SELECT s.doc_id, s.suggestion, count(e.title) AS titles, min(e.title) FILTER (WHERE e.place = 1) AS first_title
FROM ({SECTIONS}) s LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place FROM ({ENTRIES}) x) e
  ON e.doc_id = s.doc_id GROUP BY s.doc_id, s.suggestion""",
)
def _(v):
    return strategies.clean_responses(v("bullets")).select(
        "doc_id",
        "suggestion",
        F.size("strategy").cast("bigint").alias("titles"),
        F.get("strategy", F.lit(0))["title"].alias("first_title"),
    )


FREQUENCY = f"""SELECT title AS strategy, count(*) AS frequency,
  arg_min(content, (run * 1000000000 + doc_id) * 1000 + pos) AS suggestion FROM ({ENTRIES}) e GROUP BY title"""


def _frequencies(v):
    cleaned = strategies.clean_responses(v("bullets"))
    return strategies.strategy_frequency(strategies.explode_strategies(cleaned, ["run", "doc_id"]))


@query("t4_strategy_frequency", FREQUENCY)
def _(v):
    return strategies.by_frequency(_frequencies(v)).select("strategy", "frequency", "suggestion")


@query("t5_strategy_totals", f"SELECT CAST(sum(frequency) AS BIGINT) AS strategies, count(*) AS titles FROM ({FREQUENCY}) f")
def _(v):
    return strategies.strategy_totals(_frequencies(v))


def sql_list(names) -> str:
    return ", ".join(f"'{name}'" for name in names)


NAMES = rf"""SELECT doc_id, pos, name FROM (
  SELECT doc_id, unnest(names) AS name, generate_subscripts(names, 1) - 1 AS pos FROM (
    SELECT doc_id, list_filter(regexp_extract_all(split_part(resp, chr(10) || chr(10) || '[End of Optimization Suggestions]', 1),
      '- \*\*(.+?)\*\*:', 1), lambda n: n IN ({sql_list(text.SCORED_CATEGORIES)})) AS names FROM @category_resp) a) b"""


@query("t6_extract_category_names", NAMES)
def _(v):
    names = v("category_resp").select("doc_id", F.posexplode(text.category_names("resp")).alias("pos", "name"))
    return names.withColumn("pos", F.col("pos").cast("bigint"))


CLASSIFY = "Categories:\n{{  category  }}\nStrategy: {{  strategy  }}\nAnswer with one category name."
DEFINITIONS = {name: f"Definition of {name.lower()}." for name in text.CATEGORY_NAMES}
_LISTING = "".join(f"{name}: {definition}\n\n" for name, definition in DEFINITIONS.items())


@query(
    "t7_classification_prompts",
    f"""SELECT strategy, replace(replace({sql_text(CLASSIFY)}, '{{{{  category  }}}}', {sql_text(_LISTING)}),
  '{{{{  strategy  }}}}', strategy || ': ' || suggestion) AS prompt FROM ({FREQUENCY}) f""",
)
def _(v):
    return strategies.classification_prompts(_frequencies(v), CLASSIFY, DEFINITIONS).select("strategy", "prompt")


_LINE = STRIP.format("split_part(answer, chr(10), 1)")
_CONTAINED = " ".join(f"WHEN contains(line, '{name}') THEN '{name}'" for name in text.CATEGORY_NAMES)
CLASSIFIED = f"""SELECT doc_id, answer, CASE WHEN line IN ({sql_list(text.CATEGORY_NAMES)}) THEN line {_CONTAINED} ELSE 'N/A' END AS category
FROM (SELECT doc_id, answer, {_LINE} AS line FROM @answers) a"""


@query("t8_resolve_category", f"SELECT doc_id, category FROM ({CLASSIFIED}) c")
def _(v):
    return strategies.classify(v("answers")).select("doc_id", "category")


@query("t9_unrecognized", f"SELECT doc_id, answer FROM ({CLASSIFIED}) c WHERE category = 'N/A'")
def _(v):
    return strategies.unrecognized(strategies.classify(v("answers"))).select("doc_id", "answer")


@query(
    "t9_unrecognized_rate",
    f"""SELECT count(*) AS strategies, count(*) FILTER (WHERE category = 'N/A') AS unrecognized,
  round(round(count(*) FILTER (WHERE category = 'N/A') / CAST(count(*) AS DOUBLE), 4) * 100, 6) AS unrecognized_pct
FROM ({CLASSIFIED}) c""",
)
def _(v):
    rate = strategies.unrecognized_rate(strategies.classify(v("answers")))
    return rate.withColumn("unrecognized_pct", F.round("unrecognized_pct", 6))


@query(
    "t9_classify_audited",
    f"""SELECT count(*) AS rows_written, count(*) AS strategies, count(*) FILTER (WHERE category = 'N/A') AS unrecognized FROM ({CLASSIFIED}) c""",
)
def _(v):
    return written_with_counts(*strategies.classify_audited(v("answers")), "classified")
