"""Chat formatting: quotation linking, in DataFrame functions only.

Lines that start with `>` are quotes; the number of marks is their level. Runs of quoted lines of one level are
passages. Passages and the unquoted text of messages are normalised and hashed, passages meet the earliest message that
holds them unquoted, and that message becomes what the quoting one replies to.

Keys that many messages share ("ok") are folded to their earliest message before the join, so one side of it is unique
and no pairs of messages arise. Conversations are never gathered: order is a set of sort columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, query, table

MARKS = r"^((?:[ \t]*>)+)"
QUOTED = r"^[ \t]*>"


def normalised(text: Column) -> Column:
    """Lower case, letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines, blanks around it removed."""
    lines = F.filter(F.split(text, "\n"), lambda line: ~line.rlike(QUOTED))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def chat_text(role: Column, body: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), body, F.lit("<|end|>\n"))


def passages(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, first line, level, keys): maximal runs of non-blank quoted lines of one level.

    `keys` holds the hash of the whole passage, then those of its lines.
    """
    lines = messages.filter(F.col("text").rlike(r"(?m)" + QUOTED)).dropDuplicates(["mid"]).select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    marks = F.regexp_extract("line", MARKS, 1)
    content = normalised(F.regexp_replace("line", MARKS, ""))
    lines = lines.filter(marks != "").select("mid", "conv_id", "turn", "at", F.length(F.regexp_replace(marks, r"[^>]", "")).alias("level"), content.alias("content"))
    lines = lines.filter("content <> ''")
    # A window holds the quoted lines of one message.
    of_message = W.partitionBy("mid").orderBy("at")
    starts = (F.lag("at").over(of_message).eqNullSafe(F.col("at") - 1) & F.lag("level").over(of_message).eqNullSafe(F.col("level"))).cast("int")
    runs = lines.withColumn("run", F.sum(1 - starts).over(of_message))
    grouped = runs.groupBy("mid", "conv_id", "turn", "run", "level").agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("at", "content"))).alias("parts"))
    contents = F.transform("parts", lambda part: part["content"])
    return grouped.select("mid", "conv_id", "turn", "at", "level", F.transform(F.concat(F.array(F.array_join(contents, " ")), contents), F.md5).alias("keys"))


def originals(messages: DataFrame) -> DataFrame:
    """(key, conv_id, turn) for the whole unquoted text, its paragraphs and its lines."""
    units = F.concat(F.array("body"), F.split("body", r"\n\s*\n"), F.split("body", "\n"))
    keys = F.array_distinct(F.filter(F.transform(units, normalised), lambda unit: unit != ""))
    return messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.explode(F.transform(keys, F.md5)).alias("key"), "conv_id", "turn")


def linked(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Each passage with the message it quotes, as `link` struct(conv_id, turn), null where none is known.

    The whole passage goes before single lines, an earlier turn of the own conversation before others, and the earliest
    message (conv_id, turn) before later ones; a message outside must come before the quoting one in that order.
    """
    keyed = found.select("mid", "conv_id", "turn", "at", "level", F.posexplode("keys").alias("rank", "key")).withColumn("rank", F.least("rank", F.lit(1)))
    wanted = sources.join(keyed.select("key").distinct(), "key", "left_semi")
    own = wanted.groupBy("key", "conv_id").agg(F.min("turn").alias("own_turn"))
    anywhere = wanted.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    joined = keyed.join(own, ["key", "conv_id"], "left").join(anywhere, "key", "left")
    near = F.when(F.col("own_turn") < F.col("turn"), F.struct(F.col("rank"), F.lit(0).alias("outside"), F.col("conv_id"), F.col("own_turn").alias("turn")))
    earlier = (F.col("first.conv_id") < F.col("conv_id")) | ((F.col("first.conv_id") == F.col("conv_id")) & (F.col("first.turn") < F.col("turn")))
    far = F.when(earlier, F.struct(F.col("rank"), F.lit(1).alias("outside"), F.col("first.conv_id"), F.col("first.turn")))
    best = joined.groupBy("mid", "conv_id", "turn", "at", "level").agg(F.min(F.coalesce(near, far)).alias("best"))
    return best.withColumn("link", F.when(F.col("best").isNotNull(), F.struct(F.col("best.conv_id").alias("conv_id"), F.col("best.turn").alias("turn"))))


def thread_roots(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) from (conv_id, turn, parent_turn), by pointer jumping.

    Parents are earlier turns, so there are no cycles; each round doubles the reach and is written to shared storage.
    """
    state = checkpointed(replies.select("conv_id", "turn", F.col("parent_turn").alias("root_turn"), F.lit(1).cast("bigint").alias("depth")), "threads")
    while True:
        above = state.select("conv_id", F.col("turn").alias("root_turn"), F.col("root_turn").alias("next_root"), F.col("depth").alias("more"))
        jumped = state.join(above, ["conv_id", "root_turn"], "left").select(
            "conv_id", "turn", F.coalesce("next_root", "root_turn").alias("root_turn"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next_root").isNotNull().alias("moved")
        )
        jumped = checkpointed(jumped, "threads")
        if jumped.filter("moved").isEmpty():
            return jumped.drop("moved")
        state = jumped.drop("moved")


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per row of `messages` (conv_id, turn, role, text): its unquoted body, its links and its place.

    `n_quotes` passages, `max_level` (0 without), `n_linked`, `n_outside` (linked to another conversation), `parent_turn`
    (what the first level-1 passage linked inside the conversation quotes), `root_turn` and `depth` (own turn and 0 for a
    message without parent), `chat` (role mark, body, end mark). Sorted by conv_id, root_turn, depth, turn, a message comes
    after what it replies to. Null text is empty, a null role is `unknown`; rows with null conv_id or turn have no links
    and cannot be quoted. Repeated rows get the same result each; rows that share conv_id and turn are one target, and
    the smallest of their parents counts. Whole texts of any length are read; an empty table gives no rows. Other columns
    are not read.
    """
    rows = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = rows.withColumn("body", unquoted(F.col("text"))).withColumn("mid", F.when(known, F.md5(F.to_json(F.struct("conv_id", "turn", "role", "text")))))
    # Few messages quote: their links are narrow, and several steps read them.
    links = checkpointed(linked(passages(rows.filter(known)), originals(rows)), "quote-links")
    inside = F.col("link.conv_id") == F.col("conv_id")
    of_message = links.groupBy("mid").agg(
        F.count("*").alias("n_quotes"), F.max("level").alias("max_level"), F.count("link").alias("n_linked"), F.count(F.when(~inside, 1)).alias("n_outside")
    )
    parents = links.filter((F.col("level") == 1) & inside).groupBy("mid", "conv_id", "turn").agg(F.min(F.struct("at", "link.turn")).alias("first"))
    replies = parents.groupBy("conv_id", "turn").agg(F.min("first.turn").alias("parent_turn"))
    threads = thread_roots(replies).join(replies, ["conv_id", "turn"])
    zero = F.lit(0)
    return rows.join(of_message, "mid", "left").join(threads, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body",
        F.coalesce("n_quotes", zero).alias("n_quotes"), F.coalesce("max_level", zero).alias("max_level"), F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_outside", zero).alias("n_outside"),
        "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", zero).alias("depth"), chat_text(F.col("role"), F.col("body")).alias("chat"),
    )


ORACLE = r"""
WITH RECURSIVE rows_ AS (
    SELECT row_number() OVER () AS rid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations
), line AS (
    SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows_
), part AS (
    SELECT *, regexp_extract(line, '^((?:[ \t]*>)+)', 1) AS marks FROM line
), bodies AS (
    SELECT rid, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE marks = ''), ''), '^\s+|\s+$', '', 'g') AS body FROM part GROUP BY rid
), quoted AS (
    SELECT rid, conv_id, turn, pos, len(replace(replace(marks, ' ', ''), chr(9), '')) AS level,
           trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]*>)+)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS content
    FROM part WHERE marks <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), run AS (
    SELECT *, pos - row_number() OVER (PARTITION BY rid, level ORDER BY pos) AS run FROM quoted WHERE content <> ''
), passage AS (
    SELECT rid, conv_id, turn, level, min(pos) AS pos, [string_agg(content, ' ' ORDER BY pos)] || list(content ORDER BY pos) AS keys FROM run GROUP BY rid, conv_id, turn, level, run
), keyed AS (
    SELECT rid, conv_id, turn, level, pos, unnest(keys) AS key, least(generate_subscripts(keys, 1), 2) AS rank FROM passage
), source AS (
    SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS key
    FROM (SELECT conv_id, turn, unnest([body] || regexp_split_to_array(body, '\n\s*\n') || string_split(body, chr(10))) AS unit FROM rows_ JOIN bodies USING (rid))
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), own AS (
    SELECT conv_id, key, min(turn) AS own_turn FROM source WHERE key <> '' GROUP BY ALL
), anywhere AS (
    SELECT key, min((conv_id, turn)) AS first FROM source WHERE key <> '' GROUP BY key
), link AS (
    SELECT k.rid, k.conv_id, k.turn, k.level, k.pos, min(coalesce(
        CASE WHEN o.own_turn < k.turn THEN (k.rank, 0, k.conv_id, o.own_turn) END,
        CASE WHEN a.first < (k.conv_id, k.turn) THEN (k.rank, 1, a.first[1], a.first[2]) END)) AS best
    FROM keyed k LEFT JOIN own o ON o.conv_id = k.conv_id AND o.key = k.key LEFT JOIN anywhere a ON a.key = k.key
    GROUP BY ALL
), counted AS (
    SELECT rid, count(*) AS n_quotes, max(level) AS max_level, count(best) AS n_linked, count(*) FILTER (WHERE best[3] <> conv_id) AS n_outside,
           min((pos, best[4])) FILTER (WHERE level = 1 AND best[3] = conv_id) AS first
    FROM link GROUP BY rid
), reply AS (
    SELECT conv_id, turn, min(first[2]) AS parent_turn FROM counted JOIN rows_ USING (rid) WHERE first IS NOT NULL GROUP BY ALL
), climb AS (
    SELECT conv_id, turn, parent_turn AS root_turn, 1 AS depth FROM reply
    UNION ALL
    SELECT c.conv_id, c.turn, r.parent_turn, c.depth + 1 FROM climb c JOIN reply r ON r.conv_id = c.conv_id AND r.turn = c.root_turn
), thread AS (
    SELECT conv_id, turn, min(root_turn) AS root_turn, max(depth) AS depth FROM climb GROUP BY ALL
)
SELECT r.conv_id, r.turn, r.role, b.body, coalesce(n_quotes, 0) AS n_quotes, coalesce(max_level, 0) AS max_level, coalesce(n_linked, 0) AS n_linked, coalesce(n_outside, 0) AS n_outside,
       p.parent_turn, coalesce(t.root_turn, r.turn) AS root_turn, coalesce(t.depth, 0) AS depth,
       '<|' || coalesce(r.role, 'unknown') || '|>' || chr(10) || b.body || '<|end|>' || chr(10) AS chat
FROM rows_ r JOIN bodies b USING (rid) LEFT JOIN counted c USING (rid)
LEFT JOIN reply p ON p.conv_id = r.conv_id AND p.turn = r.turn LEFT JOIN thread t ON t.conv_id = r.conv_id AND t.turn = r.turn
"""


@query("op2_chat_formatting", ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
