"""URL filters: a sort-merge range join of urls with nested host and path rules.

A host turns into a canonical key, its labels reversed and each closed by a dot ("a.example.net" is
"net.example.a."). Then a host and all its subdomains are the keys with one prefix, that is an interval, and
intervals of different rules are nested or disjoint. Urls and rules are cut into the same key ranges, each range is
sorted once, and a sweep keeps the stack of rules that are open at the current key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paceline.llm.common import lower_ascii, query, table

# (host, path, verdict): fixed values of the query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
ALLOW = "allow"
# Key that lies behind every key of a prefix: keys hold no character above this one.
LAST = "\U0010ffff"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty where there is no `://`."""
    return lower_ascii(_part(url, 1))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end, as written."""
    return _part(url, 2)


def _part(url: Column, group: int) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", group), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reversed order, each closed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _ranges(keys: DataFrame, ranges: int, sample_rows: int) -> list[tuple[str, int]]:
    """Lower ends (key, salt) of key ranges with about as many urls each.

    They only decide where rows are sorted, never what a row gets. `sample_rows` bounds what the driver sees.
    The salt cuts a key that fills several ranges by itself.
    """
    rows = keys.count()
    if rows == 0 or ranges < 2:
        return []
    share = min(1.0, sample_rows / rows)
    picked = keys.sample(False, share, seed=7) if share < 1 else keys
    found = sorted((row[0], row[1]) for row in picked.limit(2 * sample_rows).collect())
    cuts = {found[i * len(found) // ranges] for i in range(1, ranges)} if found else set()
    return sorted(cuts)


def judge_urls(urls: DataFrame, rules: DataFrame, url: str = "url", ranges: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """Each row of `urls` with `host`, `path`, `rule` and `verdict`; a column of these names is replaced.

    `rules` holds host, path, verdict. A rule fits its host and all subdomains where the url's path starts with the
    rule's path. The longest `host + path` wins, then the longer host, then the verdict "block". Without a fitting
    rule the verdict is "allow" and the rule null. Null urls and urls without `://` have an empty host and path and so
    meet no rule. Rules with a null or empty host, a null path or verdict take no part; repeated ones count once.
    Repeated urls are judged each, urls of any length as a whole. An empty table of urls gives no rows, one of rules
    allows all.
    """
    spark = urls.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    # Rows of one url differ in some other column, an id at least; maps cannot be hashed.
    hashed = [f"`{c}`" for c in kept if not urls.schema[c].dataType.simpleString().count("map<") and urls.schema[c].dataType.simpleString() != "variant"]
    rows = urls.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")
    )
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("salt", F.pmod(F.xxhash64(*[F.col(f"row.{c}") for c in hashed]), F.lit(ranges)).cast("int"))
    cuts = _ranges(rows.select("key", "salt"), ranges, sample_rows)

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(cuts, pair) for pair in zip(key, salt)], dtype="int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        spans = [(bisect.bisect_right(cuts, (k, -1)), bisect.bisect_right(cuts, (k + LAST, 0))) for k in key]
        return pd.Series([list(range(lo, hi + 1)) for lo, hi in spans])

    rules = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna().filter("host <> ''").distinct()
    rules = rules.withColumn("key", host_key(F.col("host")))
    # An interval goes to every range it meets: at most as many copies as ranges for each nesting level.
    open_rules = rules.withColumn("part", F.explode(ranges_of("key"))).select(
        "part", "key", F.lit(0).alias("kind"), "host", "path", "verdict", F.lit(None).cast(rows.schema["row"].dataType).alias("row")
    )
    events = rows.select(
        range_of("key", "salt").alias("part"), "key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast("string").alias("verdict"), "row"
    ).unionByName(open_rules)
    # Rules come before urls of their key.
    ordered = events.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "key", "kind")
    schema = T.StructType([rows.schema["row"], *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])
    return ordered.mapInArrow(_sweep, schema).select("row.*", "host", "path", "rule", "verdict")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted events; `stack` holds (key, [rules]) of the rules open at the current key, outermost first."""
    part, stack = None, []
    for batch in batches:
        size = batch.num_rows
        if not size:
            continue
        events = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("part", "key", "kind", "host", "path", "verdict")}
        parts, keys, kinds, paths = events["part"], events["key"], events["kind"], events["path"]
        rule, verdict = np.full(size, None, object), np.full(size, ALLOW, object)
        change = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        for start, end in zip([0, *change], [*change, size]):
            if parts[start] != part:
                part, stack = parts[start], []
            key = keys[start]
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kinds[start] == 0:
                opened = list(zip(events["host"][start:end], paths[start:end], events["verdict"][start:end]))
                if stack and stack[-1][0] == key:
                    stack[-1][1].extend(opened)
                else:
                    stack.append((key, opened))
                continue
            fitting = sorted((r for _, opened in stack for r in opened), key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]))
            for host, path, said in fitting:  # the last that fits is the longest
                hit = start + np.flatnonzero([p.startswith(path) for p in paths[start:end]])
                rule[hit], verdict[hit] = host + path, said
        urls = pa.array(kinds == 1)
        judged = [batch.column("row"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
        yield pa.RecordBatch.from_arrays([c.filter(urls) for c in judged], ["row", "host", "path", "rule", "verdict"])


ORACLE = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(r_host, r_path, r_verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST) AS n
    FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(r_verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""


@query("op1_url_filters", ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules).drop("url")
