"""URL filters against a loop over rules; chats against SQL on made-up quotes and on the given table."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from parity import compare, connect

from paceline.llm import chat_formatting, url_filters

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/en/x", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "allow"), ("b.org", "", "block"), ("", "/", "block"), (None, "/", "block")]


def expected(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:n]), rest[n:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"], default=len(rest))]
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_rules_of_odd_urls(spark, ranges):
    urls = [None, "", "example.net/en/", "http://NET", "http://net/", "http://x.net", "http://x.net?q=://", "https://A.Example.NET/en/x?y#z", "https://a.example.net/EN/x", "http://xexample.net/en/"]
    urls += ["http://b.org", "http://c.b.org#f", "http://borg/", "ftp://org/fr/é", "http://.org/fr/", "http://a..net/", "http://a.example.net./en/x", "://net/", "http://u@h.net:80/p", "http://ü.net/\nen"]
    urls += [f"http://h{i % 7}.example.{tld}/{lang}/{i}" for i in range(60) for tld in ("net", "org") for lang in ("en", "fr")] + ["http://hot.example.net/en/1"] * 150
    urls += ["http://example.net/en/" + "x" * 200_000 + "?q", "http://" + "a." * 20_000 + "net/" + "y" * 70_000]
    rows = [(i, u, "own", "v") for i, u in enumerate(urls)]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, rule string, key string")
    got = url_filters.judge_urls(pages, rules, ranges=ranges)
    assert got.columns == ["page_id", "url", "key", "host", "path", "rule", "verdict"]
    wanted = Counter((i, *expected(u, RULES)) for i, u, *_ in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()) == wanted
    assert url_filters.judge_urls(pages.filter("false"), rules, ranges=ranges).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, rules.filter("false"), ranges=ranges).collect()} == {"allow"}


CHATS = [
    (1, 0, "user", "Hello there friend.\nHow are you today?\n\nSecond paragraph here"),
    (1, 1, "assistant", "> Hello there friend.\n> How are you today?\nFine thanks"),
    (1, 2, "user", ">> Hello there friend.\n> Fine thanks\nGood to hear"),
    (1, 3, "assistant", "> second   paragraph HERE\nok"),
    (1, 4, None, "> Good to hear!\n\n> unknown words\nyes"),
    (2, 0, "user", "> Fine thanks\ncross conversation"), (2, 1, "user", None), (2, 1, "user", None), (2, 2, "user", "> ok\n> cross conversation\nmm"),
    (None, 0, "user", "> ok\nnull conv"), (3, None, "user", "> ok\nx"), (3, 5, "user", "ok"), (3, 6, "user", ">ok\n>\n> ok\nsame"),
    (4, 1, "user", "> later\nq"), (4, 2, "user", "later"), (4, 3, "u", ""),
    (5, 0, "user", "long words " * 20_000), (5, 1, "user", "> " + ("long words " * 20_000).strip() + "\nanswer"),
    *[(9, t, "user", f"line {t}" if t == 0 else f"> line {t - 1}\nline {t}") for t in range(20)],
]


def test_quotes_are_linked_and_threads_built(spark):
    frame = spark.createDataFrame(CHATS, "conv_id bigint, turn bigint, role string, text string")
    connection = duckdb.connect()
    connection.register("conversations", frame.toPandas().convert_dtypes())
    got = chat_formatting.format_chats(frame.selectExpr("*", "'x' AS body", "1 AS depth"))
    assert compare(got, connection, chat_formatting.ORACLE) is None
    rows = {(r.conv_id, r.turn): r for r in got.collect()}
    assert (rows[1, 1].parent_turn, rows[1, 2].parent_turn, rows[1, 3].parent_turn, rows[1, 4].parent_turn) == (0, 1, 0, 2)
    assert rows[1, 4].depth == 3 and rows[9, 19].depth == 19 and rows[9, 19].root_turn == 0
    assert rows[1, 2].body == "Good to hear" and rows[2, 0].n_outside == 1 and rows[5, 1].parent_turn == 0
    assert chat_formatting.format_chats(frame.filter("false")).count() == 0


def test_plans_hold_no_python(spark, sf_dir):
    plan = chat_formatting.op2(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("module", [url_filters, chat_formatting])
def test_query_agrees(spark, sf_dir, module):
    run = module.op1 if module is url_filters else module.op2
    assert compare(run(spark, sf_dir), connect(sf_dir), module.ORACLE) is None
