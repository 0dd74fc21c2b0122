"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times; the median counts.
Results go to the no-op sink, so that every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from paceline.plans.catalogue import ORACLES, QUERIES
from paceline.session import build_session, drop_scratch

HEADLINES = (
    "c1_collect_unique_solutions",
    "c2_attach_users",
    "c5_flatten_problem_index",
    "c9_clean_test_set",
    "p1_speed_ordered_pairs",
    "p4_cross_user_pairs",
    "p5_fastest_target_pairs",
    "p_full_pairs_with_code",
    "p6_strip_cpp_comments",
    "x1_render_template",
    "t4_strategy_frequency",
    "t8_resolve_category",
    "h7_rarity_score",
    "h9_balanced_round_robin",
    "g3_batch_generate",
    "e12_problem_best",
    "e14_report_at_k",
    "m1_grade_outputs",
    "m5_aggregate_runtime",
    "m6_aggregate_native_timings",
    "m9_parse_stats_files",
    "r7_repetition_penalty_reward",
    "r11_speedup_reward",
    "r13_score_completions",
)


def medians(names, action, runs: int) -> dict[str, float]:
    result = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            action(name)
            taken.append(time.perf_counter() - start)
        result[name] = round(statistics.median(taken[1:]), 3)
    return result


def duckdb_seconds(sf_dir: str, cpus: str, runs: int, names) -> dict[str, float]:
    """The same queries' SQL in DuckDB, for `--duckdb`."""
    import duckdb

    from paceline.plans.views import TABLES

    connection = duckdb.connect(config={"threads": int(cpus)})
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return medians(names, lambda name: connection.execute(ORACLES[name]).to_arrow_table(), runs)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [name for name in sys.argv[1:] if not name.startswith("--")] or list(HEADLINES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__driver__host="127.0.0.1",
        # The tables are one row group each.
        spark__paceline__inputPartitions=cpus,
        # Small shuffles still use every core.
        spark__sql__adaptive__coalescePartitions__minPartitionSize="64k",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> None:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    queries = medians(names, run, runs)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    if "--duckdb" in sys.argv:
        result["duckdb"] = duckdb_seconds(sf_dir, cpus, runs, names)
    drop_scratch(spark)
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
