"""The catalogue of registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from paceline.plans.views import Inputs, oracle
from paceline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of `Inputs`; `sql` is what DuckDB must agree with, over the same views."""

    def register(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return register


def r6(value: Column | str) -> Column:
    """Six digits, for sums whose order differs between engines."""
    return F.round(value, 6)


def joined(values: Column | str) -> Column:
    """All elements of an array as one text, which both engines write alike; a null one is `null`."""
    return F.array_join(F.col(values).cast("array<string>") if isinstance(values, str) else values.cast("array<string>"), ",", "null")


def written_with_counts(rows: DataFrame, observed: Observation, name: str) -> DataFrame:
    """Write rows, and give how many there are with the counts that were observed on the way."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    counts = {key: F.lit(value).cast("bigint").alias(key) for key, value in observed.get.items()}
    return rows.sparkSession.read.parquet(path).agg(F.count("*").alias("rows_written")).select("*", *counts.values())
