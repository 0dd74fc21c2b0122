"""Helpers the operators share: tables, checkpoints in shared storage, content keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rows of one Arrow batch that carries whole texts to Python. A batch is what a worker holds at
# once besides its result, so a few hundred texts bound it; Spark's default is 10,000 rows.
TEXT_ROWS = 256


def query(name: str, sql: str | None = None):
    """Register a query of (spark, sf_dir); `sql` is what DuckDB must agree with."""

    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bound the Arrow batches of this session's Python stages by `rows`."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in `spark.checkpoint.dir`; a local folder only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="paceline-llm-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(column: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(column: Column) -> Column:
    """128 bits that stand for a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(column, F.lit(""))))
