"""Session settings the operators are written for."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Fixed settings: adaptive execution splits hot join partitions and picks broadcast
# sides from measured sizes, so no operator carries a broadcast hint on table data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Also split a hot join partition where an aggregation on the same key follows: partial
    # aggregates then cross the extra shuffle, and only when a partition is in fact hot.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "paceline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; `extra` keys use `__` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the same on a session somebody else has built; all of them are runtime settings."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """One of the session's settings for a while."""
    before = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame, key: list[str]) -> DataFrame:
    """Deal rows by a unique key over as many partitions as `spark.paceline.inputPartitions` says; as they are where it is unset.

    For test and bench tables that are one row group each; tables of many files need no such shuffle.
    """
    partitions = df.sparkSession.conf.get("spark.paceline.inputPartitions", None)
    return df.repartition(int(partitions), *key) if partitions else df


def scratch_folder(spark: SparkSession) -> str:
    """The folder of this application in the shared folder of `spark.checkpoint.dir`; a local one only where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return os.path.join(base, f"paceline-{spark.sparkContext.applicationId}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's scratch folder."""
    return os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")


def drop_scratch(spark: SparkSession) -> None:
    """Delete all that this application has written to scratch; for the end of a run, when its results are written."""
    file_system, hadoop_path = _located(spark, scratch_folder(spark))
    file_system.delete(hadoop_path, True)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write once to scratch and read back: what follows reads narrow files as often as it likes, and lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str) -> tuple:
    """The file system that `path` names, and the path on it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), hadoop_path


def mounted_path(spark: SparkSession, path: str) -> str | None:
    """`path` as a process opens it, on a file system that is mounted under its name; nothing for any other."""
    file_system, hadoop_path = _located(spark, path)
    return hadoop_path.toUri().getPath() if file_system.getUri().getScheme() == "file" else None


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file exists on whatever file system `path` names."""
    file_system, hadoop_path = _located(spark, path)
    return file_system.exists(hadoop_path)


def has_files(spark: SparkSession, folder: str) -> bool:
    """Whether a folder exists and holds anything but hidden files."""
    file_system, hadoop_path = _located(spark, folder)
    return file_system.exists(hadoop_path) and any(not f.getPath().getName().startswith(".") for f in file_system.listStatus(hadoop_path))


def delete_entries(spark: SparkSession, folder: str, chosen: Callable[[str], bool]) -> list[str]:
    """Delete the files and folders directly in `folder` whose name is chosen; returns their names."""
    file_system, hadoop_path = _located(spark, folder)
    found = [f.getPath() for f in file_system.listStatus(hadoop_path) if chosen(f.getPath().getName())]
    for path in found:
        file_system.delete(path, True)
    return sorted(path.getName() for path in found)


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a text file, compressed or not, without what ends it; empty for an empty file."""
    file_system, hadoop_path = _located(spark, path)
    hadoop = spark._jvm.org.apache.hadoop
    codec = hadoop.io.compress.CompressionCodecFactory(spark._jsparkSession.sessionState().newHadoopConf()).getCodec(hadoop_path)
    stream = file_system.open(hadoop_path)
    try:
        line = hadoop.io.Text()
        hadoop.util.LineReader(codec.createInputStream(stream) if codec else stream).readLine(line)
        return line.toString().removeprefix("\ufeff")
    finally:
        stream.close()


def read_mark(spark: SparkSession, path: str) -> str | None:
    """The text of a small file on whatever file system `path` names; nothing where there is none."""
    file_system, hadoop_path = _located(spark, path)
    if not file_system.exists(hadoop_path):
        return None
    stream = file_system.open(hadoop_path)
    try:
        return stream.readAllBytes().decode()
    finally:
        stream.close()


def write_mark(spark: SparkSession, path: str, text: str) -> str:
    """A small file with `text`, whole or not there at all: written beside and renamed. Returns the text the file has then.

    A file that is there already stays, also when another writer has put it there meanwhile.
    """
    file_system, hadoop_path = _located(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs
    beside = hadoop.Path(hadoop_path.getParent(), f".{hadoop_path.getName()}.{uuid.uuid4().hex}")
    stream = file_system.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        # Unlike a file system's own, this rename fails where the file is there.
        hadoop.FileContext.getFileContext(hadoop_path.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(beside, hadoop_path, options)
    except Py4JJavaError:
        file_system.delete(beside, False)
        found = read_mark(spark, path)
        if found is None:
            raise
        return found
    return text
