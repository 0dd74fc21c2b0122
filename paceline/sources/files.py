"""Record files, metadata, statements, model outputs and reports."""

from __future__ import annotations

import csv
import hashlib
import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from paceline.functions.text import listed
from paceline.session import delete_entries, first_line, mounted_path, path_exists, read_mark, setting, write_mark


def _decoded(name: Column) -> Column:
    """Percent escapes of a file name decoded; a plus sign stands for itself."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def read_records(spark: SparkSession, path: str, schema: StructType | str, lines: bool = True) -> DataFrame:
    """JSON lines (splittable), or with `lines=False` one JSON document per file; malformed text is an error."""
    return spark.read.schema(schema).json(path, multiLine=not lines, mode="FAILFAST")


def write_records(df: DataFrame, path: str, cleaned: bool = False, mode: str = "errorifexists") -> str:
    """JSON lines; `cleaned` puts `_cleaned` before the extension. Returns the path written."""
    if cleaned:
        base, dot, ext = path.rpartition(".")
        path = f"{base}_cleaned.{ext}" if dot and "/" not in ext else f"{path}_cleaned"
    df.write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def _named_in_path(pattern: str) -> Column:
    """What `pattern` finds in the last two parts of a row's file path, which are all that it may reach; decoded.

    A regular expression over a whole path tries every place of every folder, and it runs once a row.
    """
    return _decoded(F.regexp_extract(F.substring_index("_metadata.file_path", "/", -2), pattern, 1))


def _line_order() -> Column:
    """Reading order over files: name, then split offset, then row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def files_by_header(spark: SparkSession, path: str, threads: int = 16) -> dict[tuple[str, ...], list[str]]:
    """The CSV files under a glob by the names in their first line; empty files are left out.

    Only first lines are read, here on the driver as the listing of the files is; as many at once as `threads`.
    """
    # The listing of a text scan: hidden files and folders are treated as in any other scan.
    paths = sorted(spark.read.text(path).inputFiles())
    with ThreadPool(threads) as pool:
        lines = pool.map(lambda name: first_line(spark, unquote(name)), paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for name, line in zip(paths, lines):
        if line:
            groups.setdefault(tuple(next(csv.reader([line]))), []).append(unquote(name))
    return groups


def read_csv_by_name(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns, as text, of all CSV files under a glob, each read by its own header; `_order` is the reading order.

    Files with one header are one scan, which reads the wanted columns only. A file that lacks one is an error.
    """
    parts = []
    for header, names in files_by_header(spark, path).items():
        if missing := [c for c in columns if c not in header]:
            raise ValueError(f"no column {', '.join(missing)} in {names[0]}")
        # Names that repeat, which the file may have beside the wanted ones, get their place added.
        schema = StructType([StructField(c if header.index(c) == i else f"{c}_{i}", StringType()) for i, c in enumerate(header)])
        scan = spark.read.schema(schema).option("header", True).csv([_escaped(name) for name in names])
        parts.append(scan.select(*[F.col(f"`{c}`") for c in columns], _line_order().alias("_order")))
    if not parts:
        order = "struct<file: string, block: bigint, row: bigint>"
        return spark.createDataFrame([], ", ".join([*(f"`{c}` string" for c in columns), f"_order {order}"]))
    return reduce(DataFrame.union, parts)


def _escaped(path: str) -> str:
    """A file's own name, in which signs of a glob stand for themselves."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def read_submission_metadata(spark: SparkSession, path: str) -> DataFrame:
    """S3: the three wanted columns of all CSV files, rows with a gap skipped, the last row of an id wins.

    Each file goes by its own header, so files may have other columns, or the same in another order. The winner is a
    grouped maximum with partial aggregation, so repeats of one id collapse before the shuffle.
    """
    names = ["submission_id", "problem_id", "user_id"]
    return (
        read_csv_by_name(spark, path, names)
        .dropna(subset=names)
        .groupBy("submission_id")
        .agg(F.max(F.struct("_order", "problem_id", "user_id")).alias("_last"))
        .select("submission_id", "_last.problem_id", "_last.user_id")
    )


def write_named_texts(df: DataFrame, name: str, text: str, folder: str) -> None:
    """A compressed text file for each value of `name`, a line per row; the folders in `folder` hold them, named `<name>=…`.

    Rows are dealt by name to at least as many tasks as there are cores. On a mounted folder the tasks make the files
    themselves, `<name>=<value>.gz` behind the task's number in a folder for each task, and under a hidden name until whole:
    Hadoop's local file system starts a process for the permissions of each file and folder, and a folder for each name
    takes as much disk as a short text. Elsewhere Spark's writer by partitions makes them, a folder `<name>=<value>` each.
    """
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # No name and an empty one are the same to a writer by partitions.
    dealt = df.select(F.when(F.col(name) != "", F.col(name)).alias(name), text).repartition(tasks, name)
    place = mounted_path(spark, folder)
    if place is None:
        # Put in place by the tasks instead of one by one at the end.
        dealt.write.partitionBy(name).option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder, compression="gzip")
        return
    if path_exists(spark, folder):
        raise ValueError(f"{folder} is there already")
    rows = dealt.select(F.col(name).cast("string"), F.col(text).cast("binary")).sortWithinPartitions(name)
    # Texts may be long, so few of them are in a batch.
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", 256):
        rows.mapInArrow(_text_writer(place, name), "files bigint").agg(F.sum("files")).collect()


def _text_writer(place: str, name: str) -> Callable:
    # Inside a function, so that it travels to the workers whole, not by module name.
    def write(batches):
        import gzip
        import os
        import re
        from itertools import groupby

        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get()
        folder = os.path.join(place, f"{name}={task.partitionId():05d}")
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
        files = 0
        for value, same in groupby(rows, lambda row: row[0]):
            # The names that Spark gives to folders of partitions.
            escaped = re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda sign: f"%{ord(sign[0]):02X}", value) if value is not None else "__HIVE_DEFAULT_PARTITION__"
            # A task that runs again writes the same names.
            part = f"part-{task.partitionId():05d}-{name}={escaped}.gz"
            os.makedirs(folder, exist_ok=True)
            hidden = os.path.join(folder, f".writing-{task.taskAttemptId()}")
            with gzip.open(hidden, "wb", 6) as file:
                for _, text in same:
                    file.write((text or b"") + b"\n")
            os.replace(hidden, os.path.join(folder, part))
            files += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    return write


# Tasks that list or read files of statements, for each core.
STATEMENT_TASKS_PER_CORE = 16


def read_problem_statements(spark: SparkSession, path: str) -> DataFrame:
    """(problem_id, instruction) of the `{problem}.html` files, compressed or not, under a glob or in the folders it finds.

    Spark lists what the glob finds in up to 10,000 tasks and reads at most 32 small files in one, so most tasks take longer
    to start than to work, and each leaves files of its own where a shuffle follows; here there are a few for each core.
    """
    name = _named_in_path(r"([^/=]+)\.html(?:\.gz)?(?:/[^/]*)?$")
    key, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", STATEMENT_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    # The read lists.
    with setting(spark, key, min(int(spark.conf.get(key)), tasks)):
        texts = spark.read.text(path, wholetext=True)
    return texts.select(name.alias("problem_id"), F.col("value").alias("instruction")).coalesce(tasks)


def attach_statements(problems: DataFrame, statements: DataFrame) -> DataFrame:
    """Statements onto problems, empty where there is none.

    Statements that no problem asks for leave first: where problems are few, without being dealt.
    """
    wanted = statements.join(problems.select("problem_id"), "problem_id", "left_semi")
    joined = problems.join(wanted, "problem_id", "left")
    return joined.withColumn("instruction", F.coalesce("instruction", F.lit("")))


def missing_statements(problems: DataFrame, statements: DataFrame) -> DataFrame:
    """Problems without a statement file."""
    return problems.select("problem_id").distinct().join(statements.select("problem_id"), "problem_id", "left_anti")


def load_registered_dataset(
    spark: SparkSession, registry: Mapping[str, Mapping], name: str, base: str, schema: StructType | str
) -> DataFrame:
    """A dataset by its registry entry: `file_name`, and `columns` of new name → name in the file."""
    entry = registry[name]
    records = read_records(spark, f"{base.rstrip('/')}/{entry['file_name']}", schema)
    return records.withColumnsRenamed({old: new for new, old in entry["columns"].items()})


def _mark(path: str, fingerprint: str) -> str:
    return f"{path}/_published-{hashlib.sha256(fingerprint.encode()).hexdigest()[:32]}"


def _published(spark: SparkSession, path: str, fingerprint: str, write: Callable[[str], str | None]) -> str:
    """The folder under `path` that holds the result of this fingerprint; written first where there is none.

    `write` is given a folder's name; one that writes to another returns that one's.
    """
    mark = _mark(path, fingerprint)
    version = read_mark(spark, mark)
    if version is None:
        own = f"version-{uuid.uuid4().hex}"
        version = write_mark(spark, mark, write(own) or own)
    return version


def materialize_once(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], fingerprint: str = "", folders: Sequence[str] = ()
) -> DataFrame:
    """The saved result of this `fingerprint` if there is one, else compute and save it; cuts lineage on shared storage.

    `fingerprint` names what the result is made of: inputs, parameters, code. A build writes a folder of its own and then
    publishes it through a small file, one for each fingerprint, that is put in place in one step and never changed. A
    build that has failed, or is still running, is therefore never read; of two that run at once the first to publish
    wins, and both return its rows. Readers of another result keep it until `drop_old_versions`. Rows are in a folder for
    each value of `folders`, so that a filter on these reads no other.
    """
    version = _published(spark, path, fingerprint, lambda own: build().write.partitionBy(*folders).parquet(f"{path}/{own}"))
    return spark.read.parquet(f"{path}/{version}")


# Rows of one bucket, which one task sorts, on average at most.
BUCKET_ROWS = 1 << 21


def bucketed_once(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    key: Sequence[str],
    buckets: int,
    fingerprint: str = "",
    bucket_rows: int = BUCKET_ROWS,
    dealt: bool = False,
) -> DataFrame:
    """S6 in buckets: like `materialize_once`, one sorted file for each hash bucket of `key`.

    There are `buckets` of them, doubled until a bucket has at most `bucket_rows` rows on average, so that what a task
    sorts does not grow with the table. The rows are counted for that before they are written. `dealt` is for a
    build that ends in a shuffle by the key's values, for a window say, under whatever name: as its shuffles have as many
    partitions as there are buckets, its rows are in buckets already and are not dealt again.

    Results with the same key and number of buckets meet in joins, and are grouped by the key, without a shuffle or a
    sort; that pays where a result is read more than once. The rows of one key value are in one file.
    """

    def written(own: str) -> str:
        rows, number = build(), buckets
        size = rows.count()
        while size > number * bucket_rows:
            number *= 2
        # Readers know the number by the folder's name.
        own = f"{own}-{number}"
        name = f"building_{own.replace('-', '_')}"
        with setting(spark, "spark.sql.shuffle.partitions", number):
            # Dealt like the buckets, each task writes one file.
            placed = rows if dealt else rows.repartition(number, *key)
            placed.write.bucketBy(number, *key).sortBy(*key).option("path", f"{path}/{own}").saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")  # the table is external: its files stay
        return own

    version = _published(spark, path, f"{fingerprint} in {buckets} buckets of {', '.join(key)}", written)
    name, place = f"saved_{version.replace('-', '_')}", f"{path}/{version}"
    number = int(version.split("-")[2]) if version.count("-") == 2 else buckets
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema)
        names = ", ".join(f"`{c}`" for c in key)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({names}) SORTED BY ({names}) INTO {number} BUCKETS LOCATION '{place}'")
    # One file per bucket is what makes its order that of the bucket.
    return spark.table(name)


def drop_old_versions(spark: SparkSession, path: str, fingerprint: str = "") -> list[str]:
    """Delete all that was saved under `path` but the result of this fingerprint; for a time when no build runs."""
    mark = _mark(path, fingerprint)
    current = read_mark(spark, mark)
    stale = delete_entries(spark, path, lambda name: name.startswith("_published-") and name != mark.rpartition("/")[2])
    return stale + delete_entries(spark, path, lambda name: name.startswith("version-") and name != current)


# A model's name in the path of its file, which may be a folder that a writer has made.
MODEL_FILE = r"([^/]+)\.jsonl(?:/[^/]*)?$"


def read_model_outputs(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All `*.jsonl` of a folder with the file stem as `model`.

    The response and the code sit under keys named after the model (`<model>_resp`, `<model>`) and come out as `responses`
    and `codes`; a single one is wrapped. The models are known from the listing, so a line is parsed once, for the columns
    of `schema` and the keys of all models. A malformed line is an error.
    """
    lines = spark.read.text(f"{folder.rstrip('/')}/*.jsonl")
    models = sorted({unquote(re.search(MODEL_FILE, name)[1]) for name in lines.inputFiles()})
    fields = list(StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    keys = {key: StructField(key, StringType()) for model in models for key in (f"{model}_resp", model)}
    own = {field.name: field for field in fields}
    every = [*fields, *(field for key, field in keys.items() if key not in own)]
    # By place, names with dots or such as differ by case only are as good as others.
    placed = StructType([StructField(f"f{i}", field.dataType) for i, field in enumerate(every)])
    place = {field.name: f"f{i}" for i, field in enumerate(every)}
    record = F.from_json("value", StructType(every), {"mode": "FAILFAST"}).cast(placed)

    def under(ending: str) -> Column:
        """The text under the key of the row's own model; null for a file of a model that came after the listing."""
        found = F.lit(None).cast("string")
        for model in models:
            key = model + ending
            value = F.col("_record")[place[key]]
            if key in own:
                value = F.to_json(value) if isinstance(own[key].dataType, (ArrayType, MapType, StructType)) else value.cast("string")
            found = F.when(F.col("model") == model, value).otherwise(found)
        return found

    model = _named_in_path(MODEL_FILE)
    parsed = lines.select(model.alias("model"), record.alias("_record"))
    texts = parsed.select("model", *[F.col("_record")[place[f.name]].alias(f.name) for f in fields], under("_resp").alias("_responses"), under("").alias("_codes"))
    return texts.select("model", *[F.col(f"`{f.name}`") for f in fields], listed(F.col("_responses")).alias("responses"), listed(F.col("_codes")).alias("codes"))


def model_of_key(key: Column | str) -> Column:
    """The model name in a `<model>_resp` key."""
    return F.regexp_replace(key, "_resp$", "")


def write_report(summary: DataFrame, rows: DataFrame, path: str, compression: str | None = None) -> None:
    """The aggregate as CSV with a header, the rows as JSON lines, these compressed (`gzip`, say) if asked."""
    summary.write.mode("overwrite").csv(f"{path}/summary", header=True)
    rows.write.mode("overwrite").json(f"{path}/rows", compression=compression)


def read_stats_files(spark: SparkSession, path: str) -> DataFrame:
    """Lines of stats text files as (file, line_no, line) for `parse_stats_lines`; files stay splittable."""
    order = F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), order.alias("line_no"), F.col("value").alias("line")
    )
