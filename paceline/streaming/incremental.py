"""Generation over files as they arrive, restartable at any point."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from paceline.operators.generation import ModelLoader, batch_generate
from paceline.session import has_files, path_exists, read_mark, write_mark

# State lives on local disks with a log in the checkpoint, so neither memory nor a batch's cost grows with the ids seen.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
# The file of a checkpoint that names its folder in the sink.
RUN_MARK = "_run"


@contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """The settings of the state store while a query starts, which copies them; the session keeps its own."""
    before = {key: spark.conf.get(key, None) for key in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def first_rows_of_new_ids(order_col: str) -> StatefulProcessor:
    """A processor with one flag per id: the first row of an id in a micro-batch comes out if no earlier batch had the id."""

    class FirstRows(StatefulProcessor):
        """Local to the function, so that it reaches the workers by value."""

        def init(self, handle) -> None:
            self.asked = handle.getValueState("asked", "asked boolean")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
            if not self.asked.exists():
                self.asked.update((True,))
                # Rows are compared only where their order column is equal, and then by their text.
                yield min(rows, key=lambda row: ((value := row[order_col]) is not None, value if value is not None else 0, repr(row)))

        def handleInitialState(self, key, initialState, timerValues) -> None:
            self.asked.update((True,))

        def close(self) -> None:
            pass

    return FirstRows()


def incremental_generation(
    spark: SparkSession,
    source: str,
    schema: StructType | str,
    sink: str,
    checkpoint: str,
    loader: ModelLoader,
    model: str,
    id_col: str = "id",
    order_col: str = "seq",
    batch: int = 100,
    max_files: int | None = None,
) -> StreamingQuery:
    """Answer the prompts of all new JSON files under `source`, append to `sink`, then stop.

    Which ids were asked is state of the query, keyed by id, so a micro-batch costs what it holds, however large the sink
    has grown. Of an id that repeats within a batch the first row by `order_col` is asked.

    A micro-batch owns the folder `run=<checkpoint's name>/batch_id=<n>` of the sink and overwrites it. A batch that is
    replayed after a failure starts from the state before it and leaves one copy. Where a checkpoint has no batch yet, the
    ids that other runs have answered are read from the sink once, with the first batch, as its initial state.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    run = read_mark(spark, f"{checkpoint}/{RUN_MARK}") or write_mark(spark, f"{checkpoint}/{RUN_MARK}", uuid.uuid4().hex)

    def answer(rows: DataFrame, batch_id: int) -> None:
        batch_generate(rows, loader, model, batch).write.mode("overwrite").parquet(f"{sink}/run={run}/batch_id={batch_id}")

    earlier = None
    if path_exists(spark, sink) and not has_files(spark, f"{checkpoint}/commits"):
        id_type = fields[id_col].dataType.simpleString()
        answered = spark.read.schema(f"{id_col} {id_type}, run string, batch_id bigint").parquet(sink)
        earlier = answered.filter(F.col("run") != run).select(id_col).groupBy(id_col)
    new = reader.json(source).groupBy(id_col).transformWithState(first_rows_of_new_ids(order_col), fields, "append", "none", earlier)
    with state_settings(spark):
        return (
            new.writeStream.foreachBatch(answer)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
