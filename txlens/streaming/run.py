"""Reading tables as streams and draining a stream into a table of the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from txlens.session import new_dir

#: The state store that keeps maps entry by entry and knows timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 64) -> DataFrame:
    """One table, a file or a folder of part files, as a stream; later files are picked up by a running query.

    A path that does not exist is an error.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drain(stream: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run an append query over everything available, through the file sink with its checkpoint, and read the table."""
    spark = stream.sparkSession
    out, ckpt = new_dir(spark, f"{name}-out"), new_dir(spark, f"{name}-ckpt")
    w = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, step: Callable[[DataFrame, int], None]) -> None:
    """Run `step` on every micro-batch of everything available."""
    ckpt = new_dir(stream.sparkSession, f"{name}-ckpt")
    stream.writeStream.foreachBatch(step).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in `STORE`; the session's own setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drain_by_batch(stream: DataFrame, name: str, change: Callable[[DataFrame, int], DataFrame] | None = None, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run over everything available; each batch replaces a folder of its own number, so a repeated batch changes nothing.

    A later run with the same checkpoint and folder goes on where this one stopped.
    """
    spark = stream.sparkSession
    out, checkpoint = out or new_dir(spark, f"{name}-out"), checkpoint or new_dir(spark, f"{name}-ckpt")

    def write(batch: DataFrame, number: int) -> None:
        (change(batch, number) if change else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    with keyed_state(spark):
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


def state_rows(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """Entries of one state variable as they stand in a checkpoint, for audits of its size."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
