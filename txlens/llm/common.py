"""Reading tables and order keys shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txlens import session

#: Null ids come after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text per bucket.
BUCKET_BYTES = 4 << 20


def buckets_of(rows: DataFrame, column: str = "body", each: int = BUCKET_BYTES) -> int:
    """Buckets that hold what about `each` bytes of a column give, so that one of them fits a task at any size of the table."""
    size = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(partitions(rows.sparkSession), 1 + size // each)


def id_order(column: Column) -> Column:
    """The id as a number that is never null."""
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def crc_of_id(column: Column) -> Column:
    """crc32 of an id written as text; 0 for null."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0).cast("long"))


#: Rows of an Arrow batch of whole texts, and its bytes.
TEXT_ROWS, TEXT_BYTES = 1_000, 2 << 20
#: Rows that a Parquet reader decodes at once.
READ_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Limits the rows and bytes of an Arrow batch: whole texts, or pairs with their sets of shingles, would take tens of
    megabytes, several times per task. Parquet is read in batches of READ_ROWS rows, as the reader holds the texts of a
    batch in one array and doubles it when it grows. The session keeps the limits; they change no result."""
    batch = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(batch)) > READ_ROWS:
        spark.conf.set(batch, str(READ_ROWS))
    for name, most in (("maxRecordsPerBatch", TEXT_ROWS), ("maxBytesPerBatch", TEXT_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))


#: Bytes of an Arrow batch within `byte_batches`.
BATCH_BYTES = 8 << 20


@contextmanager
def byte_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> Iterator[None]:
    """Arrow batches of the steps written inside are bounded by bytes; the session's own setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def step(df: DataFrame, name: str) -> DataFrame:
    """Writes a step to the shared folder, reads it back, and lets Spark drop the shuffle files that made it.

    Spark removes shuffle files when the driver has collected their handles as garbage, which may be long after their
    last use; without this the files of all steps of an operator pile up on the executors' disks.
    """
    written = session.materialise(df, name)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return written


_CACHES: dict[str, dict] = {}


def trim() -> None:
    """Gives memory that numpy and Arrow hold on to back to the machine."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow; a worker that waits for its next task does not keep the memory of this one."""

    def ending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return ending


def worker_cache(name: str) -> dict:
    """What a Python worker remembers for one operator.

    Workers outlive tasks and serve other operators next, so what was remembered for another one goes first.
    """
    if name not in _CACHES:
        if _CACHES:
            _CACHES.clear()
            gc.collect()
            trim()
        _CACHES[name] = {}
    return _CACHES[name]
