"""What the operators share: tables in, scratch tables between stages, Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch at most; a longer row is a batch of its own.
ROWS_PER_BATCH, BYTES_PER_BATCH = 2000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables; from now on the session cuts Arrow batches as the operators want them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_PER_BATCH))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the session names, or one in the warehouse where it names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quern-scratch"


class _Staged(threading.local):
    """Paths of the tables that this thread has staged, so that runs in several threads don't drop each other's."""

    def __init__(self):
        self.paths: list[str] = []


_STAGED = _Staged()


def staged_here() -> list[str]:
    return _STAGED.paths


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table in the shared folder and read back, so that lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/quern-{uuid.uuid4().hex}-{name}"
    drop_at_exit(path)
    df.write.parquet(path)
    staged_here().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_AT_EXIT: set[str] = set()


def drop_at_exit(path: str) -> None:
    """Nothing can read a staged table any more when the process that staged it ends."""
    _AT_EXIT.add(path)


@atexit.register
def _drop_rest() -> None:
    jvm = SparkContext._jvm
    with contextlib.suppress(Exception):  # the JVM may have gone before
        for name in _AT_EXIT if jvm is not None else ():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Deletes staged tables and forgets them; nothing that reads them may be run any more."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        name = paths.pop()
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)
        _AT_EXIT.discard(name)
        if name in staged_here():
            staged_here().remove(name)


def settled(spark: SparkSession) -> None:
    """After a table is staged the shuffles behind it are of no use; Spark removes them with its next collection of garbage, which this asks for."""
    spark.sparkContext._jvm.System.gc()


#: Fixed values of the C library: the options of mallopt() for its trim threshold, its map threshold and its arenas.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD, M_ARENA_MAX = -1, -3, -8
RETURNED_BYTES = 1 << 20


@lru_cache(1)
def lean() -> None:
    """From now on this worker gives arrays of a megabyte and more back to the system when they are freed, instead of keeping them for later ones."""
    try:
        set_option = ctypes.CDLL(None).mallopt
    except (OSError, AttributeError):  # another C library; workers then keep what they had at most
        return
    for option, value in ((M_MMAP_THRESHOLD, RETURNED_BYTES), (M_TRIM_THRESHOLD, RETURNED_BYTES), (M_ARENA_MAX, 2)):
        set_option(option, value)
    pa.set_memory_pool(pa.system_memory_pool())


def by_batch(df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Arrow batches through `step`, which may give any number of batches for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """The column's strings as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
