"""What the operators of this subpackage share: the shared folder, written tables and Hadoop files."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Used only where the session names no spark.checkpoint.dir, as in tests on one machine.
LOCAL_SHARED = "file:///tmp/checkpoints"
#: Rows of a batch that goes to a Python worker; documents can be long, and a batch is held in memory.
ARROW_ROWS = "512"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Without a name for it, a cluster has none: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for a path, whatever store it is in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_fs(spark, path)
    fs.delete(at, True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove(spark, path)
        except Exception:  # the JVM is gone: the folder's owner clears it
            pass

    atexit.register(drop)
    return path


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", codec).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers by the number of documents in a batch."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(ARROW_ROWS):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and after it the memory that it held goes back to the system: Python workers serve many tasks."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim:
            trim(0)

    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_columns_of(df: DataFrame, **columns: T.DataType) -> DataFrame:
    """The named columns only, cast; a missing one is null. Extra columns, whatever their names, are left behind."""
    return df.select(*[(F.col(f"`{k}`") if k in df.columns else F.lit(None)).cast(t).alias(k) for k, t in columns.items()])
