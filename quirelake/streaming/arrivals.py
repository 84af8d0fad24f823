"""Arrivals of rows as a stream: a log that only grows, and the current row of each slot kept up to date.

The latest row by date does not depend on the order of arrival, so late rows need no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quirelake.operators.slots import latest_per


def arriving(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 1000) -> DataFrame:
    """Rows of Parquet files as they come to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def log_arrivals(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all that has arrived to a log, exactly once, and ends."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def keep_current(rows: DataFrame, path: str, checkpoint: str, keys: list[str], date: str, tie: list[str]) -> StreamingQuery:
    """Keeps the latest row of each key under path: each batch makes a version of its own from the one before it.

    A version is written in whole and under the batch's number, so a batch that is run again writes the same.
    """
    spark = rows.sparkSession

    def upsert(batch: DataFrame, no: int) -> None:
        before = current(spark, path, no - 1)
        both = batch if before is None else before.unionByName(batch)
        latest_per(both, keys, date, tie).write.mode("overwrite").parquet(f"{path}/v{no:010d}")

    return rows.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame | None:
    """The newest version, or the newest up to a batch; None before the first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    done = [f.getPath().getName() for f in fs.listStatus(at) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    known = sorted(n for n in done if n.startswith("v") and (upto is None or int(n[1:]) <= upto))
    return spark.read.parquet(f"{path}/{known[-1]}") if known else None


def windowed_counts(rows: DataFrame, ts: str, key: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts by window and key, final once the watermark has passed."""
    counts = rows.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")
