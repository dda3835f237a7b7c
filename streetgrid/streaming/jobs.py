"""Structured Streaming jobs; over the same input, ``availableNow`` ends with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.runlog import CELL, latest


def run_to_end(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write what is there to a folder and read it back; the checkpoint beside it lets a stopped job go on."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def read_stream(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{glob}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def latest_runs(stream: DataFrame, path: str) -> DataFrame:
    """Latest run of each cell: each batch is merged into a new version of the table, so a repeated batch changes nothing."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        old = spark.read.parquet(f"{path}/v{number - 1}") if number else None
        both = batch if old is None else old.unionByName(batch.select(*old.columns))
        latest(both, CELL).write.mode("overwrite").parquet(f"{path}/v{number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.parquet(f"{path}/v{last}")


def first_of_each(stream: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """One row for each key; keys older than the watermark's delay are forgotten."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def window_counts(stream: DataFrame, time: str, size: str, delay: str, by: list[str]) -> DataFrame:
    """Rows by tumbling window."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
