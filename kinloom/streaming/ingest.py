"""Ingest of rows that keep arriving: an addition to the batch operators, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_each(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose keys were not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, sum and extremes of each window and key; rows later than the watermark are dropped by Spark."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there now and stops; what is written survives a restart from the checkpoint."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
