"""A product feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.nested import flatten_payloads


def read_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(folder)


def once(feed: DataFrame, key: str = "record_id", at: str = "received_at", late: str = "1 day") -> DataFrame:
    """Each record once, however often it comes, as long as it isn't later than ``late``; state is kept no longer."""
    return feed.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def children(feed: DataFrame) -> DataFrame:
    """The flat rows of the payloads as they come: no state, the same rows as the batch operator's."""
    return flatten_payloads(feed)


def arrivals(feed: DataFrame, at: str = "received_at", by: str = "feed", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Records of each feed in windows of event time, a window once the watermark has passed it."""
    return feed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("records")).select("w.start", "w.end", by, "records")
