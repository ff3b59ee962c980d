"""Daily bars of an event stream: watermarked windows, for panels that grow while they are used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    """Events of a folder of Parquet files, as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def daily_bars(events: DataFrame, late: str = "1 day", key: str = "user_id", value: str = "value", ts: str = "ts") -> DataFrame:
    """date, asset, raw_open, raw_high, raw_low, raw_close, volume by day and key; works on a stream and on a table.

    Open and close go by event time. State of a day is dropped once the watermark has passed it.
    """
    at = F.col(ts).cast("timestamp")
    rows = events.withColumn("_at", at)
    if events.isStreaming:
        rows = rows.withWatermark("_at", late)
    bars = rows.groupBy(F.window("_at", "1 day").alias("_w"), F.col(key).cast("string").alias("asset")).agg(
        F.min_by(value, F.struct("_at", value)).alias("raw_open"), F.max(value).alias("raw_high"), F.min(value).alias("raw_low"),
        F.max_by(value, F.struct("_at", value)).alias("raw_close"), F.count("*").alias("volume"),
    )
    return bars.select(F.col("_w.start").cast("date").alias("date"), "asset", "raw_open", "raw_high", "raw_low", "raw_close", "volume")
