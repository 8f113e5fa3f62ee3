"""Hourly bars from an event stream, late data bounded by a watermark, and an idempotent journal sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.journal import KEY

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly_bars(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """One row for each (symbol, hour), final once the watermark has passed it."""
    rows = events.where("value > 0").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    bars = rows.groupBy(F.col("event_type").alias("symbol"), F.window("at", "1 hour").alias("w")).agg(
        F.min_by("value", F.struct("at", "event_id")).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", F.struct("at", "event_id")).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("hour"), "open", "high", "low", "close", "volume")


def append_forecasts(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: forecasts whose key is in the journal are not written again, so a batch may be replayed."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(list(KEY))
        try:
            known = spark.read.parquet(path).select(*KEY)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known, list(KEY), "left_anti")
        fresh.write.mode("append").parquet(path)

    return write
