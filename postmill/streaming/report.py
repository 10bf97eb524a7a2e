"""The daily report as a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.operators.report import report


def daily_counts(events: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Purchases as positive and errors as negative marks for each day, with a watermark for late events."""
    when = F.col(at).cast("timestamp").alias("at")
    marks = events.select(when, "event_type").withWatermark("at", late)
    return marks.groupBy(F.window("at", "1 day")).agg(
        F.count(F.when(F.col("event_type") == "error", 1)).alias("negative"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("positive")
    ).select(F.col("window.start").cast("date").alias("date"), "negative", "positive")


def start_daily(events: DataFrame, path: str, checkpoint: str):
    """Write the days each micro-batch changed under its batch number, so that no table of all days stays in memory; ``latest_daily`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return daily_counts(events).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_daily(spark: SparkSession, path: str) -> DataFrame:
    """The counts of each day as of the last batch that changed it."""
    last = F.max_by(F.struct("negative", "positive"), "batch").alias("x")
    return spark.read.parquet(path).groupBy("date").agg(last).select("date", "x.*")


def start_report(posts: DataFrame, path: str, checkpoint: str):
    """Write a report for each micro-batch of labelled posts under its batch number; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        report(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return posts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """A file stream over one table of a folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
