"""Incremental runs: changes merged by key in micro-batches, and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from certalog.operators.tables import latest


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def daily_counts(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Events of each day and type; those later than the watermark are lost, which batch recomputation isn't."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").agg(F.count("*").alias("n"))


def latest_state(events: DataFrame, target: str, checkpoint: str):
    """Keep the newest event of each user at target: one version folder a batch, so a batch that runs again gives the same.

    No watermark: late events lose by their time, not by their arrival.
    """
    spark = events.sparkSession

    def upsert(batch: DataFrame, number: int) -> None:
        files = spark._jvm.org.apache.hadoop.fs.Path(target)
        there = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = number - 1
        old = f"{target}/v{before}"
        merged = batch
        if there.exists(spark._jvm.org.apache.hadoop.fs.Path(old)):
            merged = spark.read.parquet(old).unionByName(batch)
        elif number:
            raise FileNotFoundError(f"{old}, the state before batch {number}, is gone")
        newest = latest(merged, ["user_id"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()])
        newest.write.mode("overwrite").parquet(f"{target}/v{number}")
        if number > 1:  # the version before stays, for a batch that runs again
            there.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{number - 2}"), True)

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
