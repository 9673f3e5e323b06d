"""Weekly composites of landed event files, as a stream that reads what is there and ends."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.shared import shared_dir

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def weekly_sums(events: DataFrame, late: str | None = None) -> DataFrame:
    """Count and sum of values by week, from Monday, and type. late: how long a week stays open, else for ever."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if late else e
    out = e.groupBy(F.window("at", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").cast("date").alias("week"), "event_type", "n", "total")


def landed(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run_weekly(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Streams the files of path into table, a row for each week, type and batch that changed it; returns the last rows.

    A run with the same table goes on where the one before ended: progress and sums are kept beside it.
    """
    table = table or f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/rows/batch={number:012d}")

    stream = weekly_sums(landed(spark, path)).writeStream.outputMode("update").option("checkpointLocation", f"{table}/progress")
    stream.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    rows = spark.read.schema("week date, event_type string, n bigint, total double, batch bigint").parquet(f"{table}/rows/batch=*")
    return rows.groupBy("week", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last")).select("week", "event_type", "last.n", "last.total")
