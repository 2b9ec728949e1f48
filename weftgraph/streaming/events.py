"""Structured Streaming over an event log: watermarked counts and liveness.

The batch twins in ``operators.ledger`` give the same rows on a finished log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import attach, shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    schema = attach(spark).read.parquet(path).schema
    either = f"{path[:-1]}[{path[-1]}]"  # as a pattern the path may be one file as well as a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(either).withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``day, event_type, n`` by tumbling day; state goes once the watermark has passed the day."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def run_to_table(counts: DataFrame) -> DataFrame:
    """Run to the end of what is there; each batch replaces its own files, later counts win."""
    spark = counts.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = (
        counts.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    keys = [c for c in counts.columns if c != "n"]
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
