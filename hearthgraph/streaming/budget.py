"""Daily budgets of sources as a stream, an addition in the spirit of the batch windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import shared_folder


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """source, day, n: a tumbling window of a day for each source. Events later than `late` are dropped by the watermark."""
    timed = events.select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"))
    g = timed.withWatermark("ts", late).groupBy("source", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("source", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def run_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything there is of the events, read as a stream once; each batch's changed windows are appended to a table in
    the shared folder with the batch's number, and the last state of each window counts."""
    out = f"{shared_folder(spark)}/budget-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{out}/rows")

    q = daily_counts(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").groupBy("source", "day").agg(F.max_by("n", "batch").alias("n"))
