"""Continuous job status and activity over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sync


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Each job's last status so far, for update or complete mode; state is one row a job."""
    return events.groupBy(key).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x")).select(key, F.col("x.event_type").alias("status"), F.col("x.ts").alias("ts"))


def activity(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; a window closes once the watermark has passed it, and its state goes."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))  # a watermark takes no timestamp without a time zone
    return timed.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def reconcile_continuously(walks: DataFrame, inventory_path: str, checkpoint: str):
    """Reconcile an inventory with every walk that arrives (rows of rel_path, file_hash and stat columns).

    Each micro-batch is one walk: it is joined with the inventory as it was, and the new
    one is written under the batch's own number, so a repeated batch gives the same.
    """

    def apply(walk: DataFrame, batch: int) -> None:
        spark = walk.sparkSession
        keep = ("rel_path", "file_hash", "size_bytes", "mtime", "ctime", "parent_dir")
        if batch:
            old = spark.read.parquet(f"{inventory_path}/{batch - 1}")
        else:
            old = walk.limit(0).select(*keep).withColumn("status", F.lit("ok"))
        state = sync.reconciled(old, walk).drop("file_hash")
        both = walk.select(*keep).withColumn("_new", F.lit(1)).unionByName(old.select(*keep).withColumn("_new", F.lit(0)))
        rows = both.groupBy("rel_path").agg(F.max(F.struct("_new", *keep[1:])).alias("x")).select("rel_path", *(f"x.{c}" for c in keep[1:]))
        rows.join(state, "rel_path").write.mode("overwrite").parquet(f"{inventory_path}/{batch}")

    return walks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
