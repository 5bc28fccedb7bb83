"""Row numbers of a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shelf import Rounds


def numbered(rows: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with their places (long, from 1) in an order that leaves no ties, as a column ``name``.

    The rows are dealt by ranges of the order and stored, so that a lost task finds the same
    ranges again; each range numbers its own rows, and what comes before it is the sum of the
    smaller ranges' counts, one row a range. An empty table gives an empty result.
    """
    spark = rows.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = Rounds(spark, "places").put("ranges", rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    counts = stored.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return stored.withColumn("_own", own).join(F.broadcast(counts), "_range").withColumn(name, F.col("_own") + F.col("_before")).drop("_range", "_own", "_before")
