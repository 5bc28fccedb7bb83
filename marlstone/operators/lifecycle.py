"""Life cycle of jobs from their events, with one job of a queue at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Seconds without any event of its queue after which an open job has timed out.
TIMEOUT = 6 * 3600


def job_history(events: DataFrame, as_of: Column, timeout: int = TIMEOUT) -> DataFrame:
    """All jobs of the events (queue, event_id, event, progress, ts: microseconds, long) as of a time.

    ``submit`` opens a job where the queue has none that is pending or running, and is skipped
    otherwise; ``start`` or ``progress`` make it running; ``complete`` and ``fail`` close it, and so
    does a gap of more than ``timeout`` seconds to the queue's next event (or to ``as_of``). A
    failed or timed-out job keeps its progress, a completed one has 1. Events of a queue are
    ordered by time, then id; those without a job to act on, and those without queue, time or id,
    change nothing. Progress is the largest reported, null counting as none.

    What closes a job also closes everything before it, whether or not a job is open. So the
    closing events cut a queue into stretches of one job at most, by a running sum, and no row
    needs the state before it.

    Returns queue, job (from 1 in each queue), status, submitted, started, ended, progress, n_skipped.
    """
    wait = timeout * 1_000_000
    order = W.partitionBy("queue").orderBy("ts", "event_id")
    known = events.where("queue is not null and ts is not null and event_id is not null").withColumn("as_of", as_of)
    alone = F.coalesce(F.lead("ts").over(order), "as_of") - F.col("ts") > wait
    closes = F.col("event").isin("complete", "fail")
    marked = known.withColumn("late", alone & ~F.coalesce(closes, F.lit(False)))
    closing = (F.coalesce(closes, F.lit(False)) | F.col("late")).cast("long")
    cut = marked.withColumn("stretch", F.coalesce(F.sum(closing).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    at = F.struct("ts", "event_id")
    inside = cut.withColumn("opened", F.min(F.when(F.col("event") == "submit", at)).over(W.partitionBy("queue", "stretch").orderBy("ts", "event_id"))).where(F.col("opened").isNotNull())
    began, end = F.col("event").isin("start", "progress"), F.when(closes, F.col("event"))
    jobs = inside.groupBy("queue", "stretch").agg(
        F.min("opened.ts").alias("submitted"),
        F.min(F.when(began, F.col("ts"))).alias("started"),
        F.max(end).alias("end"),
        F.max("late").alias("late"),
        F.max("ts").alias("last"),
        F.max(F.when(F.col("event") == "progress", F.col("progress"))).alias("reported"),
        (F.count_if(F.col("event") == "submit") - 1).alias("n_skipped"),
    )
    status = F.when(F.col("end") == "complete", "completed").when(F.col("end") == "fail", "failed").when(F.col("late"), "timed out").when(F.col("started").isNotNull(), "running").otherwise("pending")
    ended = F.when(F.col("end").isNotNull(), F.col("last")).when(F.col("late"), F.col("last") + wait)
    progress = F.when(F.col("end") == "complete", 1.0).otherwise(F.coalesce("reported", F.lit(0.0)))
    number = F.row_number().over(W.partitionBy("queue").orderBy("stretch")).cast("long")
    return jobs.select("queue", number.alias("job"), status.alias("status"), "submitted", "started", ended.alias("ended"), progress.alias("progress"), "n_skipped")
