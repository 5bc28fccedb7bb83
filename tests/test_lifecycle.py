"""Job life cycle: literal cases, and the stream against the batch form."""

from pyspark.sql import functions as F

from marlstone.operators import lifecycle
from marlstone.streaming import lifecycle as stream

HOUR = 3_600_000_000
SCHEMA = "queue long, event_id long, event string, progress double, ts long"


def history(spark, rows, as_of, timeout=3600):
    made = lifecycle.job_history(spark.createDataFrame(rows, SCHEMA), F.lit(as_of), timeout)
    return {(r["queue"], r["job"]): tuple(r)[2:] for r in made.collect()}


def test_literal_cases(spark):
    t = 1_000_000
    rows = [
        (1, 1, "progress", 0.9, 1), (1, 2, "submit", None, 2 * t), (1, 3, "submit", None, 3 * t), (1, 4, "start", None, 4 * t), (1, 5, "progress", 0.4, 5 * t),
        (1, 6, "progress", None, 6 * t), (1, 7, "fail", None, 7 * t), (1, 8, "complete", None, 8 * t), (1, 9, "submit", None, 9 * t), (1, 10, "complete", None, 9 * t),
        (2, 1, "submit", None, 0), (2, 2, "progress", 0.5, t), (2, 3, "submit", None, t + HOUR + 1), (3, 1, "submit", None, 0), (3, 2, None, None, HOUR),
        (4, 1, "submit", None, 2 * HOUR), (4, 2, "start", None, 2 * HOUR), (5, 1, "complete", None, 0), (None, 1, "submit", None, 0), (6, 1, "submit", None, None), (6, None, "submit", None, 5),
    ]
    got = history(spark, rows, 2 * HOUR)
    assert got == {
        (1, 1): ("failed", 2 * t, 4 * t, 7 * t, 0.4, 1),  # keeps its progress
        (1, 2): ("completed", 9 * t, None, 9 * t, 1.0, 0),
        (2, 1): ("timed out", 0, t, t + HOUR, 0.5, 0),
        (2, 2): ("pending", t + HOUR + 1, None, None, 0.0, 0),
        (3, 1): ("pending", 0, None, None, 0.0, 0),  # a gap of the timeout itself is none too many
        (4, 1): ("running", 2 * HOUR, 2 * HOUR, None, 0.0, 0),
    }
    assert history(spark, [], 0) == {}


def test_stream_equals_batch(spark, tmp_path):
    from marlstone.plans import catalog

    spark.conf.set(*stream.STORE)
    try:
        events = catalog.job_events(spark, "/root/testdata/sf0.001").where("queue < 12")
        last = events.agg(F.max("ts")).first()[0]
        # a far event lets the watermark pass all others, and what is still open time out
        far = spark.createDataFrame([(10**6, 10**9, "start", None, last + 100 * 24 * HOUR)], SCHEMA)
        rows = events.unionByName(far).withColumn("ts", F.timestamp_micros("ts"))
        # what arrives is out of order by less than the lateness
        order = spark.createDataFrame(sorted(rows.collect(), key=lambda r: (r["ts"].timestamp() // 36000, -r["event_id"])), rows.schema).toPandas()
        for n in range(3):
            part = order.iloc[n * len(order) // 3 : (n + 1) * len(order) // 3]
            spark.createDataFrame(part, rows.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        changes = []
        q = stream.job_states(source, late="11 hours").writeStream.outputMode("update").foreachBatch(lambda d, n: changes.extend((n, tuple(r)) for r in d.collect()))
        q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(stream.STORE[0])
    got = {}
    for _, r in changes:
        got[r[:2]] = r[2:]
    expected = {(r["queue"], r["job"]): tuple(r)[2:] for r in lifecycle.job_history(events, F.lit(last + 50 * 24 * HOUR)).collect()}
    assert got == expected
    assert {"completed", "failed", "timed out"} <= {v[0] for v in got.values()}
