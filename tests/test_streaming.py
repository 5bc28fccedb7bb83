from pyspark.sql import functions as F

from marlstone.operators import registry
from marlstone.streaming import jobs

DATA = "/root/testdata/sf0.001"


def test_latest_status_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    folder = tmp_path / "in"
    for n in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == n).coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.latest_status(jobs.event_stream(spark, str(folder), events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("latest").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("latest").collect()}
    assert got == {(r["user_id"], r["status"], r["ts"]) for r in registry.latest_status(events).collect()}


def test_activity_closes_windows(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = jobs.activity(jobs.event_stream(spark, str(tmp_path / "in"), events.schema)).writeStream.outputMode("append").format("memory").queryName("activity").trigger(availableNow=True).start()
    q.awaitTermination()
    assert 0 < spark.table("activity").agg(F.sum("n")).first()[0] <= events.count()


def test_reconcile_batches(spark, tmp_path):
    schema = "rel_path string, file_hash string, size_bytes long, mtime long, ctime long, parent_dir string"
    row = lambda p, h, m=1: (p, h, 10, m, 2, "d")
    for walk in ([row("a", "1"), row("b", "2")], [row("a", "1")], [row("a", "9", 5), row("b", "2")]):
        spark.createDataFrame(walk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        walks = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = jobs.reconcile_continuously(walks, str(tmp_path / "inv"), str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    state = lambda n: {r["rel_path"]: r["status"] for r in spark.read.parquet(str(tmp_path / "inv" / str(n))).collect()}
    assert state(0) == {"a": "ok", "b": "ok"}
    assert state(1) == {"a": "ok", "b": "missing_source"}
    assert state(2) == {"a": "stale_source", "b": "ok"}
