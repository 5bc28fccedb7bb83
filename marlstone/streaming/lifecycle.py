"""The life cycle of jobs over a stream: state and timers of each queue."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import TIMEOUT

#: The state store that states of several variables need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FIELDS = ("job", "status", "submitted", "started", "ended", "progress", "n_skipped")
OUTPUT = "queue long, job long, status string, submitted long, started long, ended long, progress double, n_skipped long"
OPEN = ("pending", "running")


class Jobs(StatefulProcessor):
    """One queue's job and the events that the watermark hasn't passed.

    Events wait in the state until the watermark passes them, so that their order is that of
    their times whatever order they come in. A timer stands at each waiting event, and one at
    the deadline of the open job.
    """

    def __init__(self, timeout: int) -> None:
        self.wait = timeout * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ts long, event_id long", "event string, progress double")
        self.job = handle.getValueState("job", "job long, status string, submitted long, started long, ended long, progress double, n_skipped long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            self.waiting.updateValue((r.ts_us, r.event_id), (r.event, r.progress))
            self.handle.registerTimer(_timer(r.ts_us))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000  # may be past several timers, whose work is done at the first
        before = self.job.get() if self.job.exists() else None
        job = dict(zip((*FIELDS, "last"), before, strict=True)) if before else {"job": 0, "status": "none"}
        out = []
        for (ts, event_id), (event, progress) in sorted(((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] <= now), key=lambda x: x[0]):
            out += self._expire(job, ts)
            out += self._apply(job, ts, event, progress)
            self.waiting.removeKey((ts, event_id))
        out += self._expire(job, now)
        if job["status"] != "none":
            self.job.update(tuple(job[c] for c in (*FIELDS, "last")))
            if job["status"] in OPEN:
                self.handle.registerTimer(_timer(job["last"] + self.wait + 1))
        for row in out:
            yield Row(queue=key[0], **row)

    def _expire(self, job: dict, now: int) -> list[dict]:
        if job["status"] not in OPEN or now - job["last"] <= self.wait:
            return []
        job |= {"status": "timed out", "ended": job["last"] + self.wait}
        return [{c: job[c] for c in FIELDS}]

    @staticmethod
    def _apply(job: dict, ts: int, event: str | None, progress: float | None) -> list[dict]:
        if job["status"] not in OPEN:
            if event != "submit":
                return []
            job |= {"job": job["job"] + 1, "status": "pending", "submitted": ts, "started": None, "ended": None, "progress": 0.0, "n_skipped": 0}
        elif event == "submit":
            job["n_skipped"] += 1
        elif event in ("start", "progress"):
            told = progress if event == "progress" and progress is not None else 0.0
            job |= {"status": "running", "started": ts if job["started"] is None else job["started"], "progress": max(job["progress"], told)}
        elif event == "complete":
            job |= {"status": "completed", "ended": ts, "progress": 1.0}
        elif event == "fail":
            job |= {"status": "failed", "ended": ts}
        job["last"] = ts
        return [{c: job[c] for c in FIELDS}]


def _timer(micros: int) -> int:
    """The first millisecond that isn't before a time."""
    return -(-micros // 1000)


def job_states(events: DataFrame, timeout: int = TIMEOUT, late: str = "10 minutes") -> DataFrame:
    """Every change of every job of a stream of events (queue: long, event_id, event, progress, ts: timestamp), for update mode.

    The last row of a (queue, job) is its state, and equals that of ``operators.lifecycle.job_history``
    over all events once the watermark has passed them. Events that come after the watermark are left
    out; of a repeated (queue, time, id) the last one counts; those without queue, time or id change
    nothing. State is the queue's last job and the events of the last ``late`` of time. The session
    needs the state store of ``STORE``.
    """
    timed = events.where("queue is not null and ts is not null and event_id is not null").withWatermark("ts", late)
    return timed.withColumn("ts_us", F.unix_micros("ts")).groupBy("queue").transformWithState(Jobs(timeout), OUTPUT, "Update", "EventTime")
