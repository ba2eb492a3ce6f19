"""The log of runs as a stream: one state machine a run, in the order of event times.

A run is asked for (queued), taken by a worker (claimed), tells what it finished (item) and ends (done or error). Events
may arrive in any order within the watermark: each is kept under its time until the watermark has passed it, and
a timer takes it out, so no run is sorted and none is held as a whole. A run that is taken and then says
nothing for its lease ends in error at that moment, as its worker is lost; another may be asked for then.
Every event leaves one row of the log, refused ones too, and rows are only ever added.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = ("queued", "claimed", "item", "done", "error")
LOG = "run_id string, n bigint, at timestamp, event string, accepted boolean, status string, completed bigint, created_at timestamp, started_at timestamp, finished_at timestamp, message string"
STATE = "n bigint, status string, completed bigint, created bigint, started bigint, finished bigint, message string, deadline bigint, waiting bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOST = "no sign of its worker"
DAY_US = 86_400_000_000
#: events of a run that are held before they are put with those that wait
AT_ONCE = 10_000


def after(state: dict[str, Any], event: str, at: int, message: str | None) -> tuple[dict[str, Any], bool]:
    """The state of a run after an event at a time (microseconds), and whether the event was one that the run could have."""
    status, new = state["status"], dict(state)
    if event == "queued" and status in (None, "done", "error"):
        new |= {"status": "pending", "created": at, "started": None, "finished": None, "completed": 0, "message": None}
    elif event == "claimed" and status == "pending":
        new |= {"status": "running", "started": at}
    elif event == "item" and status == "running":
        new |= {"completed": state["completed"] + 1}
    elif event == "done" and status == "running":
        new |= {"status": "done", "finished": at}
    elif event == "error" and status in ("pending", "running"):
        new |= {"status": "error", "finished": at, "message": message}
    else:
        return new, False
    return new, True


NEW = {"n": 0, "status": None, "completed": 0, "created": None, "started": None, "finished": None, "message": None, "deadline": None, "waiting": 0}


class RunMachine(StatefulProcessor):
    """Events wait in a map from the day of their time; a timer at the first of each takes out, in order, what the watermark has passed.

    Reads and writes of state are counted by days, not by events, and no more than a day of a run is held at once.
    """

    def __init__(self, lease_ms: int | None):
        self.lease = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", STATE)
        self.waiting = handle.getMapState("waiting", "at bigint", "events array<struct<us:bigint,seq:bigint,event:string,message:string>>")

    def _state(self) -> dict[str, Any]:
        return dict(zip(NEW, self.run.get(), strict=True)) if self.run.exists() else dict(NEW)

    def _keep(self, state: dict[str, Any]) -> None:
        self.run.update(tuple(state[c] for c in NEW))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, new, n = self._state(), {}, 0
        for r in rows:
            new.setdefault(r.us // DAY_US, []).append((r.us, r.seq, r.event, r.message))
            n += 1
            if n % AT_ONCE == 0:
                self._wait(state, new)
        self._wait(state, new)
        self._keep(state)
        return iter(())

    def _wait(self, state: dict[str, Any], new: dict[int, list]) -> None:
        for day, events in new.items():
            before = [tuple(e) for e in self.waiting.getValue((day,))[0]] if self.waiting.containsKey((day,)) else []
            first = min(e[0] for e in events) // 1000
            state["waiting"] += not before
            if not before or first < min(e[0] for e in before) // 1000:
                self.handle.registerTimer(first)
            self.waiting.updateValue((day,), ([*before, *events],))
        new.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, state, out = expiredTimerInfo.getExpiryTimeInMs(), self._state(), []

        def lost() -> None:
            when = state["deadline"] * 1000
            state.update(after(state, "error", when, LOST)[0], deadline=None, n=state["n"] + 1)
            out.append(self._row(key, state, when, "lost", True, LOST))

        day, passed = at * 1000 // DAY_US, timerValues.getCurrentWatermarkInMs()
        events = sorted((tuple(e) for e in self.waiting.getValue((day,))[0]), key=lambda e: (e[0], e[1])) if self.waiting.containsKey((day,)) else []
        due = [e for e in events if e[0] // 1000 <= passed]
        # timers of a lease may come before the first event of the day: then no event is taken out
        if due and due[0][0] // 1000 <= at:
            if len(due) < len(events):
                self.waiting.updateValue((day,), (events[len(due) :],))
                self.handle.registerTimer(events[len(due)][0] // 1000)
            else:
                self.waiting.removeKey((day,))
                state["waiting"] -= 1
            for us, _, event, message in due:
                # a lease that ended before an event is seen at it
                if state["deadline"] is not None and state["deadline"] < us // 1000:
                    lost()
                new, accepted = after(state, event, us, message)
                state.update(new, n=state["n"] + 1)
                out.append(self._row(key, state, us, event, accepted, message))
                if accepted:
                    state["deadline"] = us // 1000 + self.lease if self.lease is not None and state["status"] == "running" else None
            if state["deadline"] is not None:
                # with nothing left to come before it, a lease that is over already ends now
                if not state["waiting"] and state["deadline"] <= passed:
                    lost()
                else:
                    self.handle.registerTimer(state["deadline"])
        elif state["deadline"] is not None and state["deadline"] <= at:
            lost()
        if out:
            self._keep(state)
        return iter(out)

    def _row(self, key, state: dict[str, Any], us: int, event: str, accepted: bool, message: str | None) -> Row:
        return Row(
            run_id=key[0], n=state["n"], at=us, event=event, accepted=accepted, status=state["status"], completed=state["completed"],
            created_at=state["created"], started_at=state["started"], finished_at=state["finished"], message=message,
        )


def run_log(events: DataFrame, lease_seconds: int | None = 3600, late: str = "0 seconds") -> DataFrame:
    """The log of a stream of events (run_id, at, seq, event, message); the columns of LOG, to be appended.

    n counts the rows of a run from 1. Events of one time are taken by seq. Those without a run, a time or a known event
    are left out; those later than the watermark (`late` behind the latest time seen) are dropped, as in any
    windowed count. An event is logged when the watermark reaches its time, so with `late` above zero
    the last events wait for later ones. A refused event has no effect but its row.
    """
    known = events.where(F.col("run_id").isNotNull() & F.col("at").isNotNull() & F.col("event").isin(*EVENTS))
    rows = known.select(F.col("run_id").cast("string").alias("run_id"), F.col("at").cast("timestamp").alias("at"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.coalesce(F.col("seq").cast("bigint"), F.lit(0)).alias("seq"), "event", F.col("message").cast("string").alias("message"))
    kind = ", ".join(f"{c.strip().split(' ')[0]} {'bigint' if 'timestamp' in c else c.strip().split(' ')[1]}" for c in LOG.split(","))
    made = rows.withWatermark("at", late).groupBy("run_id").transformWithState(RunMachine(None if lease_seconds is None else lease_seconds * 1000), kind, "Append", "EventTime")
    return made.withColumns({c: F.timestamp_micros(F.col(c)) for c in ("at", "created_at", "started_at", "finished_at")})


def publish_runs(events: DataFrame, target: str, checkpoint: str, lease_seconds: int | None = 3600, late: str = "0 seconds") -> StreamingQuery:
    """Append the log of a stream to target, each row once, also across restarts; it ends when what has arrived is done.

    State is in RocksDB under the checkpoint, so a restart goes on where the last commit was.
    """
    spark = events.sparkSession
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        # the provider is fixed when the stream starts
        return run_log(events, lease_seconds, late).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def runs(log: DataFrame) -> DataFrame:
    """run_id, status, created_at, started_at, finished_at, completed, n_log, message: each run as its last row of the log has it."""
    last = log.groupBy("run_id").agg(F.max_by(F.struct("status", "created_at", "started_at", "finished_at", "completed", F.col("n").alias("n_log")), "n").alias("r"), F.max_by("message", F.when(F.col("accepted") & F.col("event").isin("error", "lost"), F.col("n"))).alias("_m"))
    return last.select("run_id", "r.*", F.when(F.col("r.status") == "error", F.col("_m")).alias("message"))


def next_run(log: DataFrame) -> DataFrame:
    """run_id, created_at of the pending run that waits longest: one row, or none."""
    return runs(log).where("status = 'pending'").orderBy("created_at", "run_id").limit(1).select("run_id", "created_at")


def events_of(spark: SparkSession, folder: str, schema: str, per_batch: int | None = None) -> DataFrame:
    """A stream of the event files of a folder, so many at a time."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)
