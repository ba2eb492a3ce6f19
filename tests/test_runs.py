"""The log of runs against a plain fold, over batches, arrivals out of order and restarts."""

import datetime
import random
import uuid

from pyspark.sql import functions as F

from millrace.session import shared_dir
from millrace.streaming import runs

KIND = "run_id string, at timestamp, seq bigint, event string, message string"
START = datetime.datetime(2026, 1, 1)


def plain(events, lease, until):
    """Rows of the log: (run_id, n, at, event, accepted, status, completed, message), one event after the other."""
    out, state = [], {}

    def note(run, at, event, accepted, message):
        s = state[run]
        s["n"] += 1
        out.append((run, s["n"], at, event, accepted, s["status"], s["completed"], message))

    def expire(run, upto):
        s = state[run]
        if s["status"] == "running" and s["seen"] + lease < upto:
            at, s["status"] = s["seen"] + lease, "error"
            note(run, at, "lost", True, runs.LOST)

    for run, at, _, event, message in sorted(events, key=lambda e: (e[1], e[2])):
        if at > until:
            continue
        s = state.setdefault(run, {"n": 0, "status": None, "completed": 0, "seen": None})
        expire(run, at)
        moves = {("queued", None): "pending", ("queued", "done"): "pending", ("queued", "error"): "pending", ("claimed", "pending"): "running", ("item", "running"): "running", ("done", "running"): "done", ("error", "pending"): "error", ("error", "running"): "error"}
        new = moves.get((event, s["status"]))
        if new:
            s["status"], s["seen"] = new, at
            s["completed"] = 0 if event == "queued" else s["completed"] + (event == "item")
        note(run, at, event, new is not None, message)
    for run in state:
        expire(run, until + datetime.timedelta(milliseconds=1))
    return sorted(out)


def made(n=400):
    rng = random.Random(11)
    events, at = [], START
    for i in range(n):
        at += datetime.timedelta(seconds=rng.randint(0, 90), microseconds=1000 * rng.randint(0, 3))
        events.append((f"run-{rng.randint(0, 9)}", at, i, rng.choice(["queued", "claimed", "claimed", "item", "item", "done", "error"]), f"m{i}"))
    return events


def published(spark, slices, lease, late="0 seconds", restart=False):
    base = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert zone == "UTC"
    for part in slices:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if restart:
            runs.publish_runs(runs.events_of(spark, f"{base}/in", KIND, 1), f"{base}/out", f"{base}/mark", lease, late).awaitTermination()
    if not restart:
        runs.publish_runs(runs.events_of(spark, f"{base}/in", KIND, 1), f"{base}/out", f"{base}/mark", lease, late).awaitTermination()
    return spark.read.parquet(f"{base}/out")


def rows(log):
    utc = lambda t: t.astimezone(datetime.UTC).replace(tzinfo=None)
    return sorted((r.run_id, r.n, utc(r.at), r.event, r.accepted, r.status, r.completed, r.message) for r in log.collect())


def utc_events(events):
    return [(r, at.replace(tzinfo=datetime.UTC), *rest) for r, at, *rest in events]


def test_a_stream_equals_a_fold(spark):
    events = made()
    log = published(spark, [utc_events(events[:250]), utc_events(events[250:])], 300, restart=True)
    want = plain(events, datetime.timedelta(seconds=300), events[-1][1])
    assert rows(log) == want
    assert {r[3] for r in want} == {*runs.EVENTS, "lost"}
    now = {r.run_id: r for r in runs.runs(log).collect()}
    last = {}
    for r in want:
        last[r[0]] = r
    assert {k: (v.status, v.completed, v.n_log) for k, v in now.items()} == {k: (v[5], v[6], v[1]) for k, v in last.items()}
    pending = [k for k, v in now.items() if v.status == "pending"]
    oldest = runs.next_run(log).collect()
    assert [r.run_id for r in oldest] == sorted(pending, key=lambda k: now[k].created_at)[:1]


def test_arrivals_out_of_order(spark):
    events = made(120)
    rng = random.Random(3)
    shuffled = sorted(events, key=lambda e: e[1] + datetime.timedelta(seconds=rng.randint(0, 600)))
    odd = [(None, START, 1, "queued", None), ("x", None, 1, "queued", None), ("x", START, 1, "unknown", None)]
    slices = [utc_events(shuffled[:50]) + [(r, a and a.replace(tzinfo=datetime.UTC), *m) for r, a, *m in odd], utc_events(shuffled[50:])]
    log = published(spark, slices, None, late="15 minutes")
    # with no lease nothing is lost; what is within the watermark waits
    want = plain(events, datetime.timedelta(days=9999), events[-1][1] - datetime.timedelta(minutes=15))
    assert rows(log) == want
    assert log.where(F.col("event") == "lost").isEmpty()


def test_events_of_one_time_in_two_batches(spark):
    """Events that wait at a time meet others of that time that arrive later."""
    at = START + datetime.timedelta(minutes=5)
    events = [("a", at, 2, "claimed", "m2"), ("a", at, 1, "queued", "m1"), ("a", at, 3, "item", "m3"), ("a", at + datetime.timedelta(hours=2), 4, "item", "m4")]
    log = published(spark, [utc_events(events[:1]), utc_events(events[1:3]), utc_events(events[3:])], None, late="10 minutes")
    assert rows(log) == plain(events[:3], datetime.timedelta(days=9999), at)
