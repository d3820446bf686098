"""Queue items and publishing: the batch fold, single steps and the stream on random events; the log of streaming upserts."""

import random

import pytest

from quire.operators import machine
from quire.sources.scratch import Files
from quire.streaming import review_stream, snapshot_log
from quire.streaming.snapshot_log import SnapshotLog

QUEUE_EVENT = "item_id long, at long, event_id long, event string, n int, text string"


def random_events(m, items=60, seed=1):
    """Events that mostly fit the state, so that items get far, and others, with gaps longer than the lease."""
    rng, out = random.Random(seed), []
    names = sorted({r.event for r in m.rules} - {machine.LOST})
    for item in range(items):
        s, at = m.start(), 1_700_000_000
        for k in range(rng.randrange(1, 40)):
            at += rng.choice([0, 5, 60, 3600, machine.LEASE, machine.LEASE + 1, 3 * machine.LEASE])
            fitting = sorted({r.event for r in m.rules if s["status"] in r.sources and r.event != machine.LOST})
            fitting = [e for e in fitting if e != "fail" or rng.random() < 0.2] or fitting
            event = rng.choice(fitting) if fitting and rng.random() < 0.9 else rng.choice([*names, "unheard of"])
            e = {"item_id": item, "at": at, "event_id": k, "event": event, "n": rng.choice([*range(s.get("pages", 0)), 0, 0, rng.choice([-1, 2, None])]) if event == "approve" else rng.choice([1, 2, 0, None]), "text": rng.choice(["x", "y", None])}
            out.append(e)
            s = m.run(s, [e])
    return out


def plain(m, events, until=None):
    by = {}
    for e in sorted(events, key=lambda e: (e["at"], e["event_id"])):
        by.setdefault(e["item_id"], []).append(e)
    return {k: m.run(m.start(), v, until) for k, v in by.items()}


def collected(df):
    return {r["item_id"]: {c: v for c, v in r.asDict().items() if c != "item_id"} for r in df.collect()}


@pytest.mark.parametrize("m", [machine.queue(), machine.publishing("local"), machine.publishing("web")], ids=["queue", "local", "web"])
def test_fold_equals_steps(spark, m):
    events = random_events(m, 120)
    frame = spark.createDataFrame([tuple(e.values()) for e in events], QUEUE_EVENT).repartition(3)
    for until in (None, max(e["at"] for e in events) + machine.LEASE // 2, 1_900_000_000):
        expected = plain(m, events, until)
        assert collected(m.fold(frame, ["item_id"], ["at", "event_id"], until)) == expected
    seen = {s for r in m.rules for s in (*r.sources, r.target) if s}
    visited = set()
    for i in range(400):
        own, held = [e for e in random_events(m, 1, 100 + i)], m.start()
        for e in own:
            held = m.run(held, [e])
            visited.add(held["status"])
    assert visited | {"new"} == seen | {"new"}


def test_pause_takes_effect_at_the_next_tick():
    m = machine.queue()
    event = lambda name, at, n=None: {"event": name, "at": at, "n": n, "text": None}
    log = [event("enqueue", 1), event("start", 2), event("fetched", 3), event("split", 4), event("pages", 5, 2), event("approve", 6, 0), event("approve", 7, 0)]
    s = m.run(m.start(), log)
    assert (s["status"], s["approved"], s["refused"]) == ("awaiting_review", [0], 0)
    s = m.run(s, [event("approve", 8, 5), event("approve", 9, 1)])
    assert (s["status"], s["refused"]) == ("approved", 1)
    assert m.run(s, [event("pause", 10)])["status"] == "paused"
    s = m.run(s, [event("start", 10), event("tick", 11), event("pause", 12)])
    assert (s["status"], s["asked"], s["progress"]) == ("ocr_running", True, 1)
    assert m.run(s, [event("finish", 13)])["status"] == "done"
    s = m.run(s, [event("tick", 13), event("tick", 14)])
    assert (s["status"], s["refused"]) == ("paused", 2)
    s = m.run(s, [event("resume", 15), event("start", 16)])
    assert (s["status"], s["progress"]) == ("ocr_running", 0)
    s = m.run(s, [event("enqueue", 17 + machine.LEASE)])  # the step was cut off: its item waits for a worker again
    assert (s["status"], s["recovered"], s["asked"]) == ("approved", 1, False)
    s = m.run(s, [event("start", 18 + machine.LEASE), event("fail", 19 + machine.LEASE), event("retry", 20 + machine.LEASE)])
    assert (s["status"], s["error"]) == ("approved", None)


def test_queue_stream_equals_batch(spark, tmp_path):
    m = machine.queue()
    events = sorted(random_events(m, 40, 5), key=lambda e: (e["at"], e["event_id"], e["item_id"]))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k in range(4):  # a file a batch, in order
        part = events[k * len(events) // 4 : (k + 1) * len(events) // 4]
        spark.createDataFrame([tuple(e.values()) for e in part], QUEUE_EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(QUEUE_EVENT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    run = review_stream.queue_states(stream, "item_id").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
    run = run.foreachBatch(lambda df, i: seen.update(collected(df))).trigger(availableNow=True).start()
    assert run.awaitTermination(180)
    if run.exception():
        raise run.exception()
    from datetime import datetime

    mark = run.lastProgress["eventTime"]["watermark"]
    until = int(datetime.fromisoformat(mark.replace("Z", "+00:00")).timestamp())
    expected = plain(m, events, until)
    keep = lambda s: {c: v for c, v in s.items() if c != "at"}
    assert {k: keep(s) for k, s in seen.items()} == {k: keep(s) for k, s in expected.items()}
    assert any(s["recovered"] for s in expected.values())


# -- the log of upserts -------------------------------------------------------

KIND = "k int, t int, v string"


def batches(n=9, size=40, keys=60, seed=3):
    rng = random.Random(seed)
    return [[(rng.choice([None, *range(keys)]), rng.choice([None, *range(12)]), f"{b}.{i}") for i in range(rng.choice([0, 1, size]))] for b in range(n)]


def newest(all_):
    out = {}
    for rows in all_:
        own = {}
        for k, t, v in rows:
            mark = -1 if t is None else t
            if k not in own or (mark, v) > own[k][:2]:
                own[k] = (mark, v, t)
        for k, (mark, v, t) in own.items():
            if k not in out or mark > out[k][0]:
                out[k] = (mark, v, t)
    return sorted(((k, t, v) for k, (_, v, t) in out.items()), key=repr)


def rows_of(log):
    got = log.current()
    return [] if got is None else sorted(map(tuple, got.collect()), key=repr)


def test_log_of_batches(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path), ["k"], "t", ("v",), buckets=4)
    done = batches()
    for i, rows in enumerate(done):
        log.upsert(spark.createDataFrame(rows, KIND), i)
        assert rows_of(log) == newest(done[: i + 1])
        assert log.upsert(spark.createDataFrame([(1, 99, "again")], KIND), i) == {"rows": 0, "written": 0}
    assert len(log.versions()) == snapshot_log.KEPT
    assert set(Files(spark, str(tmp_path)).names("data")) == set().union(*(log.manifest(v).tables() for v in log.versions()))
    before = sorted(map(tuple, log.current(log.versions()[0]).collect()), key=repr)  # a reader of the manifest before
    assert before == newest(done[:-1])


class Killed(Exception):
    pass


def test_log_survives_a_job_killed_at_any_step(spark, tmp_path):
    done = [r for r in batches(5, 25, 20, 4) if r][:3] + [[(k, 50, "last") for k in range(0, 20, 3)]]
    steps, n = [], 0
    log = SnapshotLog(spark, str(tmp_path / "whole"), ["k"], "t", ("v",), buckets=2)
    log.after = steps.append
    for i, rows in enumerate(done):
        log.upsert(spark.createDataFrame(rows, KIND), i)
    assert {"rows", "merged", "manifest written", "manifest", "manifest deleted", "table deleted"} <= set(steps)
    for stop in range(0, len(steps), 1):
        path, left, count = str(tmp_path / f"run{stop}"), list(enumerate(done)), [0]

        def after(step, count=count, stop=stop):
            count[0] += 1
            if count[0] == stop + 1:
                raise Killed

        while left:
            log = SnapshotLog(spark, path, ["k"], "t", ("v",), buckets=2)
            log.after = after
            try:
                log.upsert(spark.createDataFrame(left[0][1], KIND), left[0][0])
                left.pop(0)
            except Killed:
                n += 1  # and again, as a restarted stream does
        assert rows_of(log) == newest(done)
        log.prune()
        assert set(Files(spark, path).names("data")) == set().union(*(log.manifest(v).tables() for v in log.versions()))
    assert n == len(steps)


def test_what_a_batch_writes_follows_the_batch(spark, tmp_path):
    log = SnapshotLog(spark, str(tmp_path), ["k"], "t", buckets=2)
    log.upsert(spark.range(20_000).selectExpr("int(id) k", "1 t", "'x' v"), 0)
    written = [log.upsert(spark.range(i * 50, i * 50 + 50).selectExpr("int(id) k", f"{i + 1} t", "'y' v"), i)["written"] for i in range(1, 12)]
    assert max(written) < 1500 and sum(written) < 11 * 50 * 6
    assert log.current().count() == 20_000 and log.current().where("v = 'y'").count() == 550
    assert max(len(f) for f in log.manifest().buckets.values()) <= 8


def test_stack_to_merge():
    assert [snapshot_log.stack_to_merge(x) for x in ([5], [100, 5], [10, 5], [100, 10, 5], [40, 10, 5], [3, 0])] == [1, 1, 2, 2, 2, 1]


def test_streamed_upserts(spark, tmp_path):
    done = [r for r in batches(8, 30) if r]
    for rows in done:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    merge = review_stream.newest_suggestions(str(tmp_path / "log"), ["k"], "t", ("v",))
    stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing to do
        run = stream.writeStream.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(merge).trigger(availableNow=True).start()
        assert run.awaitTermination(180)
    got = rows_of(SnapshotLog(spark, str(tmp_path / "log"), ["k"], "t", ("v",)))
    assert [(k, t) for k, t, _ in got] == [(k, t) for k, t, _ in newest(done)]
