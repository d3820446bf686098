"""The review flow as streams: newest suggestions, two-reviewer consensus, windows of actions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.operators.consensus import START, step
from quire.operators.machine import LEASE, RUNNING, Machine, queue
from quire.streaming import snapshot_log

STATE = "status string, final_text string, pending_text string, pending_by string, accepted long, rejected long"
RESULT = "doc_id long, status string, final_text string, accepted long, rejected long"
LIMIT = 60


def per_minute(actions: DataFrame) -> DataFrame:
    """Actions of every user in each minute; on a stream give it a watermark first."""
    at = F.window(F.col("ts"), "1 minute")
    return actions.groupBy("user_id", at).agg(F.count("*").alias("n")).select("user_id", F.col("window.start").alias("minute"), "n")


def over_limit(actions: DataFrame, limit: int = LIMIT, late: str = "5 minutes") -> DataFrame:
    return per_minute(actions.withWatermark("ts", late)).where(F.col("n") > limit)


# Requests that a person may make of a route and the seconds they count in; '*' is every other route, null no limit.
LIMITS = {"*": (300, 60), "suggest": (60, 60), "finalize": (60, 60), "accept": (60, 60), "apply": (5, 3600), "image": None, "ingest": None}


def limits(table: dict[str, tuple[int, int] | None] = LIMITS) -> tuple[Column, Column]:
    """The limit of the column route and the seconds it counts in, null where there is none."""
    most = seconds = F.lit(None).cast("long")
    rest = table.get("*")
    if rest:
        most, seconds = F.lit(rest[0]).cast("long"), F.lit(rest[1]).cast("long")
    for route, own in table.items():
        if route != "*":
            most = F.when(F.col("route") == route, F.lit(own[0] if own else None).cast("long")).otherwise(most)
            seconds = F.when(F.col("route") == route, F.lit(own[1] if own else None).cast("long")).otherwise(seconds)
    return most, seconds


def per_route(requests: DataFrame, table: dict[str, tuple[int, int] | None] = LIMITS) -> DataFrame:
    """(user_id, route, since, most, n) of requests (user_id, route, ts) in each route's own windows, which begin at whole
    multiples of their length. Requests without a user and routes without a limit aren't counted."""
    most, seconds = limits(table)
    held = requests.where("user_id IS NOT NULL").withColumns({"most": most, "_s": seconds}).where("_s IS NOT NULL")
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    since = F.timestamp_seconds(second - F.pmod(second, F.col("_s")))
    return held.groupBy("user_id", "route", since.alias("since"), "most").agg(F.count("*").alias("n"))


def over_limits(requests: DataFrame, table: dict[str, tuple[int, int] | None] = LIMITS) -> DataFrame:
    return per_route(requests, table).where("n > most")


def seen_once_a_minute(actions: DataFrame) -> DataFrame:
    """At most one last-seen update per user and minute."""
    return actions.withWatermark("ts", "1 minute").withColumn("minute", F.date_trunc("minute", "ts")).dropDuplicatesWithinWatermark(["user_id", "minute"])


class Consensus(StatefulProcessor):
    """Two-reviewer consensus per snippet; within a batch events are taken in order of time and id."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        if self.state.exists():
            held = self.state.get()
            state, counts = dict(zip(START, held[:4], strict=True)), [held[4], held[5]]
        else:
            state, counts = dict(START), [0, 0]
        for e in events.itertuples(index=False):
            state, role = step(state, e.reviewer, e.text, bool(e.is_expert), e.draft)
            counts[role is None] += 1
        self.state.update((*state.values(), *counts))
        yield pd.DataFrame({"doc_id": [key[0]], "status": [state["status"]], "final_text": [state["final_text"]], "accepted": [counts[0]], "rejected": [counts[1]]})

    def close(self) -> None:
        pass


def consensus(events: DataFrame) -> DataFrame:
    """A stream of snippets' states after each batch of events (doc_id, ts, event_id, reviewer, text, is_expert, draft)."""
    return events.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Consensus(), outputStructType=RESULT, outputMode="Update", timeMode="None")


def newest_suggestions(path: str, keys: list[str], time: str, ties: tuple[str, ...] = (), buckets: int = 64):
    """A foreachBatch function that keeps the newest row of each key in a log under path (see snapshot_log). Older rows that
    come late change nothing; running a batch again, or after a job that died in it, gives the same."""
    return snapshot_log.upserting(path, keys, time, ties, buckets)


class Queue(StatefulProcessor):
    """Queue items event by event: the machine's fields in a value, approved pages in a map, and a timer for the lease of a
    running step. Within a batch events are taken in order of time and number."""

    def __init__(self, machine: Machine, lease: int) -> None:
        self.machine, self.lease = machine, lease
        self.names = [n for n, _, _ in machine.fields if n != "approved"] + ["at", "taken", "refused", "recovered"]
        self.types = {n: t for n, t, _ in machine.fields} | dict.fromkeys(("at", "taken", "refused", "recovered"), "long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", ", ".join(f"{n} {self.types[n]}" for n in self.names))
        self.pages = handle.getMapState("pages", "page int", "approved boolean")

    def _held(self) -> dict:
        s = self.machine.start()
        if self.state.exists():
            s |= dict(zip(self.names, self.state.get(), strict=True))
            s["approved"] = sorted(k[0] for k in self.pages.keys())  # noqa: SIM118
        return s

    def _keep(self, key, s: dict) -> Iterator[pd.DataFrame]:
        self.state.update(tuple(s[n] for n in self.names))
        before = {k[0] for k in self.pages.keys()}  # noqa: SIM118
        for page in before - set(s["approved"]):
            self.pages.removeKey((page,))
        for page in set(s["approved"]) - before:
            self.pages.updateValue((page,), (True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s["status"] in RUNNING:
            self.handle.registerTimer((s["at"] + self.lease + 1) * 1000)
        yield pd.DataFrame({"key": [key[0]]} | {n: [s[n]] for n, _, _ in self.machine.fields} | {n: [s[n]] for n in ("at", "taken", "refused", "recovered")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        plain = [{"event": e.event, "at": int(e.at), "n": None if pd.isna(e.n) else int(e.n), "text": None if pd.isna(e.text) else e.text} for e in events.itertuples(index=False)]
        yield from self._keep(key, self.machine.run(self._held(), plain))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._keep(key, self.machine.run(self._held(), [], expiredTimerInfo.getExpiryTimeInMs() // 1000))

    def close(self) -> None:
        pass


def queue_states(events: DataFrame, key: str, late: str = "0 seconds", lease: int = LEASE) -> DataFrame:
    """A stream of queue items' states from events (key, at in seconds, event_id, event, n, text); see operators.machine.

    A step that gives no sign of life for its lease goes back to wait for a worker once the watermark has passed."""
    m = queue(lease)
    rows = events.withColumn("time", F.timestamp_seconds("at")).withWatermark("time", late)
    schema = f"key {events.schema[key].dataType.simpleString()}, {m.ddl()}"
    out = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=Queue(m, lease), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return out.withColumnRenamed("key", key)
