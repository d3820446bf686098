"""Guarded state machines: one table of transitions, run as a fold in columns over a batch or event by event in a stream.

A rule names an event, the states it is taken in, a guard and the state after it; the first rule that fits counts. An
event that no rule takes changes nothing and is counted as refused. Effects say what an event that was taken writes
besides the state. Guards and effects come in two forms, over Python values and over columns; a test holds both
against each other on random events. LOST is no event of the log: it is offered before each event, and by timers in a
stream, and taken where a step has run longer than its lease without a sign of life.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOST = "lost"


@dataclass(frozen=True)
class Rule:
    event: str
    sources: tuple[str, ...]
    target: str | None  # None: the state stays
    guard: str | None = None


@dataclass(frozen=True)
class Effect:
    """What field becomes after one of the events, if the state after it is in states (any, if there are none)."""

    field: str
    events: tuple[str, ...]
    plain: Callable[[dict, dict], object]
    column: Callable[[Column, Column], Column]
    states: tuple[str, ...] = ()


@dataclass(frozen=True)
class Machine:
    """fields: name, type and first value of each; the first one is status, at is the time of the last event taken."""

    rules: tuple[Rule, ...]
    fields: tuple[tuple[str, str, object], ...]
    guards: dict[str, tuple[Callable[[dict, dict], bool], Callable[[Column, Column], Column]]]
    effects: tuple[Effect, ...]

    def start(self) -> dict:
        return {n: list(v) if isinstance(v, tuple) else v for n, _, v in self.fields} | {"at": None, "taken": 0, "refused": 0, "recovered": 0}

    def ddl(self) -> str:
        return ", ".join(f"{n} {t}" for n, t, _ in self.fields) + ", at long, taken long, refused long, recovered long"

    # -- one event at a time -----------------------------------------------------

    def step(self, s: dict, e: dict) -> dict:
        """The state after event e (event, at and what guards and effects read)."""
        for r in self.rules:
            if r.event == e["event"] and s["status"] in r.sources and (r.guard is None or self.guards[r.guard][0](s, e)):
                break
        else:
            return s if e["event"] == LOST else {**s, "refused": s["refused"] + 1}
        lost = e["event"] == LOST
        after = {**s, "status": r.target or s["status"], "at": e["at"], "taken": s["taken"] + (not lost), "recovered": s["recovered"] + lost}
        for f in self.effects:
            if e["event"] in f.events and (not f.states or after["status"] in f.states):
                after[f.field] = f.plain(s, e)
        return after

    def run(self, s: dict, events: list[dict], until: int | None = None) -> dict:
        for e in events:
            s = self.step(self.step(s, {**e, "event": LOST}), e)
        return s if until is None else self.step(s, {"event": LOST, "at": until})

    # -- a batch -----------------------------------------------------------------

    def _after(self, s: Column, e: Column, lost: bool) -> Column:
        """The state after event e, which is LOST or is not. The state that a rule leads to is found once, rules by their event, and has
        a name within the expression, else every field would try all rules again."""
        status, event = s["status"], e["event"]
        by_event: dict[str, Column] = {}
        for r in self.rules:
            if (r.event == LOST) == lost:
                fit = status.isin(*r.sources) & (F.lit(True) if r.guard is None else F.coalesce(self.guards[r.guard][1](s, e), F.lit(False)))
                by_event[r.event] = by_event.get(r.event, F.when(F.lit(False), F.lit(""))).when(fit, F.lit(r.target) if r.target else status)
        target = F.when(F.lit(False), F.lit(""))
        for name, column in by_event.items():
            target = column if lost else target.when(event == name, column)
        add = lambda c, if_: (s[c] + F.when(if_, 1).otherwise(0)).cast("long").alias(c)

        def moved(after: Column) -> Column:
            """after is null where no rule took the event."""
            taken = after.isNotNull()
            out = [F.coalesce(after, status).alias("status")]
            for n, t, _ in self.fields[1:]:
                value = F.when(~taken, s[n])
                for f in self.effects:
                    events = [x for x in f.events if (x == LOST) == lost]
                    if f.field == n and events:
                        value = value.when(event.isin(*events) & (after.isin(*f.states) if f.states else F.lit(True)), f.column(s, e).cast(t))
                out.append(value.otherwise(s[n]).alias(n))
            none = F.lit(False)
            return F.struct(*out, F.when(taken, e["at"]).otherwise(s["at"]).alias("at"), add("taken", none if lost else taken), add("refused", none if lost else ~taken), add("recovered", taken if lost else none))

        return F.element_at(F.transform(F.array(target), moved), 1)

    def fold(self, events: DataFrame, keys: list[str], order: list[str], until: int | None = None) -> DataFrame:
        """The state of each key after its events (event, at, payload columns) in order; with until, steps whose lease ends before
        that time are given up. A key's events are one list: a queue item or book has as many as people and steps made.

        The fold is part of the aggregation, so that a filter on the state doesn't fold once more."""
        rest = [c for c in events.columns if c not in {*keys, *order, "event"}]
        row = F.struct(*order, "event", *rest)
        kind = events.select(row.alias("e")).schema["e"].dataType
        lost = lambda e: F.struct(*[(F.lit(LOST) if c == "event" else e[c]).alias(c) for c in kind.names])

        def step(s: Column, e: Column) -> Column:
            """LOST is offered first; the state between has a name of its own."""
            return F.element_at(F.transform(F.array(self._after(s, lost(e), True)), lambda x: self._after(x, e, False)), 1)

        first = self.start()
        types = dict((n, t) for n, t, _ in self.fields) | dict.fromkeys(("at", "taken", "refused", "recovered"), "long")
        value = lambda n: (F.array() if first[n] == [] else F.lit(first[n])).cast(types[n]).alias(n)
        state = F.aggregate(F.array_sort(F.collect_list(row)), F.struct(*[value(n) for n in types]), step)
        if until is not None:
            end = F.struct(*[(F.lit(LOST) if c == "event" else F.lit(until) if c == "at" else F.lit(None)).cast(kind[c].dataType).alias(c) for c in kind.names])
            state = F.element_at(F.transform(F.array(state), lambda s: self._after(s, end, True)), 1)
        return events.groupBy(*keys).agg(state.alias("s")).select(*keys, "s.*")


# -- queue items -------------------------------------------------------------------

# The states of a queue item.
RUNNING = ("downloading", "downloaded", "rasterizing", "ocr_running")
#: Seconds without a sign of life after which a running step counts as cut off.
LEASE = 6 * 3600
FETCH = RUNNING[:3]


def _late(lease: int):
    return (lambda s, e: e["at"] - s["at"] > lease), (lambda s, e: e["at"] - s["at"] > lease)


def queue(lease: int = LEASE) -> Machine:
    """A queue item from download to the end of reading, with pauses, retries and steps taken up again after a restart.

    Events: enqueue, start (a worker takes the item up, also one whose step was cut off), fetched, split, pages (n of them),
    approve (page n), pause, resume, tick (a page or snippet is read), finish, fail (text), retry. A pause of a running
    item takes effect at its next tick; an item whose last page is approved goes on by itself."""
    new = lambda s, e: sorted({*s["approved"], e["n"]})
    page = lambda s, e: (e["n"] >= 0) & (e["n"] < s["pages"])
    known = lambda s, e: e["n"] is not None and 0 <= e["n"] < s["pages"]
    new_column = lambda s, e: F.array_sort(F.array_union(s["approved"], F.array(e["n"])))
    rules = (
        Rule("enqueue", ("new",), "queued"),
        Rule("start", ("queued", *FETCH), "downloading"),
        Rule("start", ("approved", "ocr_running"), "ocr_running"),
        Rule("fetched", ("downloading",), "downloaded"),
        Rule("split", ("downloaded",), "rasterizing"),
        Rule("pages", ("rasterizing",), "awaiting_review"),
        Rule("approve", ("awaiting_review",), "approved", "last page"),
        Rule("approve", ("awaiting_review",), None, "page"),
        Rule("pause", ("approved",), "paused"),
        Rule("pause", ("ocr_running", "paused"), None),
        Rule("resume", ("paused",), "approved"),
        Rule("tick", ("ocr_running",), "paused", "asked"),
        Rule("tick", ("ocr_running",), None),
        Rule("finish", ("ocr_running",), "done"),
        Rule("fail", RUNNING, "failed"),
        Rule("retry", ("done", "failed"), "approved", "all pages"),
        Rule("retry", ("done", "failed"), "awaiting_review", "some pages"),
        Rule("retry", ("done", "failed"), "queued"),
        Rule(LOST, FETCH, "queued", "late"),
        Rule(LOST, ("ocr_running",), "approved", "late"),
    )
    fields = (("status", "string", "new"), ("error", "string", None), ("pages", "int", 0), ("approved", "array<int>", ()), ("asked", "boolean", False), ("progress", "int", 0))
    guards = {
        "page": (known, page),
        "last page": (lambda s, e: known(s, e) and len(new(s, e)) == s["pages"], lambda s, e: page(s, e) & (F.size(new_column(s, e)) == s["pages"])),
        "all pages": (lambda s, e: s["pages"] > 0 and len(s["approved"]) == s["pages"], lambda s, e: (s["pages"] > 0) & (F.size(s["approved"]) == s["pages"])),
        "some pages": (lambda s, e: s["pages"] > 0, lambda s, e: s["pages"] > 0),
        "asked": (lambda s, e: s["asked"], lambda s, e: s["asked"]),
        "late": _late(lease),
    }
    const = lambda v: (lambda s, e: v, lambda s, e: F.lit(v))
    effects = (
        Effect("error", ("fail",), lambda s, e: e["text"], lambda s, e: e["text"]),
        Effect("error", ("retry",), *const(None)),
        Effect("pages", ("pages",), lambda s, e: max(e["n"] or 0, 0), lambda s, e: F.greatest(F.coalesce(e["n"], F.lit(0)), F.lit(0))),
        Effect("approved", ("pages",), lambda s, e: [], lambda s, e: F.array()),
        Effect("approved", ("approve",), new, new_column),
        Effect("asked", ("pause",), *const(True), ("ocr_running",)),
        Effect("asked", ("start", "resume", "finish", "fail", LOST), *const(False)),
        Effect("asked", ("tick",), *const(False), ("paused",)),
        Effect("progress", ("start",), *const(0), ("ocr_running",)),
        Effect("progress", ("tick",), lambda s, e: s["progress"] + 1, lambda s, e: s["progress"] + 1, ("ocr_running",)),
    )
    return Machine(rules, fields, guards, effects)


def publishing(stage: str, lease: int = LEASE) -> Machine:
    """Publishing of a finished item to one of the stages. 'local' starts by itself, 'web' only when it was requested; failed and
    skipped ones wait for a request. Events: request, start (target in text), progress (text), publish, skip, fail (text)."""
    ready = ("none", "requested") if stage == "local" else ("requested",)
    rules = (
        Rule("request", ("none", "requested", "published", "failed", "skipped"), "requested"),
        Rule("start", (*ready, "publishing"), "publishing"),
        Rule("progress", ("publishing",), None),
        Rule("publish", ("publishing",), "published"),
        Rule("skip", ("publishing",), "skipped"),
        Rule("fail", ("publishing",), "failed"),
        Rule(LOST, ("publishing",), "requested", "late"),
    )
    text = (lambda s, e: e["text"], lambda s, e: e["text"])
    none = (lambda s, e: None, lambda s, e: F.lit(None))
    last = (lambda s, e: e["text"] if e["text"] is not None else s["target"], lambda s, e: F.coalesce(e["text"], s["target"]))
    fields = (("status", "string", "none"), ("error", "string", None), ("target", "string", None), ("progress", "string", None), ("published_at", "long", None))
    effects = (
        Effect("error", ("fail",), *text),
        Effect("error", ("request", "start", "publish", "skip", LOST), *none),
        Effect("target", ("start",), *last),
        Effect("progress", ("progress",), *text),
        Effect("progress", ("request", "start", "publish", "skip", "fail", LOST), *none),
        Effect("published_at", ("publish",), lambda s, e: e["at"], lambda s, e: e["at"]),
    )
    return Machine(rules, fields, {"late": _late(lease)}, effects)
