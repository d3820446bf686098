"""Kept tallies after random inserts, changes, withdrawals, new texts and new roles, against counting everything."""

import random
from datetime import datetime, timedelta

import pytest

from quire.operators import tally
from quire.streaming.live_tally import LiveTally

BATCH = "snippet_id string, user_id long, id long, ts timestamp_ntz, kind string, text string, gone boolean"
SNIPPETS = "snippet_id string, working_text string, final_text string"
USERS = "id long, name string, role string"
ROLES = ("guest", "reviewer", "editor", "admin")


def world(seed):
    """Batches with the snippets and users at their time: (rows, texts, people, changed snippets, changed users)."""
    rng = random.Random(seed)
    texts = {f"s{i}": ("a b c d e", None) for i in range(8)}
    people = {i: rng.choice(ROLES) for i in range(6)}
    out, n = [], 0
    for k in range(7):
        rows = []
        for _ in range(rng.choice([0, 3, 12])):
            n += 1
            s = rng.choice([*texts, "unknown"])
            words = ["a", "b", "c", "d", "e"]
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(["X", "Y", "X Y", "c"])
            rows.append((s, rng.randrange(7), n, datetime(2024, 1, 1) + timedelta(minutes=n), rng.choice(["edit", "edit", "confirm"]), " ".join(words), rng.random() < 0.2))
        changed = [s for s in texts if rng.random() < 0.2] if k else []
        for s in changed:
            texts[s] = rng.choice([("a X c d e", None), ("a b c d e", "a b Y d e"), ("a b c d", None)])
        moved = [u for u in people if rng.random() < 0.15] if k % 2 else []
        for u in moved:
            people[u] = rng.choice(ROLES)
        out.append((rows, dict(texts), dict(people), changed, moved))
    return out


def frames(spark, texts, people):
    return spark.createDataFrame([(k, *v) for k, v in texts.items()], SNIPPETS), spark.createDataFrame([(k, f"N{k}", v) for k, v in people.items()], USERS)


def counted(spark, rows, texts, people):
    """What tally.tallied says of the suggestions that stand."""
    snippets, users = frames(spark, texts, people)
    held = {}
    for s, u, i, ts, kind, text, gone in rows:
        held[s, u] = (s, u, i, ts, kind, text, gone)
    votes = spark.createDataFrame([v for v in held.values() if not v[6]], BATCH)
    done = tally.tallied(snippets, votes, users).where("suggestion_count > 0")
    return {r["snippet_id"]: tuple(r[c] for c in COLUMNS) for r in done.collect()}


COLUMNS = ("confirms_reviewers", "confirms_guests", "edit_suggestions", "suggestion_count", "attention", "word_changes")


def kept(live):
    rows = live.tallies()
    return {} if rows is None else {r["snippet_id"]: tuple(r[c] for c in COLUMNS) for r in rows.collect()}


def apply(spark, live, k, rows, texts, people, changed, moved):
    snippets, users = frames(spark, texts, people)
    one = lambda name, kind, xs: spark.createDataFrame([(x,) for x in xs], f"{name} {kind}") if xs else None
    live.apply(spark.createDataFrame(rows, BATCH), k, snippets, users, one("snippet_id", "string", changed), one("user_id", "long", moved))


@pytest.mark.parametrize("seed", [1])
def test_kept_equals_counted(spark, tmp_path, seed):
    live, all_ = LiveTally(spark, str(tmp_path), buckets=3), []
    for k, (rows, *rest) in enumerate(world(seed)):
        apply(spark, live, k, rows, *rest)
        all_ += [r for r in rows if r[0] != "unknown" and r[1] < 6]
        if k in (0, 3, 6):
            assert kept(live) == counted(spark, all_, *rest[:2])


class Killed(Exception):
    pass


def test_a_job_that_dies_between_the_logs(spark, tmp_path):
    """After any of a batch's writes the job is killed once; the batch comes again."""
    live, all_, hits = LiveTally(spark, str(tmp_path), buckets=2), [], 0
    batches = world(3)[:3]
    for k, (rows, *rest) in enumerate(batches):
        for log in ("groups", "counts", "votes"):
            for step in ("rows", "manifest"):

                def after(s, step=step):
                    if s == step:
                        raise Killed

                getattr(live, log).after = after
                if k % 3 == ("groups", "counts", "votes").index(log):
                    with pytest.raises(Killed):
                        apply(spark, live, k, rows, *rest)
                    hits += 1
                    live = LiveTally(spark, str(tmp_path), buckets=2)
                getattr(live, log).after = lambda s: None
                if live.votes.manifest().batch >= k:
                    break
        apply(spark, live, k, rows, *rest)
        all_ += [r for r in rows if r[0] != "unknown" and r[1] < 6]
    assert kept(live) == counted(spark, all_, *batches[-1][1:3]) and hits >= 3


def test_texts_are_beside_the_logs(spark, tmp_path):
    """No log moves a text; tables of texts that hold mostly what is gone become one, from which new texts are compared."""
    texts, people = {"s": ("a b c", None)}, {1: "editor", 2: "editor"}
    live, at = LiveTally(spark, str(tmp_path), buckets=2), datetime(2024, 1, 1)
    vote = lambda u, n, text, gone=False: ("s", u, n, at + timedelta(minutes=n), "edit", text, gone)
    for k in range(14):
        apply(spark, live, k, [vote(1, k, f"a x{k} c"), vote(2, k, "a b d", k == 13)], texts, people, [], [])
    names = live._text_tables()
    assert "text" not in live.votes.current().columns and names[0].endswith("-all") and len(names) < 14 and names == live.texts.names()
    texts = {"s": ("a y c", None)}
    apply(spark, live, 14, [], texts, people, ["s"], [])
    assert kept(live) == counted(spark, [vote(1, 13, "a x13 c")], texts, people)


def test_batches_that_bring_their_snippets_texts(spark, tmp_path):
    live = LiveTally(spark, str(tmp_path), buckets=2)
    snippets, users = frames(spark, {"s": ("a b c", None)}, {1: "editor"})
    rows = [("s", 1, 1, datetime(2024, 1, 1), "edit", "a x c", False, "a b c"), ("unknown", 1, 2, datetime(2024, 1, 1), "edit", "a x c", False, None)]
    live.apply(spark.createDataFrame(rows, BATCH + ", current_text string"), 0, snippets, users)
    assert kept(live) == counted(spark, [rows[0][:7]], {"s": ("a b c", None)}, {1: "editor"})


def test_a_bucket_is_written_by_several_tasks(spark, tmp_path):
    live = LiveTally(spark, str(tmp_path), buckets=1)
    assert live.votes._dealt(spark.range(1000).selectExpr("concat('s', id) AS snippet_id")).select("_p").distinct().count() > 1
