"""Operators on small frames: tallies, merges, consensus, catalog, exports."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog, consensus, ensemble, export, library, merge, people, tally
from quire.sources import readers, sinks
from quire.streaming import review_stream

SNIPPET = "snippet_id string, book_id string, page_index int, working_text string, final_text string"
SUGGESTION = "id long, snippet_id string, user_id long, kind string, text string, ts timestamp"
USER = "id long, name string, role string"
AT = dt.datetime(2024, 1, 1)


def tallies(spark, base, suggestions, final=None):
    snippets = spark.createDataFrame([("s", "b", 1, base, final)], SNIPPET)
    made = spark.createDataFrame([(i, "s", i, kind, text, AT + dt.timedelta(seconds=i)) for i, (_, kind, text) in enumerate(suggestions)], SUGGESTION)
    users = spark.createDataFrame([(i, f"n{i}", role) for i, (role, _, _) in enumerate(suggestions)], USER)
    return tally.tallied(snippets, made, users)


def test_two_reviewers_agree(spark):
    row = tallies(spark, "a b c", [("reviewer", "edit", "a X c"), ("editor", "edit", "a X c"), ("reviewer", "confirm", None), ("guest", "confirm", None)]).first()
    (group,) = row["word_changes"]
    assert (group["count"], group["editors"], group["guests"], row["confirms_reviewers"], row["confirms_guests"], row["attention"]) == (2, 1, 0, 1, 1, True)


def test_guests_raise_no_attention_and_equal_edits_confirm(spark):
    row = tallies(spark, "a b c", [("guest", "edit", "a X c")] * 3 + [("reviewer", "edit", "a  b c")]).first()
    (group,) = row["word_changes"]
    assert (group["count"], group["guests"], row["attention"], row["confirms_reviewers"], row["edit_suggestions"]) == (0, 3, False, 1, 3)


@pytest.mark.parametrize("edits, confirms, approvable", [(2, 0, 1), (2, 3, 0), (1, 0, 0), (3, 2, 1)])
def test_approval_plan(spark, edits, confirms, approvable):
    rows = tallies(spark, "a b c", [("reviewer", "edit", "a X c")] * edits + [("reviewer", "confirm", None)] * confirms)
    plan = tally.approval_plan(rows).first()
    assert (plan["changes_applied"], plan["after"]) == (approvable, "a X c" if approvable else "a b c")


def test_library_progress(spark):
    snippets = spark.createDataFrame([("B1", None, 1, False), ("B1", "x", 0, False), ("B1", None, 0, False), ("B1", None, 0, False)], "book_id string, final_text string, suggestion_count long, attention boolean")
    books = spark.createDataFrame([("B1", "t", False), ("B2", "t", False), ("B3", "t", True)], "book_id string, title string, hidden boolean")
    rows = {r["book_id"]: r for r in library.progress(books, snippets).collect()}
    assert (rows["B1"]["finalized"], rows["B1"]["awaiting_approval"], rows["B1"]["untouched"], rows["B1"]["completion_pct"]) == (1, 1, 2, 25.0)
    assert (rows["B2"]["total"], rows["B2"]["completion_pct"]) == (0, 0.0) and "B3" not in rows


def test_upserts(spark):
    old = spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "new", 5), (2, "new", 6), (3, "new", 1)], "k int, v string, t int")
    as_dict = lambda df: {r["k"]: r["v"] for r in df.collect()}
    assert as_dict(merge.upserted_if_newer(old, new, ["k"], "t")) == {1: "old", 2: "new", 3: "new"}
    assert as_dict(merge.upserted(old, new, ["k"], ["t"])) == {1: "new", 2: "new", 3: "new"}
    assert as_dict(merge.inserted(old, new, ["k"])) == {1: "old", 2: "old", 3: "new"}


def test_ingest_keeps_human_work(spark):
    kind = "snippet_id string, page_index int, ai_text string, working_text string, final_text string, suggestion_count long"
    old = spark.createDataFrame([("a", 1, "x", "x", "done", 0), ("b", 1, "x", "x", None, 1), ("c", 1, "x", "x", None, 0), ("d", 1, "x", "y", None, 0)], kind)
    new = spark.createDataFrame([(k, 2, "new") for k in "abcde"], "snippet_id string, page_index int, ai_text string")
    rows = {r["snippet_id"]: r for r in merge.ingested(old, new).collect()}
    assert {k: r["ai_text"] for k, r in rows.items()} == {"a": "x", "b": "x", "c": "new", "d": "x", "e": "new"}
    assert rows["a"]["final_text"] == "done" and rows["e"]["outcome"] == "created" and rows["a"]["page_index"] == 2


EVENT = "doc_id long, ts int, event_id long, reviewer string, text string, is_expert boolean, draft string"


def fold(events):
    state, counts = dict(consensus.START), [0, 0]
    for _, _, _, who, text, expert, draft in sorted(events, key=lambda e: (e[1], e[2])):
        state, role = consensus.step(state, who, text, expert, draft)
        counts[role is None] += 1
    return state["status"], state["final_text"], *counts


def test_consensus_table(spark):
    rng, events = random.Random(3), []
    for doc in range(300):
        for i in range(rng.randrange(1, 7)):
            events.append((doc, i, i, rng.choice("pqr"), rng.choice(["draft ", "X", "Y", " X "]), rng.random() < 0.3, "draft "))
    got = {r["doc_id"]: (r["status"], r["final_text"], r["accepted"], r["rejected"]) for r in consensus.consensus(spark.createDataFrame(events, EVENT), ["doc_id"], ["ts", "event_id"]).collect()}
    assert got == {d: fold([e for e in events if e[0] == d]) for d in got}
    assert {v[0] for v in got.values()} == set(consensus.STATUSES) - {"pending"}


def test_stream_equals_batch(spark, tmp_path):
    rng, events = random.Random(5), []
    for i in range(120):
        events.append((i % 20, i, i, rng.choice("pqr"), rng.choice(["d", "X", "Y"]), rng.random() < 0.3, "d"))
    for k in range(3):
        spark.createDataFrame(events[k * 40 : k * 40 + 40], EVENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = review_stream.consensus(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")))
    seen = []
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: seen.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["doc_id"]: (r["status"], r["final_text"], r["accepted"], r["rejected"]) for r in seen}
    assert got == {d: fold([e for e in events if e[0] == d]) for d in range(20)}


def test_catalog(spark):
    rows = [(i, f"E{i}", "http://x" if i == 1 else "(wait)" if i % 2 else None, f"Work {i}") for i in range(1, 7)]
    entries = spark.createDataFrame(rows, "id long, entry_id string, kosha_link string, prasanga_name string").withColumns({"kavi_name": F.lit(None).cast("string"), "publisher_name": F.lit(None).cast("string")})
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(catalog.searched(entries, kosha="none")) == [2, 3, 4, 5, 6] and ids(catalog.searched(entries, kosha="has")) == [1]
    assert tuple(catalog.facets(entries).first()) == (6, 1, 5) and tuple(catalog.facets(entries, "work 3").first()) == (1, 0, 1)
    assert ids(catalog.searched(entries, kosha="none", limit=2, offset=2)) == [4, 5]


def test_permissions(spark):
    users = spark.createDataFrame([(1, "admin", True, False, "unset"), (2, "admin", False, False, "unset"), (3, "editor", True, True, "unset"), (4, "superadmin", True, False, "pending")], "id long, role string, active boolean, banned boolean, application_status string")
    got = {}
    for r in people.granted(users, people.permission_table(spark)).collect():
        got.setdefault(r["id"], set()).add(r["permission"])
    assert got == {1: set(people.PERMISSIONS) - {"grant_superadmin"}, 2: {"read"}, 4: {"read", "suggest"}}


def test_flags_on_partial_and_empty_readings(spark):
    kind = ", ".join(f"{e} struct<text:string,avg_confidence:double>" for e in ensemble.ENGINES)
    rows = spark.createDataFrame([(("", 0.0), ("", 0.0), ("", None)), (None, ("x", 0.5), None), (("p q", 0.95), ("p  q", 0.99), ("z", None))], kind)
    empty, single, mixed = ensemble.flags(rows, (0x41, 0x24F)).collect()
    assert (empty["majority_agreement"], empty["disagreement"], empty["surya_suspect"], empty["low_confidence"]) == (True, False, True, True)
    assert single["disagreement"] is None and single["sim_easyocr_surya"] is None
    assert (mixed["majority_agreement"], mixed["disagreement"], mixed["low_confidence"], mixed["sim_easyocr_tesseract"]) == (True, True, False, 1.0)


def test_run_files(spark, tmp_path):
    for name, text in (("a", json.dumps([{"book_id": "B", "page_number": 1, "tesseract": {"text": "ಹರಿ", "avg_confidence": 1}}])), ("b", '[{"book_id": "B"')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(text)
    (row,) = readers.run_files(spark, str(tmp_path / "*" / "result.json")).collect()
    assert (row["tesseract"]["text"], row["easyocr"]) == ("ಹರಿ", None)
    assert readers.newest_run(spark, str(tmp_path)).first()["run"].endswith("/b")


def test_bundles_round_trip(spark, tmp_path):
    kind = "book_id string, snippet_id string, " + ", ".join(f"{e} struct<text:string,avg_confidence:double>" for e in ensemble.ENGINES)
    rows = spark.createDataFrame([("B", "B:1:P:0", None, ("t", 0.5), None), ("B", "B:1:P:1", ("e", None), ("t", 0.5), ("s", None))], kind)
    sinks.gzip_bundles(rows, str(tmp_path / "out"))
    got = {r["snippet_id"]: r["readings"] for r in readers.bundle(spark, str(tmp_path / "out")).collect()}
    assert got["B:1:P:0"]["easyocr"] is None and got["B:1:P:1"]["easyocr"]["text"] == "e"


def test_pairs_and_training_rows(spark, tmp_path):
    kind = "book_id string, page_number int, side string, seq int, source string, image_path string, tesseract_text string, refined_text string"
    rows = [("B", 1, "P", i, "human" if i != 2 else "llm", f"{i}.png" if i != 3 else None, "o", "ಹ") for i in range(6)]
    frame = spark.createDataFrame(rows, kind)
    assert export.retrain(frame, 4).first() == (4, 4, True)
    named = export.pair_names(frame, "kan", ["seq"])
    assert [r["stem"] for r in named.orderBy("seq").collect()] == [f"kan_B_1_P_{s}_{i}" for i, s in enumerate((0, 1, 4, 5))]
    out = str(tmp_path)

    def write(name, raw):
        with open(f"{out}/{name}", "wb") as f:
            f.write(raw)

    done = sinks.pairs(named, lambda p: None if p == "1.png" else b"x", write).collect()
    assert sum(r["written"] for r in done) == 3 and (tmp_path / "kan_B_1_P_4_2.gt.txt").read_text() == "ಹ"
    sinks.json_lines(frame, str(tmp_path / "lines"))
    line = next(p for p in (tmp_path / "lines").iterdir() if p.name.startswith("part") and p.stat().st_size).read_text().splitlines()[0]
    assert list(json.loads(line)) == list(export.EXPORT_KEYS) and "ಹ" in line


def test_refine_falls_back_row_by_row(spark):
    from quire.operators import refine

    kind = "id int, " + ", ".join(f"{e} struct<text:string,avg_confidence:double>" for e in ensemble.ENGINES)
    rows = spark.createDataFrame([(1, ("good", 1.0), ("good", 1.0), ("x", 1.0)), (2, ("bad", 1.0), ("", 1.0), None)], kind)

    def call(prompt):
        if "bad" in prompt:
            raise ValueError("no answer")
        return "better"

    got = {r["id"]: (r["refined_text"], r["refined_model"], r["refine_failed"]) for r in refine.refined(ensemble.flags(rows), call, "m", wait=0).collect()}
    assert got == {1: ("better", "m", None), 2: ("bad", "fallback-no-llm", "ValueError: no answer")}
    prompts = rows.select("id", refine.three_reading_prompt(F.lit(True), F.lit(False)).alias("p"), refine.one_reading_prompt("tesseract").alias("q")).orderBy("id").collect()
    assert "Reading C: (empty)" in prompts[1]["p"] and "good" in prompts[0]["p"] and prompts[1]["q"] is None
    own = rows.select("id", refine.three_reading_prompt(F.lit(False), F.lit(False), "Rules {{x}}: {c}|{a}").alias("p")).orderBy("id").collect()
    assert [r["p"] for r in own] == ["Rules {x}: x|good", "Rules {x}: (empty)|bad"]
    with pytest.raises(KeyError):
        refine.three_reading_prompt(F.lit(False), F.lit(False), "{unknown}")


def test_one_reading_is_refined_and_a_blank_one_never_sent(spark):
    from quire.operators import refine

    rows = spark.createDataFrame([(1, ("good",)), (2, (" \t",)), (3, None), (4, ("bad",))], "id int, tesseract struct<text:string>")

    def call(prompt):
        assert prompt.startswith("by tesseract: ")
        if "bad" in prompt:
            raise ValueError("no answer")
        return prompt[14:].upper()

    got = {r["id"]: (r["refined_text"], r["refined_model"], r["refine_failed"]) for r in refine.refined_one(rows, "tesseract", call, "m", wait=0, template="by {engine}: {text}").collect()}
    assert got == {1: ("GOOD", "m", None), 2: (" \t", None, None), 3: ("", None, None), 4: ("bad", "fallback-no-llm", "ValueError: no answer")}


def test_limits_by_route(spark):
    from datetime import datetime, timedelta

    from quire.streaming import review_stream

    at = datetime(2024, 1, 1, 10, 59, 30)
    rows = [("u", "apply", at + timedelta(minutes=k)) for k in range(7)] + [("u", "image", at)] * 900 + [("v", "suggest", at)] * 61 + [("v", "read", at)] * 300 + [("w", "read", at)] * 301 + [(None, "suggest", at)] * 3
    done = review_stream.over_limits(spark.createDataFrame(rows, "user_id string, route string, ts timestamp")).collect()
    # six of the seven applications are in the hour from eleven on
    assert sorted((r["user_id"], r["route"], r["n"]) for r in done) == [("u", "apply", 6), ("v", "suggest", 61), ("w", "read", 301)]


def test_sync_takes_one_row_of_a_snippet_and_counts_the_rest(spark):
    snippets = spark.createDataFrame([("a", "w", None, None), ("b", "w", None, None), ("c", "w", "done", "u0")], "snippet_id string, working_text string, final_text string, finalized_by string")
    sent = spark.createDataFrame([("a", "x", None, None), ("a", "", "fin", " P@x.org"), ("b", "new", None, None), ("b", "new", None, None), ("c", "y", "z", None), ("gone", "y", None, None)], "snippet_id string, working_text string, final_text string, finalized_by_email string")
    emails = spark.createDataFrame([("p@x.org", "u2"), ("P@x.org ", "u1")], "email string, uid string")
    done = merge.synced(snippets, sent, emails)
    got = {r["snippet_id"]: (r["working_text"], r["final_text"], r["finalized_by"], r["applied"]) for r in done.collect()}
    assert got == {"a": ("fin", "fin", "u1", "finalized"), "b": ("new", None, None, "working"), "c": ("w", "done", "u0", "none")} and done.count() == 3
    made = spark.createDataFrame([("a",), ("a",), ("gone",)], "snippet_id string")
    assert merge.sync_counters(done, sent, made).first().asDict() == {"finalizations_applied": 1, "working_text_applied": 1, "skipped": 1, "suggestions_applied": 2}


def test_last_of_several_new_rows_wins(spark):
    old = spark.createDataFrame([(1, "old", 9)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "first", 1), (1, "last", 2)], "k int, v string, t int")
    assert [tuple(r) for r in merge.upserted(old, new, ["k"], ["t"]).collect()] == [(1, "last", 2)]
