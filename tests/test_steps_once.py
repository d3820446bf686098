"""Steps that are done once, on little at a time, however a query reads them."""

import random
from datetime import datetime
from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import functions as F

from quire.functions import diff, images
from quire.operators import ensemble, export, library, machine, postings, tally, versions
from quire.plans import review
from quire.sources import scratch
from quire.sources.adapters import Tables
from quire.streaming.live_tally import LiveTally

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_state_writes_nothing_and_compares_once(spark, monkeypatch):
    def none(_):
        raise AssertionError("a table was written")

    monkeypatch.setattr(scratch, "folder", none)
    assert plan(review.state(Tables(spark, SMALL))).count("ArrowEvalPython") == 1


def test_word_marks_compare_once(spark):
    t = Tables(spark, SMALL)
    assert plan(tally.word_marks(tally.groups(tally.each_change(t.snippets, t.suggestions, t.users)))).count("ArrowEvalPython") == 1


def test_texts_of_suggestions_stay_out_of_the_join_with_users(spark):
    t = Tables(spark, SMALL)
    above = plan(tally.each_change(t.snippets, t.suggestions, t.users)).split("ArrowEvalPython")[0]
    assert "user_id" in above and "Join Inner" in above


def test_words_shared_at_the_ends_are_not_compared(monkeypatch):
    rng = random.Random(5)
    for unique in (True, False):
        for _ in range(400):
            words = [f"w{i}" for i in range(12)] if unique else rng.choices("abc", k=12)
            other = [w for w in words if rng.random() > 0.15]
            for _ in range(rng.randrange(3)):
                other.insert(rng.randrange(len(other) + 1), f"n{rng.randrange(99)}" if unique else rng.choice("abc"))
            full = [s for s in SequenceMatcher(None, words, other, autojunk=False).get_opcodes() if s[0] != "equal"]
            assert diff._opcodes(words, other) == full
            assert diff.anchors(words, other) == diff._anchors(words, other)
            assert diff.alignment_score(" ".join(words), " ".join(other)) == diff._score(len(diff._anchors(words, other)), len(words) + len(other))
    seen = []
    monkeypatch.setattr(diff, "SequenceMatcher", lambda j, a, b, autojunk: (seen.append(len(a) + len(b)), SequenceMatcher(j, a, b, autojunk=autojunk))[1])
    text = [f"w{i}" for i in range(100)]
    assert diff.word_changes(" ".join(text), " ".join([*text[:50], "x", *text[51:]])) == [{"start": 50, "end": 51, "original": "w50", "replacement": "x"}]
    assert seen == [2]


def test_fold_is_not_done_again_for_a_filter(spark):
    rows = spark.createDataFrame([(1, 0, 0, "enqueue", None, None)], "item_id long, at long, event_id long, event string, n int, text string")
    done = machine.queue().fold(rows, ["item_id"], ["at", "event_id"]).where("status = 'queued'").select("item_id", "status")
    assert plan(done).count("collect_list") == 1 and plan(done).count("lambdafunction(") < 60
    assert "aggregate(" not in "".join(x for x in plan(done).splitlines() if "Filter" in x)
    assert done.collect() == [(1, "queued")]


def test_hints_find_shared_words_once(spark):
    kind = "struct<text:string,avg_confidence:double>"
    rows = spark.createDataFrame([(("a b", 0.9), ("a  c", 0.9), ("d", 0.9))], f"easyocr {kind}, tesseract {kind}, surya {kind}")
    told = rows.select(ensemble.hint(F.lit(False), F.lit(False)).alias("h"), ensemble.hint(F.lit(True), F.lit(True)).alias("g"))
    assert plan(told.select("h")).count("array_distinct") == 4  # a set for each reading, and the words of two
    line = "Words that two or more readings share: a"
    assert told.first() == (f"\n{line}\n", f"\n{ensemble.LINES['agree']}\n{line}\n{ensemble.LINES['doubt']}\n")


def test_pair_names_with_wide_rows(spark):
    """Sizes of ranges and places in them were once taken from two sorts, whose ranges differed."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.parallelismFirst", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("100k", "false", "16"), strict=True):
            spark.conf.set(k, v)
        rows = spark.range(3000).select(
            F.lit("B").alias("book_id"), F.lit(1).alias("page_number"), F.lit("P").alias("side"), F.col("id").alias("seq"), F.lit("human").alias("source"), F.lit("x.png").alias("image_path"),
            F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 256) for i in range(4)]).alias("tesseract_text"), F.lit("").alias("refined_text"),
        )
        got = {r["seq"]: r["stem"] for r in export.pair_names(rows, "kan", ["seq"]).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: f"kan_B_1_P_{i}_{i}" for i in range(3000)}


def test_bundles_hold_no_book(spark):
    kind = "book_id string, snippet_id string, " + ", ".join(f"{e} struct<text:string,avg_confidence:double>" for e in ensemble.ENGINES)
    rows = spark.createDataFrame([("B", f"B:{i:02d}", None, (f'{{"t{i}",', 0.5), None) for i in range(20)], kind)
    lines = export.bundles(rows).orderBy("part", "snippet_id").collect()
    assert len(lines) == 22
    import json

    whole = json.loads("\n".join(r["line"] for r in lines))
    assert list(whole) == [f"B:{i:02d}" for i in range(20)] and whole["B:07"] == {"tesseract": {"text": '{"t7",', "avg_confidence": 0.5}}


def test_book_texts_are_joined_by_blocks(spark):
    rows = spark.createDataFrame([("A", p, s, f"A:{p}:{s}", None, f"l{p}.{s}") for p in (0, 255, 256, 600) for s in (0, 1)] + [("B", 1, 0, "B:1:0", None, " ")], "book_id string, page_index int, seq int, snippet_id string, final_text string, working_text string")
    texts = library.book_texts(rows)
    assert plan(texts).count("collect_list") == 2
    assert dict(map(tuple, texts.collect())) == {"A": "\n\n".join(f"l{p}.0\nl{p}.1" for p in (0, 255, 256, 600)) + "\n", "B": "\n"}


def test_levels_give_the_median():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 10):
        for _ in range(50):
            x = rng.integers(0, 256, n, dtype=np.uint8)
            assert images.median(images.levels(x)) == int(np.median(x))


def test_index_deals_texts_of_one_file(spark, tmp_path, monkeypatch):
    parts = []
    index = postings.Index(spark, str(tmp_path))
    monkeypatch.setattr(index, "_write", lambda pairs: parts.append(pairs.rdd.getNumPartitions()))
    index.add(spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id long, text string").coalesce(1))
    assert parts[0] >= spark.sparkContext.defaultParallelism


def test_kept_tally_compares_a_batch_once(spark, tmp_path, monkeypatch):
    live = LiveTally(spark, str(tmp_path), buckets=2)
    monkeypatch.setattr(scratch, "folder", lambda _: str(tmp_path / "batch"))
    seen = []
    for log in (live.groups, live.counts, live.votes):
        monkeypatch.setattr(log, "upsert", lambda rows, k: seen.append(plan(rows).count("ArrowEvalPython")))
    batch = spark.createDataFrame([("s", 1, 1, datetime(2024, 1, 1), "edit", "a c", False)], "snippet_id string, user_id long, id long, ts timestamp_ntz, kind string, text string, gone boolean")
    live.apply(batch, 0, spark.createDataFrame([("s", "a b", None)], "snippet_id string, working_text string, final_text string"), spark.createDataFrame([(1, "N", "editor")], "id long, name string, role string"))
    assert seen == [0, 0, 0]


def test_store_finds_tables_once(spark, tmp_path, monkeypatch):
    """What an applied version makes of suggestions and snippets is written before it is counted."""
    t = Tables(spark, SMALL)
    store = versions.ReviewStore(spark, str(tmp_path))
    votes = t.suggestions.select("snippet_id", "user_id", "kind", "text", "ts")
    zero = t.snippets.select("snippet_id", F.lit(0).cast("long").alias("suggestion_count"), F.lit(False).alias("attention"))
    store.put({"users": t.users, "snippets": t.snippets, "suggestions": votes, "counts": zero})
    version, held, real = store.save(review.sent_payload(t), "import"), [], versions.applied
    monkeypatch.setattr(versions, "applied", lambda *a: (held.append(real(*a)), held[0])[1])
    store.apply(version)
    assert "max_by" not in plan(held[0].counts) and set(store.table("snippets").columns) == set(t.snippets.columns)


def test_texts_travel_once_and_after_people(spark):
    """A state without texts makes each piece's text for the comparison only; people and labels are joined to rows without any."""
    t = Tables(spark, SMALL)
    made = plan(review.marked(t).select("snippet_id", "final_text", "attention"))
    assert made.count("array_join(transform(") == 1
    above = plan(review.each(t)).split("array_join(transform(")[0]
    assert "Join LeftOuter" in above and "Join Inner, (doc" in above.replace("((doc", "(doc") and "c_custkey" not in plan(t.pieces)
    assert "labels" not in str(t.pieces.inputFiles())


def test_pieces_carry_no_other_words(spark):
    made = plan(Tables(spark, SMALL).pieces)
    explode = next(x for x in made.splitlines() if "Generate" in x)
    assert "slice(" in explode


def test_rows_of_few_files_are_dealt_whatever_their_size(spark, monkeypatch):
    from quire.sources import adapters

    monkeypatch.setattr(adapters, "SHARE", 1 << 10)
    rows = Tables(spark, SMALL).spread("documents", "doc_id")
    assert rows.rdd.getNumPartitions() > 100 and rows.count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()


def test_texts_without_a_plan_are_not_sent(spark):
    assert "_apply(CASE WHEN" in plan(tally.approval_plan(review.state(Tables(spark, SMALL), review.PLANNED)))


def test_replaced_word():
    a, b = "x y  z ".split(), "x fix\nmore z".split()
    assert diff._cut("x y  z ", a, 1, 3) == "y  z" and diff._cut("x fix\nmore z", b, 1, 3) == "fix\nmore" and diff._cut("x", ["x"], 0, 1) == "x" and diff._cut("x", ["x"], 1, 1) == ""
    assert diff.word_changes("x y z", "x z") == [{"start": 1, "end": 2, "original": "y", "replacement": ""}]
    assert diff.word_changes("x y z", "x y z") == []


def test_applied_counts_read_no_text(spark, tmp_path, monkeypatch):
    """Changes are found while suggestions are merged and written with them; texts don't go through the join with people."""
    t = Tables(spark, SMALL)
    store = versions.ReviewStore(spark, str(tmp_path))
    store.put({"users": t.users, "snippets": t.snippets})
    t = t.over(store.table("snippets"))
    votes = t.suggestions_beside.select("snippet_id", "user_id", "kind", "text", "ts", tally.changes_of("current_text").alias("changes"))
    store.put({"suggestions": votes, "counts": lambda done: versions.counted(t.snippets, done["suggestions"], t.users)})
    assert store.table("suggestions").columns == ["snippet_id", "user_id", "kind", "text", "ts"]
    version, held, real = store.save(review.sent_payload(t), "import"), [], versions.applied
    monkeypatch.setattr(versions, "applied", lambda *a: (held.append(real(*a)), held[0])[1])
    store.apply(version)
    assert "ArrowEvalPython" not in plan(held[0].counts)


def test_rows_meet_whole_documents(spark):
    """Suggestions find their texts by document, as documents come dealt; no snippet's text is dealt again."""
    made = plan(Tables(spark, SMALL).suggestions)
    assert "Generate explode" not in made and made.count("array_join(transform(") == 1


def test_kept_tally_moves_no_text(spark, tmp_path, monkeypatch):
    """What the kept tallies take is cut from the documents once, for all batches."""
    cut, real = [], Tables.with_texts
    monkeypatch.setattr(Tables, "with_texts", lambda *a: (cut.append(1), real(*a))[1])
    live = review.kept_tally(Tables(spark, SMALL))
    assert len(cut) == 1 and "text" not in live.votes.current().columns
