"""SQLite tables, two-phase sinks, manifests of files, substring search and keyset pages."""

import gzip
import json
import os
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import postings
from quire.sources import committed, keyset, manifests
from quire.sources.sqlite_rows import sqlite_table

# -- SQLite --------------------------------------------------------------------


@pytest.fixture(scope="module")
def sqlite_files(tmp_path_factory):
    """Three runs; the second lacks a column, the third has odd values."""
    base, rng = tmp_path_factory.mktemp("runs"), random.Random(1)
    rows = {}
    for run in ("a", "b", "c c%"):
        (base / run).mkdir()
        with sqlite3.connect(base / run / "corrections.db") as db:
            extra = "" if run == "b" else ", source TEXT COLLATE NOCASE"
            db.execute(f'CREATE TABLE "corr""ections" (id INTEGER PRIMARY KEY, page INT, score REAL, text VARCHAR(9), raw BLOB{extra})')
            own = []
            for i in rng.sample(range(-50, 4000), 300):
                r = [i, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 2.0, 3]), rng.choice([None, "", "x", "X", "é'", "zz"]), rng.choice([None, b"", b"\x00\x01"])]
                own.append(r + ([] if run == "b" else [rng.choice(["human", "Human", None])]))
            if run == "c c%":
                own.append([9999, "no number", "no real", b"no text", "no blob", 5])
            db.executemany(f'INSERT INTO "corr""ections" VALUES ({", ".join("?" * len(own[0]))})', own)
            db.execute("CREATE TABLE plain (k TEXT PRIMARY KEY, v INT) WITHOUT ROWID")
            db.executemany("INSERT INTO plain VALUES (?, ?)", [(f"{run}{i}", i) for i in range(5)])
            db.execute("CREATE TABLE bare (k TEXT)")
        for r in own:
            keep = [v if v is None or isinstance(v, t) else None for v, t in zip(r[:5], (int, int, (int, float), str, bytes), strict=True)]
            source = None if len(r) < 6 or r[5] is None else str(r[5])  # stored as a text in a text column
            rows[run, r[0]] = (*keep[:2], None if keep[2] is None else float(keep[2]), *keep[3:], source)
    return base, rows


FILTERS = [
    "page = 2", "page <> 2", "page IS NULL", "page IS NOT NULL", "score >= 2", "score < 2.5 AND page IN (1, 3)", "text = 'x'", "text > 'X'", "text IN ('é''', '')", "NOT text IN ('x')", "page <=> 3", "page <=> NULL",
    "source = 'human'", "source IS NULL", "raw = X'0001'", "id BETWEEN 100 AND 120 OR page = 1", "text LIKE 'z%'", "run = 'b' AND page = 1", "page + 1 = 2", "id > 9000 AND page IS NULL", "score = 3",
]


@pytest.mark.parametrize("where", [None, *FILTERS])
def test_sqlite_rows(spark, sqlite_files, where):
    base, rows = sqlite_files
    frame = sqlite_table(spark, f"{base}/*/corrections.db", 'corr"ections', tag="run", rows=97)
    assert frame.columns == ["id", "page", "score", "text", "raw", "source", "run"] and frame.rdd.getNumPartitions() > 100
    kind = "id long, page long, score double, text string, raw binary, source string, run string"
    plain = spark.createDataFrame([(*v, k[0]) for k, v in rows.items()], kind)
    if where:
        frame, plain = frame.where(where), plain.where(where)
    got = lambda df: sorted(repr([bytes(x) if isinstance(x, bytearray) else x for x in r]) for r in df.collect())
    assert got(frame) == got(plain)


def test_sqlite_pushes_filters_and_columns(spark, sqlite_files, tmp_path, capsys):
    base, rows = sqlite_files
    one = f"{base}/a/corrections.db"
    frame = sqlite_table(spark, one, 'corr"ections', columns="text string, id bigint").where("id > 100 AND text = 'x'")
    frame.explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(id), IsNotNull(text), GreaterThan(id,100), EqualTo(text,x)]" in plan and "ReadSchema: struct<text:string,id:bigint>" in plan and "Filter (" not in plan
    assert frame.columns == ["text", "id"] and frame.count() == sum(k[0] == "a" and k[1] > 100 and v[3] == "x" for k, v in rows.items())
    import duckdb

    con = duckdb.connect()
    try:
        con.execute("LOAD sqlite")
    except duckdb.Error:
        with sqlite3.connect(f"file:{one}?mode=ro", uri=True) as db:
            n = db.execute('SELECT count(*), sum(id) FROM "corr""ections" WHERE page = 2').fetchone()
    else:
        n = con.execute(f"SELECT count(*), sum(id) FROM sqlite_scan('{one}', 'corr\"ections') WHERE page = 2").fetchone()
    assert tuple(sqlite_table(spark, one, 'corr"ections').where("page = 2").agg(F.count("*"), F.sum("id")).first()) == tuple(n)
    assert sorted(r["k"] for r in sqlite_table(spark, f"{base}/*/corrections.db", "plain", rows=2).where("v >= 3").collect()) == sorted(f"{r}{i}" for r in ("a", "b", "c c%") for i in (3, 4))
    assert sqlite_table(spark, one, "bare").count() == 0
    for path, table in ((str(tmp_path / "none.db"), "x"), (one, "unknown")):
        with pytest.raises(Exception, match="none.db|no table"):
            sqlite_table(spark, path, table).count()
    assert not (tmp_path / "none.db").exists()
    before = os.stat(one).st_mtime_ns, sorted(os.listdir(base / "a"))
    sqlite_table(spark, one, "plain").collect()
    assert (os.stat(one).st_mtime_ns, sorted(os.listdir(base / "a"))) == before


# -- two-phase sinks -------------------------------------------------------------

RECORD = "book_id string, page_index int, snippet_id string, text string"


def records(pages, version="v", books=("b 1/x", "é")):
    return [(b, p, f"{b}:{p}:{i}", f"{version}{i}" if i else None) for b in books for p in pages for i in range(3)]


def visible(spark, path):
    rows = committed.committed_records(spark, path, "snippet_id string, text string")
    return sorted((r["book_id"], r["page_index"], r["snippet_id"], r["text"] or "") for r in rows.collect())


@pytest.mark.parametrize("kind", ["page_json", "page_bundle"])
def test_pages_grow_and_are_replaced(spark, tmp_path, kind):
    committed.registered(spark)
    path = str(tmp_path / "out")
    write = lambda rows, n: committed.page_rows(spark.createDataFrame(rows, RECORD), columns=["snippet_id", "text"]).write.format(kind).option("path", path).option("commit", n).mode("append").save()
    want = lambda rows: sorted((*r[:3], r[3] or "") for r in rows)
    write(records(range(3)), 0)
    assert visible(spark, path) == want(records(range(3)))
    write(records([3]), 1)
    write(records([1], "new"), 2)
    after = [r for r in records(range(4)) if r[1] != 1] + records([1], "new")
    assert visible(spark, path) == want(after)
    files = {f for _, _, names in os.walk(path) for f in names}
    write(records([0], "again"), 2)  # a commit that was made
    assert visible(spark, path) == want(after) and {f for _, _, names in os.walk(path) for f in names} == files
    one = committed.Store(path).listed()[0]["file"]
    raw = (tmp_path / "out" / one).read_bytes()
    whole = json.loads(gzip.decompress(raw) if kind == "page_bundle" else raw)
    assert isinstance(whole, dict if kind == "page_bundle" else list) and len(whole) == 3


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    committed.registered(spark)
    path = str(tmp_path / "out")
    bad = spark.createDataFrame([("b", p, f"k{p}", "{}" if p < 30 else "no json") for p in range(40)], committed.SCHEMA).repartition(4, "page_index")
    with pytest.raises(Exception, match="JSON|Expecting"):
        bad.write.format("page_json").option("path", path).option("commit", 0).mode("append").save()
    assert committed.Store(path).commits() == {} and committed.committed_pages(spark, path).count() == 0
    committed.Store(path).clean()  # what tasks that were killed had staged
    assert not [f for _, _, names in os.walk(path) for f in names if f.startswith("page-")]


def test_stream_of_pages_commits_each_batch_once(spark, tmp_path):
    committed.registered(spark)
    path = str(tmp_path / "out")
    for p in range(4):
        spark.createDataFrame(records([p, 0], f"v{p}"), RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        rows = committed.page_rows(spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), columns=["snippet_id", "text"])
        run = rows.writeStream.format("page_json").option("path", path).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert run.awaitTermination(120)
    assert len(committed.Store(path).commits()) == 4
    got = visible(spark, path)
    assert len({r[:3] for r in got}) == len(got) == 2 * 3 * 4
    os.remove(f"{path}/_commits/000000000003.json")  # as if the job had died before the last rename: the batch comes again
    writer = committed._StreamWriter(path, False)
    assert writer.store.commits().keys() == {0, 1, 2}


# -- manifests -------------------------------------------------------------------


def test_only_changed_files_are_sent_again(spark, tmp_path):
    for name, text in (("a/1.webp", "x"), ("a/2.webp", "y"), ("b c/3.webp", "z"), ("b c/note.txt", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    now = manifests.listed(spark, str(tmp_path), "*.webp", "web")
    assert sorted(r["key"] for r in now.collect()) == ["a/1.webp", "a/2.webp", "b c/3.webp"]
    sent = spark.createDataFrame(now.collect(), now.schema).select("target", "key", "signature")
    (tmp_path / "a/1.webp").write_text("longer")
    os.utime(tmp_path / "a/2.webp", (1, 1))
    (tmp_path / "a/new.webp").write_text("n")
    os.remove(tmp_path / "b c/3.webp")
    now = manifests.listed(spark, str(tmp_path), "*.webp", "web")
    todo = manifests.changed(now, sent)
    assert sorted(r["key"] for r in todo.collect()) == ["a/1.webp", "a/2.webp", "a/new.webp"]
    scan = next(line for line in todo._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan binaryFile" in line)
    assert "content" not in scan.split("ReadSchema")[1]
    assert [r["key"] for r in manifests.gone(now, sent).collect()] == ["b c/3.webp"]
    after = manifests.merged(sent, todo.select("target", "key", "signature"))
    assert manifests.changed(now, after).count() == 0 and after.count() == 4
    assert manifests.changed(now.withColumn("target", F.lit("local")), after).count() == 3


def test_newest_complete_run(spark, tmp_path):
    def put(name, text, at):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
        os.utime(tmp_path / name, (at, at))

    put("r1/result.json", "[1]", 100)
    put("r1/done.txt", "x", 900)
    put("r2/result.json", "[2]", 300)
    put("x/r3/result.json", "[3]", 200)
    put("x/r3/done.txt", "x", 100)
    put("r4/result.json", "", 500)
    put("r5/other.json", "[]", 999)
    files = manifests.listed(spark, str(tmp_path))
    newest = lambda *needed: [r["run"] for r in manifests.newest_run(files, "result.json", needed).collect()]
    assert newest() == ["r2"] and newest("done.txt") == ["x/r3"] and newest("never") == []
    assert {r["run"]: r["complete"] for r in manifests.runs(files).collect()} == {"r1": True, "r2": True, "x/r3": True}


# -- search ----------------------------------------------------------------------


def test_search_equals_contains(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abÀßİ%_ ") for _ in range(rng.randrange(7)))
    rows = [(i, rng.choice([None, "", word() + word()]), word()) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, name string, email string")
    index = postings.Index(spark, str(tmp_path))
    text = postings.joined([F.col("name"), F.col("email")]).alias("text")
    for part in ("id < 200", "id BETWEEN 200 AND 250", "id > 250"):
        index.add(frame.where(part).select("id", text))
    for step in range(2):
        for needle in ["", "a", "b%", "_", "ß", "À", "abab", "ab ", "nothing at all", *[(r[1] or "x")[1:5] for r in rows[:25]]]:
            hit = lambda c, n=needle: F.contains(F.lower(F.col(c)), F.lit(n.lower()))
            plain = frame.where(F.lit(not needle) | F.coalesce(hit("name"), F.lit(False)) | F.coalesce(hit("email"), F.lit(False)))
            assert sorted(r["id"] for r in index.search(frame, "id", ["name", "email"], needle).collect()) == sorted(r["id"] for r in plain.collect()), needle
            if step and len(needle) > 2:
                break
        index.compact()
        assert len(index.tables()) == 1
    for needle in ("a%b", "_a", "%", "ab_b", "À%İ"):
        plain = frame.where(F.coalesce(F.ilike("name", F.lit(f"%{needle}%")), F.lit(False)) | F.coalesce(F.ilike("email", F.lit(f"%{needle}%")), F.lit(False)))
        assert sorted(r["id"] for r in index.search(frame, "id", ["name", "email"], needle, wildcards=True).collect()) == sorted(r["id"] for r in plain.collect()), needle
    plan = index.candidates("abab")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan


# -- pages by cursor -------------------------------------------------------------


def test_keyset_pages(spark, tmp_path):
    table = keyset.Clustered(spark, str(tmp_path), ["book", "id"])
    rng = random.Random(7)
    rows = [(f"b{rng.randrange(3)}", i, f"v{i}") for i in range(400)]
    kind = "book string, id long, v string"
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.add(spark.createDataFrame(rows, kind))
        n_files = table.index().count()
        seen, cursor, late = [], None, [("a", 9000, "before"), ("b1", 9001, "in"), ("z", 9002, "behind")]
        read = []
        while page := table.page(cursor, 37).collect():
            read.append(len(table.files_of(cursor, 37)))
            seen += [tuple(r) for r in page]
            cursor = (page[-1]["book"], page[-1]["id"])
            if len(seen) == 37:
                table.add(spark.createDataFrame(late, kind))  # rows come while somebody pages
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    old = [r for r in seen if r[1] < 9000]
    assert old == sorted(rows, key=lambda r: r[:2]) and len(set(seen)) == len(seen)
    assert {r[1] for r in seen if r[1] >= 9000} == {9001, 9002}
    assert n_files >= 10 and max(read) <= 6
    assert table.page(None, 0).count() == 1 and table.page(("zz", 0), 10).count() == 0
    assert "And(EqualTo(book,b1),GreaterThan(id,5))" in table.page(("b1", 5), 5)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
