"""Line dedup, importance resampling and vector codes against brute force, with nulls, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import importance_resampling as R
from quire.llm import line_dedup as L
from quire.llm import vector_codes as V
from quire.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- lines -------------------------------------------------------------------


def plain_lines(rows):
    """(id, text) rows to (id, n_lines, n_dropped, kept)."""
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(-1 if i is None else i)
    last = {k: max(v) for k, v in held.items() if len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if last.get(key(x), -2) in (-2, -1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_rows(n=150, seed=3):
    rng = random.Random(seed)
    shared = [f"Shared line number {k} with É and some words" for k in range(12)] + ["İ" * 20, "short", "x" * 19, "y" * 20, "ſ" * 25]
    rows = []
    for i in range(n):
        lines = [rng.choice([rng.choice(shared), f"own line {i} of this very document {rng.random()}", "", "  "]) for _ in range(rng.randrange(9))]
        lines = [rng.choice([x, x.upper(), f" \t{x}\r", f"\x0b{x}\x0c", f" {x}"]) if rng.random() < 0.5 else x for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(None, None), (None, shared[0] + "\n" + shared[1]), (None, shared[0]), (7, shared[0]), (7, shared[2]), (149, shared[3] + "\n" + shared[3]), (500, ""), (501, "\n"), (502, "\n\n" + shared[5] + "\n")]
    return rows + [(7, shared[0])] * 3 + [(503, shared[4])] * 2 + [(504, "\n".join([shared[4]] * 3000 + ["own"] * 3000))]


def got_lines(out):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=repr)


def test_lines(spark):
    rows = line_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = docs.withColumns({c: F.lit("clash") for c in ("id", "h1", "t1", "pos", "last", "gone", "salt", "hot", "n_dropped", "a.b", "_d0")}).withColumn("m", F.create_map(F.lit(1), F.lit("x")))
    out = L.deduplicated(docs)
    assert set(out.columns) == set(docs.columns) | {"n_lines", "kept_text"}
    assert got_lines(out) == plain_lines(rows)
    assert all(r["id"] == "clash" and r["m"] == {1: "x"} for r in out.collect())


def test_frequent_lines_and_documents_take_the_other_way(spark, monkeypatch):
    """With a bound of one row everything is frequent, and with one in between some is."""
    rows = line_rows(60, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 8):
        monkeypatch.setattr("quire.llm.common.LEAST_HOT", least)
        monkeypatch.setattr("quire.llm.common.MOST_HOT", 10)
        assert got_lines(L.deduplicated(docs)) == plain_lines(rows)


def test_lines_of_nothing_and_of_string_ids(spark):
    assert L.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "the same line in all of the documents"
    out = L.deduplicated(spark.createDataFrame([(c, line) for c in ("a", "b", "c", None)], "doc_id string, text string"))
    assert {r["doc_id"]: r["kept_text"] for r in out.collect()} == {"a": "", "b": "", "c": line, None: ""}


def test_no_python_in_the_lines_plan(spark):
    docs = spark.createDataFrame(line_rows(5), "doc_id long, text string")
    assert "Python" not in (plan := L.deduplicated(docs)._jdf.queryExecution().toString()) and "Arrow" not in plan


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_importance_resampling"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    answer = con.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    got = QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(answer.fetchall(), key=repr)


# -- draws -------------------------------------------------------------------


def plain_features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def plain_draws(rows, target, run=2, m=10000, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % m
    s = Counter(bucket(f) for _, t in rows for f in plain_features(t, run)[1])
    t = Counter(bucket(f) for x in target for f in plain_features(x, run)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + m) / ((s[b] + 1) * (tt + m)))) for b in range(m)]
    out = []
    for i, text in rows:
        words, features = plain_features(text, run)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    ok = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(ok[: percent * len(ok) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def draw_rows(n=300, seed=4):
    rng = random.Random(seed)
    vocabulary = ["Ab", "c1", "É", "naïve", "x-y", "日本", "don't", "0"] + [f"w{k}" for k in range(60)]
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 60])))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "..."), (1003, "w1 " * 200_000)], [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize("run", [1, 2, 3])
def test_draws(spark, run):
    rows, target = draw_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6).withColumns({c: F.lit("clash") for c in ("weight", "_score", "_rank", "_p", "bucket", "a`b")})
    out = R.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), run=run)
    assert set(out.columns) == set(docs.columns) | {"n_features", "score", "rank"}
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(plain_draws(rows, target, run), key=repr)


def test_draws_of_ties_repeats_and_rows_without_id(spark):
    rows = [(k % 3, "one two three four " * 6) for k in range(30)] + [(None, "one two three four " * 6)] * 10
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in R.resampled(docs, docs.select("text")).collect()]
    assert sorted(got, key=repr) == sorted(plain_draws(rows, [t for _, t in rows]), key=repr)


def test_draws_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert R.resampled(none, some).count() == 0
    assert R.resampled(some, none).first()["rank"] is None  # floor(25 * 1 / 100) are drawn


def test_long_texts_keep_their_ring_from_part_to_part(monkeypatch):
    words = [f"w{i}".encode() for i in range(50)]
    whole = np.concatenate(list(R.ring_buckets(words, 3, 1000)))
    monkeypatch.setattr(R, "AT_A_TIME", 7)
    assert np.concatenate(list(R.ring_buckets(iter(words), 3, 1000))).tolist() == whole.tolist()
    assert [R.n_words(len(plain_features(" ".join(["w"] * n), run)[1]), run) for run in (1, 2, 3, 5) for n in range(9)] == [n for _ in range(4) for n in range(9)]


# -- codes -------------------------------------------------------------------


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(id, vector) rows to {position in rows: (code, error)} and the digest, by plain Lloyd rounds."""
    kept = [(k, [math.floor(256 * x) for x in v]) for k, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, hashlib.sha256(b"").hexdigest()
    first = sorted(kept, key=lambda r: (rows[r[0]][0] is None, rows[r[0]][0] or 0, [float(x) for x in rows[r[0]][1]]))
    dim = len(first[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    x = np.array([v for _, v in kept], dtype=object).reshape(len(kept), parts, -1)
    books = np.array([v for _, v in first if len(v) == dim][:entries], dtype=object).reshape(-1, parts, dim // parts)
    near = lambda: [[min(range(len(books)), key=lambda e: (sum((x[i, p] - books[e, p]) ** 2), e)) for p in range(parts)] for i in range(len(x))]
    for _ in range(rounds):
        codes = near()
        new = books.copy()
        for p in range(parts):
            for e in range(len(books)):
                own = [x[i, p] for i in range(len(x)) if codes[i][p] == e]
                if own:
                    new[e, p] = sum(own) // len(own)
        books = new
    codes = near()
    out = {k: ("".join(f"{c:02x}" for c in codes[i]), int(sum(sum((x[i, p] - books[codes[i][p], p]) ** 2) for p in range(parts)))) for i, (k, _) in enumerate(kept)}
    return out, hashlib.sha256(",".join(str(v) for p in range(parts) for e in range(len(books)) for v in books[e, p]).encode()).hexdigest()


def vector_rows(n, dim, seed, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("n", "dim", "spread"), [(400, 32, 0.3), (300, 16, 0.001), (90, 48, 3.0), (20, 32, 0.5), (1, 16, 1.0)])
def test_codes(spark, monkeypatch, n, dim, spread):
    monkeypatch.setattr(V, "BLOCK_ROWS", 37)
    rows = vector_rows(n, dim, n, spread)
    bad = [None, [None] * dim, [math.nan] + [0.0] * (dim - 1), [math.inf] * dim]
    rows += [(1000 + k, v) for k, v in enumerate(bad)] + [(0, rows[0][1]), (None, rows[0][1]), (None, [1.0] * dim)] + [(2000, rows[0][1])] * 3
    frame = spark.createDataFrame([(i, v, k) for k, (i, v) in enumerate(rows)], "vec_id long, embedding array<float>, at int").repartition(3)
    frame = frame.withColumns({c: F.lit("clash") for c in ("x", "n", "code", "k", "_c0", "a.b")}).withColumn("list", F.array(F.lit(1), F.lit(2)))
    out, codes = V.compressed(frame)
    expected, digest = plain_codes(rows)
    assert {r["at"]: (r["code"], r["error"]) for r in out.collect()} == expected and codes.digest() == digest
    assert set(out.columns) == set(frame.columns) - {"embedding"} | {"error"} and all(r["list"] == [1, 2] and r["x"] == "clash" for r in out.collect())


def test_rounds_compare_only_what_drift_has_reached(spark):
    """Clusters apart from each other: after the first round few parts are compared again, with the same result."""
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(64)]
    rows = [(i, [c + rng.gauss(0, 0.01) for c in centres[i % 64]]) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    codes = V.Codes(frame, "embedding", "vec_id", 16, 64)
    turns = [codes.turn() for _ in range(5)]
    assert turns[0] == 600 * 16 and 0 < turns[1] < turns[0] / 2 and turns[4] == 0
    out, digest = plain_codes(rows, rounds=5)
    assert {r["_c0"]: (r["_code"], r["_error"]) for r in codes.coded().collect()} == out and codes.digest() == digest


def test_other_lengths_empty_tables_and_large_numbers(spark):
    schema = "vec_id long, embedding array<double>, label int"
    rows = [(5, [1.0] * 16, 1), (6, [2.0] * 32, 1), (7, [], None), (8, [3.0] * 16, None)]
    out, _ = V.compressed(spark.createDataFrame(rows, schema))
    assert {r["vec_id"]: r["code"] for r in out.collect()} == {5: "00" * 16, 8: "01" * 16, 6: None, 7: None}
    for some in ([], [(1, None, 1)], [(1, [1.0] * 15, 1)], [(1, [], 1)]):
        out, codes = V.compressed(spark.createDataFrame(some, schema))
        assert [r["code"] for r in out.collect()] == [None] * sum(v is not None for _, v, _ in some) and codes.digest() == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError, match="long"):
        V.compressed(spark.createDataFrame([(1, [1e300] * 16, 1)], schema))
    large = [(k, [float(k * 1e4 + j) for j in range(16)]) for k in range(70)]
    out, codes = V.compressed(spark.createDataFrame(large, "vec_id long, embedding array<double>"))
    expected, digest = plain_codes(large)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out.collect()} == expected and codes.digest() == digest


@pytest.mark.parametrize("least", [1, 5, 1000])
def test_group_errors(spark, monkeypatch, least):
    monkeypatch.setattr("quire.llm.common.LEAST_HOT", least)
    monkeypatch.setattr("quire.llm.common.MOST_HOT", 8)
    rows = [(k, [3, None, 1, 3, 3][k % 5], k) for k in range(40)] + [(99, 7, None)]
    out = V.with_group_errors(spark.createDataFrame(rows, "vec_id long, label int, error long"), "label", "label_error").collect()
    total = defaultdict(int)
    for _, g, e in rows:
        total[g] += e or 0
    assert sorted((r["vec_id"], r["label_error"]) for r in out if r["label"] != 7) == [(k, total[g]) for k, g, _ in rows[:-1]]
    assert len(out) == len(rows)


def test_registered_codes(spark):
    got = QUERIES["op13_vector_codes"](spark, SMALL).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    expected, digest = plain_codes(rows)
    by_id = {rows[k][0]: v for k, v in expected.items()}
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == by_id and {r["codebooks_sha256"] for r in got} == {digest}
    total = Counter()
    for i, (_, e) in by_id.items():
        total[label[i]] += e
    assert all(r["label_error"] == total[label[r["vec_id"]]] for r in got)
