"""The corpus pipeline's stages on small rows, and the registration of all queries."""

import random

import corpus_pipeline as P
from quire.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(6)
    parts = {"aa": ["lo", "ti", "ra", "me"], "bb": ["schk", "üng", "zer", "pft"]}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(60))
    out = [(i, text(lang), lang, f"s{i % 3}", 0) for i, lang in enumerate(rng.choice(list(parts)) for _ in range(80))]
    out += [(100, out[0][1], "aa", "s0", 0), (101, out[1][1] + " tail", "aa", None, 0), (102, None, None, "s1", 0), (103, "123 456", None, "s1", 0)]
    return out + [(104, text("aa") + " password=abcdef12345", "aa", "s2", 0), (104, out[5][1], "bb", "s2", 0)]


def test_stages(spark):
    docs = spark.createDataFrame(rows(), DOCS).withColumn("extra", P.F.lit(1))
    steps = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["language_id", "jaccard_join", "secret_scans", "mixing", "packing"]
    one = steps["language_id"](spark, docs, "")
    assert one.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()} == {102, 103}
    two = steps["jaccard_join"](spark, one, "")
    kept = [r["doc_id"] for r in two.collect()]
    assert 100 not in kept and 101 not in kept and {0, 1, 5} <= set(kept) and two.columns == docs.columns
    three = steps["secret_scans"](spark, docs, "")
    found = [r for r in three.collect() if P.REDACTED in (r["text"] or "")]
    assert [r["doc_id"] for r in found] == [104] and "abcdef12345" not in found[0]["text"] and found[0]["n_chars"] == len(found[0]["text"])
    assert three.count() == docs.count() and three.columns == docs.columns
    four = steps["mixing"](spark, docs, "")
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {r["doc_id"] for r in docs.collect()}
    five = steps["packing"](spark, docs, "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in five}) == len(five) >= docs.count()


def test_all_stages_on_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_stages_keep_rows_and_columns_of_any_name(spark):
    """Near duplicates go by row; input columns named as the stages' own, with dots and backticks, come through untouched."""
    word = lambda k, n=60: " ".join(f"{k}{i}" for i in range(n))
    rows = [
        (3, word("a"), "x1"), (7, word("a"), "x2"), (7, word("b"), "x3"), (9, word("b") + " tail", "x4"),
        (5, word("c"), "x5"), (5, word("c"), "x5"), (5, word("c"), "x6"), (None, word("d"), "x7"), (4, word("d"), "x8"),
        (None, word("e"), "x9"), (None, word("e"), "x9"), (11, "", "y1"), (12, None, "y2"), (12, None, "y2"),
    ]
    extra = {"spans": "mine", "score": "mine", "n_assign": "mine", "lang_pred": "mine", "copies": "mine", "a.b": "mine", "c`d": "mine", "chunk": "mine", "cid": "mine"}
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string").withColumns({"lang": P.F.lit("aa"), "source": P.F.lit("s"), "n_chars": P.F.lit(0).cast("long")})
    for name, value in extra.items():
        docs = docs.withColumn(name, P.F.lit(value))
    steps = dict(P.STAGES)
    two = steps["jaccard_join"](spark, docs, "").collect()
    kept = sorted((r["tag"] for r in two))
    assert kept == sorted(["x1", "x3", "x8", "x9", "y1", "y2", "y2"] + [t for t in kept if t in ("x5", "x6")]) and sum(t in ("x5", "x6") for t in kept) == 1
    for name in ("language_id", "jaccard_join", "secret_scans", "mixing"):
        out = steps[name](spark, docs, "")
        assert out.columns == docs.columns
        assert all(r[c] == "mine" for r in out.collect() for c in extra)


def test_mixing_draws_rows_without_id_by_text(spark):
    from quire.llm import mixing

    docs = spark.createDataFrame([(None, f"w{i} " * 5, "s" if i % 2 else "t") for i in range(400)], "doc_id long, text string, source string")
    assert len({r["copies"] for r in mixing.copies(docs).where("source = 's'").collect()}) > 1


def test_without_duplicates_equals_components(spark):
    """What stays is the smallest row of each component that the join finds, over random near copies."""
    from quire.llm import jaccard_join

    rng, base = random.Random(11), [f"b{i}" for i in range(50)]
    rows = []
    for i in range(120):
        w = list(base) if i % 2 else [f"c{i // 10}x{j}" for j in range(40)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(20)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = jaccard_join.grouped(docs, chunk_words=300).collect()
    kept = {r["doc_id"] for r in jaccard_join.without_duplicates(docs, chunk_words=300).collect()}
    assert kept == {r["component_id"] for r in groups}


def test_columns_of_any_type(spark):
    """Maps, structs that hold maps, and intervals come through every stage."""
    word = lambda k: " ".join(f"{k}{i}" for i in range(40))
    docs = spark.createDataFrame([(i, word("ab"[i % 2]), "s") for i in range(6)] + [(7, None, None), (8, "", "s")], "doc_id long, text string, source string").withColumn("lang", P.F.lit("aa"))
    docs = docs.withColumns({
        "m": P.F.create_map(P.F.col("doc_id"), P.F.lit("x")), "s": P.F.struct(P.F.create_map(P.F.lit(1), P.F.array(P.F.lit(2))).alias("a.b")),
        "ym": P.F.expr("INTERVAL '1-3' YEAR TO MONTH"), "y": P.F.expr("INTERVAL '-2' YEAR"), "dt": P.F.expr("INTERVAL '3 04:05:06' DAY TO SECOND"), "b": P.F.expr("X'0102'"),
    })
    before = {r["doc_id"]: r for r in docs.selectExpr("doc_id", "m", "s", "string(ym) ym", "string(y) y", "dt", "b").collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        rows = out.selectExpr("doc_id", "m", "s", "string(ym) ym", "string(y) y", "dt", "b").collect()
        assert rows and all(r == before[r["doc_id"]] for r in rows)
    assert sorted(r["doc_id"] for r in dict(P.STAGES)["jaccard_join"](spark, docs, "").select("doc_id").collect()) == [0, 1, 7, 8]
    assert P.STAGES[-1][1](spark, docs, "").count() == 8


def test_equal_rows_travel_once(spark):
    """A third of all rows, equal in all columns: every task passes on one, and blank ones aren't dealt at all."""
    from quire.llm import jaccard_join

    one, blank = (1, "the same words in every row of them", "s"), (2, " ", "s")
    docs = spark.createDataFrame([one] * 500 + [blank] * 500 + [(10 + i, f"own words {i} and nothing of the others {i} {i}", "s") for i in range(100)], "doc_id long, text string, source string").repartition(4)
    out = [r["doc_id"] for r in jaccard_join.without_duplicates(docs).collect()]
    assert out.count(1) == 1 and out.count(2) == 500 and len(set(out)) == 102


def plain_packing_ok(rows, pieces):
    at, by = {}, {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for of in by.values():
        end = 0
        for offset, length in sorted(of):
            assert offset == end
            end += length
        assert end <= 2048
    for r in pieces:
        at[r["doc_id"]] = at.get(r["doc_id"], 0) + r["length"]
    return set(at) == set(rows)


def test_run_equals_its_stages_one_by_one(spark, tmp_path):
    """run() on a folder of tables: what language ID keeps, without near copies, redacted, mixed and packed."""
    import zlib

    from quire.llm import language_id, mixing, secrets

    docs = spark.createDataFrame(rows(), DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = P.run(spark, str(tmp_path)).collect()
    read = spark.read.parquet(str(tmp_path / "documents.parquet"))
    judged = {(r["doc_id"], r["text"]): r for r in language_id.predicted(read, language_id.learned(read), ("lang_pred", "score")).collect()}
    kept = [r for r in read.collect() if judged[r["doc_id"], r["text"]]["lang_pred"] != "und" and judged[r["doc_id"], r["text"]]["score"] >= P.LEAST_SCORE]
    # near copies by definition: five-word shingles, three quarters of the union, components
    sets = [{tuple((r["text"] or "").lower().split()[i : i + 5]) for i in range(max(1, len((r["text"] or "").split()) - 4))} for r in kept]
    root = list(range(len(kept)))
    for _ in kept:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 75 * len(a | b):
                    root[i] = min(root[i], root[j])
    ids = {}
    for i, r in enumerate(kept):
        ids.setdefault(root[i], []).append(r["doc_id"])
    left = sorted(min(v) for v in ids.values())
    clean = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for k in ids for r in kept if r["doc_id"] == min(ids[k]) and root[kept.index(r)] == k], DOCS)
    assert sorted(r["doc_id"] for r in clean.collect()) == left
    redacted = {}
    for r in clean.collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in secrets.scanned(spark.createDataFrame([r], DOCS)).first()["spans"].split(",") if s] if "password" in r["text"] else []
        text = r["text"]
        for b, e in sorted(spans, reverse=True):
            text = text[:b] + P.REDACTED + text[e:]
        redacted[r["doc_id"]] = text
    counts = {r["doc_id"]: r["copies"] for r in mixing.copies(clean).collect()}
    want = sorted(i for i, n in counts.items() for _ in range(n))
    firsts = sorted(r["doc_id"] for r in got if r["piece"] == 0)
    assert firsts == want and plain_packing_ok(set(want), got)
    from tokenizers import Tokenizer

    from quire.llm import packing

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for r in got:
        own = [*tok.encode(redacted[r["doc_id"]], add_special_tokens=False).ids, 0]
        piece = own[r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece)) == r["ids_crc32"]
