"""URL cascade and embedding dedup against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import embedding_dedup, url_filter

URLS = [
    None, "", "no scheme", "http://", "http://WWW.Example.com/en/x", "https://example.com/en/", "https://example.com/english", "https://a.b.example.com/en/1?q", "http://notexample.com/en/1",
    "http://x.net/es/", "http://net/fr/2", "http://x.net/de/1", "http://x.com", "http://x.com?y=/", "http://x.com#/en/", "ftp://x.org//en/", "http://x.com/", "a://b://c.com/",
]


def judge(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_judged(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"rule": F.lit("clash"), "key": F.lit(1)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()}
    assert got == {i: judge(u) for i, u in enumerate(URLS * 2)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    levels = url_filter.cascade(listed, universe)
    got = {r["key"] for r in universe.where(url_filter.listed_by(levels, F.col("key"))).collect()}
    assert got == set(listed) and len(levels) > 1
    assert sum(len(x.words) for x in levels) * 64 < 20 * len(listed)


def test_empty_pages(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def brute(rows):
    ids = sorted({i for i, _ in rows})
    ok = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=float) / np.linalg.norm(v)
    link = {i: {j for j in ok if i in ok and j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9} for i in ids}
    root = {}
    for i in ids:
        if i not in root:
            todo, root[i] = [i], i
            while todo:
                for j in link[todo.pop()]:
                    if j not in root:
                        root[j] = i
                        todo.append(j)
    return {i: (len(link[i]), root[i], root[i] == i) for i in ids}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    near = lambda c, s: (c + s * rng.standard_normal(16) / 4).tolist()
    centres = rng.standard_normal((40, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    out = [near(c, 0) for c in centres]
    out += [near(centres[0], s) for s in np.linspace(0.1, 0.5, 120)]  # a dense group with a loose rim
    out += [near(centres[k], 0.15) for k in range(1, 20) for _ in range(2)]
    out += [out[3]] * 5  # copies
    out += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.1], [1e-300] * 16]
    return list(enumerate(out))


def test_near_duplicates(spark, vectors):
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "id": F.lit("clash")})
    out, recall = embedding_dedup.near_duplicates(table)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()}
    expected = brute(vectors)
    assert set(got) == set(expected) and recall >= embedding_dedup.RECALL
    assert sum(g[0] for g in got.values()) >= 0.95 * sum(e[0] for e in expected.values())
    assert np.mean([got[i] == expected[i] for i in got]) > 0.95
    assert all(got[i][0] <= expected[i][0] for i in got)


def test_links_between_groups_that_fill_their_lists(spark, monkeypatch):
    """Two groups of 300 vectors whose lists hold only their own members; no links of audit vectors are added."""
    monkeypatch.setattr(embedding_dedup, "AUDIT", 0)
    monkeypatch.setattr(embedding_dedup, "NEIGHBOURS_MOST", 16)
    rng = np.random.default_rng(11)
    axes = np.eye(16)
    angle = np.arccos(0.92)
    centres = [axes[0], np.cos(angle) * axes[0] + np.sin(angle) * axes[1]]
    rows = list(enumerate((c + 0.008 * rng.standard_normal(16)).tolist() for c in centres for _ in range(300)))
    rows += [(1000 + i, rng.standard_normal(16).tolist()) for i in range(20)]
    expected = brute(rows)
    assert expected[300][1] == 0
    out, _ = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == expected


def test_recall_is_not_hidden_by_a_hot_group(spark):
    """A hot group's links are all found; half of the isolated pairs are missed."""
    hot = [(a, b) for a in range(60) for b in range(60) if a != b]
    pairs = [(1000 + i, 2000 + i) for i in range(20)]
    truth = spark.createDataFrame(hot + pairs, "a long, b long")
    roots = spark.createDataFrame([(i, 0) for i in range(60)] + [(x, a) for a, b in pairs[:10] for x in (a, b)], "node long, root long")
    assert embedding_dedup.found_share(truth, roots) == 0.5
    assert embedding_dedup.found_share(truth.limit(0), roots) == 1.0


def test_projections_grow_with_bits():
    for bits in range(1, 25):
        together = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - together) ** embedding_dedup.projections(bits, 0.9) <= embedding_dedup.MISSED


def test_a_recall_that_is_not_reached_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "RECALL", 1.1)
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>"))


def test_no_vectors(spark):
    out, recall = embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert out.count() == 0 and recall == 1.0
    out, _ = embedding_dedup.near_duplicates(spark.createDataFrame([(7, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>"))
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()} == {(7, 0, 7, True), (None, 0, None, True)}
