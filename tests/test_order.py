"""Ranks, neighbours and running sums without a window over a group, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import _order, _skew


def plain(rows, dense, sums):
    """rows: (g, a, b, v, s) -> {b: (position, prev, next, dense rank, sum before)}; b is unique."""
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for of in by.values():
        of.sort(key=lambda r: (r[1], r[2]))
        keys = sorted({r[1] for r in of})
        total = 0
        for i, r in enumerate(of):
            out[r[2]] = (i + 1, of[i - 1][3] if i else None, of[i + 1][3] if i + 1 < len(of) else None, keys.index(r[1]) + 1, total)
            total += r[4] or 0
    return out


@pytest.mark.parametrize(("ranges", "batch"), [(1, 1000), (7, 3), (40, 1), (200, 5)])
@pytest.mark.parametrize("shape", ["one group", "some", "many", "ties"])
def test_neighbours(spark, ranges, batch, shape):
    rng = random.Random(ranges + batch)
    groups = {"one group": ["g"], "some": ["a", "b", None, "c"], "many": [f"g{i}" for i in range(60)], "ties": ["x", "y"]}[shape]
    rows = [(rng.choice(groups), rng.randrange(2 if shape == "ties" else 30), i, rng.choice(["p", "q", None, f"v{i}"]), rng.choice([None, 1, 5, 1 << 40])) for i in range(150)]
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, (ranges, batch, "false"), strict=True):
            spark.conf.set(k, str(v))
        frame = spark.createDataFrame(rows, "g string, a int, b long, v string, s long").repartition(4)
        out = _order.with_neighbours(frame, "g", ["a", "b"], ("v",), ("a",), ("s",)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {r["b"]: (r["position"], r["prev_v"], r["next_v"], r["page"], r["before_s"]) for r in out} == plain(rows, True, True)


def test_neighbours_of_nothing(spark):
    assert _order.with_neighbours(spark.createDataFrame([], "g string, a int, v string"), "g", ["a"], ("v",)).count() == 0


def test_ranges_are_even_though_groups_are_not(spark):
    """Twenty groups, one with half of the rows: no task has more than twice the median's rows, and no plan a window by group."""
    frame = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20).alias("g"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = sorted(r["count"] for r in _order.in_ranges(frame, ["g", "id"]).groupBy("_p").count().collect())
        plan = _order.with_neighbours(frame, "g", ["id"], ("id",))._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[-1] < 2 * sizes[len(sizes) // 2] and "Window" not in plan


@pytest.mark.parametrize("least", [1, 20, 1000])
def test_group_rows_by_both_ways(spark, monkeypatch, least):
    monkeypatch.setattr(_skew, "LEAST_HOT", least)
    monkeypatch.setattr(_skew, "MOST_HOT", 8)
    rows = spark.createDataFrame([([None, "a", "a", "a", "b", f"c{i}"][i % 6], i) for i in range(90)], "g string, i int")
    per = rows.groupBy("g").agg(F.count("*").alias("total"))
    sizes = {r["g"]: r["total"] for r in per.collect()}
    assert {r["i"]: r["total"] for r in _skew.with_group(rows, per, "g", "total").collect()} == {r["i"]: sizes[r["g"]] for r in rows.collect()}
