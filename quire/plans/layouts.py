"""Queries over geometry and layout; quads and profiles are derived from line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout
from quire.plans.registry import query
from quire.sources.adapters import Tables


def quads(t: Tables) -> DataFrame:
    """A quad per part: a box with one corner moved."""
    k = F.col("p_partkey")
    x, y, w, h = (k % 7).cast("double"), (k % 5).cast("double"), (F.lit(10) + k % 90).cast("double"), (F.lit(5) + k % 60).cast("double")
    point = lambda a, b: F.array(a, b)
    return t.raw("part").select("p_partkey", F.array(point(x, y), point(x + w, y), point(x + w + k % 3, y + h), point(x, y + h)).alias("quad"))


QUADS = "(SELECT p_partkey, (p_partkey % 7)::DOUBLE AS x, (p_partkey % 5)::DOUBLE AS y, (10 + p_partkey % 90)::DOUBLE AS w, (5 + p_partkey % 60)::DOUBLE AS h, (p_partkey % 3)::DOUBLE AS m FROM part)"
AREA = "(h * (2 * w + m) / 2)"


@query("S9_area", f"SELECT p_partkey, {AREA} AS area FROM {QUADS}", views=False)
def s9(t):
    return quads(t).select("p_partkey", G.area(F.col("quad")).alias("area"))


VALID = f"greatest(x + w + m, y + h) <= 80 AND {AREA} >= 100"


@query("F18_valid_regions", f"SELECT p_partkey, {VALID} AS ok FROM {QUADS}", views=False)
def f18(t):
    return quads(t).select("p_partkey", G.valid(F.col("quad"), F.lit(40.0), F.lit(30.0)).alias("ok"))


@query("F18_valid_pages", f"SELECT p_partkey // 10 AS page, count(*) <= 8 AND bool_and({VALID}) AS ok FROM {QUADS} WHERE p_partkey % 10 <= p_partkey // 10 % 11 GROUP BY 1", views=False)
def f18_pages(t):
    """Pages of one to ten regions."""
    page = F.floor(F.col("p_partkey") / 10)
    rows = quads(t).where(F.col("p_partkey") % 10 <= page % 11).groupBy(page.alias("page")).agg(F.collect_list("quad").alias("quads"))
    return rows.select("page", G.valid_page(F.col("quads"), F.lit(40.0), F.lit(30.0)).alias("ok"))


@query("S11_spreads", f"SELECT p_partkey, (w + (w + m)) / (h + sqrt(m * m + h * h)) > 1.15::DOUBLE AS spread FROM {QUADS}", views=False)
def s11(t):
    return quads(t).select("p_partkey", G.is_spread(F.col("quad")).alias("spread"))


@query("S12_ordered_points", f"SELECT p_partkey, x AS x0, y AS y0, x + w AS x1, y AS y1, x + w + m AS x2, y + h AS y2, x AS x3, y + h AS y3 FROM {QUADS}", views=False)
def s12(t):
    turned = quads(t).withColumn("quad", F.reverse("quad"))
    o = F.col("o")
    return turned.select("p_partkey", G.ordered(F.col("quad")).alias("o")).select("p_partkey", *[o[i][j].alias(f"{c}{i}") for i in range(4) for j, c in enumerate("xy")])


@query("S13_scaled", f"SELECT p_partkey, 4 * {AREA} AS area FROM {QUADS}", views=False)
def s13(t):
    return quads(t).select("p_partkey", G.area(G.scaled(F.col("quad"), F.lit(2.0))).alias("area"))


@query("S8_margins", "SELECT p_partkey, CAST(greatest(4, least(60, floor((-(100 + p_size)::DOUBLE + sqrt(greatest((100 + p_size)::DOUBLE * (100 + p_size) - 4 * (100.0::DOUBLE * p_size - (p_partkey % 900) / 0.07::DOUBLE), 0))) / 4))) AS INT) AS margin FROM part", views=False)
def s8(t):
    return t.raw("part").select("p_partkey", G.ink_margin(F.lit(100), F.col("p_size"), F.col("p_partkey") % 900).alias("margin"))


@query("IM5_runs", """WITH p AS (SELECT DISTINCT l_orderkey % 50 AS page, CAST(l_partkey % 400 AS INT) AS x FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x) AS run FROM n)
SELECT page, min(x) AS start, max(x) + 1 AS "end" FROM r GROUP BY page, run HAVING max(x) + 1 - min(x) >= 4""", views=False)
def im5(t):
    p = t.raw("lineitem").where("l_returnflag = 'R'").select((F.col("l_orderkey") % 50).alias("page"), (F.col("l_partkey") % 400).cast("int").alias("at"), F.lit(1).alias("value")).distinct()
    return layout.runs(p, "page", "at", 2, 4)


@query("W8_snippet_sequence", "SELECT doc_id, row_number() OVER (PARTITION BY book_id, page_number ORDER BY side, seq, doc_id) - 1 AS sequence FROM v_snippets")
def w8(t):
    boxes = t.snippets.select("doc_id", F.concat_ws(":", "book_id", "page_number").alias("page"), F.when(F.col("side") == "L", 0).otherwise(1).alias("column_index"), F.struct("seq", "doc_id").alias("y0"))
    return layout.sequenced(boxes, "page").select("doc_id", F.col("sequence").cast("long").alias("sequence"))


@query("IM8_sliced_pages")
def im8(t):
    """Small pages with two inked blocks each, sliced."""
    import pandas as pd

    def draw(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for k in pdf["page_id"]:
                page = np.full((120, 160), 255, np.uint8)
                page[5 : 25 + k % 20, 5:60] = 0
                page[60:90, 90 : 140 + k % 15] = 0
                rows.append((f"p{k}", 160, 120, page.tobytes()))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "content"])

    return layout.sliced(t.raw("pages").select("page_id").mapInPandas(draw, "path string, width int, height int, content binary"))


@query("IM9_trimmed", """WITH p AS (SELECT p_partkey, 20 + p_size AS h, 30 + p_partkey % 50 AS w FROM part),
m AS (SELECT *, greatest(4, least(60, floor((-(w + h)::DOUBLE + sqrt(greatest((w + h)::DOUBLE * (w + h) - 4 * (w * h - (w * h) / 0.07::DOUBLE), 0))) / 4))) AS m FROM p)
SELECT 'p' || p_partkey AS path, CAST(w + 2 * m AS INT) AS width, CAST(h + 2 * m AS INT) AS height, CAST(2 * m * (w + h + 2 * m) AS BIGINT) AS n_paper FROM m""", views=False)
def im9(t):
    """A block of ink on a larger crop, a part each."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 64):  # so many crops at once
                rows = []
                for k, size in pdf[at : at + 64].itertuples(index=False):
                    crop = np.full((200, 250), 240, np.uint8)
                    crop[30 : 50 + size, 40 : 70 + k % 50] = 20
                    rows.append((f"p{k}", 250, 200, crop.tobytes()))
                yield pd.DataFrame(rows, columns=["path", "width", "height", "content"])

    # parts are a small table, their pictures aren't
    parts = t.raw("part").select("p_partkey", "p_size").repartition(4 * t.spark.sparkContext.defaultParallelism, "p_partkey")
    out = layout.trimmed(parts.mapInPandas(draw, layout.PAGES))
    paper = F.length(F.replace(F.decode("content", "ISO-8859-1"), F.lit("\x14")))
    return out.select("path", "width", "height", paper.cast("long").alias("n_paper"))
