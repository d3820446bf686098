"""Text, link and geometry columns on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry, links
from quire.functions import text as T


def one(spark, column, **values):
    rows = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, (t, _) in ((k, v) for k, v in TYPES.items() if k in values)))
    return rows.select(column.alias("x")).first()["x"]


TYPES = {"t": ("string", None), "a": ("string", None), "b": ("string", None), "c": ("string", None), "q": ("array<array<double>>", None)}


@pytest.mark.parametrize("text", ["", "  a  b ", "a b c", "x\x1cy\x1fz", "\n\t"])
def test_words_are_those_of_split(spark, text):
    assert one(spark, T.words(F.col("t")), t=text) == text.split()
    assert one(spark, T.normalised(F.col("t")), t=text) == " ".join(text.split())
    assert one(spark, T.strip(F.col("t")), t=text) == text.strip()
    assert one(spark, T.n_words(F.col("t")), t=text) == len(text.split())


def test_null_texts(spark):
    assert one(spark, T.n_words(F.col("t")), t=None) == 0
    assert one(spark, T.blank_to_null(F.col("t")), t="  ") is None
    assert one(spark, T.truthy(F.col("a"), F.col("b"), F.col("c")), a="", b=None, c="") == ""


def test_consensus_and_marks(spark):
    cols = [F.col(x) for x in "abc"]
    assert one(spark, T.consensus(*cols), a="p q q", b="q r", c="r p z") == ["p", "q", "r"]
    assert one(spark, T.mark_floor("।", *cols), a="x । y ।", b=None, c="।") == 2
    assert one(spark, T.mark_floor("॥", *cols), a="x", b="", c=None) is None


def test_suspect(spark):
    kannada = "ಹರಿ ತುಂಡತನ ವರ್ಣ"
    ask = lambda t, ratio=0.9, script=T.SCRIPT: one(spark, T.suspect(F.col("t"), F.lit(ratio), script), t=t)
    assert ask("") and ask("ಹ" * 1201) and ask("plain latin text")
    assert not ask(kannada) and not ask("plain latin text", script=T.LATIN)
    assert ask(kannada * 4, 0.2) and not ask(kannada, 0.2)


def test_file_keys_and_names(spark):
    page, side = T.file_key(F.col("t"))
    assert one(spark, F.struct(page, side), t="IMG_20240131_0012_L.tif") == (12, "L")
    assert one(spark, F.struct(page, side), t="scan.tif") == (0, "")
    assert one(spark, T.safe_name(F.col("t")), t="ಕಥೆ: a/b") == "ಕಥೆ__a_b"
    assert one(spark, T.percent(F.lit(0.125)), t="") == "12%"


@pytest.mark.parametrize(
    "link, kind",
    [
        ("https://drive.google.com/file/d/Ab-1/view", "drive"),
        ("https://drive.google.com/open?id=Zz_9", "drive"),
        ("https://drive.google.com/drive/x", "unsupported"),
        ("https://www.archive.org/details/item5?x", "archive"),
        ("http://x.example/a.PDF?dl=1", "direct_pdf"),
        ("http://x.example/a.html", "unsupported"),
        ("ftp://x.example/a.pdf", "unsupported"),
        (None, "unsupported"),
    ],
)
def test_link_kinds(spark, link, kind):
    assert one(spark, links.kind(F.col("t")), t=link) == kind


def test_geometry(spark):
    quad = [[0.0, 0.0], [20.0, 0.0], [20.0, 10.0], [0.0, 10.0]]
    assert one(spark, geometry.area(F.col("q")), q=quad) == 200.0
    assert one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=quad)
    # corners may lie outside the page, by a width before it and up to twice its longer side
    assert one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=[[-30.0, 0.0], *quad[1:]])
    assert not one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=[[-31.0, 0.0], *quad[1:]])
    assert not one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(20)), q=[[61.0, 0.0], *quad[1:]])
    assert not one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=[[math.inf, 0.0], *quad[1:]])
    assert not one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=quad[:3])
    assert not one(spark, geometry.valid(F.col("q"), F.lit(30), F.lit(30)), q=[[math.nan, 0.0], *quad[1:]])
    assert one(spark, geometry.ordered(F.col("q")), q=quad[::-1]) == quad
    assert one(spark, geometry.is_spread(F.col("q")), q=quad)
    assert one(spark, geometry.sides(F.lit(3)), t="") == ["A", "B", "C"]


@pytest.mark.parametrize("seconds, words", [(None, "never"), (60, "just now"), (150, "3 min ago"), (3600, "1 h ago"), (200_000, "2 days ago")])
def test_ago(spark, seconds, words):
    assert spark.range(1).select(T.ago(F.lit(seconds).cast("long")).alias("x")).first()["x"] == words
