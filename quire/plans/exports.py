"""Queries over corrections, merges of records and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import export, merge, people
from quire.plans.registry import query
from quire.sources.adapters import Tables


def corrections(t: Tables) -> DataFrame:
    """Corrections derived from snippets: human ones for finalised texts, some without a picture."""
    d = F.col("doc_id")
    return t.snippets.select(
        "doc_id", "book_id", "page_number", "side", "seq", F.col("ai_text").alias("tesseract_text"), F.coalesce("final_text", "ai_text").alias("refined_text"),
        F.when(F.col("final_text").isNotNull(), "human").otherwise("llm").alias("source"), F.when(d % 4 != 0, F.concat(F.lit("crops/"), d.cast("string"), F.lit(".png"))).alias("image_path"),
    )


HUMAN = "FROM v_snippets WHERE final_text IS NOT NULL AND doc_id % 4 <> 0"


@query("F13_ground_truth", f"SELECT doc_id {HUMAN}")
def f13(t):
    return export.ground_truth(corrections(t)).select("doc_id")


@query("A17_retrain_trigger", f"SELECT count(*) AS count, 1000::BIGINT AS threshold, count(*) >= 1000 AS ready {HUMAN}")
def a17(t):
    return export.retrain(corrections(t))


@query("SK3_training_rows", f"SELECT 'crops/' || doc_id || '.png' AS image_path, ai_text AS original_ocr, final_text AS corrected {HUMAN}")
def sk3(t):
    return export.training_rows(corrections(t))


@query("SK4_pair_names", f"SELECT doc_id, concat_ws('_', 'kan', book_id, page_number, side, seq, row_number() OVER (ORDER BY doc_id) - 1) AS stem {HUMAN}")
def sk4(t):
    return export.pair_names(corrections(t).drop("tesseract_text", "refined_text"), "kan", ["doc_id"]).select("doc_id", "stem")


@query("SK5_bundle_rows", "SELECT doc_id, complete AS has_easyocr, t AS tesseract FROM v_readings")
def sk5(t):
    fields = "map<string,struct<easyocr:struct<text:string,avg_confidence:double>,tesseract:struct<text:string,avg_confidence:double>,surya:struct<text:string,avg_confidence:double>>>"
    rows = export.bundles(t.readings).select(F.explode(F.from_json(export.bundle_members(F.col("line")), fields)).alias("snippet_id", "r"))
    return t.readings.select("doc_id", "snippet_id").join(rows, "snippet_id").select("doc_id", F.col("r.easyocr").isNotNull().alias("has_easyocr"), F.col("r.tesseract.text").alias("tesseract"))


@query("U1_SC3_runs", "SELECT doc_id, 'run' || doc_id % 3 AS run FROM v_snippets")
def u1(t):
    from quire.sources.readers import combined

    d = F.col("doc_id")
    runs = [corrections(t).where(d % 3 == k).drop(*(["image_path"] if k == 1 else [])).withColumn("run", F.lit(f"run{k}")) for k in range(3)]
    return combined(runs).select("doc_id", "run")


@query("U2_replace_page", "SELECT doc_id, CASE WHEN page_number % 3 = 1 THEN 'again' ELSE 'first' END AS pass FROM v_snippets WHERE page_number % 3 <> 1 OR side = 'L'")
def u2(t):
    old = t.snippets.select("book_id", "page_number", "side", "seq", "doc_id", F.lit("first").alias("pass"))
    new = old.where("page_number % 3 = 1 AND side = 'L'").withColumn("pass", F.lit("again"))
    return merge.replaced(old, new, ["book_id", "page_number"]).select("doc_id", "pass")


@query("U3_replace_record", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'again' ELSE 'first' END AS pass FROM v_snippets")
def u3(t):
    old = t.snippets.select("book_id", "page_number", "side", "seq", "doc_id", F.lit("first").alias("pass"))
    return merge.replaced(old, old.where("doc_id % 5 = 0").withColumn("pass", F.lit("again")), ["book_id", "page_number", "side", "seq"]).select("doc_id", "pass")


@query("U4_first_spellings", "SELECT lower(n) AS email_key, arg_min(n, k) AS spelling FROM (SELECT n_nationkey + 25 * i AS k, CASE i WHEN 0 THEN upper(n_name) ELSE n_name END AS n FROM nation, range(2) r(i)) GROUP BY 1", views=False)
def u4(t):
    n = t.raw("nation").select(F.col("n_nationkey").alias("k"), F.upper("n_name").alias("n"))
    both = n.unionByName(t.raw("nation").select((F.col("n_nationkey") + 25).alias("k"), F.col("n_name").alias("n")))
    return people.first_seen(both, "n", ["k"]).select("email_key", F.col("n").alias("spelling"))


@query("U5_defaults", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS k, 'none' AS mode FROM events", views=False)
def u5(t):
    given = F.from_json("props", "map<string,string>")
    merged = F.map_from_entries(F.array_union(F.map_entries(F.map_filter(F.create_map(F.lit("k"), F.lit("0"), F.lit("mode"), F.lit("none")), lambda k, v: ~F.array_contains(F.map_keys(given), k))), F.map_entries(given)))
    return t.raw("events").select("event_id", merged.alias("m")).select("event_id", F.col("m")["k"].cast("int").alias("k"), F.col("m")["mode"].alias("mode"))


@query("A18_grouped_pages", "SELECT book_id, page_number || '_' || side AS page, string_agg(snippet_id, ',' ORDER BY seq, snippet_id) AS snippets FROM v_snippets GROUP BY ALL")
def a18(t):
    rows = t.snippets.groupBy("book_id", F.concat_ws("_", "page_number", "side").alias("page")).agg(F.array_sort(F.collect_list(F.struct("seq", "snippet_id"))).alias("l"))
    return rows.select("book_id", "page", F.array_join("l.snippet_id", ",").alias("snippets"))


@query("L7_merged_order", "SELECT snippet_id, row_number() OVER (PARTITION BY book_id ORDER BY page_number, side, seq) AS place FROM v_snippets")
def l7(t):
    from quire.operators.library import positions

    return positions(t.snippets, ["page_number", "side", "seq"]).select("snippet_id", F.col("position").alias("place"))


@query("SK9_report_rows")
def sk9(t):
    from quire.functions.text import LATIN
    from quire.operators.ensemble import flags
    from quire.sources.sinks import report_rows

    return report_rows(flags(t.readings, LATIN))


@query("J17_word_bags", r"""SELECT doc_id, len(list_distinct(list_concat(list_concat(list_intersect(a, b), list_intersect(a, c)), list_intersect(b, c)))) AS common
FROM (SELECT doc_id, regexp_extract_all(coalesce(e, ''), '\S+') AS a, regexp_extract_all(t, '\S+') AS b, regexp_extract_all(coalesce(s, ''), '\S+') AS c FROM v_readings WHERE complete)""")
def j17(t):
    from quire.functions.text import consensus

    common = consensus(*[F.col(f"{e}.text") for e in ("easyocr", "tesseract", "surya")])
    return t.readings.where("easyocr IS NOT NULL").select("doc_id", F.size(common).cast("long").alias("common"))
