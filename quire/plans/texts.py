"""Queries over readings and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import diff
from quire.functions import text as T
from quire.operators import ensemble
from quire.plans.registry import query



@query("SC9_file_keys", r"SELECT doc_id, coalesce(CAST(nullif(regexp_extract(n, 'IMG_\d{8}_(\d+)_([A-Z])', 1), '') AS INT), 0) AS page, regexp_extract(n, 'IMG_\d{8}_(\d+)_([A-Z])', 2) AS side FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'scan' || doc_id ELSE 'IMG_20240102_' || lpad(doc_id::VARCHAR, 4, '0') || '_' || side || '.tif' END AS n FROM v_snippets)")
def sc9(t):
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("scan"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("IMG_20240102_"), F.lpad(F.col("doc_id").cast("string"), 4, "0"), F.lit("_"), "side", F.lit(".tif")))
    page, side = T.file_key(name)
    return t.snippets.select("doc_id", page.alias("page"), side.alias("side"))


@query("P4_ai_text", "SELECT doc_id, coalesce(nullif(refined, ''), CASE WHEN complete THEN e ELSE t END) AS text FROM v_readings")
def p4(t):
    return t.readings.select("doc_id", ensemble.present_text(F.col("refined_text")).alias("text"))


@query("P5_seed_text", "SELECT doc_id, coalesce(nullif(refined, ''), nullif(e, ''), nullif(t, ''), s, '') AS text FROM v_readings")
def p5(t):
    return t.readings.select("doc_id", ensemble.seed_text(F.col("refined_text")).alias("text"))


@query("P14_sides", "SELECT doc_id, CASE seq + 1 WHEN 1 THEN ['P'] WHEN 2 THEN ['L', 'R'] ELSE list_transform(range(0, seq + 1), lambda i: chr(CAST(65 + i AS INT))) END AS sides FROM v_snippets")
def p14(t):
    from quire.functions.geometry import sides

    return t.snippets.select("doc_id", sides(F.col("seq") + 1).alias("sides"))


@query("P15_minted_names", "SELECT o_orderkey, 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '_P.tif' AS name FROM orders", views=False)
def p15(t):
    return t.raw("orders").select("o_orderkey", T.minted_name(F.col("o_orderdate"), (F.col("o_orderkey") % 10000).cast("int"), F.lit("P")).alias("name"))


@query("P16_image_urls", "SELECT s.doc_id, CASE WHEN s.page_number % 3 = 0 THEN 'https://files.example/' || k ELSE NULL END AS url FROM (SELECT doc_id, page_number, 'books/' || book_id || '/pages/' || page_number || side || '.webp' AS k FROM v_snippets) s")
def p16(t):
    stem = F.concat(F.col("page_number").cast("string"), F.col("side"), F.lit(".tif"))
    key = F.concat(F.lit("books/"), "book_id", F.lit("/pages/"), F.regexp_replace(stem, r"\.tif$", ".webp"))
    asked = t.snippets.select("doc_id", "page_number", key.alias("key"))
    manifest = asked.where("page_number % 3 = 0").select("key", F.concat(F.lit("https://files.example/"), "key").alias("url")).distinct()
    return asked.join(manifest, "key", "left").select("doc_id", "url")


@query("P20_ago", """SELECT event_id, CASE WHEN s IS NULL THEN 'never' WHEN m < 2 THEN 'just now' WHEN m < 60 THEN m || ' min ago' WHEN m < 2880 THEN CAST(floor(m / 60.0 + 0.5) AS BIGINT) || ' h ago' ELSE CAST(floor(m / 1440.0 + 0.5) AS BIGINT) || ' days ago' END AS ago
FROM (SELECT event_id, s, greatest(0, CAST(floor(s / 60.0 + 0.5) AS BIGINT)) AS m FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN event_id * 37 END AS s FROM events))""", views=False)
def p20(t):
    s = F.when(F.col("event_id") % 9 != 0, F.col("event_id") * 37)
    return t.raw("events").select("event_id", T.ago(s).alias("ago"))


@query("P21_S15_safe_names", r"SELECT p_partkey, regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9_.-]', '_', 'g') AS name, replace(url_encode(p_name), '+', '%20') AS quoted FROM part", views=False)
def p21(t):
    return t.raw("part").select("p_partkey", T.safe_name(F.concat("p_name", F.lit(" / "), "p_type")).alias("name"), T.quoted(F.col("p_name")).alias("quoted"))


@query("TX1_normalised", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[^\s\x0B\x1C-\x1F]+'), ' ') AS text FROM documents", views=False)
def tx1(t):
    return t.raw("documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


@query("TX2_flags", """SELECT doc_id, CASE WHEN complete THEN len(list_distinct([ne, nt, ns])) > 1 END AS disagreement, CASE WHEN complete THEN len(list_distinct([ne, nt, ns])) < 3 END AS majority_agreement,
CASE WHEN complete THEN conf < 0.90::DOUBLE OR coalesce(s_conf < 0.90::DOUBLE, false) OR doubtful END AS low_confidence FROM v_readings""")
def tx2(t):
    return ensemble.flags(t.readings, T.LATIN).select("doc_id", "disagreement", "majority_agreement", "low_confidence")


@query("TX3_similarity")
def tx3(t):
    return ensemble.flags(t.readings, T.LATIN).select("doc_id", "sim_easyocr_tesseract", "sim_easyocr_surya", "sim_tesseract_surya")


@query("TX4_consensus_words", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_intersect(a, b), list_intersect(a, c)), list_intersect(b, c)))), ' ') AS words
FROM (SELECT doc_id, regexp_extract_all(coalesce(e, ''), '\S+') AS a, regexp_extract_all(t, '\S+') AS b, regexp_extract_all(coalesce(s, ''), '\S+') AS c FROM v_readings)""")
def tx4(t):
    return t.readings.select("doc_id", F.array_join(T.consensus(*[F.col(f"{e}.text") for e in ensemble.ENGINES]), " ").alias("words"))


@query("TX5_suspect_rules", "SELECT doc_id, s = '' AS empty, length(s) > 1200 AS too_long, length(s) AS n_chars FROM v_readings WHERE complete")
def tx5(t):
    s = F.col("surya.text")
    return t.readings.where("surya IS NOT NULL").select("doc_id", (s == "").alias("empty"), (F.length(s) > T.MOST_CHARS).alias("too_long"), F.length(s).cast("long").alias("n_chars"))


@query("TX5_suspect")
def tx5b(t):
    return ensemble.flags(t.readings, T.LATIN).select("doc_id", "surya_suspect")


@query("TX6_mark_floor", "SELECT doc_id, nullif(greatest(length(coalesce(e, '')) - length(replace(coalesce(e, ''), 'a', '')), length(t) - length(replace(t, 'a', '')), length(coalesce(s, '')) - length(replace(coalesce(s, ''), 'a', ''))), 0) AS n FROM v_readings")
def tx6(t):
    return t.readings.select("doc_id", T.mark_floor("a", *[F.col(f"{e}.text") for e in ensemble.ENGINES]).cast("long").alias("n"))


@query("TX14_fallback", """SELECT doc_id, coalesce(CASE WHEN complete AND len(list_distinct([ne, nt, ns])) < 3 THEN CASE WHEN ne = nt OR ne = ns THEN e WHEN nt = ns THEN t END END, nullif(e, ''), nullif(t, ''), s, '') AS text FROM v_readings""")
def tx14(t):
    rows = ensemble.flags(t.readings, T.LATIN)
    return rows.select("doc_id", ensemble.fallback_text(F.coalesce("majority_agreement", F.lit(False))).alias("text"))


@query("TX15_hints")
def tx15(t):
    rows = ensemble.flags(t.readings, T.LATIN)
    return rows.select("doc_id", ensemble.hint(F.coalesce("majority_agreement", F.lit(False)), F.coalesce("surya_suspect", F.lit(False))).alias("hint"))


@query("TX18_tokens", r"SELECT snippet_id, unnest(regexp_extract_all(working_text, '\S+')) AS token FROM v_snippets")
def tx18(t):
    return t.snippets.select("snippet_id", F.explode(F.regexp_extract_all("working_text", F.lit(r"\S+"), F.lit(0))).alias("token"))


@query("TX19_alignment")
def tx19(t):
    rows = t.readings.where("easyocr IS NOT NULL").select("doc_id", diff.alignment(F.col("tesseract.text"), F.col("easyocr.text")).alias("score"))
    return rows.withColumn("band", diff.score_band(F.col("score")))


@query("TX20_projection")
def tx20(t):
    return t.readings.where("easyocr IS NOT NULL").select("doc_id", diff.project_selection(F.col("tesseract.text"), F.col("easyocr.text"), F.lit(2), F.lit(4)).alias("words"))


@query("TX22_escape_percent", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, printf('%.0f%%', (page_id % 7) / 8.0::DOUBLE * 100) AS share FROM pages""", views=False)
def tx22(t):
    return t.raw("pages").select("page_id", T.escaped(F.col("html")).alias("html"), T.percent((F.col("page_id") % 7) / F.lit(8.0)).alias("share"))


@query("TX23_blank_to_null", "SELECT conv_id, turn, nullif(trim(CASE WHEN turn % 3 = 0 THEN '   ' ELSE '  ' || role || '  ' END), '') AS text FROM conversations", views=False)
def tx23(t):
    return t.raw("conversations").select("conv_id", "turn", T.blank_to_null(F.when(F.col("turn") % 3 == 0, "   ").otherwise(F.concat(F.lit("  "), "role", F.lit("  ")))).alias("text"))


@query("A16_report_totals")
def a16(t):
    return ensemble.report(ensemble.flags(t.readings, T.LATIN))


@query("A19_mean_confidence", "SELECT page_number, coalesce(round(avg(s_conf), 6), 0.0::DOUBLE) AS mean, count(s_conf) AS n FROM v_readings GROUP BY 1")
def a19(t):
    c = F.col("surya.avg_confidence")
    return t.readings.groupBy("page_number").agg(F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias("mean"), F.count(c).alias("n"))


@query("S1_S2_ages", "SELECT event_id, datediff('second', date_trunc('second', ts), TIMESTAMP '2030-01-01') AS age, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS iso FROM events", views=False)
def s1(t):
    sec = F.date_trunc("second", "ts")
    return t.raw("events").select("event_id", F.timestamp_diff("SECOND", sec.cast("timestamp_ntz"), F.lit("2030-01-01").cast("timestamp_ntz")).alias("age"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso"))


@query("S3_S4_round_clamp", "SELECT o_orderkey, round_even((o_orderkey % 1000) / 16.0::DOUBLE, 1) AS r, greatest(1, least(o_orderkey % 500, 200)) AS c FROM orders", views=False)
def s3(t):
    k = F.col("o_orderkey")
    return t.raw("orders").select("o_orderkey", F.bround((k % 1000) / F.lit(16.0), 1).alias("r"), F.greatest(F.lit(1).cast("long"), F.least(k % 500, F.lit(200).cast("long"))).alias("c"))


@query("S5_S6_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, CAST(event_type = 'view' AS INT) AS seen FROM events", views=False)
def s5(t):
    return t.raw("events").select("event_id", F.from_json("props", "k int")["k"].alias("k"), (F.col("event_type") == "view").cast("int").alias("seen"))


@query("S7_cache_keys", "SELECT event_id, substr(sha1(props), 1, 12) AS key FROM events", views=False)
def s7(t):
    return t.raw("events").select("event_id", F.substring(F.sha1("props"), 1, 12).alias("key"))


@query("S7_canonical_keys", """SELECT event_id, substr(sha1('{"a":[' || event_id % 4 || ',null],"k":' || json_extract_string(props, '$.k') || ',"t":{"x":"é","y":true}}'), 1, 12) AS key FROM events""", views=False)
def s7_canonical(t):
    """A value written in two ways, by turns, has one key."""
    k, a = F.get_json_object("props", "$.k"), (F.col("event_id") % 4).cast("string")
    one = F.concat(F.lit('{"t": {"y": true, "x": "é"}, "k": '), k, F.lit(', "a": ['), a, F.lit(", null]}"))
    two = F.concat(F.lit('{ "a":['), a, F.lit(',null],"t":{"x":"\\u00e9","y":true},"k":'), k, F.lit("}"))
    return t.raw("events").select("event_id", T.cache_key(F.when(F.col("event_id") % 2 == 0, one).otherwise(two)).alias("key"))
