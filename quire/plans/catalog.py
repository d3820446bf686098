"""Queries over the catalog and links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import links
from quire.operators import catalog, postings
from quire.operators._order import with_neighbours
from quire.plans.registry import query
from quire.sources import scratch
from quire.sources.adapters import Tables


def joined(t: Tables) -> DataFrame:
    return catalog.joined(t.catalog, **t.dimensions)


def queue(t: Tables) -> DataFrame:
    from quire.operators.consensus import queue_state

    return queue_state(t.queue_events, "item_id", ["ts", "event_id"]).select("item_id", (F.col("item_id") % 50).alias("catalog_entry_id"), "status")


@query("J1_catalog_star", "SELECT id, entry_id, kavi_name, prasanga_name, publisher_name FROM v_entries")
def j1(t):
    return joined(t).select("id", "entry_id", "kavi_name", "prasanga_name", "publisher_name")


MATCH = "(entry_id ILIKE '%{0}%' OR coalesce(prasanga_name ILIKE '%{0}%', false) OR coalesce(kavi_name ILIKE '%{0}%', false) OR coalesce(publisher_name ILIKE '%{0}%', false))"


@query("F1_search", f"SELECT id FROM v_entries WHERE {MATCH.format('e_1')} ORDER BY id LIMIT 200")
def f1(t):
    return catalog.searched(joined(t), "  e_1 ", limit=1000).select("id")


@query("F1_indexed_search", f"SELECT id FROM v_entries WHERE {MATCH.format('e_1')}")
def f1_indexed(t):
    """All entries that a search finds, by an index of trigrams."""
    rows, fields = joined(t), ["entry_id", "prasanga_name", "kavi_name", "publisher_name"]
    index = postings.Index(t.spark, scratch.folder(t.spark))
    index.add(rows.select("id", postings.joined([F.col(c) for c in fields]).alias("text")))
    return index.search(rows, "id", fields, "e_1", wildcards=True).select("id")


@query("F2_has_link", "SELECT id FROM v_entries WHERE has_link ORDER BY id LIMIT 200")
def f2(t):
    return catalog.searched(joined(t), kosha="has", limit=200).select("id")


@query("F2_no_link", "SELECT id FROM v_entries WHERE NOT has_link ORDER BY id LIMIT 200")
def f2b(t):
    return catalog.searched(joined(t), kosha="none", limit=200).select("id")


@query("L1_paging", "SELECT id FROM v_entries ORDER BY id OFFSET 20 LIMIT 10")
def l1(t):
    return catalog.searched(joined(t), limit=10, offset=20).select("id")


@query("A12_facets", f"SELECT count(*) AS \"any\", count(*) FILTER (has_link) AS has, count(*) FILTER (NOT has_link) AS none FROM v_entries WHERE {MATCH.format('an')}")
def a12(t):
    return catalog.facets(joined(t), "AN")


@query("P8_link_kind", "SELECT id, kind FROM v_kinds")
def p8(t):
    return t.catalog.select("id", links.kind(F.col("prati_link")).alias("kind"))


@query("P9_P10_link_ids", "SELECT id, drive_id, archive_id FROM v_kinds")
def p9(t):
    return t.catalog.select("id", links.drive_id(F.col("prati_link")).alias("drive_id"), links.archive_id(F.col("prati_link")).alias("archive_id"))


@query("P11_preview", "SELECT id, CASE kind WHEN 'drive' THEN 'https://drive.google.com/file/d/' || drive_id || '/preview' WHEN 'archive' THEN 'https://archive.org/embed/' || archive_id WHEN 'direct_pdf' THEN prati_link END AS preview_url FROM v_kinds")
def p11(t):
    return t.catalog.select("id", links.preview(F.col("prati_link")).alias("preview_url"))


@query("P12_J9_described", """SELECT k.id, coalesce(starts_with(kosha_link, 'http'), false) AS has_kosha, kind <> 'unsupported' AS can_queue, q.queue_status, q.queue_item_id
FROM v_kinds k LEFT JOIN (SELECT item_id % 50 AS id, arg_max(status, item_id) AS queue_status, max(item_id) AS queue_item_id FROM v_items GROUP BY 1) q USING (id)""")
def p12(t):
    return catalog.described(joined(t), queue(t)).select("id", "has_kosha", "can_queue", "queue_status", "queue_item_id")


@query("P19_target_labels", "SELECT page_id, coalesce(nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 2), ''), url) || ' + local storage' AS label FROM pages")
def p19(t):
    return t.raw("pages").select("page_id", links.target_label(F.col("url"), F.lit("local")).alias("label"))


@query("ST10_enqueue_outcomes", """SELECT r.id, CASE WHEN k.id IS NULL THEN 'missing' WHEN kind = 'unsupported' THEN 'unsupported' WHEN h.id IS NOT NULL THEN 'already_queued' ELSE 'added' END AS outcome
FROM (SELECT page_id + 7 AS id FROM pages) r LEFT JOIN v_kinds k USING (id) LEFT JOIN (SELECT DISTINCT item_id % 50 AS id FROM v_items WHERE status <> 'failed') h USING (id)""")
def st10(t):
    return catalog.enqueue_outcomes(t.raw("pages").select((F.col("page_id") + 7).alias("id")), t.catalog, queue(t))


@query("L10_bulk_ids", "SELECT source, list_slice(list(doc_id ORDER BY doc_id), 1, 500) AS ids FROM documents GROUP BY 1")
def l10(t):
    """The first ids of each source: ranks from a range sort, so no source's ids are collected whole."""
    rows = with_neighbours(t.raw("documents").select("source", "doc_id").distinct(), "source", ["doc_id"])
    return rows.where(F.col("position") <= catalog.BULK_MOST).groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))


@query("TX17_strip_html", r"SELECT page_id, array_to_string(regexp_extract_all(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[^\s\x0B]+'), ' ') AS text FROM pages")
def tx17(t):
    from quire.functions.text import without_tags

    return t.raw("pages").select("page_id", without_tags(F.col("html")).alias("text"))
