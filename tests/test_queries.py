"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from quire.plans import registry

SMALL = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = """A1_library_progress A3_contributor_stats A7_top_approved A12_facets F1_search F17_J16_permissions J1_catalog_star J14_upsert_if_newer L4_next_for_reviewer
P12_J9_described ST1_consensus ST2_queue_state ST3_publish_state ST3_publish_local ST3_publish_web J14_streamed_upserts ST7_ingest ST8_review_sync TX2_flags TX4_consensus_words TX8_word_diff L6_change_order TX11_approval_plan F1_indexed_search F4_indexed_search L2_keyset_pages L10_bulk_ids rate_limits_by_route S7_canonical_keys TX12_book_text TX12_text_blocks A20_kept_counts TX7_kept_changes ST9_applied_users ST9_applied_suggestions ST9_applied_texts ST9_applied_counts W2_positions J18_W3_neighbours W7_page_breaks TX21_word_marks IM5_runs U2_replace_page W1_page_index""".split()
NAMES = sorted(registry.SQL) if os.environ.get("ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def plain(x):
    return repr(float(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    frame = registry.QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(registry.SQL[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall())


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flags_and_report_against_plain_python(spark):
    """What SQL can't say (zlib, the matcher's ratio): flags, totals and report lines of all readings, one by one."""
    import re
    import zlib
    from difflib import SequenceMatcher
    from html import escape

    from quire.sources.adapters import Tables

    rows = Tables(spark, SMALL).readings.collect()
    got = {n: {r["doc_id"]: r for r in registry.QUERIES[n](spark, SMALL).collect()} for n in ("TX5_suspect", "TX3_similarity", "TX2_flags")}
    kept = re.compile(r"[\s\x1c-\x1f।॥|/Il.,:;\-—'\"()\[\]0-9\u0041-\u024f]")
    totals, cells = [0, 0, 0], []
    for r in rows:
        d, full = r["doc_id"], r["easyocr"] is not None and r["surya"] is not None
        e, t, s = (r[x] and r[x]["text"] for x in ("easyocr", "tesseract", "surya"))
        ratio = lambda a, b: round(SequenceMatcher(None, a.split(), b.split()).ratio(), 4)
        similar = [ratio(a, b) if full else None for a, b in ((e, t), (e, s), (t, s))] if full else [None] * 3
        assert [got["TX3_similarity"][d][f"sim_{x}"] for x in ("easyocr_tesseract", "easyocr_surya", "tesseract_surya")] == similar
        suspect = None
        if full:
            raw = s.encode()
            suspect = not s or len(s) > 1200 or (len(s) > 40 and len(zlib.compress(raw)) / len(raw) < 0.28) or len(kept.sub("", s)) / max(len(s), 1) > 0.3
        assert got["TX5_suspect"][d]["surya_suspect"] == suspect, d
        flags = got["TX2_flags"][d]
        totals = [totals[0] + full, totals[1] + bool(full and (flags["disagreement"] or flags["low_confidence"] or suspect)), totals[2] + bool(full and flags["majority_agreement"])]
        share = "" if similar[0] is None else f"{round(similar[0] * 100):d}%"
        cells.append((r["snippet_id"], "<tr>" + "".join(f"<td>{escape(x or '')}</td>" for x in (r["snippet_id"], e, t, s, share)) + "</tr>"))
    assert tuple(registry.QUERIES["A16_report_totals"](spark, SMALL).first()) == tuple(totals)
    assert sorted(map(tuple, registry.QUERIES["SK9_report_rows"](spark, SMALL).collect())) == sorted(cells)
