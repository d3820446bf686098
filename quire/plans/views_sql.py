"""The entity views in DuckDB SQL, as the WITH clause that oracle queries begin with."""

import re

VIEWS = r"""
WITH RECURSIVE n_docs AS (SELECT count(*) AS n FROM documents),
lab AS (SELECT doc_id, max(quality) AS q, max(toxic) AS t FROM labels GROUP BY doc_id),
v_books AS (SELECT DISTINCT source AS book_id, 'Title ' || source AS title, CAST(substr(source, 4, 10) AS INT) % 7 = 6 AS hidden FROM documents),
s0 AS (SELECT doc_id AS doc, source, coalesce(regexp_extract_all(text, '\S+'), []) AS words FROM documents),
d0 AS (SELECT *, greatest(1, (len(words) + 99) // 100) AS places FROM s0),
s00 AS (SELECT doc, source, words, CAST(unnest(range(0, places)) AS INT) AS place FROM d0),
s1 AS (SELECT doc, doc * 1048576 + place AS doc_id, source AS book_id, CAST(doc + 1 AS INT) AS page_number, CASE WHEN place % 2 = 0 THEN 'L' ELSE 'R' END AS side, CAST(place // 2 AS INT) AS seq,
         CAST(doc * 2 + place % 2 AS INT) AS page_index, list_transform(list_slice(words, place * 100 + 1, place * 100 + 100), lambda x, i: (i - 1)::VARCHAR || '_' || x) AS w FROM s00),
s11 AS (SELECT *, array_to_string(w, ' ') AS ai_text, ([1, 34, 67])[doc % 3 + 1] AS spot FROM s1),
s2 AS (SELECT s11.*, CASE WHEN q = 1 THEN CASE WHEN t = 1 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i - 1 = spot THEN 'fix' || spot::VARCHAR ELSE x END), ' ')
         ELSE ai_text END END AS final_text FROM s11 LEFT JOIN (SELECT doc_id AS doc, q, t FROM lab) l USING (doc)),
v_snippets AS (SELECT book_id || ':' || page_number || ':' || side || ':' || seq AS snippet_id, doc_id, doc, book_id, page_number, side, seq, page_index, ai_text, coalesce(final_text, ai_text) AS working_text,
         final_text, CASE WHEN final_text IS NOT NULL THEN 'u' || (doc % 100 + 1)::VARCHAR END AS finalized_by, len(w) AS n_words, w FROM s2),
v_users AS (SELECT c_custkey AS id, 'u' || c_custkey AS uid, c_name AS name, lower(replace(c_name, '#', '.')) || '@example.org' AS email,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'guest' WHEN 'BUILDING' THEN 'reviewer' WHEN 'AUTOMOBILE' THEN 'editor' WHEN 'HOUSEHOLD' THEN 'admin' WHEN 'FURNITURE' THEN 'superadmin' END AS role,
         c_custkey % 13 <> 0 AS active, c_custkey % 17 = 0 AS banned, (['unset', 'new', 'pending', 'declined', 'rejected', 'approved'])[c_custkey % 6 + 1] AS application_status FROM customer),
v_actions AS (SELECT e.event_id, e.ts, s.doc_id, s.snippet_id, s.book_id, e.user_id, CASE WHEN event_type IN ('click', 'view') THEN 'confirm' ELSE 'edit' END AS kind,
         ([0, 33, 66])[CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1] AS p, s.ai_text, s.w, s.final_text
         FROM events e, n_docs JOIN d0 ON d0.doc = e.event_id % n JOIN v_snippets s ON s.doc_id = d0.doc * 1048576 + (e.event_id // n) % d0.places),
v_texts AS (SELECT *, CASE WHEN kind = 'edit' THEN array_to_string(flatten(list_transform(w, lambda x, i: CASE WHEN i - 1 <> p THEN [x] WHEN event_id % 4 = 0 THEN ['fix' || p] WHEN event_id % 4 = 1 THEN ['new' || p, x]
         WHEN event_id % 4 = 2 THEN []::VARCHAR[] ELSE ['fix' || p || chr(10) || 'more' || p] END)), ' ') END AS text FROM v_actions),
v_suggestions AS (SELECT event_id AS id, * EXCLUDE (event_id) FROM v_texts QUALIFY row_number() OVER (PARTITION BY snippet_id, user_id ORDER BY ts DESC, event_id DESC) = 1),
-- changes that turn the current text into the suggested one: no word stands twice in a text, so both are parted by the words they
-- share, and what lies between two of these is a change
c0 AS (SELECT id, snippet_id, user_id, ts, kind, string_split(coalesce(final_text, ai_text), ' ') AS a, text, regexp_extract_all(coalesce(text, ''), '\S+') AS b FROM v_suggestions),
c00 AS (SELECT *, CASE WHEN kind <> 'edit' THEN [] ELSE list_concat(list_concat([[0, 0]::BIGINT[]], list_filter(list_transform(a, lambda x, i: [i, coalesce(list_position(b, x), 0)]::BIGINT[]), lambda y: y[2] > 0)), [[len(a) + 1, len(b) + 1]::BIGINT[]]) END AS same FROM c0),
c1 AS (SELECT *, list_filter(list_transform(same[2:], lambda y, i: [same[i][1], y[1] - 1, same[i][2], y[2] - 1]), lambda z: z[1] < z[2] OR z[3] < z[4]) AS spans FROM c00),
c2 AS (SELECT *, unnest(spans) AS sp FROM c1),
v_changes AS (SELECT id, snippet_id, user_id, ts, CAST(sp[1] AS INT) AS start, CAST(sp[2] AS INT) AS "end", array_to_string(list_slice(a, sp[1] + 1, sp[2]), ' ') AS original,
         regexp_replace(array_to_string(list_slice(b, sp[3] + 1, sp[4]), ' '), '(fix\d+) (more\d+)', '\1' || chr(10) || '\2') AS replacement FROM c2),
v_groups AS (SELECT c.snippet_id, c.start, c."end", c.replacement, min(c.original) AS original, arg_min(c.ts, (c.ts, c.id)) AS first_ts, arg_min(c.id, (c.ts, c.id)) AS first_id, count(*) FILTER (u.role <> 'guest') AS n,
         count(*) FILTER (u.role IN ('editor', 'admin', 'superadmin')) AS editors, count(*) FILTER (u.role = 'guest') AS guests
         FROM v_changes c JOIN v_users u ON u.id = c.user_id GROUP BY ALL),
v_votes AS (SELECT c.snippet_id, count(*) FILTER (len(spans) = 0 AND u.role <> 'guest') AS confirms_reviewers, count(*) FILTER (len(spans) = 0 AND u.role = 'guest') AS confirms_guests,
         count(*) FILTER (len(spans) > 0) AS edit_suggestions, count(*) AS suggestion_count FROM c1 c JOIN v_users u ON u.id = c.user_id GROUP BY c.snippet_id),
v_state AS (SELECT s.*, coalesce(confirms_reviewers, 0) AS confirms_reviewers, coalesce(confirms_guests, 0) AS confirms_guests, coalesce(edit_suggestions, 0) AS edit_suggestions,
         coalesce(suggestion_count, 0) AS suggestion_count, coalesce(m.most >= 2, false) AS attention
         FROM v_snippets s LEFT JOIN v_votes USING (snippet_id) LEFT JOIN (SELECT snippet_id, max(n) AS most FROM v_groups GROUP BY 1) m USING (snippet_id)),
v_library AS (SELECT b.book_id, b.title, b.hidden, count(s.snippet_id) AS total, count(*) FILTER (final_text IS NOT NULL) AS finalized,
         count(*) FILTER (s.snippet_id IS NOT NULL AND final_text IS NULL AND suggestion_count > 0) AS awaiting_approval, count(*) FILTER (s.snippet_id IS NOT NULL AND final_text IS NULL AND suggestion_count = 0) AS untouched,
         count(*) FILTER (final_text IS NULL AND attention) AS needs_attention, count(*) FILTER (final_text IS NOT NULL AND attention) AS finalized_challenged
         FROM v_books b LEFT JOIN v_state s USING (book_id) GROUP BY ALL),
v_progress AS (SELECT *, total - finalized AS pending, CASE WHEN total > 0 THEN round_even(100.0::DOUBLE * finalized / total, 1) ELSE 0.0::DOUBLE END AS completion_pct FROM v_library WHERE NOT hidden),
r0 AS (SELECT doc_id, snippet_id, book_id, page_number, side, seq, ai_text, w, 0.80::DOUBLE + (doc % 20) / 100.0::DOUBLE AS conf, doc_id % 5 <> 4 AS complete,
         CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_slice(w, 1, len(w) - 1), ' ') ELSE replace(ai_text, ' ', '  ') END AS e,
         CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 13 = 0 THEN repeat(ai_text || ' ', 30) ELSE ai_text END AS s FROM v_snippets),
v_readings AS (SELECT doc_id, snippet_id, book_id, page_number, side, seq, complete, len(list_filter(range(0, greatest(1, len(w))), lambda i: (doc_id + i) % 97 = 0)) > 0 AS doubtful, CASE WHEN complete THEN e END AS e, ai_text AS t, CASE WHEN complete THEN s END AS s, conf,
         CASE WHEN complete AND doc_id % 19 <> 0 THEN conf END AS s_conf, CASE WHEN doc_id % 4 = 0 THEN ai_text WHEN doc_id % 4 = 1 THEN '' END AS refined,
         array_to_string(regexp_extract_all(e, '\S+'), ' ') AS ne, ai_text AS nt, array_to_string(regexp_extract_all(s, '\S+'), ' ') AS ns FROM r0),
v_catalog AS (SELECT page_id AS id, 'E' || page_id AS entry_id, CASE page_id % 3 WHEN 0 THEN url WHEN 2 THEN '(wait)' END AS kosha_link,
         CASE page_id % 5 WHEN 0 THEN 'https://drive.google.com/file/d/D' || page_id || '/view' WHEN 1 THEN 'https://drive.google.com/open?id=D' || page_id
           WHEN 2 THEN 'https://archive.org/details/item' || page_id WHEN 3 THEN 'https://x.example/f' || page_id || '.PDF' ELSE url END AS prati_link,
         CASE WHEN page_id % 11 <> 0 THEN page_id % 25 END AS kavi_id, page_id % 100 AS prasanga_id, page_id % 10 AS publisher_id FROM pages),
v_entries AS (SELECT c.id, c.entry_id, c.kosha_link, c.prati_link, k.n_name AS kavi_name, p.p_name AS prasanga_name, b.s_name AS publisher_name,
         coalesce(c.kosha_link ILIKE 'http%', false) AS has_link FROM v_catalog c LEFT JOIN nation k ON k.n_nationkey = c.kavi_id LEFT JOIN part p ON p.p_partkey = c.prasanga_id LEFT JOIN supplier b ON b.s_suppkey = c.publisher_id),
v_kinds AS (SELECT *, CASE WHEN NOT coalesce(starts_with(prati_link, 'http'), false) THEN 'unsupported'
           WHEN contains(host, 'drive.google.com') AND drive_id IS NOT NULL THEN 'drive' WHEN ends_with(host, 'archive.org') AND archive_id IS NOT NULL THEN 'archive'
           WHEN ends_with(lower(path), '.pdf') THEN 'direct_pdf' ELSE 'unsupported' END AS kind
         FROM (SELECT *, lower(regexp_extract(prati_link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, regexp_extract(prati_link, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
           coalesce(nullif(regexp_extract(prati_link, '/file/d/([\w-]+)', 1), ''), nullif(regexp_extract(prati_link, '[?&]id=([\w-]+)', 1), '')) AS drive_id,
           nullif(regexp_extract(prati_link, 'archive\.org/(?:details|embed|download)/([^/?#]+)', 1), '') AS archive_id FROM v_entries)),
v_queue AS (SELECT event_id, ts, user_id AS item_id, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'awaiting_review' WHEN 'click' THEN 'approved' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' END AS status, value FROM events),
v_items AS (SELECT item_id, arg_max(status, (ts, event_id)) AS status, count(*) AS changes FROM v_queue GROUP BY item_id)
"""


def review_chain(p: str) -> str:
    """The views from changes to states once more, over p_snippets, p_suggestions (with the snippet's final_text and
    working_text) and p_users instead of the fixture's; their names begin with p_."""
    begin, end = VIEWS.index("c0 AS ("), VIEWS.index("v_library AS (")
    part = VIEWS[begin:end].replace("coalesce(final_text, ai_text)", "coalesce(final_text, working_text)")
    plain = re.sub(r"\bv_(changes|groups|votes|state|suggestions|snippets|users)\b", rf"{p}_\1", part)
    plain = re.sub(r"\b(c0|c00|c1|c2)\b", rf"{p}_\1", plain)
    return plain.rstrip().rstrip(",")
