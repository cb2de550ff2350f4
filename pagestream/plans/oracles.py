"""DuckDB SQL that states the same results as the queries of ``queries``."""

from __future__ import annotations

from pagestream.functions import text as T


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_STRIPPED = STRIP.format("coalesce(text, '')")

LINES = """
WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
     blocks AS (SELECT doc_id, (unnest(range(len(l))))::INT AS reading_order, unnest(l) AS text FROM b)
"""

PAGES = """
WITH RECURSIVE j AS (
  SELECT l.*, o.o_custkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
n AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS page_index,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS num,
    count(*) OVER (PARTITION BY l_orderkey) AS total FROM j),
pages AS (
  SELECT o_custkey::VARCHAR AS bundle_id, page_index::INT AS page_index, CASE WHEN l_partkey % 5 <> 0 THEN num END AS page_num,
    CASE WHEN l_partkey % 5 <> 0 AND l_suppkey % 3 <> 0 THEN total END AS page_total, CASE WHEN l_returnflag = 'A' THEN 595 ELSE 612 END AS width,
    l_orderkey AS gold_id, num = 1 AS gold_start FROM n)
"""

SIGNALS = (
    PAGES
    + """,
f AS (
  SELECT *, coalesce(page_num = 1 AND lag(page_num) OVER w > 1, false) AS reset,
    coalesce(page_num = 1 AND lag(page_num) OVER w > 1 AND lag(page_num) OVER w = lag(page_total) OVER w, false) AS completed
  FROM pages WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)),
sig AS (
  SELECT *, CASE WHEN reset THEN 0.45::DOUBLE + CASE WHEN completed THEN 0.2::DOUBLE ELSE 0::DOUBLE END END AS confidence,
    CASE WHEN reset AND completed THEN 'page_number_reset+sequence_completed' WHEN reset THEN 'page_number_reset' END AS reason FROM f)
"""
)

# The look-ahead as a recursion over each bundle's pages: (s_at, s_num, s_total) is the anchor, s_at null if there is none.
_FITS = "(s.s_at IS NOT NULL AND {n} IS NOT NULL AND (s.s_total IS NULL OR {t} IS NULL OR s.s_total = {t}) AND (s.s_total IS NULL OR {n} <= s.s_total) AND {i} - s.s_at <= 3 AND CASE WHEN s.s_num IS NULL THEN {i} - s.s_at >= 1 AND {n} BETWEEN 1 AND {i} - s.s_at + 1 ELSE {n} > s.s_num AND {n} <= s.s_num + {i} - s.s_at END)"
_F0 = _FITS.format(n="p.page_num", t="p.page_total", i="p.page_index")
_F1 = _FITS.format(n="p.n1", t="p.t1", i="(p.page_index + 1)")
_F2 = _FITS.format(n="p.n2", t="p.t2", i="(p.page_index + 2)")
_IMPLIED = f"(p.page_num IS NULL AND (s.s_at IS NULL OR s.s_num IS NOT NULL) AND CASE WHEN p.n1 IS NOT NULL THEN NOT {_F1} AND p.n1 = 2 WHEN p.n2 IS NOT NULL THEN NOT {_F2} AND p.n2 = 3 ELSE false END)"
_NEXT = "(p.page_num IS NOT NULL AND {n} = p.page_num + {k} AND (p.page_total IS NULL OR {t} IS NULL OR p.page_total = {t}))"
_REASON = f"""CASE
  WHEN p.conf < 0.4 AND p.page_num IS NOT NULL THEN 'no_signal'
  WHEN p.conf < 0.4 THEN CASE WHEN {_IMPLIED} THEN 'implied_page_one' ELSE 'no_signal' END
  WHEN p.conf >= 0.75 THEN 'high_confidence'
  WHEN {_F0} THEN 'continues_sequence'
  WHEN {_IMPLIED} THEN 'implied_page_one'
  WHEN p.n1 IS NOT NULL AND {_NEXT.format(n="p.n1", t="p.t1", k=1)} THEN 'lookahead_numbering'
  WHEN p.n1 IS NOT NULL AND {_F1} THEN 'old_sequence_continues'
  WHEN p.n2 IS NOT NULL AND {_NEXT.format(n="p.n2", t="p.t2", k=2)} THEN 'lookahead_numbering'
  WHEN p.n2 IS NOT NULL AND {_F2} THEN 'old_sequence_continues'
  WHEN p.conf >= 0.55 THEN 'fallback_eager' ELSE 'fallback_below' END"""
_SPLITS = "('implied_page_one', 'high_confidence', 'lookahead_numbering', 'fallback_eager')"

DECISIONS = (
    SIGNALS
    + f""",
ahead AS (
  SELECT bundle_id, page_index, page_num, page_total, coalesce(confidence, 0) AS conf, lead(page_num, 1) OVER w AS n1, lead(page_total, 1) OVER w AS t1, lead(page_num, 2) OVER w AS n2, lead(page_total, 2) OVER w AS t2
  FROM sig WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)),
walk AS (
  SELECT bundle_id, -1 AS page_index, NULL::BIGINT AS s_at, NULL::BIGINT AS s_num, NULL::BIGINT AS s_total, '' AS reason, false AS split FROM (SELECT DISTINCT bundle_id FROM pages)
  UNION ALL
  SELECT bundle_id, page_index, CASE WHEN moves THEN page_index ELSE s_at END, CASE WHEN moves THEN page_num ELSE s_num END, CASE WHEN moves THEN page_total ELSE s_total END, reason, split
  FROM (SELECT *, reason IN {_SPLITS} AS split, reason IN {_SPLITS} OR (reason <> 'old_sequence_continues' AND page_num IS NOT NULL) AS moves
        FROM (SELECT p.bundle_id, p.page_index, p.page_num, p.page_total, s.s_at, s.s_num, s.s_total, {_REASON} AS reason FROM walk s JOIN ahead p ON p.bundle_id = s.bundle_id AND p.page_index = s.page_index + 1))),
decided AS (SELECT bundle_id, page_index, split, reason FROM walk WHERE page_index >= 0),
indexed AS (
  SELECT *, split AND page_index > 0 AS effective, (sum(CASE WHEN split AND page_index > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY page_index))::INT AS doc_index FROM decided)
"""
)

MARKS = (
    DECISIONS
    + """,
g AS (SELECT bundle_id, page_index - 1 AS page_index FROM pages WHERE gold_start AND page_index > 0),
pr AS (SELECT bundle_id, page_index - 1 AS page_index FROM indexed WHERE effective),
marks AS (
  SELECT coalesce(g.bundle_id, pr.bundle_id) AS bundle_id, coalesce(g.page_index, pr.page_index) AS page_index, CASE WHEN g.bundle_id IS NULL THEN 'fp' WHEN pr.bundle_id IS NULL THEN 'fn' ELSE 'tp' END AS mark
  FROM g FULL JOIN pr ON g.bundle_id = pr.bundle_id AND g.page_index = pr.page_index),
c AS (
  SELECT p.bundle_id, count(*) FILTER (mark = 'tp') AS tp, count(*) FILTER (mark = 'fp') AS fp, count(*) FILTER (mark = 'fn') AS fn
  FROM (SELECT DISTINCT bundle_id FROM pages) p LEFT JOIN marks m ON p.bundle_id = m.bundle_id GROUP BY 1),
pq AS (
  SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp)::DOUBLE END AS precision, CASE WHEN tp + fp + fn = 0 THEN 1.0::DOUBLE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn)::DOUBLE END AS recall FROM c),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pq)
"""
)

_HITS = ", ".join(f"struct_pack(hits := len(list_filter(w, lambda x: x IN ({_list(s.split())}))), lang := '{k}')" for k, s in T.STOPWORDS.items())
GUESS = f"""
WITH t AS (SELECT doc_id, source, lang, text, regexp_replace(text, '[^\\p{{L}}]', '', 'g') AS letters, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda x: lower(x)) AS w FROM documents),
u AS (SELECT *, list_reverse_sort([{_HITS}]) AS h, length(letters) AS n, length(letters) - length(regexp_replace(letters, '[\\x{{00}}-\\x{{24f}}]', '', 'g')) AS latin FROM t),
g AS (SELECT doc_id, source, lang, CASE WHEN n >= 30 AND latin >= 0.6 * n AND len(w) >= 20 AND h[1].hits >= 0.15 * len(w) AND h[1].hits >= 2 * h[2].hits THEN h[1].lang END AS guess FROM u),
p AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS page_index, lag(guess) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM g)
"""
WORDS = f"""
WITH w AS (SELECT doc_id, source, unnest(list_filter(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{4,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_list(T.IGNORED)}))) AS word FROM documents)
"""

TEXTS = """
WITH t AS (
  SELECT conv_id::VARCHAR AS bundle_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS page_index, count(*) OVER (PARTITION BY conv_id) AS total, role, text FROM conversations),
l AS (
  SELECT bundle_id, page_index::INT AS page_index, 'Log of ' || role AS top, CASE WHEN total % 2 = 0 THEN 'Page ' || (page_index + 1) || ' of ' || total ELSE (page_index + 1)::VARCHAR END AS bottom, total FROM t)
"""
_TAGS = """
SELECT a.bundle_id, a.page_index, true AS is_page_number,
  EXISTS (SELECT 1 FROM l b WHERE b.bundle_id = a.bundle_id AND b.page_index <> a.page_index AND b.page_index BETWEEN a.page_index - 3 AND a.page_index + {0}) AS is_footer,
  EXISTS (SELECT 1 FROM l b WHERE b.bundle_id = a.bundle_id AND b.page_index <> a.page_index AND b.page_index BETWEEN a.page_index - 3 AND a.page_index + {0} AND b.top = a.top) AS is_header
FROM l a
"""

BLOCKS = r"""
WITH pg AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS bundle_id, html FROM pages),
pn AS (SELECT *, (row_number() OVER (PARTITION BY bundle_id ORDER BY page_id) - 1)::INT AS page_index, regexp_extract_all(html, '(?is)<(?:title|h1|h2|h3|p|li|footer)[^>]*>.*?</(?:title|h1|h2|h3|p|li|footer)>') AS l FROM pg),
ex AS (SELECT bundle_id, page_index, (unnest(range(len(l))))::INT AS reading_order, unnest(l) AS raw FROM pn),
tg AS (SELECT *, lower(regexp_extract(raw, '(?i)^<(\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS text FROM ex),
blocks AS (SELECT bundle_id, page_index, reading_order, CASE WHEN tag = 'title' THEN 'title' WHEN tag IN ('h1', 'h2', 'h3') THEN 'heading' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'footer' THEN 'footer' ELSE 'paragraph' END AS kind,
  CASE WHEN tag = 'title' THEN 0 WHEN tag IN ('h1', 'h2', 'h3') THEN tag[2:2]::INT END AS heading_level, text, bundle_id || '-p' || page_index || '-b' || reading_order AS block_id FROM tg WHERE text <> '')
"""

CACHE = """
WITH d AS (SELECT doc_id AS page, source, sha1(text) AS sha, text FROM documents),
cache AS (SELECT sha, page, CASE WHEN page % 7 = 0 THEN 'corrupt' WHEN page % 5 = 0 THEN 'stale' ELSE 'cached' END AS state, length(text) AS raw_chars, page % 11 = 0 AS truncated FROM d WHERE page % 3 <> 0)
"""

CITED = (
    BLOCKS
    + """,
cited AS (SELECT bundle_id, page_index AS doc_index, CASE WHEN reading_order % 5 = 0 THEN block_id || 'x' WHEN reading_order % 3 = 0 THEN bundle_id || '-p' || (page_index + 1) || '-b0' ELSE block_id END AS block_id FROM blocks),
known AS (SELECT bundle_id, block_id, min(page_index) AS known_from FROM blocks GROUP BY 1, 2)
"""
)

ORACLES: dict[str, str] = {
    "classify_pages": f"""
WITH t AS (SELECT doc_id, length({_STRIPPED}) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 40 THEN 'text' WHEN n > 0 THEN 'mixed' ELSE 'scan' END AS page_class, (CASE WHEN n >= 40 THEN 0.7 WHEN n > 0 THEN 0.45 ELSE 0.6 END)::DOUBLE AS confidence, n > 0 AS has_text_ops FROM t""",
    "text_layer_census": f"""
WITH t AS (SELECT source, length({_STRIPPED}) AS n FROM documents)
SELECT coalesce(source, 'total') AS source, count(*) AS pages, count(*) FILTER (n >= 40) AS text_pages, sum(n)::BIGINT AS chars FROM t GROUP BY ROLLUP (source)""",
    "block_split": LINES + "SELECT doc_id, reading_order, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM blocks",
    "block_kinds": LINES
    + rf"""
, k AS (SELECT *, reading_order = 0 AND length(text) < 140 AS title, regexp_matches(text, '(?i)^(?:chapter|part|section|article|appendix|exhibit|schedule)\s+[\w.\-]+') OR regexp_matches(text, '^\d+(?:\.\d+)+\s+\S') OR regexp_matches(text, '^\d+\.\s+[A-Z].{{0,80}}$') OR regexp_matches(text, '^[IVXLCM]+\.\s+\S') OR regexp_matches(text, '^[A-Z][A-Z0-9 ,.''-]{{8,80}}$') AS heading FROM blocks)
SELECT doc_id, reading_order, CASE WHEN title THEN 'title' WHEN heading THEN 'heading' WHEN regexp_matches(text, '^(?:[-*•] |\d+[.)]\s)') THEN 'list_item' ELSE 'paragraph' END AS kind,
  CASE WHEN title THEN 0 WHEN heading THEN least(CASE WHEN regexp_matches(text, '^\d') THEN length(text) - length(replace(text, '.', '')) + 1 ELSE 1 END, 6) END::INT AS heading_level FROM k""",
    "page_label_parse": r"""
WITH t AS (
  SELECT l_linenumber AS n, l_linenumber + l_suppkey % 9 AS m, l_partkey % 8 AS f FROM lineitem),
x AS (
  SELECT CASE f WHEN 0 THEN 'Page ' || n || ' of ' || m WHEN 1 THEN n || '/' || m WHEN 2 THEN 'p. ' || n || ' of ' || m WHEN 3 THEN '- ' || n || ' -' WHEN 4 THEN '  page ' || n || '  '
    WHEN 5 THEN chr(10) || n || ' of ' || m || chr(10) || 'more' WHEN 6 THEN 'ratio ' || n || '/' || m || ' in text' ELSE 'Total due PAGE ' || n || ' / ' || m END AS label,
    CASE WHEN f IN (0, 1, 2, 5) THEN n END AS num, CASE WHEN f IN (0, 1, 2, 5) THEN m END AS total, CASE WHEN f IN (0, 2) THEN n END AS keyword_num, CASE WHEN f = 4 THEN n END AS bare, f IN (0, 1, 2, 3, 4) AS labelled,
    CASE WHEN f = 7 THEN 'Total due' END AS trailing_body, CASE WHEN f = 7 THEN 'PAGE ' || n || ' / ' || m END AS trailing_label FROM t)
SELECT label, num::INT AS num, total::INT AS total, keyword_num::INT AS keyword_num, bare::INT AS bare, labelled, trailing_body, trailing_label, count(*) AS n FROM x GROUP BY ALL""",
    "content_words": WORDS + "SELECT d.doc_id, count(word)::INT AS n_words, count(DISTINCT word)::INT AS n_distinct, min(word) AS first_word FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id GROUP BY 1",
    "detect_language": GUESS + "SELECT lang, guess, count(*) AS n FROM g GROUP BY 1, 2",
    "language_changed": GUESS + "SELECT source AS bundle_id, page_index, coalesce(before <> guess, false) AS changed FROM p WHERE page_index > 0",
    "topic_similarity_adjacent": WORDS
    + """
, p AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS page_index FROM documents),
c AS (SELECT p.source, p.page_index, word, count(*) AS c FROM w JOIN p ON w.doc_id = p.doc_id GROUP BY 1, 2, 3),
n AS (SELECT source, page_index, sum(c * c) AS norm FROM c GROUP BY 1, 2),
d AS (SELECT a.source, a.page_index, sum(a.c * b.c) AS dot FROM c a JOIN c b ON a.source = b.source AND a.word = b.word AND b.page_index = a.page_index - 1 GROUP BY 1, 2)
SELECT p.source AS bundle_id, p.page_index, round(coalesce(d.dot, 0) / coalesce(sqrt(n.norm::DOUBLE * m.norm), 1), 6) AS similarity
FROM p LEFT JOIN n ON n.source = p.source AND n.page_index = p.page_index LEFT JOIN n m ON m.source = p.source AND m.page_index = p.page_index - 1 LEFT JOIN d ON d.source = p.source AND d.page_index = p.page_index WHERE p.page_index > 0""",
    "page_number_reset": SIGNALS + "SELECT bundle_id, page_index, reset AS page_number_reset, completed AS sequence_completed FROM sig",
    "media_box_jump": PAGES
    + """
, s AS (SELECT bundle_id, page_index, CASE WHEN page_num IS NOT NULL THEN 600 + (page_index * 7) % 45 END AS width, CASE WHEN page_index % 17 = 0 THEN 90 ELSE 0 END AS rotation FROM pages)
SELECT bundle_id, page_index, coalesce(page_index > 0 AND width IS NOT NULL AND lag(width) OVER w IS NOT NULL AND (rotation <> lag(rotation) OVER w OR abs(width - lag(width) OVER w) > 20), false) AS media_box_changed FROM s WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)""",
    "embed_shift": """
WITH p AS (SELECT label::VARCHAR AS bundle_id, (row_number() OVER w - 1)::INT AS page_index, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER w AS e1, lag(embedding::DOUBLE[], 2) OVER w AS e2 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (SELECT bundle_id, page_index, e, CASE WHEN e2 IS NOT NULL THEN list_transform(range(1, len(e) + 1), lambda i: (e1[i] + e2[i]) / 2) ELSE e1 END AS mean FROM p),
c AS (SELECT bundle_id, page_index, list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * mean[i])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(mean, lambda x: x * x)))) AS c FROM m)
SELECT bundle_id, page_index, round(c, 6) AS cosine, coalesce(c <= 0.5, false) AS embed_shift FROM c""",
    "boundary_score": SIGNALS + "SELECT bundle_id, page_index, round(confidence, 6) AS confidence, reason FROM sig",
    "eager_split": SIGNALS + "SELECT bundle_id, page_index, coalesce(confidence, 0) >= 0.55 AS split, CASE WHEN coalesce(confidence, 0) >= 0.55 THEN 'eager' ELSE 'below_threshold' END AS reason, round(coalesce(confidence, 0), 6)::DOUBLE AS confidence FROM sig",
    "lookahead_split": DECISIONS + "SELECT bundle_id, page_index, split, reason FROM decided",
    "document_ranges": DECISIONS + "SELECT bundle_id, doc_index, min(page_index) AS page_start, max(page_index) AS page_end FROM indexed GROUP BY 1, 2",
    "boundary_marks": MARKS + "SELECT bundle_id, page_index, mark FROM marks",
    "boundary_prf": MARKS + "SELECT bundle_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores",
    "gate": MARKS
    + """
SELECT bundles, failed, failed = 0 AND macro >= 0.6 AS passed, round(macro, 6) AS macro_f1, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS micro_f1
FROM (SELECT count(*) AS bundles, count(*) FILTER (f1 < 0) AS failed, avg(f1) AS macro, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM scores)""",
    "event_log": DECISIONS
    + """,
ends AS (SELECT bundle_id, max(page_index) AS page_index, max(doc_index) AS d FROM indexed GROUP BY 1),
ev AS (
  SELECT bundle_id, page_index, 0 AS phase, 'boundary_decided' AS kind, reason AS payload FROM indexed
  UNION ALL SELECT bundle_id, page_index, 1, 'document_closed', 'doc-' || (doc_index - 1) FROM indexed WHERE effective
  UNION ALL SELECT bundle_id, page_index, 2, 'document_opened', 'doc-' || doc_index FROM indexed WHERE effective OR page_index = 0
  UNION ALL SELECT bundle_id, page_index, 3, 'document_closed', 'doc-' || d FROM ends
  UNION ALL SELECT bundle_id, page_index, 4, 'bundle_closed', '' FROM ends)
SELECT bundle_id, (row_number() OVER (PARTITION BY bundle_id ORDER BY page_index, phase) - 1)::INT AS seq, kind, page_index AS page, payload FROM ev""",
    "furniture_final": TEXTS + _TAGS.format(3),
    "furniture_streaming": TEXTS + _TAGS.format(-1),
    "doc_titles": BLOCKS
    + """
, b AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY page_index, reading_order) AS pos FROM blocks WHERE kind <> 'footer')
SELECT bundle_id, coalesce(min_by(text[1:200], pos) FILTER (pos <= 8 AND kind IN ('title', 'heading')), min_by(text[1:200], pos) FILTER (pos = 1)) AS title FROM b GROUP BY 1""",
    "sections": BLOCKS
    + """
, b AS (SELECT *, row_number() OVER w AS pos, kind IN ('title', 'heading') AS head, CASE WHEN kind = 'title' THEN 0 WHEN kind = 'heading' THEN heading_level END AS level FROM blocks WHERE kind <> 'footer' WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index, reading_order)),
o AS (SELECT *, sum(CASE WHEN head OR pos = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY pos) AS ord FROM b),
s AS (SELECT bundle_id, ord, min_by(CASE WHEN head THEN block_id || '-sec' ELSE 'anon-1' END, pos) AS section_id, min_by(coalesce(level, 1), pos) AS level, min_by(page_index, pos) AS page_start, max(page_index) AS last_page, count(*) AS n_blocks, min_by(CASE WHEN head THEN md5(text[1:200]) ELSE '' END, pos) AS heading_md5 FROM o GROUP BY 1, 2)
SELECT bundle_id, ord::BIGINT AS ord, section_id, level::INT AS level, (SELECT max(x.ord) FROM s x WHERE x.bundle_id = s.bundle_id AND x.ord < s.ord AND x.level < s.level)::BIGINT AS parent_ord, page_start,
  (SELECT max(x.last_page) FROM s x WHERE x.bundle_id = s.bundle_id AND x.ord >= s.ord AND x.ord < coalesce((SELECT min(y.ord) FROM s y WHERE y.bundle_id = s.bundle_id AND y.ord > s.ord AND y.level <= s.level), 1e18)) AS page_end, n_blocks, nullif(heading_md5, '') AS heading_md5 FROM s""",
    "unresolved_citations": CITED + "SELECT c.bundle_id, c.doc_index, c.block_id, count(*) AS n FROM cited c LEFT JOIN known k ON c.bundle_id = k.bundle_id AND c.block_id = k.block_id WHERE NOT coalesce(known_from <= doc_index, false) GROUP BY 1, 2, 3",
    "citation_integrity": CITED + "SELECT c.bundle_id, round(avg(CASE WHEN known_from IS NULL THEN 0 ELSE 1 END), 6) AS integrity FROM cited c LEFT JOIN known k ON c.bundle_id = k.bundle_id AND c.block_id = k.block_id GROUP BY 1",
    "review_checks": BLOCKS
    + r"""
, k AS (SELECT bundle_id, kind, regexp_replace(lower(text), '\d+', '#', 'g') AS k FROM blocks)
SELECT bundle_id, kind, count(*) AS n FROM k WHERE kind <> 'footer' AND EXISTS (SELECT 1 FROM k f WHERE f.kind = 'footer' AND f.bundle_id = k.bundle_id AND f.k = k.k) GROUP BY 1, 2""",
    "ocr_cache_join": CACHE
    + "SELECT source, coalesce(state, 'pending') AS state, count(*) AS pages, coalesce(sum(raw_chars) FILTER (state = 'cached'), 0)::BIGINT AS chars, count(*) FILTER (state = 'cached' AND truncated) AS truncated FROM d LEFT JOIN cache ON d.sha = cache.sha AND d.page = cache.page GROUP BY 1, 2",
    "false_ocr": CACHE + f"SELECT DISTINCT page FROM cache WHERE state = 'cached' AND page IN (SELECT doc_id FROM documents WHERE length({_STRIPPED}) >= 40)",
    "auroc": """
WITH r AS (SELECT length(text) AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM r)
SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round(((sum(r) FILTER (y = 1)) - sum(y) * (sum(y) + 1) / 2.0)::DOUBLE / (sum(y) * sum(1 - y))::DOUBLE, 9) AS auroc FROM k""",
    "threshold_tune": """
WITH r AS (SELECT list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nl}\\p{No}]+'), lambda x: lower(x)) AS w, quality AS y FROM documents JOIN labels USING (doc_id)),
s AS (SELECT len(list_distinct(w))::DOUBLE / greatest(len(w), 1) AS s, y FROM r),
t AS (SELECT k / 20.0::DOUBLE AS threshold FROM range(1, 20) x(k)),
c AS (SELECT threshold, count(*) FILTER (s >= threshold) AS n_pred, coalesce(sum(y) FILTER (s >= threshold), 0)::BIGINT AS tp, sum(y) AS n_gold FROM t, s GROUP BY 1),
q AS (SELECT *, CASE WHEN n_pred = 0 THEN 0.0 ELSE tp / n_pred::DOUBLE END AS p, tp / n_gold::DOUBLE AS r FROM c)
SELECT threshold, n_pred, tp, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q""".replace("\\\\", "\\"),
    "percentile_nearest_rank": """
WITH r AS (SELECT event_type, round(value, 2) AS v, row_number() OVER (PARTITION BY event_type ORDER BY round(value, 2)) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, min(v) FILTER (k >= greatest(ceil(0.5::DOUBLE * n), 1)) AS p50, min(v) FILTER (k >= greatest(ceil(0.95::DOUBLE * n), 1)) AS p95 FROM r GROUP BY 1""",
    "split_disjoint": "SELECT md5(text) AS text_md5 FROM documents WHERE source IN ('src1', 'src3', 'src5') INTERSECT SELECT md5(text) FROM documents WHERE source NOT IN ('src1', 'src3', 'src5')",
    "grouped_folds": "SELECT source, count(*) AS n, 1::BIGINT AS folds FROM documents GROUP BY 1",
    "error_rates": "SELECT p_partkey, round(levenshtein(p_name, replace(replace(replace(p_name, 'a', '@'), 'e', '3'), 'o', '')) / greatest(length(p_name), 1)::DOUBLE, 6) AS cer FROM part",
    "range_validation": PAGES
    + """
, r AS (SELECT bundle_id, gold_id, min(page_index) AS s, max(page_index) AS e FROM pages GROUP BY 1, 2),
k AS (SELECT *, lead(s) OVER (PARTITION BY bundle_id ORDER BY s) - e AS step FROM r)
SELECT bundle_id, count(*) AS documents, count(*) FILTER (step > 1) AS gaps, count(*) FILTER (step < 1) AS overlaps, min(s) AS first_page, max(e) AS last_page FROM k GROUP BY 1""",
    "neighbor_heads": """
WITH t AS (SELECT conv_id::VARCHAR AS bundle_id, (row_number() OVER w - 1)::INT AS page_index, substr(replace(text, chr(10), ' '), 1, 40) AS h FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT bundle_id, page_index, md5(concat_ws(' | ', lag(h) OVER w, lead(h) OVER w, lead(h, 2) OVER w)) AS heads_md5 FROM t WINDOW w AS (PARTITION BY bundle_id ORDER BY page_index)""",
    "retrieval_metrics": """
WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, label AS g FROM embeddings),
s AS (SELECT q.id, v.id AS other, v.g = q.g AS hit, round(list_dot_product(q.e, v.e), 9) AS s FROM v q JOIN v ON q.id % 20 = 0 AND v.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS k FROM s),
a AS (SELECT id, count(*) FILTER (hit) AS rel, coalesce(sum(1 / log2(k + 1)) FILTER (hit AND k <= 5), 0) AS dcg, min(k) FILTER (hit) AS first, count(*) FILTER (hit AND k <= 10) AS in10 FROM r GROUP BY 1)
SELECT id, round(CASE WHEN rel = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, least(rel, 5) + 1), lambda k: 1 / log2(k + 1))) END, 6) AS ndcg5, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(CASE WHEN rel = 0 THEN 0 ELSE in10 / rel::DOUBLE END, 6) AS recall10 FROM a""",
    "streaming_parity": DECISIONS + "SELECT bundle_id, page_index, split, reason FROM decided",
    "topic_shift": GUESS
    + f"""
, w AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{Nl}}\\p{{No}}]{{4,}}'), lambda x: lower(x)), lambda x: x NOT IN ({_list(T.IGNORED)}))) AS word FROM documents),
c AS (SELECT p.source, p.page_index, word, count(*) AS c FROM w JOIN p ON w.doc_id = p.doc_id GROUP BY 1, 2, 3),
before AS (SELECT source, page_index, word, sum(c) AS c FROM (SELECT source, page_index + 1 AS page_index, word, c FROM c UNION ALL SELECT source, page_index + 2, word, c FROM c) GROUP BY 1, 2, 3),
n AS (SELECT source, page_index, sum(c) AS words, sum(c * c) AS norm FROM c GROUP BY 1, 2),
m AS (SELECT source, page_index, sum(c * c) AS norm FROM before GROUP BY 1, 2),
d AS (SELECT a.source, a.page_index, sum(a.c * b.c) AS dot FROM c a JOIN before b USING (source, page_index, word) GROUP BY 1, 2)
SELECT p.source AS bundle_id, p.page_index,
  coalesce(n.words >= 40 AND l.words >= 40 AND p.guess IS NOT NULL AND p.before IS NOT NULL AND coalesce(d.dot, 0) / sqrt(n.norm::DOUBLE * m.norm) <= 0.01, false) AS topic_shift,
  p.page_index > 0 AND coalesce(p.before <> p.guess, false) AS language_changed
FROM p LEFT JOIN n ON n.source = p.source AND n.page_index = p.page_index LEFT JOIN n l ON l.source = p.source AND l.page_index = p.page_index - 1 LEFT JOIN m ON m.source = p.source AND m.page_index = p.page_index LEFT JOIN d ON d.source = p.source AND d.page_index = p.page_index""",
    "ocr_routing": """
WITH p AS (SELECT source AS bundle_id, doc_id AS i, CASE WHEN doc_id % 4 = 0 THEN 'scan' WHEN doc_id % 4 = 1 THEN 'mixed' ELSE 'text' END AS page_class, doc_id % 3 = 0 AS seen FROM documents),
r AS (SELECT bundle_id, page_class, CASE WHEN page_class = 'text' OR (page_class = 'mixed' AND NOT seen) THEN 'native' WHEN seen THEN 'ocr' END AS origin FROM p)
SELECT bundle_id, page_class, origin, count(*) AS n FROM r WHERE origin IS NOT NULL GROUP BY 1, 2, 3""",
    "logistic_predict": """
WITH x AS (SELECT doc_id, ln(1 + length(text)) AS a, length(regexp_replace(text, '[^#*$%&|]', '', 'g')) / greatest(length(text), 1)::DOUBLE AS b FROM documents JOIN labels USING (doc_id))
SELECT doc_id, round(1 / (1 + exp(-(0.25::DOUBLE + 0.3::DOUBLE * (a - 7) - 1.7::DOUBLE * (b - 0.01::DOUBLE) / 0.02::DOUBLE))), 6) AS probability FROM x""",
    "student_features": """
WITH p AS (SELECT label::VARCHAR AS bundle_id, (row_number() OVER w - 1)::INT AS page_index, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER w AS e1, lag(embedding::DOUBLE[], 2) OVER w AS e2 FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
m AS (SELECT bundle_id, page_index, e, e1, CASE WHEN e2 IS NOT NULL THEN list_transform(range(1, len(e) + 1), lambda i: (e1[i] + e2[i]) / 2) ELSE e1 END AS m FROM p)
SELECT bundle_id, page_index, round(coalesce(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * e1[i])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(e1, lambda x: x * x)))), 0), 6) AS cos1,
  round(coalesce(list_sum(list_transform(range(1, len(e) + 1), lambda i: e[i] * m[i])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(m, lambda x: x * x)))), 0), 6) AS cos2, page_index = 0 AS first FROM m""",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, true) AS opens FROM events),
s AS (SELECT user_id, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "bundle_plan": """
WITH d AS (SELECT o_orderkey, o_custkey % 9 + 1 AS pages, md5('seed-7:' || o_orderkey) AS k FROM orders),
n AS (SELECT *, k[1:2] AS part, row_number() OVER (PARTITION BY k[1:2] ORDER BY k) - 1 AS n FROM d),
g AS (SELECT *, part || '-' || (n // 3) AS bundle_id FROM n),
s AS (SELECT bundle_id, o_orderkey, pages, (sum(pages) OVER (PARTITION BY bundle_id ORDER BY n))::BIGINT AS upto FROM g)
SELECT bundle_id, o_orderkey, upto - pages AS page_start, upto - 1 AS page_end FROM s""",
    "fewshot_grounding": BLOCKS
    + """
, d AS (SELECT DISTINCT bundle_id, page_index FROM blocks)
SELECT bundle_id, unnest(['own', 'other', 'none']) AS field, unnest([NULL, 'ungrounded', 'invalid_schema']) AS "drop", count(*) AS n FROM d GROUP BY bundle_id""",
    "reply_ladder": """
WITH t AS (SELECT user_id::VARCHAR AS bundle_id, event_id AS page_index, CASE WHEN event_id % 5 IN (0, 1, 2) AND round(abs(value) % 2, 2) <= 1 THEN round(abs(value) % 2, 2) END AS probability FROM events),
s AS (SELECT *, (sum(CASE WHEN probability IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY page_index))::BIGINT AS strike FROM t)
SELECT bundle_id, page_index, probability, strike, strike >= 3 AS exhausted FROM s""",
    "layout_blocks": """
WITH a AS (
  SELECT l_orderkey::VARCHAR AS bundle_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS pos,
    CASE WHEN l_suppkey % 4 = 0 THEN 'Item ' || l_partkey || '.' WHEN l_suppkey % 9 = 0 THEN 'Page ' || l_linenumber ELSE 'Line ' || l_partkey END AS text, 50 + l_suppkey % 5 AS x0,
    (CASE WHEN l_partkey % 11 = 0 THEN 20 WHEN l_partkey % 7 = 0 THEN 12.5 WHEN l_partkey % 13 = 0 THEN 8 ELSE 11 END)::DOUBLE AS size, l_returnflag = 'A' AS bold FROM lineitem),
b AS (SELECT *, (30 + pos * CASE WHEN length(text) % 2 = 0 THEN 14 ELSE 130 END)::DOUBLE AS top FROM a),
c AS (SELECT *, top + size AS bottom, x0 + length(text) * 5.0::DOUBLE AS x1 FROM b),
w AS (SELECT bundle_id, size, sum(length(text)) AS chars, min(pos) AS seen FROM c GROUP BY 1, 2),
y AS (SELECT bundle_id, size AS body FROM w QUALIFY row_number() OVER (PARTITION BY bundle_id ORDER BY chars DESC, seen) = 1),
d AS (SELECT c.*, body, CASE WHEN bottom <= 792 * 0.08::DOUBLE THEN 'top' WHEN top >= 792 * (1 - 0.08::DOUBLE) THEN 'bottom' END AS band FROM c JOIN y USING (bundle_id)),
e AS (SELECT *, max(CASE WHEN band IS NULL THEN size END) OVER (PARTITION BY bundle_id) AS biggest, row_number() OVER (PARTITION BY bundle_id ORDER BY CASE WHEN band = 'top' THEN 0 WHEN band IS NULL THEN 1 ELSE 2 END, CASE WHEN band IS NOT NULL THEN top ELSE 0 END, pos) AS n FROM d),
f AS (SELECT *, coalesce(band IS NULL AND biggest >= body * 1.3::DOUBLE AND size = biggest AND top <= 792 * 0.45::DOUBLE, false) AS cand FROM e),
g AS (SELECT *, min(CASE WHEN cand THEN n END) OVER (PARTITION BY bundle_id) AS first FROM f),
h AS (SELECT *, cand AND sum(CASE WHEN n >= first AND NOT cand THEN 1 ELSE 0 END) OVER (PARTITION BY bundle_id ORDER BY n) = 0 AS title FROM g),
k AS (SELECT *, CASE WHEN band IS NOT NULL THEN CASE WHEN text LIKE 'Page %' THEN 'page_number' ELSE 'paragraph' END WHEN title THEN 'title' WHEN NOT regexp_matches(text, '[.,]$') AND (size >= body * 1.12::DOUBLE OR (bold AND size >= body * 0.95::DOUBLE)) THEN 'heading' ELSE 'paragraph' END AS kind FROM h),
j AS (SELECT *, coalesce(band IS NULL AND lag(kind) OVER v IS NOT NULL AND lag(band) OVER v IS NULL AND lag(kind) OVER v = kind AND (kind = 'title' OR (kind = 'paragraph' AND top - lag(bottom) OVER v < greatest(size, 1) * 1.2::DOUBLE)), false) AS joins FROM k WINDOW v AS (PARTITION BY bundle_id ORDER BY n)),
o AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY bundle_id ORDER BY n) - 1 AS reading_order FROM j)
SELECT bundle_id, reading_order::BIGINT AS reading_order, min(kind) AS kind, min(band) AS band, CASE min(kind) WHEN 'title' THEN 0 WHEN 'heading' THEN 1 END AS heading_level, min_by(size, n) < min(body) * 0.95::DOUBLE AS small, md5(string_agg(text, chr(10) ORDER BY n)) AS text_md5,
  round(min(x0)::DOUBLE, 3) AS x0, round(min_by(top, n), 3) AS y0, round(max(x1)::DOUBLE, 3) AS x1, round(max_by(bottom, n), 3) AS y1 FROM o GROUP BY 1, 2""",
}
