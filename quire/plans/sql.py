"""SQL (DuckDB) equivalent to the core queries, over views named like the tables."""

from __future__ import annotations


import unicodedata
from functools import lru_cache

from quire.functions.digits import ARABIC_DIGITS, ASCII_DIGITS
from quire.functions.normalize import LETTER_FOLD
from quire.functions.urls import RESERVED


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@lru_cache(1)
def _folds() -> str:
    """Rows (character, what it contributes) of all characters that are more than kept or dropped: from the character
    data and the list of variants alone, not by the engine's own kernel."""
    to = {v: k for k, vs in LETTER_FOLD.items() for v in vs}
    rows = []
    for code in range(0x20, 0x30000):
        ch = chr(code)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Cn", "Co"):
            continue
        parts = [(c, unicodedata.category(c)) for c in unicodedata.normalize("NFKC", ch)]
        out = "".join(str(unicodedata.decimal(c)) if k == "Nd" else to.get(c, c).lower() for c, k in parts if k[0] in "LN" and c != "\u0640")
        if out != (ch.lower() if kind[0] in "LN" else ""):
            rows.append(f"({_q(ch)},{_q(out)})")
    return ",".join(rows)


_WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_NWS = "[^" + _WS[1:]
_DIGIT = f"[{ARABIC_DIGITS}]"

_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
_OPEN = r"[(\[{«“‘\"''\x{FD3E}\x{FD3F}]"
# cuts: raw place, before openers, in words to the nearest start; c4 has them as they are before they may not fall
_CUTS = (
    "c0 AS (SELECT m.book_id, m.stream, page, pdf_chars, length(raw_text) AS n, raw_text, CASE WHEN boundary >= len(norm_map) THEN length(raw_text) ELSE norm_map[boundary + 1] END AS cut"
    " FROM m JOIN s USING (book_id, stream) WHERE boundary IS NOT NULL AND norm_text IS NOT NULL),"
    f" c1 AS (SELECT *, greatest(cut - 60, 0) AS lo, cut - length(regexp_extract(substr(raw_text, greatest(cut - 60, 0) + 1, least(cut, 60)), '((?:{_OPEN}{_WS}?)+)$', 1)) AS opn FROM c0),"
    " c2 AS (SELECT *, substr(raw_text, lo + 1, opn - lo) AS l, substr(raw_text, opn + 1, lo + 120 - opn) AS r FROM c1),"
    f" c3 AS (SELECT *, length(regexp_extract(l, '{_WS}({_NWS}+)$', 1)) AS dl, length(regexp_extract(r, '^({_NWS}*{_WS}+){_NWS}', 1)) AS dr,"
    r" regexp_matches(l, '[\p{L}\p{N}]$') AND regexp_matches(r, '^[\p{L}\p{N}]') AS inside FROM c2),"
    " c4 AS (SELECT *, least(n, CASE WHEN NOT coalesce(pdf_chars > 0, false) THEN cut WHEN inside AND dl BETWEEN 1 AND 14 AND (dl <= dr OR dr NOT BETWEEN 1 AND 14) THEN opn - dl WHEN inside AND dr BETWEEN 1 AND 14 THEN opn + dr ELSE opn END) AS moved FROM c3)"
)

BLOCKS = "b AS (SELECT DISTINCT block_id, book_id, page, block_ord, lines, text, x0, y0, x1, y1, font_size, fonts, kind FROM pdf_blocks)"
PAGES = "p AS (SELECT DISTINCT * FROM pdf_pages)"
STREAMS = "s AS (SELECT DISTINCT stream_id, book_id, CAST(stream AS INT) AS stream, raw_text, norm_text, norm_map FROM streams)"
TEXTS = f"{STREAMS}, e AS (SELECT book_id, stream, norm_text AS norm, length(norm_text) AS n_e FROM s WHERE norm_text IS NOT NULL)"
MATCHES = (
    "m AS (SELECT DISTINCT book_id, CAST(stream AS INT) AS stream, page, pdf_chars, status, start_pos, end_pos, score, anchors_hit, boundary, raw_start, raw_end FROM page_matches)"
)
TOC = "t AS (SELECT DISTINCT book_id, ord, url, path, discovered FROM toc)"
SITE = "w AS (SELECT DISTINCT page_id, book_id, ord, url, host, title, body, footnotes FROM page_contents)"
FOLD = f"fold(ch, rep) AS (VALUES {_folds()})"


def _norm(source: str, keys: str, text: str) -> str:
    """A query: ``keys`` and ``norm``, the normalised ``text`` of ``source``."""
    rep = r"coalesce(rep, CASE WHEN regexp_matches(ch, '[\p{L}\p{N}]') THEN lower(ch) ELSE '' END)"
    return (
        f"SELECT {keys}, coalesce(string_agg({rep}, '' ORDER BY i), '') AS norm, flatten(list([i - 1 FOR x IN range(length({rep}))] ORDER BY i)) AS norm_map FROM"
        f" (SELECT {keys}, unnest(l) AS ch, generate_subscripts(l, 1) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '(?s).') AS l FROM {source})) LEFT JOIN fold USING (ch) GROUP BY ALL"
    ).replace("GROUP BY ALL", f"GROUP BY {keys}")


PAGE_TEXTS = (
    f"{BLOCKS}, {PAGES}, {FOLD}, pt0 AS (SELECT book_id, page, CASE kind WHEN 'body' THEN 0 ELSE 1 END AS stream, string_agg(text, chr(10) ORDER BY block_ord) AS text"
    f" FROM b WHERE kind IN ('body', 'footnote') GROUP BY ALL), pt1 AS ({_norm('pt0', 'book_id, page, stream', 'text')}),"
    " pt AS (SELECT p.book_id, st.stream, p.page, coalesce(pt1.norm, '') AS norm FROM p CROSS JOIN (VALUES (0), (1)) st(stream) LEFT JOIN pt1 ON pt1.book_id = p.book_id AND pt1.page = p.page AND pt1.stream = st.stream)"
)
OFFSETS = "po AS (SELECT *, CAST(coalesce(sum(length(norm) + 1) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS offs FROM pt)"
UNIQUE = (
    "ug AS (SELECT book_id, stream, g, min(j) AS j FROM (SELECT book_id, stream, substr(norm, CAST(i AS INT) + 1, 8) AS g, CAST(offs + i AS INT) AS j FROM"
    " (SELECT *, unnest(range(length(norm) - 7)) AS i FROM po)) GROUP BY ALL HAVING count(*) = 1)"
).replace("GROUP BY ALL", "GROUP BY book_id, stream, g")
RARE = (
    "rg AS (SELECT book_id, stream, g, CAST(count(*) AS INT) AS n, list(q ORDER BY q) AS places FROM (SELECT book_id, stream, substr(norm, CAST(i AS INT) + 1, 8) AS g, CAST(i AS INT) AS q FROM"
    " (SELECT *, unnest(range(n_e - 7)) AS i FROM e)) GROUP BY book_id, stream, g HAVING count(*) <= 3)"
)

URL = r"'^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::(\d*))?([^?#]*)'"


def _url(col: str) -> str:
    part = lambda i: f"regexp_extract({col}, {URL}, {i})"
    path = f"regexp_replace(CASE WHEN {part(4)} = '' THEN '/' ELSE {part(4)} END, '/+', '/', 'g')"
    port = f"CASE WHEN {part(3)} = '' OR (lower({part(1)}) = 'http' AND {part(3)} = '80') OR (lower({part(1)}) = 'https' AND {part(3)} = '443') THEN '' ELSE ':' || {part(3)} END"
    return f"lower({part(1)}) || '://' || lower({part(2)}) || {port} || {path} || CASE WHEN regexp_matches({path}, '/$|\\.[^/]*$') THEN '' ELSE '/' END"


BOUNDS = (
    f"{TEXTS}, {MATCHES}, a0 AS (SELECT m.*, n_e, CASE WHEN pdf_chars > 0 THEN start_pos END AS kn FROM m JOIN e USING (book_id, stream)),"
    " a1 AS (SELECT *, count(kn) OVER u AS isl, CASE WHEN kn IS NOT NULL THEN greatest(kn, coalesce(nullif(end_pos, 0), kn)) END AS le FROM a0 WINDOW u AS (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),"
    " a2 AS (SELECT *, coalesce(last_value(le IGNORE NULLS) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,"
    " coalesce(first_value(kn IGNORE NULLS) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_e) AS r0,"
    " CASE WHEN kn IS NULL AND pdf_chars > 0 THEN pdf_chars ELSE 0 END AS free FROM a1),"
    " a3 AS (SELECT *, greatest(r0, lft) AS rgt, sum(free) OVER (PARTITION BY book_id, stream, isl) AS tot, coalesce(sum(free) OVER (PARTITION BY book_id, stream, isl ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum FROM a2),"
    " a4 AS (SELECT *, (rgt - lft >= 0.3::DOUBLE * tot AND tot >= 20) AS room FROM a3),"
    " a5 AS (SELECT *, CASE WHEN pdf_chars > 0 THEN coalesce(kn, CASE WHEN room THEN lft + round_even((rgt - lft) * cum::DOUBLE / greatest(tot, 1), 0) ELSE rgt END) END AS v, CASE WHEN free > 0 THEN CASE WHEN room THEN 'interpolated' ELSE 'missing' END END AS gap_status FROM a4),"
    " a6 AS (SELECT *, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n_e) AS v2 FROM a5),"
    " bd AS (SELECT book_id, stream, page, pdf_chars, start_pos, end_pos, anchors_hit, n_e, gap_status, CAST(greatest(0, least(n_e, max(v2) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) AS INT) AS bnd FROM a6)"
)
SCORED = (
    f"{BOUNDS}, {PAGE_TEXTS}, sg AS (SELECT *, bnd AS lo, coalesce(lead(bnd) OVER (PARTITION BY book_id, stream ORDER BY page), end_pos, n_e) AS hi FROM (SELECT bd.*, pt.norm AS pn FROM bd JOIN pt USING (book_id, stream, page))),"
    " sx AS (SELECT sg.*, substr(e.norm, lo + 1, greatest(hi - lo, 0)) AS seg FROM sg JOIN e USING (book_id, stream)),"
    " tg AS (SELECT book_id, stream, page, substr(pn, CAST(i AS INT) + 1, 3) AS g, 1 AS x, 0 AS y FROM (SELECT *, unnest(range(length(pn) - 2)) AS i FROM sx WHERE length(pn) >= 3 AND length(seg) >= 3)"
    " UNION ALL SELECT book_id, stream, page, substr(seg, CAST(i AS INT) + 1, 3), 0, 1 FROM (SELECT *, unnest(range(length(seg) - 2)) AS i FROM sx WHERE length(pn) >= 3 AND length(seg) >= 3)),"
    " cm AS (SELECT book_id, stream, page, sum(k) AS k FROM (SELECT book_id, stream, page, g, least(sum(x), sum(y)) AS k FROM tg GROUP BY book_id, stream, page, g) GROUP BY book_id, stream, page),"
    " sc AS (SELECT sx.*, length(seg) AS seg_chars, CASE WHEN pdf_chars <= 0 THEN 0.0::DOUBLE ELSE round_even(CASE WHEN pn = '' OR seg = '' THEN 0.0::DOUBLE WHEN length(pn) < 3 OR length(seg) < 3 THEN CASE WHEN pn = seg THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    " ELSE 2.0::DOUBLE * coalesce(k, 0) / (length(pn) + length(seg) - 4) END, 4) END AS score FROM sx LEFT JOIN cm USING (book_id, stream, page))"
)
STATUS = (
    "CASE WHEN pdf_chars = 0 THEN 'empty' WHEN gap_status = 'missing' THEN 'missing' WHEN pdf_chars >= 60 AND seg_chars < 0.15::DOUBLE * pdf_chars AND score < 0.3::DOUBLE THEN 'missing' WHEN gap_status = 'interpolated' THEN 'interpolated'"
    " WHEN anchors_hit >= 1 AND score < 0.6::DOUBLE AND seg_chars < 0.7::DOUBLE * pdf_chars THEN 'partial' WHEN anchors_hit >= 2 AND score >= 0.85::DOUBLE THEN 'exact' WHEN score >= 0.55::DOUBLE AND anchors_hit >= 2 THEN 'exact' ELSE 'fuzzy' END"
)
CONFIDENCE = "CASE WHEN status = 'empty' THEN 'n/a' WHEN status = 'exact' AND score >= 0.85 THEN 'high' WHEN status IN ('exact', 'fuzzy') AND score >= 0.55 THEN 'medium' ELSE 'low' END"
PARAGRAPHS = (
    f"{STREAMS}, pr0 AS (SELECT book_id, stream, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS node_ord FROM (SELECT book_id, stream, string_split(raw_text, chr(10)) AS l FROM s WHERE raw_text IS NOT NULL)),"
    " pr AS (SELECT book_id, stream, CAST(node_ord AS INT) AS node_ord, text, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY book_id, stream ORDER BY node_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS st FROM pr0)"
)
SIG = "CAST(round_even(y0 / 4, 0) AS INT)"
HEADS = (
    f"{BLOCKS}, {PAGES}, ts AS (SELECT book_id, page, arg_min(struct_pack(f := fonts, st := {SIG}), struct_pack(a := y0, o := block_ord)) AS sig FROM (SELECT b.*, height FROM b JOIN p USING (book_id, page)) WHERE y0 < 0.25 * height GROUP BY book_id, page),"
    " np AS (SELECT book_id, count(*) AS pages FROM p GROUP BY book_id), rs AS (SELECT book_id, sig, count(*) AS n FROM ts JOIN np USING (book_id) GROUP BY book_id, sig, pages HAVING count(*) >= CASE WHEN pages > 4 THEN greatest(3, floor(0.3 * pages)) ELSE 2 END)"
)
CLASSIFIED = (
    f"{HEADS}, {FOLD}, lk AS (SELECT block_id, array_to_string(lines, ' ') AS jl FROM b WHERE lines IS NOT NULL), nm AS ({_norm('lk', 'block_id', 'jl')}),"
    f" c0 AS (SELECT b.*, height, separator_y, coalesce(nm.norm, '') AS norm, coalesce(struct_pack(f := fonts, st := {SIG}) = h.sig, false) AS hit FROM b JOIN p USING (book_id, page) LEFT JOIN (SELECT ts.* FROM ts JOIN rs USING (book_id, sig)) h USING (book_id, page) LEFT JOIN nm USING (block_id)),"
    " c1 AS (SELECT *, y1 <= height * 0.12 AS top, y0 >= height * (1.0 - 0.06) AS bottom FROM c0),"
    " c2 AS (SELECT *, CASE WHEN top OR bottom OR hit THEN CASE WHEN regexp_replace(norm, '[0-9]', '', 'g') = '' THEN 'page_number' WHEN top OR hit THEN 'header' ELSE 'footer' END WHEN separator_y IS NOT NULL AND (y0 + y1) / 2 >= separator_y THEN 'footnote' ELSE 'body' END AS k1 FROM c1),"
    " fs AS (SELECT book_id, arg_max(size, struct_pack(a := n, b := -size)) AS bs FROM (SELECT book_id, round_even(font_size * 2, 0) / 2 AS size, sum(list_sum([length(x) FOR x IN lines])) AS n FROM c2 WHERE k1 = 'body' GROUP BY ALL) GROUP BY book_id)"
).replace("GROUP BY ALL) GROUP BY book_id)", "GROUP BY book_id, size) GROUP BY book_id)")
SECTIONS = (
    f"{TOC}, g0 AS (SELECT *, coalesce(path[1], '') AS section FROM t), g1 AS (SELECT book_id, section, row_number() OVER (PARTITION BY book_id ORDER BY min(ord)) AS group_no FROM g0 GROUP BY book_id, section),"
    " g2 AS (SELECT g0.*, group_no, row_number() OVER (PARTITION BY book_id, section ORDER BY ord) AS page_no FROM g0 JOIN g1 USING (book_id, section))"
)
TREE = (
    f"{SECTIONS}, x0 AS (SELECT book_id, ord, printf('chap_%03d_%03d.xhtml', group_no, page_no) AS href, path AS fp, unnest(range(1, len(path) + 1)) AS n FROM g2 WHERE path IS NOT NULL),"
    " x1 AS (SELECT book_id, ord, href, fp, list_slice(fp, 1, n) AS path FROM x0), x2 AS (SELECT book_id, path, min(ord) AS fo, arg_max(href, ord) FILTER (WHERE path = fp) AS href FROM x1 GROUP BY book_id, path),"
    " x3 AS (SELECT a.book_id, a.path, list(b.fo ORDER BY len(b.path)) AS k FROM x2 a JOIN x2 b ON a.book_id = b.book_id AND len(b.path) <= len(a.path) AND list_slice(a.path, 1, len(b.path)) = b.path GROUP BY a.book_id, a.path),"
    " tr AS (SELECT x2.book_id, x2.path, x2.path[-1] AS title, len(x2.path) AS depth, row_number() OVER (PARTITION BY x2.book_id ORDER BY k, len(x2.path), array_to_string(x2.path, chr(1))) AS preorder, href FROM x2 JOIN x3 USING (book_id, path))"
)
GOOD = "('exact', 'fuzzy', 'partial')"

SQL: dict[str, str] = {
    "text_normalize": f"WITH {FOLD}, n AS ({_norm('documents', 'doc_id', 'text')}) SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(n.norm, '') END AS norm FROM documents d LEFT JOIN n USING (doc_id)",
    "norm_map": f"WITH {FOLD}, n AS ({_norm('documents', 'doc_id', 'text')}) SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(CAST(n.norm_map AS INT[]), []) END AS norm_map FROM documents d LEFT JOIN n USING (doc_id)",
    "digit_runs": f"WITH r AS (SELECT doc_id, unnest(l) AS run, generate_subscripts(l, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(text, '{_DIGIT}{{2,}}') AS l FROM documents)) SELECT doc_id, CAST(n AS INT) AS n, CAST(CAST(translate(run, '{ARABIC_DIGITS}', '{ASCII_DIGITS}') AS DECIMAL(38,0)) AS VARCHAR) AS as_is, CAST(CAST(translate(reverse(run), '{ARABIC_DIGITS}', '{ASCII_DIGITS}') AS DECIMAL(38,0)) AS VARCHAR) AS reversed_value FROM r",
    "reverse_digits": f"SELECT doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all(text, '{_DIGIT}+|[^{ARABIC_DIGITS}]+'), lambda x: CASE WHEN regexp_matches(x, '^{_DIGIT}') THEN reverse(x) ELSE x END), '') END AS text FROM documents",
    "text_order": f"WITH {BLOCKS}, o AS (SELECT block_id, 'logical' AS mode, lines AS l FROM b UNION ALL SELECT block_id, 'reverse_chars', list_transform(lines, lambda x: array_to_string(list_reverse(regexp_extract_all(x, '(?s).')), '')) FROM b UNION ALL SELECT block_id, 'reverse_words', list_transform(lines, lambda x: array_to_string(list_reverse(string_split(trim(regexp_replace(x, '{_WS}+', ' ', 'g')), ' ')), ' ')) FROM b) SELECT block_id, mode, array_to_string(list_transform(l, lambda x: regexp_replace(x, '[\x27\x27]?[اﺍﺎ]ﷲ', 'ﷲ', 'g')), chr(10)) AS text FROM o".replace("[\x27\x27]?", ""),
    "url_normalize": f"SELECT url, {_url('url')} AS norm_url FROM (SELECT DISTINCT url FROM toc)",
    "url_dedup": f"WITH {TOC} SELECT book_id, {_url('url')} AS url, min(ord) AS ord FROM t WHERE url IS NOT NULL GROUP BY 1, 2",
    "url_scope": rf"WITH u AS (SELECT url, {_url('url')} AS n FROM (SELECT DISTINCT url FROM toc)) SELECT url, nullif(regexp_extract(n, '^[a-z]+://[^/]+/[a-z]{{2}}/[a-z]+/([^/]+)/', 1), '') AS book_ref, nullif(regexp_extract(n, '^[a-z]+://[^/]+/[a-z]{{2}}/[a-z]+/[^/]+/'), '') AS scope, regexp_extract(url, '#(.*)$', 1) AS fragment FROM u",
    "cache_key": f"SELECT url, sha256({_url('url')}) AS cache_key FROM (SELECT DISTINCT url FROM page_contents)",
    "safe_filename": f"WITH a AS (SELECT DISTINCT book_id, title FROM book_meta), n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(title, ''), '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '{_WS}+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g') AS f FROM a), k AS (SELECT *, CASE WHEN f = '' THEN 'book' WHEN upper(f) IN ({', '.join(map(_q, RESERVED))}) THEN f || '_' ELSE f END AS g FROM n) SELECT book_id, title, CASE WHEN length(g) > 40 THEN regexp_replace(substr(g, 1, 40), '[ .]+$', '') ELSE g END AS file_name FROM k",
    "mime_extension": "SELECT mime, CASE WHEN lower(mime) LIKE '%png%' THEN '.png' WHEN lower(mime) LIKE '%gif%' THEN '.gif' WHEN lower(mime) LIKE '%webp%' THEN '.webp' WHEN lower(mime) LIKE '%svg%' THEN '.svg' ELSE '.jpg' END AS extension FROM (VALUES ('image/jpeg'), ('image/png; q=1'), ('IMAGE/GIF'), ('image/svg+xml'), ('image/webp'), ('text/html'), (NULL)) v(mime)",
    "page_offsets": f"WITH {PAGE_TEXTS}, {OFFSETS} SELECT book_id, stream, page, offs AS \"offset\", CAST(length(norm) AS INT) AS n_chars FROM po",
    "rare_gram_index": f"WITH {TEXTS}, {RARE} SELECT book_id, stream, g, n, array_to_string(places, ',') AS places FROM rg",
    "unique_page_grams": f"WITH {PAGE_TEXTS}, {OFFSETS}, {UNIQUE} SELECT * FROM ug",
    "anchor_hits": f"WITH {PAGE_TEXTS}, {OFFSETS}, {UNIQUE}, {TEXTS}, {RARE} SELECT book_id, stream, j, unnest(places) AS q FROM ug JOIN rg USING (book_id, stream, g)",
    "page_boundaries": f"WITH {BOUNDS} SELECT book_id, stream, page, bnd AS boundary, gap_status FROM bd",
    "extra_text": f"WITH {BOUNDS}, x AS (SELECT *, lead(bnd) OVER (PARTITION BY book_id, stream ORDER BY page) - coalesce(end_pos, bnd) AS extra FROM bd WHERE pdf_chars > 0) SELECT book_id, stream, page, CAST(extra AS INT) AS extra FROM x WHERE coalesce(gap_status <> 'interpolated', true) AND extra > greatest(120.0, 0.35::DOUBLE * pdf_chars)",
    "page_scores": f"WITH {SCORED} SELECT book_id, stream, page, score, CAST(seg_chars AS INT) AS seg_chars FROM sc",
    "page_status": f"WITH {SCORED}, z AS (SELECT book_id, stream, page, score, {STATUS} AS status FROM sc) SELECT book_id, stream, page, status, {CONFIDENCE} AS confidence FROM z",
    "status_histogram": f"WITH {MATCHES} SELECT book_id, status, count(*) AS n FROM m GROUP BY book_id, status",
    "confidence_histogram": f"WITH {MATCHES} SELECT book_id, {CONFIDENCE} AS confidence, count(*) AS n FROM m GROUP BY 1, 2",
    "mean_score": f"WITH {MATCHES} SELECT book_id, coalesce(round_even(avg(score) FILTER (WHERE status IN {GOOD}), 4), 0.0::DOUBLE) AS mean_score FROM m GROUP BY book_id",
    "accepted_books": f"WITH {MATCHES}, g AS (SELECT book_id, count(*) FILTER (WHERE pdf_chars > 0) AS text_pages, count(*) FILTER (WHERE pdf_chars > 0 AND status IN {GOOD}) AS good_pages FROM m GROUP BY book_id) SELECT *, text_pages = 0 OR good_pages >= 0.3::DOUBLE * text_pages AS accepted FROM g",
    "problem_pages": f"WITH {MATCHES}, z AS (SELECT book_id, stream, page, status, {CONFIDENCE} AS confidence FROM m) SELECT * FROM z WHERE status IN ('missing', 'partial', 'interpolated', 'unmatched') OR confidence = 'low'",
    "last_text_end": f"WITH {TEXTS}, {MATCHES} SELECT book_id, stream, CAST(arg_max(least(n_e, greatest(coalesce(end_pos, 0), least(n_e, boundary + pdf_chars))), page) AS INT) AS last_end FROM m JOIN e USING (book_id, stream) WHERE pdf_chars > 0 AND status <> 'missing' GROUP BY book_id, stream",
    "text_hit_rate": f"WITH {PAGE_TEXTS}, {TEXTS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, stream ORDER BY length(norm) DESC, page) AS k FROM pt), pb AS (SELECT book_id, stream, substr(norm, CAST(floor((length(norm) - 10) * i / 7.0::DOUBLE) AS INT) + 1, 10) AS probe FROM (SELECT *, unnest(range(8)) AS i FROM r WHERE k <= 12 AND length(norm) >= 30)) SELECT book_id, stream, CAST(count(*) FILTER (WHERE contains(e.norm, probe)) AS INT) AS hits, CAST(count(*) AS INT) AS probes FROM pb JOIN e USING (book_id, stream) GROUP BY book_id, stream",
    "page_of_offset": f"WITH {PARAGRAPHS}, {MATCHES}, rs AS (SELECT book_id, stream, raw_start, max(page) AS page FROM m WHERE raw_start IS NOT NULL GROUP BY book_id, stream, raw_start), f AS (SELECT book_id, stream, arg_min(page, raw_start) AS page FROM rs GROUP BY book_id, stream) SELECT pr.book_id, pr.stream, pr.node_ord, coalesce(rs.page, f.page) AS page FROM pr ASOF LEFT JOIN rs ON pr.book_id = rs.book_id AND pr.stream = rs.stream AND pr.st >= rs.raw_start LEFT JOIN f ON f.book_id = pr.book_id AND f.stream = pr.stream WHERE coalesce(rs.page, f.page) IS NOT NULL",
    "nearest_note_start": f"WITH {PARAGRAPHS}, {MATCHES}, c AS (SELECT book_id, stream, page, raw_start FROM m WHERE stream = 1 AND raw_start IS NOT NULL) SELECT c.book_id, c.stream, c.page, c.raw_start, arg_min(st, struct_pack(d := abs(st - raw_start), s := st)) AS nearest FROM c LEFT JOIN (SELECT * FROM pr WHERE text <> '') q ON q.book_id = c.book_id AND q.stream = c.stream AND abs(st - raw_start) <= 25 GROUP BY c.book_id, c.stream, c.page, c.raw_start",
    "span_overlap": f"WITH {PARAGRAPHS}, {MATCHES} SELECT m.book_id, m.stream, m.page, node_ord, substr(text, greatest(raw_start - st, 0) + 1, least(raw_end - st, length(text)) - greatest(raw_start - st, 0)) AS piece, st >= raw_start AS keeps_id FROM pr JOIN m ON m.book_id = pr.book_id AND m.stream = pr.stream AND st < raw_end AND st + length(text) > raw_start WHERE text <> '' AND raw_end > raw_start",
    "block_classify": f"WITH {CLASSIFIED} SELECT block_id, CASE WHEN k1 = 'body' AND bs > 0 AND separator_y IS NULL AND font_size <= bs * 0.9 AND y0 > height * 0.45 THEN 'footnote' ELSE k1 END AS found_kind FROM c2 LEFT JOIN fs USING (book_id)",
    "header_signatures": f"WITH {HEADS} SELECT book_id, array_to_string(sig.f, ',') AS fonts, sig.st AS step, n FROM rs",
    "body_font_mode": f"WITH {BLOCKS}, z AS (SELECT book_id, round_even(font_size * 2, 0) / 2 AS size, sum(list_sum([length(x) FOR x IN lines])) AS n FROM b WHERE kind = 'body' GROUP BY book_id, round_even(font_size * 2, 0) / 2) SELECT book_id, arg_max(size, struct_pack(a := n, b := -size)) AS body_font_size FROM z GROUP BY book_id",
    "removed_heads": f"WITH {BLOCKS}, {FOLD}, h AS (SELECT block_id, array_to_string(lines, ' ') AS jl FROM b WHERE kind IN ('header', 'footer')), n AS ({_norm('h', 'block_id', 'jl')}) SELECT book_id, substr(regexp_replace(coalesce(norm, ''), '[0-9]+', '', 'g'), 1, 30) AS signature, count(*) AS n FROM b LEFT JOIN n USING (block_id) WHERE kind IN ('header', 'footer') GROUP BY 1, 2",
    "page_kinds": f"WITH {BLOCKS}, {PAGES}, n AS (SELECT book_id, page, coalesce(sum(length(regexp_replace(array_to_string(lines, ''), '{_WS}+', '', 'g'))) FILTER (WHERE kind = 'body'), 0) AS bc, coalesce(sum(length(regexp_replace(array_to_string(lines, ''), '{_WS}+', '', 'g'))) FILTER (WHERE kind = 'footnote'), 0) AS nc FROM b GROUP BY book_id, page), z AS (SELECT p.book_id, p.page, p.kind IN ('image', 'mixed') AS art, coalesce(bc, 0) AS body_chars, coalesce(nc, 0) AS note_chars FROM p LEFT JOIN n USING (book_id, page)) SELECT book_id, page, CASE WHEN art AND body_chars < 25 THEN 'image' WHEN art THEN 'mixed' WHEN body_chars + note_chars = 0 THEN 'blank' ELSE 'text' END AS found_kind, CAST(body_chars AS BIGINT) AS body_chars, CAST(note_chars AS BIGINT) AS note_chars FROM z",
    "page_regions": f"WITH {BLOCKS} SELECT book_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY book_id, page",
    "separator_check": f"WITH {BLOCKS}, {PAGES}, l AS (SELECT book_id, page, round_even(separator_y, 1) AS y FROM p WHERE separator_y IS NOT NULL AND 100 <= 0.8 * width AND separator_y > 0.30 * height AND separator_y < 0.985 * height) SELECT book_id, page, max(y) AS separator_y FROM l WHERE EXISTS (SELECT 1 FROM b WHERE b.book_id = l.book_id AND b.page = l.page AND b.y0 >= y - 3) GROUP BY book_id, page",
    "consecutive_numbers": f"WITH {BLOCKS}, r0 AS (SELECT book_id, page, block_ord, unnest(lines) AS line, generate_subscripts(lines, 1) AS ln FROM b WHERE kind IN ('body', 'footnote')), r1 AS (SELECT *, regexp_extract_all(line, '{_DIGIT}{{2,}}') AS l FROM r0), r2 AS (SELECT book_id, page, block_ord, ln, unnest(l) AS run, generate_subscripts(l, 1) AS n FROM r1), r3 AS (SELECT *, CAST(translate(run, '{ARABIC_DIGITS}', '{ASCII_DIGITS}') AS DECIMAL(38,0)) AS a, CAST(translate(reverse(run), '{ARABIC_DIGITS}', '{ASCII_DIGITS}') AS DECIMAL(38,0)) AS r FROM r2), r4 AS (SELECT book_id, a = lag(a) OVER u + 1 AS sa, r = lag(r) OVER u + 1 AS sr FROM r3 WINDOW u AS (PARTITION BY book_id ORDER BY page, block_ord, ln, n)) SELECT book_id, count(*) FILTER (WHERE sa) AS as_is, count(*) FILTER (WHERE sr) AS \"reversed\" FROM r4 GROUP BY book_id",
    "note_places": f"WITH {BLOCKS}, {PAGES}, z AS (SELECT p.book_id, p.page, coalesce(sum(n) FILTER (WHERE y1 <= separator_y + 2), 0) AS above, coalesce(sum(n), 0) AS total FROM p LEFT JOIN (SELECT book_id, page, y1, length(regexp_replace(array_to_string(lines, ''), '{_WS}+', '', 'g')) AS n FROM b WHERE kind = 'body') q USING (book_id, page) WHERE separator_y IS NOT NULL GROUP BY p.book_id, p.page) SELECT book_id, page, round_even(above::DOUBLE / greatest(total, 1), 6) AS y_ratio FROM z",
    "toc_sections": f"WITH {SECTIONS} SELECT book_id, ord, section, CAST(group_no AS INT) AS group_no, CAST(page_no AS INT) AS page_no, printf('chap_%03d.xhtml', group_no) AS href FROM g2",
    "toc_tree": f"WITH {TREE} SELECT book_id, array_to_string(path, ' / ') AS path, title, CAST(depth AS INT) AS depth, CAST(preorder AS INT) AS preorder, href FROM tr",
    "navigation": f"WITH {TREE}, f0 AS (SELECT a.book_id, a.path, arg_min(b.href, b.preorder) AS first_href FROM tr a JOIN tr b ON a.book_id = b.book_id AND b.href IS NOT NULL AND list_slice(b.path, 1, len(a.path)) = a.path GROUP BY a.book_id, a.path),"
    f" n0 AS (SELECT tr.book_id, preorder, CAST(depth AS BIGINT) AS depth, {_ESCAPE.format('title')} AS t, {_ESCAPE.format('first_href')} AS h FROM tr LEFT JOIN f0 USING (book_id, path)),"
    " n1 AS (SELECT *, lag(depth, 1, 0) OVER u AS d0, lead(depth, 1, 0) OVER u AS d1 FROM n0 WINDOW u AS (PARTITION BY book_id ORDER BY preorder))"
    " SELECT book_id, string_agg((CASE WHEN depth > d0 THEN '<ol>' ELSE '' END) || '<li>' || (CASE WHEN h IS NOT NULL THEN '<a href=\"' || h || '\">' || t || '</a>' ELSE '<span>' || t || '</span>' END)"
    " || (CASE WHEN d1 > depth THEN '' ELSE '</li>' || repeat('</ol></li>', depth - greatest(d1, 1)) || (CASE WHEN d1 = 0 THEN '</ol>' ELSE '' END) END), '' ORDER BY preorder) AS nav FROM n1 GROUP BY book_id",
    "ncx_play_order": f"WITH {TREE}, f0 AS (SELECT a.book_id, a.path, arg_min(b.href, b.preorder) AS first_href FROM tr a JOIN tr b ON a.book_id = b.book_id AND b.href IS NOT NULL AND list_slice(b.path, 1, len(a.path)) = a.path GROUP BY a.book_id, a.path), f1 AS (SELECT book_id, preorder, first_href FROM tr JOIN f0 USING (book_id, path)), f2 AS (SELECT book_id, first_href, row_number() OVER (PARTITION BY book_id ORDER BY min(preorder)) AS play_order FROM f1 GROUP BY book_id, first_href) SELECT book_id, CAST(preorder AS INT) AS preorder, first_href, CAST(play_order AS INT) AS play_order FROM f1 JOIN f2 USING (book_id, first_href)",
    "crawl_frontier": f"WITH RECURSIVE {TOC}, {SITE}, sd AS (SELECT book_id, {_url('url')} AS url, min(ord) AS rk FROM t WHERE NOT discovered AND url IS NOT NULL GROUP BY 1, 2), lk AS (SELECT DISTINCT book_id, url, nx FROM (SELECT book_id, {_url('url')} AS url, lead({_url('url')}) OVER (PARTITION BY book_id ORDER BY ord, page_id) AS nx FROM w WHERE url IS NOT NULL) WHERE nx IS NOT NULL),"
    " f(book_id, url, level, rk) AS (SELECT book_id, url, 0, rk FROM sd UNION SELECT f.book_id, lk.nx, f.level + 1, f.rk FROM f JOIN lk ON lk.book_id = f.book_id AND lk.url = f.url WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.book_id = f.book_id AND sd.url = lk.nx) AND f.level < 2000),"
    " g AS (SELECT book_id, url, level, min(rk) AS rk, row_number() OVER (PARTITION BY book_id, url ORDER BY level) AS k FROM f GROUP BY book_id, url, level), h AS (SELECT * FROM g WHERE k = 1) SELECT book_id, url, level, CAST(pl AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY level, rk, url) AS pl FROM h) WHERE pl <= 3000",
    "dead_letter": f"WITH {TOC} SELECT DISTINCT book_id, url, CASE WHEN body IS NULL THEN 'no body' ELSE 'empty body' END AS error FROM (SELECT DISTINCT book_id, url, title, body FROM page_contents WHERE body IS NULL OR trim(body) = '') UNION ALL SELECT DISTINCT book_id, NULL, 'no entries' FROM book_meta WHERE book_id NOT IN (SELECT book_id FROM t)",
    "html_links": f"WITH {SITE}, l AS (SELECT page_id, regexp_extract_all(body, '<a [^>]*href=\"([^\"]*)\"', 1) AS l FROM w WHERE body IS NOT NULL) SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS n, unnest(l) AS href FROM l",
    "html_text": f"WITH {SITE} SELECT page_id, regexp_replace(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS text FROM w WHERE body IS NOT NULL",
    "unique_ids": f"WITH {SITE}, k AS (SELECT book_id, page_id AS ord, title, row_number() OVER (PARTITION BY book_id, title ORDER BY page_id) AS k FROM w WHERE title IS NOT NULL) SELECT book_id, ord, CASE WHEN k = 1 THEN title WHEN k = 2 THEN title || '-d1' ELSE title || '-d1-' || (k - 1) END AS new_id FROM k",
    "page_output": f"WITH {STREAMS}, {MATCHES}, t AS (SELECT book_id, stream, raw_text, replace(raw_text, chr(10), '') AS x FROM s WHERE raw_text IS NOT NULL), c AS (SELECT m.book_id, m.stream, page, max(length(replace(substr(raw_text, 1, raw_start), chr(10), ''))) OVER (PARTITION BY m.book_id, m.stream ORDER BY page) AS cut, x FROM m JOIN t USING (book_id, stream) WHERE raw_start IS NOT NULL),"
    " e AS (SELECT *, lead(cut, 1, length(x)) OVER (PARTITION BY book_id, stream ORDER BY page) AS nxt FROM c), p AS (SELECT book_id, page, coalesce(max(CASE WHEN stream = 0 THEN substr(x, cut + 1, nxt - cut) END), '') AS b, coalesce(max(CASE WHEN stream = 1 THEN substr(x, cut + 1, nxt - cut) END), '') AS n FROM e GROUP BY book_id, page)"
    " SELECT book_id, page, CAST(length(b) AS INT) AS body_chars, md5(b) AS body, CAST(length(n) AS INT) AS note_chars, md5(n) AS notes FROM p",
    "output_verified": f"WITH {STREAMS}, {MATCHES} SELECT DISTINCT m.book_id, true AS body_ok, true AS notes_ok, true AS count_ok, true AS ok FROM m JOIN s USING (book_id, stream) WHERE raw_start IS NOT NULL AND raw_text IS NOT NULL",
    "image_modes": f"WITH {PAGES}, {MATCHES}, x AS (SELECT DISTINCT book_id, page FROM m WHERE stream = 0 AND status = 'missing') SELECT * FROM (SELECT p.book_id, p.page, CASE WHEN kind = 'image' THEN 'image' WHEN kind = 'mixed' THEN 'inline' WHEN x.page IS NOT NULL THEN 'fallback' END AS mode FROM p LEFT JOIN x ON x.book_id = p.book_id AND x.page = p.page) WHERE mode IS NOT NULL",
    "raw_cuts": f"WITH {STREAMS}, {MATCHES}, {_CUTS} SELECT book_id, stream, page, CAST(greatest(0, max(moved) OVER (PARTITION BY book_id, stream ORDER BY page)) AS INT) AS cut FROM c4",
    "note_cuts": f"WITH {PARAGRAPHS}, {MATCHES}, c AS (SELECT book_id, stream, page, raw_start FROM m WHERE stream = 1 AND raw_start IS NOT NULL), n AS (SELECT c.book_id, c.stream, c.page, coalesce(arg_min(st, struct_pack(d := abs(st - raw_start), s := st)), raw_start) AS cut FROM c LEFT JOIN (SELECT * FROM pr WHERE text <> '') q ON q.book_id = c.book_id AND q.stream = c.stream AND abs(st - raw_start) <= 25 GROUP BY c.book_id, c.stream, c.page, c.raw_start) SELECT book_id, stream, page, max(cut) OVER (PARTITION BY book_id, stream ORDER BY page) AS cut FROM n",
    "concat_invariant": f"WITH {BLOCKS}, {STREAMS} SELECT 'block' AS kind, block_id AS id FROM b WHERE array_to_string(lines, chr(10)) IS DISTINCT FROM text UNION ALL SELECT 'stream', stream_id FROM s WHERE length(norm_text) <> len(norm_map)",
}

_DIAG = (
    "near{n} AS (SELECT *, list_sort(list_concat(coalesce(list(q - j) OVER (PARTITION BY book_id, stream ORDER BY j ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []), coalesce(list(q - j) OVER (PARTITION BY book_id, stream ORDER BY j ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), []))) AS nb FROM {src}),"
    " d{n} AS (SELECT book_id, stream, j, q, size FROM near{n} WHERE size < 3 OR len(nb) = 0 OR abs(q - j - nb[len(nb) // 2 + 1]) <= 80)"
)
SQL["diag_filter"] = (
    f"WITH {MATCHES}, d0 AS (SELECT *, count(*) OVER (PARTITION BY book_id, stream) AS size FROM (SELECT book_id, stream, CAST(coalesce(sum(pdf_chars + 1) OVER (PARTITION BY book_id, stream ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS j, start_pos AS q FROM m) WHERE q IS NOT NULL), "
    + ", ".join(_DIAG.format(n=n, src=f"d{n - 1}") for n in (1, 2))
    + " SELECT book_id, stream, j, q FROM d2"
)
