"""Equivalent SQL (DuckDB) of this package's queries, where SQL can express them."""

from quire.plans.sql import BLOCKS, FOLD, MATCHES, STREAMS, _norm

_LINES = (
    f"{BLOCKS}, {FOLD}, ln AS (SELECT block_id, book_id, page, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) - 1 AS INT) AS line_no FROM b),"
    f" dl AS (SELECT DISTINCT line FROM ln WHERE line IS NOT NULL), nk AS ({_norm('dl', 'line', 'line')}),"
    " kl AS (SELECT ln.*, regexp_replace(norm, '[0-9]', '', 'g') AS key FROM ln JOIN nk USING (line)),"
    " rk AS (SELECT book_id, key FROM kl WHERE key <> '' GROUP BY book_id, key HAVING count(DISTINCT page) >= 8),"
    " fd AS (SELECT DISTINCT block_id, line_no FROM kl JOIN rk USING (book_id, key))"
)
_SPANS = (
    f"{STREAMS}, ws AS (SELECT book_id, stream, CAST(i AS INT) AS i, substr(norm_text, CAST(i AS INT) + 1, 120) AS w FROM (SELECT *, unnest(range(length(norm_text) - 119)) AS i FROM s WHERE norm_text IS NOT NULL)),"
    " sw AS (SELECT w FROM ws GROUP BY w HAVING count(DISTINCT struct_pack(a := book_id, b := stream)) > 1), hs AS (SELECT ws.book_id, stream, i FROM ws JOIN sw USING (w)),"
    " gs AS (SELECT *, i > coalesce(lag(i) OVER u, -1000) + 120 AS fresh FROM hs WINDOW u AS (PARTITION BY book_id, stream ORDER BY i)),"
    " is0 AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY book_id, stream ORDER BY i) AS isl FROM gs),"
    " sp AS (SELECT book_id, stream, min(i) AS span_start, max(i) + 120 AS span_end FROM is0 GROUP BY book_id, stream, isl)"
)

SQL: dict[str, str] = {
    "p2_found": f"WITH {_SPANS} SELECT * FROM sp",
    "p2_pages": f"WITH {_SPANS}, {MATCHES}, sh AS (SELECT m.book_id, m.stream, m.page, CAST(sum(least(end_pos, span_end) - greatest(start_pos, span_start)) AS INT) AS n FROM m JOIN sp ON sp.book_id = m.book_id AND sp.stream = m.stream AND span_start < end_pos AND span_end > start_pos GROUP BY m.book_id, m.stream, m.page)"
    " SELECT m.book_id, m.stream, m.page, greatest(0, coalesce(end_pos - start_pos, 0)) AS n_chars, coalesce(n, 0) AS n_shared, anchors_hit, score FROM m LEFT JOIN sh USING (book_id, stream, page)",
    "p3_found": f"WITH {_LINES} SELECT * FROM fd",
    "p3_clean": f"WITH {_LINES}, ds AS (SELECT block_id, list(line_no) AS ds FROM fd GROUP BY block_id) SELECT block_id, array_to_string([x FOR x, i IN lines IF NOT coalesce(list_contains(ds, i - 1), false)], chr(10)) AS text, CAST(coalesce(len(ds), 0) AS INT) AS n_removed FROM b LEFT JOIN ds USING (block_id)",
    "p7_report": "SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, CAST(0 AS BIGINT) AS n_over, CAST(0 AS BIGINT) AS n_divided, true AS tight FROM (SELECT DISTINCT spec_id FROM pack_specs)",
}
