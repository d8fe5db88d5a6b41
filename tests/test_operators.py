import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.operators import alignment, anchors, asof, blocks, crawl, fragments, report, toc


def test_longest_chain_is_longest():
    rng = random.Random(3)
    for _ in range(60):
        pts = [(rng.randrange(7), rng.randrange(7)) for _ in range(rng.randrange(8))]
        got = anchors.longest_chain(pts)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(got, got[1:])) and set(got) <= set(pts)
        best = max((n for n in range(len(pts) + 1) for c in combinations(sorted(pts), n) if all(a[0] < b[0] and a[1] < b[1] for a, b in zip(c, c[1:]))), default=0)
        assert len(got) == best


def test_chain_operators_agree(spark):
    rng = random.Random(5)
    base = [("b", s, j, j + rng.choice([0, 0, 0, 3, 500])) for s in (0, 1) for j in range(60)]
    hits = spark.createDataFrame(base + [("b", 0, 10, 900), ("b", 0, 11, 12)], "book_id string, stream int, j int, q int").distinct()
    steps = anchors.prefer_latest(anchors.diagonal_filter(anchors.chains(hits)), hits)
    whole = hits.groupBy("book_id", "stream").applyInPandas(anchors._whole_chain, "book_id string, stream int, j int, q int")
    assert sorted(steps.collect()) == sorted(whole.collect()) and steps.count() > 20


def boundaries_by_hand(pages, n_e):
    """Boundaries of one stream as the description has them, page by page."""
    n, b, st = len(pages), [p[1] if p[0] > 0 else None for p in pages], [None] * len(pages)
    known = list(b)
    for i in range(n):
        if pages[i][0] > 0 and known[i] is None:
            left = next((max(known[k], pages[k][2] or known[k]) for k in reversed(range(i)) if known[k] is not None), 0)
            right = max(next((known[k] for k in range(i, n) if known[k] is not None), n_e), left)
            lo = next((k + 1 for k in reversed(range(i)) if known[k] is not None), 0)
            hi = next((k for k in range(i, n) if known[k] is not None), n)
            free = [k for k in range(lo, hi) if pages[k][0] > 0]
            total, before = sum(pages[k][0] for k in free), sum(pages[k][0] for k in free if k < i)
            if right - left >= 0.3 * total and total >= 20:
                b[i], st[i] = left + round((right - left) * before / total), "interpolated"
            else:
                b[i], st[i] = right, "missing"
    nxt = n_e
    for i in reversed(range(n)):
        b[i] = nxt if b[i] is None else b[i]
        nxt = b[i]
    out, top = [], 0
    for v in b:
        top = max(top, v)
        out.append(min(n_e, top))
    return list(zip(out, st))


def test_boundaries_against_hand(spark):
    rng, rows, want = random.Random(7), [], {}
    for s in range(80):
        n_e, at, pages = rng.randrange(400), 0, []
        for _ in range(rng.randrange(1, 9)):
            chars = rng.choice([0, 5, 30, 61])
            start = min(n_e, at + rng.randrange(40)) if chars and rng.random() < 0.5 else None
            end = None if start is None else min(n_e, start + chars)
            at = start if start is not None else at
            pages.append((chars, start, end))
        want[s] = boundaries_by_hand(pages, n_e)
        rows += [("b", s, i, *p, n_e) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "book_id string, stream int, page int, pdf_chars int, start_pos int, end_pos int, n_e int")
    got = {}
    for r in alignment.boundaries(df).orderBy("stream", "page").collect():
        got.setdefault(r.stream, []).append((r.boundary, r.gap_status))
    assert got == want


def test_alignment_finds_pages(spark):
    rng = random.Random(11)
    text = "".join(rng.choices("abcdefghijklmnop", k=3000))
    cut = [0, 400, 900, 1500, 2200, 3000]
    pages = [("b", 0, i + 1, text[a:b]) for i, (a, b) in enumerate(zip(cut, cut[1:]))] + [("b", 0, 6, ""), ("c", 0, 1, "")]
    pages = spark.createDataFrame(pages, "book_id string, stream int, page int, norm string")
    texts = spark.createDataFrame([("b", 0, text)], "book_id string, stream int, norm string")
    m = {(r.book_id, r.page): r for r in alignment.align_pages(pages, texts).collect()}
    assert [m["b", i].boundary for i in range(1, 6)] == cut[:5]
    assert all(m["b", i].status == "exact" and m["b", i].confidence == "high" for i in range(1, 6)) and m["b", 6].status == "empty"
    assert m["c", 1].status == "empty"


def test_common_piece_against_every_piece():
    rng = random.Random(4)
    for _ in range(200):
        text, head = ("".join(rng.choices("abc𝔘", k=rng.randrange(0, 14))) for _ in range(2))
        found = [(-n, i, j) for n in range(1, 14) for i in range(len(text) - n + 1) for j in range(len(head) - n + 1) if text[i : i + n] == head[j : j + n]]
        n, i, j = min(found, default=(0, 0, 0))
        assert alignment.common_piece(text, head)[2] == -n and (not n or alignment.common_piece(text, head) == (i, j, -n))


def test_refined_starts(spark):
    text = "zzzz" + "the quick brown fox jumps over it" + "yyyy"
    rows = [(1, "XX" + "the quick brown", text, 6, 0), (2, "abc", text, 6, 0), (3, "the quack brown fox", "zzzzzz" + "the quick brown fox", 8, 0), (4, "jumps over it", text, 30, 20), (5, "", text, 3, 0)]
    df = spark.createDataFrame([(i, h, x[lo:], s, lo) for i, h, x, s, lo in rows], "page int, head string, around string, s int, lo int")
    got = {r.page: r.refined for r in alignment.refined_starts(df, 60).collect()}
    assert got == {1: 4, 2: None, 3: 6, 4: 24, 5: None}


def test_asof_and_nearest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("a", 0), ("b", 1), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y")], "k string, u int, v string")
    got = {(r.k, r.t): r.v for r in asof.asof_join(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", 5): "x", ("a", 10): "y", ("a", 0): None, ("b", 1): None, ("a", None): None}
    near = {(r.k, r.t): r.nearest for r in asof.nearest_join(spark.createDataFrame([("a", 7), ("a", 30), ("a", 12), ("a", 9)], "k string, t int"), right, ["k"], "t", "u", 3).collect()}
    assert near == {("a", 7): 5, ("a", 30): None, ("a", 12): 9, ("a", 9): 9}


def test_overlap_join_against_pairs(spark):
    rng = random.Random(2)
    spans = [("g", i, a, a + rng.randrange(30)) for i, a in enumerate(rng.choices(range(200), k=40))]
    ranges = [("g", i, a, a + rng.randrange(1, 60)) for i, a in enumerate(rng.choices(range(200), k=20))]
    s = spark.createDataFrame(spans, "g string, s int, a int, b int")
    r = spark.createDataFrame(ranges, "g string, r int, c int, d int")
    got = sorted((x.s, x.r) for x in asof.overlap_join(s, r, ["g"], ("a", "b"), ("c", "d"), width=16).collect())
    want = sorted((i, j) for _, i, a, b in spans for _, j, c, d in ranges if (a < d and b > c if b > a else c <= a < d))
    assert got == want


def test_block_kinds(spark):
    pages = spark.createDataFrame([("b", n, 400.0, 600.0, None, "text") for n in range(1, 6)], "book_id string, page int, width double, height double, separator_y double, kind string")
    rows = []
    for n in range(1, 6):
        rows += [("b", n, 0, ["كتاب الفقه"], 10.0, 25.0, 9.0, ["F"]), ("b", n, 1, [f"نص الصفحة {n} وفيه كلام طويل"], 100.0, 400.0, 12.0, ["F"]), ("b", n, 2, [f"{n}"], 570.0, 590.0, 9.0, ["F"])]
    b = spark.createDataFrame(rows, "book_id string, page int, block_ord int, lines array<string>, y0 double, y1 double, font_size double, fonts array<string>")
    got = {(r.page, r.block_ord): r.found_kind for r in blocks.classify(b, pages, 0.08, 0.08).collect()}
    assert all(got[n, 0] == "header" and got[n, 1] == "body" and got[n, 2] == "page_number" for n in range(1, 6))
    assert blocks.classify(b.limit(0), pages).count() == 0


def test_blocks_from_spans_and_regions(spark):
    s = spark.createDataFrame([("b", 1, 0, 0, 0, "ab ", 10.0, "F", 16), ("b", 1, 0, 0, 1, "cdef", 13.0, "G", 0), ("b", 1, 1, 0, 0, "  ", 9.0, "F", 0)], "book_id string, page int, block_ord int, line_ord int, span_ord int, text string, size double, font string, flags int")
    r = blocks.blocks_from_spans(s).collect()
    assert len(r) == 1 and r[0].lines == ["ab cdef"] and r[0].font_size == 12.0 and r[0].fonts == ["F", "G"] and not r[0].bold
    d = spark.createDataFrame([("b", 1, 10.0 * i, 100.0, 10.0 * i + 20, 200.0) for i in range(8)], "book_id string, page int, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([("b", 1, 400.0, 600.0)], "book_id string, page int, width double, height double")
    assert [tuple(x)[2:] for x in blocks.drawing_regions(d, p).collect()] == [(0.0, 100.0, 90.0, 200.0)]
    box = spark.createDataFrame([(1.0, 2.0, 3.0, 5.0)], "x0 double, y0 double, x1 double, y1 double").select(*blocks.rotate(("x0", "y0", "x1", "y1"), (0, 1, -1, 0, 10, 0)))
    assert tuple(box.first()) == (5.0, 1.0, 8.0, 3.0)


def test_reversed_digits(spark):
    rows = [("b", 1, 0, ["٠١ ١١ ٢١ ٣١ ٤١ ٥١ ٦١"], "body"), ("c", 1, 0, ["١٠ ١١ ١٢"], "body"), ("d", 1, 0, None, "body")]
    b = spark.createDataFrame(rows, "book_id string, page int, block_ord int, lines array<string>, kind string")
    assert {r.book_id: r.digits_reversed for r in blocks.digits_reversed(b).collect()} == {"b": True, "c": False}


def test_contents(spark):
    rows = [("b", 0, ["A", "x"]), ("b", 1, ["B"]), ("b", 2, ["A", "y"]), ("b", 3, ["A", "x"]), ("b", 4, None)]
    t = toc.sections(spark.createDataFrame(rows, "book_id string, ord int, path array<string>"), "page")
    assert [(r.ord, r.group_no, r.page_no) for r in t.orderBy("ord").collect()] == [(0, 1, 1), (1, 2, 1), (2, 1, 2), (3, 1, 3), (4, 3, 1)]
    nodes = toc.first_targets(toc.tree(t.where("path IS NOT NULL")))
    got = [(r.path, r.href, r.first_href) for r in nodes.orderBy("preorder").collect()]
    assert got == [(["A"], None, "chap_001_003.xhtml"), (["A", "x"], "chap_001_003.xhtml", "chap_001_003.xhtml"), (["A", "y"], "chap_001_002.xhtml", "chap_001_002.xhtml"), (["B"], "chap_002_001.xhtml", "chap_002_001.xhtml")]
    order = [r.play_order for r in toc.play_order(nodes).orderBy("preorder").collect()]
    assert order == [1, 1, 2, 3]
    nav = toc.navigation(nodes).first().nav
    assert nav.count("<ol>") == nav.count("</ol>") == 2 and nav.count("<li>") == nav.count("</li>") == 4 and nav.index("x") < nav.index("B")


def test_contents_read_their_entries_once(spark):
    rows = [("b", 0, ["A", "x"], "h0"), ("b", 0, ["B", "y"], "h1"), ("b", 1, ["C", "C"], None), ("b", 1, ["C", "C"], None), ("b", 2, ["C", "D"], "h0"), (None, 0, ["Z"], "h2"), ("b", 3, [], "h3")]
    nodes = toc.first_targets(toc.tree(spark.createDataFrame(rows, "book_id string, ord int, path array<string>, href string")))
    got = [(r.book_id, r.path, r.preorder, r.href, r.first_href) for r in nodes.orderBy("preorder").collect()]
    assert got == [  # A and B have one first sight: what stands under them comes after both
        ("b", ["A"], 1, None, "h0"), ("b", ["B"], 2, None, "h1"), ("b", ["A", "x"], 3, "h0", "h0"), ("b", ["B", "y"], 4, "h1", "h1"),
        ("b", ["C"], 5, None, "h0"), ("b", ["C", "C"], 6, None, None), ("b", ["C", "D"], 7, "h0", "h0"),
    ]
    ordered = toc.play_order(nodes)
    assert [(r.preorder, r.play_order) for r in ordered.orderBy("preorder").collect()] == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 1), (7, 1)]
    assert ordered._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_frontier(spark):
    seeds = spark.createDataFrame([("b", 0, "u0"), ("b", 1, "u3"), ("b", 2, "u0")], "book_id string, ord int, url string")
    links = spark.createDataFrame([("b", "u0", "u1"), ("b", "u1", "u2"), ("b", "u2", "u0"), ("b", "u3", None)], "book_id string, url string, next_url string")
    got = [(r.url, r.level, r.place) for r in crawl.frontier(seeds, links).orderBy("place").collect()]
    assert got == [("u0", 0, 1), ("u3", 0, 2), ("u1", 1, 3), ("u2", 2, 4)]
    with pytest.raises(RuntimeError):
        crawl.frontier(seeds, links, max_levels=1)
    assert crawl.frontier(seeds, links, max_levels=2).count() == 4
    assert crawl.frontier(seeds, links, max_pages=2).count() == 2 and crawl.frontier(seeds.limit(0), links).count() == 0


def test_fragments_lose_nothing(spark):
    text = "one two\nthree\n\nfour five six"
    t = spark.createDataFrame([("b", 0, text)], "book_id string, stream int, text string")
    spans = fragments.paragraphs(t, "text")
    cuts = [0, 5, 11, 20, len(text) + 1]
    pages = spark.createDataFrame([("b", 0, i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], "book_id string, stream int, page int, raw_start int, raw_end int")
    f = fragments.page_fragments(spans, pages).withColumn("ord", F.col("node_ord"))
    assert report.lost_text(f, t).count() == 0
    assert report.lost_text(f.where("page <> 1"), t).count() == 1
    kept = f.where("keeps_id").groupBy("node_ord").count().collect()
    assert all(r["count"] == 1 for r in kept)


def test_unique_ids(spark):
    rows = [("b", 1, 1, 0, "x"), ("b", 1, 2, 2, "x"), ("b", 1, 3, 2, "x"), ("b", 1, 4, 2, "x-d2"), ("b", 1, 5, 2, "x"), ("b", 1, 6, 1, "y"), ("b", 2, 7, 1, "x"), ("b", 2, 8, 1, None), ("b", 2, 9, 1, None)]
    ids = spark.createDataFrame(rows, "book_id string, page int, ord int, doc int, id string")
    got = {r.ord: r.new_id for r in fragments.unique_ids(ids).collect()}
    assert got == {1: "x", 2: "x-d2", 3: "x-d2-2", 4: "x-d2-d2", 5: "x-d2-3", 6: "y", 7: "x", 8: None, 9: None}
    assert fragments.unique_ids(ids.limit(0)).count() == 0


def test_links_to_pages(spark):
    links = spark.createDataFrame([("b", "a.xhtml", "i"), ("b", "a.xhtml", None), ("b", "p.png", None), ("b", "q", None)], "book_id string, path string, fragment string")
    docs = spark.createDataFrame([("b", "a.xhtml", 3)], "book_id string, path string, first_page int")
    res = spark.createDataFrame([("b", "p.png")], "book_id string, path string")
    known = spark.createDataFrame([("b", "a.xhtml", "i", 4)], "book_id string, path string, id string, page int")
    assert sorted((r.kind, r.href) for r in fragments.resolve_links(links, docs, res, known).collect() if r.href) == [("document", "page-0003.xhtml"), ("id", "page-0004.xhtml#i"), ("resource", "p.png")]


def test_note_cuts_and_headers(spark):
    notes = [("b", 1, 0, "shortheader"), ("b", 1, 13, "anotherhead"), ("b", 1, 30, "longnotetext"), ("b", 1, 60, "tiny"), ("b", 1, 70, "last")]
    n = spark.createDataFrame(notes, "book_id string, stream int, start int, norm string")
    pages = [("b", 1, 1, 5, ""), ("b", 1, 2, 30, "anotherheadshortheaderlongnotetext"), ("b", 1, 3, 70, "tinylast"), ("b", 1, 4, 70, None), ("c", 1, 1, 3, "x")]
    c = spark.createDataFrame(pages, "book_id string, stream int, page int, cut int, head string")
    assert [(r.book_id, r.page, r.cut) for r in fragments.extend_over_headers(c, n).orderBy("book_id", "page").collect()] == [("b", 1, 0), ("b", 2, 0), ("b", 3, 70), ("b", 4, 70), ("c", 1, 3)]
    first = c.withColumn("head", F.when(F.col("page") == 1, "full").otherwise(F.col("head")))  # nothing moves before a page with text
    assert [r.cut for r in fragments.extend_over_headers(first, n).where("book_id = 'b'").orderBy("page").collect()] == [5, 13, 70, 70]
    cuts = spark.createDataFrame([("b", 1, 1, 10), ("b", 1, 2, 20), ("b", 1, 3, 200), ("b", 1, 4, 90)], "book_id string, stream int, page int, cut int")
    starts = spark.createDataFrame([("b", 1, 0), ("b", 1, 30), ("b", 1, 75)], "book_id string, stream int, start int")
    assert [r.cut for r in fragments.note_cuts(cuts, starts).orderBy("page").collect()] == [0, 30, 200, 200]


def test_raw_cuts(spark):
    texts = spark.createDataFrame([("b", 0, "one («two three» four", list(range(21)))], "book_id string, stream int, raw_text string, norm_map array<int>")
    pages = spark.createDataFrame([("b", 0, 1, 0, 5), ("b", 0, 2, 6, 5), ("b", 0, 3, 8, 0), ("b", 0, 4, 7, 9), ("b", 0, 5, 13, 4), ("b", 0, 6, 99, 3)], "book_id string, stream int, page int, boundary int, pdf_chars int")
    assert [r.cut for r in fragments.raw_cuts(pages, texts).orderBy("page").collect()] == [0, 4, 8, 8, 10, 21]


def test_reports(spark):
    m = spark.createDataFrame([("b", 0, 1, 50, "exact", 0.9), ("b", 0, 2, 50, "fuzzy", 0.6), ("b", 0, 3, 50, "missing", 0.0), ("b", 0, 4, 0, "empty", 0.0)], "book_id string, stream int, page int, pdf_chars int, status string, score double")
    m = alignment.confidence(m)
    assert report.mean_scores(m).first().mean_score == 0.75
    assert [r.page for r in report.problem_pages(m).collect()] == [3] and report.accepted(m).first().accepted
    v = spark.createDataFrame([("a", 0, "Messages: 0 fatals / 0 errors / 2 warnings / 1 infos\nWARNING(X): y"), ("b", 1, "FATAL(Z)")], "file string, returncode int, output string")
    got = {r.file: (r.fatals, r.errors, r.warnings, r.is_valid, len(r.messages)) for r in report.validator_counts(v).collect()}
    assert got == {"a": (0, 0, 2, True, 1), "b": (1, 1, 0, False, 1)}
    rates = spark.createDataFrame([("b", 0, "logical", 0.1), ("b", 0, "reverse_chars", 0.9)], "book_id string, stream int, mode string, rate double")
    assert report.best_order(rates).first()["mode"] == "reverse_chars"


def test_page_range():
    from quire.sources.pdf import page_range

    assert page_range(10, 3, 99) == (3, 10)
    with pytest.raises(ValueError):
        page_range(10, 11, 20)


def test_images_of_substance(spark):
    pages = spark.createDataFrame([("b", n, 100.0, 100.0) for n in (1, 2)], "book_id string, page int, width double, height double")
    images = spark.createDataFrame([("b", 1, 0.0, 0.0, 100.0, 100.0), ("b", 1, 0.0, 0.0, 6.0, 6.0), ("b", 1, 0.0, 0.0, 20.0, 20.0), ("b", 2, 0.0, 0.0, 95.0, 95.0)], "book_id string, page int, x0 double, y0 double, x1 double, y1 double")
    text = spark.createDataFrame([("b", 1, ["a b " * 30], "body"), ("b", 2, ["x" * 39], "body"), ("b", 2, ["x" * 90], "header")], "book_id string, page int, lines array<string>, found_kind string")
    assert sorted((r.page, r.x1) for r in blocks.page_images(images, pages, text).collect()) == [(1, 20.0), (2, 95.0)]
    assert blocks.page_images(images, pages, text.limit(0)).count() == 3


def test_glyphs(spark):
    from quire.sources import pdf

    rules = [(("l_a", "x"), "l_a_x"), (("l", "a"), "l_a"), (("a",), "a.fina"), (("gone",), "y")]
    assert pdf.glyph_texts(["l", "a", "l_a", "a.fina", "l_a_x", "y", "thin"], {"l": "\u0644", "a": "\u0627", "x": "x"}, rules, {"thin": 0}) == {0: "\u0644", 1: "\u0627", 2: "\u0644\u0627", 3: "\u0627", 4: "\u0644\u0627x", 5: "\ufffd", 6: ""}
    d = spark.createDataFrame([("b", "x"), ("b", ""), ("b", "\ufffd"), ("b", None)], "book_id string, text string")
    assert tuple(pdf.decode_stats(d).first()) == ("b", 4, 1, 1)
    rate = lambda *r: spark.createDataFrame(r, "book_id string, rate double")
    got = pdf.decode_choice(rate(("a", 0.3), ("b", 0.1), ("c", 0.1), ("d", 0.0), ("b", 0.05)), rate(("a", 0.9), ("b", 0.15), ("c", 0.6)))
    assert {r.book_id: r.decode for r in got.collect()} == {"a": "native", "b": "native", "c": "glyph", "d": "native"}
