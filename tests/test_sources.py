import hashlib

from pyspark.sql import functions as F

from quire.sources import cache, epub, html, pdf


def test_html_cleaning_and_paragraphs():
    r = html.parse_page('<div>a\nb<br>c <font onclick="x" style="y">d</font><script>bad()</script><!-- no --></div><h2>T</h2><img><img src="i.png"><a id="k" href="/in/1">l</a><a href="http://o.example/">m</a>', "<p>n</p>", "http://h.example/in/", "http://h.example/in/")
    assert r["blocks"][0] == "<p>a b</p>" and r["blocks"][1] == "<p>c d</p>" and r["blocks"][2] == "<h2>T</h2>"
    assert r["images"] == ["http://h.example/in/i.png"] and r["anchors"] == ["k"] and 'rel="noopener noreferrer"' in r["blocks"][3]
    assert r["blocks"][-2:] == ['<hr class="footnote-separator"/>', '<p class="footnote">n</p>']
    assert html.parse_page(None, None, "", "/")["blocks"] == []
    assert "bad()" in html.clean(html.parse("<script>bad()</script>"), faithful=True).get_text()


def test_page_blocks_keep_columns(spark):
    rows = [(1, "b", 3, None, "http://h.example/1", "<p>x</p>", None), (2, None, None, "T", None, None, None)]
    p = spark.createDataFrame(rows, "page_id long, book_id string, ord int, title string, url string, body string, footnotes string")
    got = sorted(tuple(r) for r in html.page_blocks(p, ["book_id", "ord", "title"]).select("page_id", "blocks", "book_id", "ord", "title").collect())
    assert got == [(1, ["<p>x</p>"], "b", 3, None), (2, [], None, None, "T")]
    assert html.page_blocks(p).columns == ["page_id", "blocks", "anchors", "images"]


def test_adapter():
    a = html.SiteLayout("s", ("h.example",), r"/\w+/book/([^/]+)/")
    page = '<title>Book - Site</title><div class="b">Home » Law » Title</div><div class="book-cover" style="background:url(c.png)"></div><ul class="baz"><li><a href="/ar/book/7/1/">P » Q</a></li><li><a href="/ar/book/7/1">again</a></li><li><a href="/ar/book/8/1/">other</a></li></ul>'
    i = a.info(page, "http://h.example/ar/book/7/")
    assert i["title"] == "Title" and i["cover"] == "http://h.example/ar/book/7/c.png" and i["toc"] == [{"url": "http://h.example/ar/book/7/1/", "path": ["P", "Q"]}]
    assert a.info("<a href='x.pdf'>p</a>", "http://h.example/ar/book/7/")["error"] == "only a PDF"
    assert a.next_url('<a class="fl" href="2/">n</a>', "http://h.example/ar/book/7/") == "http://h.example/ar/book/7/2/"
    assert a.category('<table><tr><td><a href="/ar/book/9/">N</a></td></tr></table>', "http://h.example/") == [("N", "http://h.example/ar/book/9/")]
    html.register(a)
    assert html.layout_for("http://www.h.example/x") is a


def test_cache_scan(spark, tmp_path):
    key = hashlib.sha256(b"http://h.example/a/").hexdigest()
    (tmp_path / f"{key}.html").write_text("<p>سلام</p>", encoding="utf-8")
    (tmp_path / f"{key}.bin").write_bytes(b"\x01")
    (tmp_path / f"{key}.mime").write_text("image/png; x=1")
    urls = spark.createDataFrame([("http://H.example/a#t",), ("http://h.example/b",)], "url string")
    got = {r.url: r.html for r in cache.with_cache(urls, cache.cached_pages(spark, str(tmp_path))).collect()}
    assert got == {"http://H.example/a#t": "<p>سلام</p>", "http://h.example/b": None}
    r = cache.cached_images(spark, str(tmp_path)).first()
    assert (r.mime, r.extension, bytes(r.data)) == ("image/png", ".png", b"\x01")


def test_epub_round_trip(spark):
    files = [("a.xhtml", "A", '<p id="m1">one <b>two</b></p><div class="footnote">n1</div>tail'), ("b.xhtml", "B", "<p>three</p>")]
    data = epub.build("T & t", "ar", "rtl", "id", files, '<ol><li><a href="a.xhtml#m1">x</a><ol><li><a href="b.xhtml">y</a></li></ol></li></ol>', extra={"s.css": ("text/css", b"p{}")})
    assert data[30:38] == b"mimetype"
    df = spark.createDataFrame([("k", bytearray(data))], "book string, content binary")
    docs = epub.documents(df)
    s = {r.stream: r.raw_text for r in epub.streams(docs).collect()}
    assert s == {0: "one twotailthree", 1: "n1"}
    toc = epub.contents(df).orderBy("ordinal_path").collect()
    assert [(r.ordinal_path, r.title, r.path, r.fragment) for r in toc] == [([1], "x", "OEBPS/a.xhtml", "m1"), ([1, 1], "y", "OEBPS/b.xhtml", None)]
    spans = epub.spans(df, docs).where("tag = 'p'").orderBy("start").collect()
    assert [(r.id, r.stream, r.start, r.end) for r in spans] == [("m1", 0, 0, 7), (None, 0, 11, 16)]
    assert epub.Archive(data).resources() == {"OEBPS/s.css": "text/css", f"OEBPS/{epub.STYLE}": "text/css"} and epub.Archive(data).metadata["title"] == ["T & t"]


def test_glyphs(spark):
    chars = spark.createDataFrame([("F", 1, "?", 5.0), ("F", 9, "?", 0.0), ("F", 8, "?", 5.0), ("G", 1, "z", 5.0)], "font string, gid int, uni string, width double")
    glyphs = spark.createDataFrame([("F", 1, "لا")], "font string, gid int, text string")
    assert sorted(r.text for r in pdf.decode_glyphs(chars, glyphs).collect()) == sorted(["لا", "", "�", "z"])
    placed = spark.createDataFrame([("b", 1, 30.0, 10.0, 10.0, "ا"), ("b", 1, 20.0, 11.0, 10.0, "ب"), ("b", 1, 5.0, 40.0, 10.0, "a"), ("b", 1, 15.0, 41.0, 10.0, "b")], "book_id string, page int, x double, y double, size double, text string")
    assert [r.text for r in pdf.glyph_lines(placed).orderBy("line_ord").collect()] == ["اب", "ab"]


def test_streaming_ingest(spark, tmp_path):
    from quire.streaming.ingest import PAGES, new_pages, pages_per_hour

    src = tmp_path / "in"
    rows = spark.sql("SELECT 1L page_id, 'h' host, 'http://h/a' url, 'B' body, timestamp'2024-01-01 05:10:00' fetched_at UNION ALL SELECT 1L, 'h', 'http://h/a', 'B', timestamp'2024-01-01 05:20:00'")
    spark.createDataFrame(rows.rdd, PAGES).write.parquet(str(src))
    q = pages_per_hour(new_pages(spark, str(src))).writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.host, r.n) for r in spark.table("hours").collect()] == [("h", 1)]


