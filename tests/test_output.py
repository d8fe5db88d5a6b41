import random
import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from quire.operators import output, toc
from quire.sources import epub
from quire.sources.html import Node, parse


def book():
    a = '<h1 id="top">One</h1><p id="x">first <b id="y">bold text</b> and more</p><p><a href="b.xhtml#z">to z</a> <a href="#x">up</a> <a href="b.xhtml">b</a> <a href="nav.xhtml">nav</a> <img src="p.png"/> <a href="http://e.example/">out</a> <a href="gone.xhtml#q">gone</a></p>'
    b = '<p id="x">second <span id="z">part</span></p><aside epub:type="footnote" id="n1">a note here</aside><p id="e"></p>tail'
    return epub.build("T", "en", "ltr", "id", [("a.xhtml", "A", a), ("b.xhtml", "B", b)], '<ol><li><a href="a.xhtml#y">Y</a><ol><li><a href="b.xhtml">B</a></li></ol></li><li><a href="http://e.example/">E</a></li></ol>', extra={"p.png": ("image/png", b"png")})


def test_cut_book():
    archive = epub.open_archive(book())
    docs = [epub.index_document(b) for *_, b in archive.documents()]
    body, notes = ("".join(d[i] for d in docs) for i in (0, 1))
    cuts = ([0, 12, 30, 30, body.index("part")], [0, 0, 2, 2, 6])
    out = output.cut_book(archive, [1, 2, 3, 4, 5], cuts, (len(body) + 1, len(notes) + 1))
    assert [p.body.get_text() for p in out.pages] == [body[i:j] for i, j in zip(cuts[0], [*cuts[0][1:], len(body)])]
    assert [p.notes.get_text() for p in out.pages] == ["", "a ", "", "note", " here"]
    html = ["".join(c.xhtml() for c in p.body.children) for p in out.pages]
    assert html[0].count('id="y"') == 1 and 'id="y"' not in html[1] and "<b>" in html[1] and html[2] == '<span id="pg-0003" epub:type="pagebreak" role="doc-pagebreak" aria-label="3"></span>'
    rest = html[3] + html[4]
    assert 'href="page-0005.xhtml#z"' in rest and 'href="page-0001.xhtml#x"' in rest and 'href="../nav.xhtml"' in rest and 'src="../p.png"' in rest and 'href="http://e.example/"' in rest
    whole = output.cut_book(archive, [1], ([0], [0]), (len(body) + 1, len(notes) + 1)).pages[0].body.xhtml()
    assert 'id="x"' in html[3] and whole.count('id="x"') == whole.count('id="x-d1"') == 1 and out.unresolved == ["OEBPS/a.xhtml: href=gone.xhtml#q"]
    assert [(c["title"], c["href"]) for c in out.contents] == [("Y", "Text/page-0001.xhtml#y"), ("B", "Text/page-0004.xhtml"), ("E", None)]


def test_any_cuts_lose_nothing():
    archive = epub.open_archive(book())
    docs = [epub.index_document(b) for *_, b in archive.documents()]
    body, notes = ("".join(d[i] for d in docs) for i in (0, 1))
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(1, 9)
        cuts = tuple(sorted(rng.randrange(len(t) + 1) for _ in range(n)) for t in (body, notes))
        ends = tuple(rng.randrange(c[-1], len(t) + 2) for c, t in zip(cuts, (body, notes)))
        out = output.cut_book(archive, list(range(1, n + 1)), cuts, ends)
        assert "".join(p.body.get_text() for p in out.pages) == body[cuts[0][0] : ends[0]] and "".join(p.notes.get_text() for p in out.pages) == notes[cuts[1][0] : ends[1]]
        assert all(len(i) == len(set(i)) for p in out.pages for i in [[x.attrs["id"] for x in p.body.walk() if "id" in x.attrs]])


def test_images_among_blocks():
    body = parse("<p>aaaa</p><p>bbbb</p><p>cc</p>")
    output.place_images(body, [("1", "", 0.5), ("2", "", None), ("3", "", 0.0), ("4", "", 1.0)])
    assert [next((x.attrs["src"] for x in c.walk()), c.get_text()) for c in body.children] == ["3", "aaaa", "1", "bbbb", "cc", "2", "4"]
    empty = Node("body")
    output.place_images(empty, [("1", "", 0.3)])
    assert len(empty.children) == 1


def test_page_documents(spark):
    files = spark.createDataFrame([("b", book(), 1), ("bad", b"no archive", 1), ("c", book(), 1)], "book_id string, content binary, page int")
    cuts = spark.createDataFrame([("b", 0, 1, 0), ("b", 0, 2, 9), ("b", 1, 2, 0), ("bad", 0, 1, 0)], "book_id string, stream int, page int, cut int")
    texts = files.where("book_id = 'b'").select("book_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("stream"), F.lit("x" * 200).alias("raw_text"))
    same, ends = output.trimmed(cuts, texts, None)
    pages = output.page_documents(files, output.book_cuts(same, ends)).orderBy("page").collect()
    assert [(r.book_id, r.page) for r in pages] == [("b", 1), ("b", 2)] and pages[1].note_text == "a note here" and "pdf-footnotes" in pages[1].xhtml and "pdf-footnotes" not in pages[0].xhtml
    moved, last = output.trimmed(cuts, texts, spark.createDataFrame([("b", 0, 4), ("b", 1, 99)], "book_id string, stream int, last_cut int"))
    assert sorted(tuple(r) for r in last.collect()) == [("b", 0, 9), ("b", 1, 99)] and moved.exceptAll(cuts).count() == 0
    assert [r.href for r in output.page_contents(files, output.book_cuts(same, ends)).orderBy("ordinal_path").collect()] == ["Text/page-0002.xhtml#y", "Text/page-0002.xhtml", None]
    assert output.page_documents(files.limit(0), output.book_cuts(same, ends)).count() == 0


def test_archives_that_cannot_be_read(spark):
    files = spark.createDataFrame([("b", book()), ("bad", b"no archive"), ("cut", book()[:300])], "book string, content binary")
    assert sorted(r.book for r in epub.broken(files).collect()) == ["bad", "cut"]
    assert epub.documents(files).select("book").distinct().count() == 1 and epub.contents(files).count() == 3
    assert {(r.name, r.value) for r in epub.metadata(files).collect()} == {("title", "T"), ("language", "en"), ("identifier", "id")}
    assert {r.path for r in epub.resources(files).collect()} == {"OEBPS/p.png", "OEBPS/Styles/quire.css"}


def test_packages_are_complete(spark):
    books = spark.createDataFrame([("b", "T & U", "ar", "rtl", "P", None)], "book_id string, title string, lang string, direction string, publisher string, source string")
    pages = spark.createDataFrame([("b", 0, "p1.xhtml", "A", "<p>x</p>", "1"), ("b", 1, "p2.xhtml", "B", "<p>y</p>", None)], "book_id string, ord int, href string, title string, xhtml string, label string")
    rows = [("b", 1, ["A"], 1, "A", "p1.xhtml"), ("b", 2, ["A", "x"], 2, "x", "p1.xhtml"), ("b", 3, ["A", "x", "y"], 3, "y", "p2.xhtml"), ("b", 4, ["B"], 1, "B", "p2.xhtml")]
    nodes = spark.createDataFrame(rows, "book_id string, preorder int, path array<string>, depth int, title string, first_href string")
    ordered = toc.play_order(nodes)
    navs = toc.navigation(nodes).join(toc.ncx_points(ordered), "book_id")
    extras = spark.createDataFrame([("b", "Images/cover.jpg", "image/jpeg", b"j"), ("b", "nav.xhtml", "x", b"no")], "book_id string, path string, type string, content binary")
    with zipfile.ZipFile(BytesIO(bytes(epub.packages(books, pages, navs, extras).first().epub))) as z:
        names, opf, ncx, nav = z.namelist(), *(z.read(f"OEBPS/{x}").decode() for x in ("content.opf", "toc.ncx", "nav.xhtml"))
    assert names[0] == "mimetype" and len(names) == len(set(names)) and "OEBPS/Images/cover.jpg" in names
    assert ncx.count("<navPoint") == ncx.count("</navPoint>") == 4 and "</navPoint></navPoint></navPoint>" in ncx.replace("\n", "") and epub._xml(ncx.encode()).children[0].tag == "ncx"
    assert "<dc:publisher>P</dc:publisher>" in opf and 'properties="cover-image"' in opf and "T &amp; U" in opf and 'epub:type="page-list"' in nav and nav.count("p2.xhtml") == 2


def test_deep_pages_do_not_fail():
    from quire.sources import html

    deep = parse("<div>" * 1500 + "text" + "</div>" * 1500)
    assert deep.get_text() == "text" and html.clean(deep).xhtml().count("text") == 1 and [p.get_text() for p in html.paragraphs(deep)] == ["text"] and html.select(deep, "div")
    assert epub._xml(("<a>" * 1500 + "text" + "</a>" * 1500).encode()).get_text() == "text"
