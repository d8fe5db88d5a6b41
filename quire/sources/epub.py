"""EPUB archives: reading documents, streams, spans and contents; writing packages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Iterator
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.html import Node, parse, select

# Names of notes in EPUB's vocabulary, and classes that begin like notes.
NOTE_TYPES = {"footnote", "footnotes", "endnote", "endnotes", "rearnote", "rearnotes"}
NOTE_CLASSES = ("footnote", "endnote", "fn")
DOCUMENTS = ("application/xhtml+xml", "text/html")
DC_KEPT = ("title", "creator", "publisher", "language", "description", "identifier", "date", "rights", "subject", "contributor", "source")

DOCS = "book string, doc_idx int, path string, item_id string, title string, body string, notes string"
RUNS = "book string, doc_idx int, node_ord int, tag string, id string, stream int, start int, end int"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(data: bytes) -> Node:
    """A tree of XML, or of what HTML's rules make of it if it is not well formed."""
    try:
        def turn(e: ET.Element) -> Node:
            n = Node(_local(e.tag).lower(), attrs={_local(k) if "}" in k and not k.endswith("}type") else ("epub:type" if k.endswith("}type") else k): v for k, v in e.attrib.items()})
            if e.text:
                n.children.append(Node(text=e.text))
            for c in e:
                if isinstance(c.tag, str):
                    n.children.append(turn(c))
                if c.tail:
                    n.children.append(Node(text=c.tail))
            return n

        return Node("#root", children=[turn(ET.fromstring(data))])
    except (ET.ParseError, RecursionError):  # the tree of the latter has bounded depth
        return parse(data.decode("utf-8", "replace"))


def _join(base: str, href: str) -> str:
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), unquote(href.partition("#")[0])))


def resolve(base: str, href: str) -> tuple[str | None, str | None]:
    """Path and fragment of a link in an archive; nulls if it leads out of it, the base itself if it has no path."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", href):
        return None, None
    bare, _, fragment = href.partition("#")
    return (_join(base, bare) if bare else base), unquote(fragment) or None


def is_note(n: Node, extra: tuple[str, ...] = ()) -> bool:
    classes = n.attrs.get("class", "").lower().split()
    return any(c.startswith(NOTE_CLASSES + tuple(x.lower() for x in extra)) for c in classes) or bool(NOTE_TYPES & set(n.attrs.get("epub:type", "").split()))


def index_document(body: Node, note_classes: tuple[str, ...] = (), split_notes: bool = True) -> tuple[str, str, list[tuple]]:
    """Body text, note text and the elements' spans ``(tag, id, stream, start, end)`` of a document; rules among
    notes count for nothing, what follows a note belongs to its parent's stream."""
    texts: list[list[str]] = [[], []]
    at = [0, 0]
    spans: list[tuple] = []
    ids: set[str] = set()

    def visit(n: Node, s: int):
        if not n.tag:
            texts[s].append(n.text)
            at[s] += len(n.text)
            return
        if split_notes and s == 0 and is_note(n, note_classes):
            if n.tag == "hr":
                return
            s = 1
        place, lo = len(spans), at[s]
        spans.append(())
        for c in n.children:
            visit(c, s)
        i = n.attrs.get("id")
        spans[place] = (n.tag, i if i and i not in ids else None, s, lo, at[s])
        if i:
            ids.add(i)

    for c in body.children:
        visit(c, 0)
    return "".join(texts[0]), "".join(texts[1]), spans


class Archive:
    """What an EPUB file holds: ``metadata``, ``manifest``, ``spine``, documents and contents."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())
        rootfile = select(_xml(self.zip.read("META-INF/container.xml")), "rootfile")[0].attrs["full-path"]
        opf = _xml(self.zip.read(rootfile))
        self.folder = posixpath.dirname(rootfile)
        self.manifest = {}
        for item in select(opf, "manifest > item"):
            a = item.attrs
            self.manifest[a.get("id", "")] = {"path": _join(rootfile, a.get("href", "")), "type": a.get("media-type", ""), "properties": a.get("properties", "").split()}
        spine = select(opf, "spine")
        self.spine = [n.attrs.get("idref", "") for n in select(opf, "itemref")]
        self.ncx = self.manifest.get(spine[0].attrs.get("toc", "")) if spine else None
        self.metadata: dict[str, list[str]] = {}
        for m in select(opf, "metadata"):
            for c in m.children:
                if c.tag in DC_KEPT:
                    self.metadata.setdefault(c.tag, []).append(c.words())
        self.nav = next((m for m in self.manifest.values() if "nav" in m["properties"]), None)

    def documents(self) -> Iterator[tuple[str, dict, Node, Node]]:
        """Documents in reading order that have a body; navigation and other types are no documents."""
        for i in self.spine:
            m = self.manifest.get(i)
            if m and m is not self.nav and m["type"] in DOCUMENTS and m["path"] in self.names:
                root = _xml(self.zip.read(m["path"]))
                if body := select(root, "body"):
                    yield i, m, root, body[0]

    def contents(self) -> list[dict]:
        """Entries ``ordinal_path, title, path, fragment`` of the navigation, else of the NCX."""
        out: list[dict] = []

        def entry(where: list[int], title: str, href: str | None, base: str):
            path, fragment = resolve(base, href) if href else (None, None)
            out.append({"ordinal_path": where, "title": title, "path": path, "fragment": fragment})

        def nav(ol: Node, where: list[int]):
            for n, li in enumerate((c for c in ol.children if c.tag == "li"), 1):
                label = next((c for c in li.children if c.tag in ("a", "span")), None)
                if label:
                    entry([*where, n], label.words(), label.attrs.get("href"), self.nav["path"])
                for c in li.children:
                    if c.tag == "ol":
                        nav(c, [*where, n])

        def points(parent: Node, where: list[int]):
            for n, p in enumerate((c for c in parent.children if c.tag == "navpoint"), 1):
                label = next(iter(select(p, "navlabel > text")), Node("x")).words()
                href = next((c.attrs.get("src") for c in p.children if c.tag == "content"), None)
                entry([*where, n], label, href, self.ncx["path"])
                points(p, [*where, n])

        if self.nav and self.nav["path"] in self.names:
            for n in select(_xml(self.zip.read(self.nav["path"])), "nav"):
                if "toc" in n.attrs.get("epub:type", "").split():
                    for ol in n.children:
                        if ol.tag == "ol":
                            nav(ol, [])
                    break
        if not out and self.ncx and self.ncx["path"] in self.names:
            for m in select(_xml(self.zip.read(self.ncx["path"])), "navmap"):
                points(m, [])
        return out

    def resources(self) -> dict[str, str]:
        """Paths and types of what is neither a document nor navigation."""
        used = {self.manifest[i]["path"] for i in self.spine if i in self.manifest}
        used |= {m["path"] for m in (self.nav, self.ncx) if m}
        used |= {m["path"] for m in self.manifest.values() if m["type"] == "application/x-dtbncx+xml"}
        return {m["path"]: m["type"] for m in self.manifest.values() if m["path"] not in used and m["path"] in self.names}


def open_archive(data: bytes) -> Archive | None:
    """The archive, or nothing if it cannot be read: such files are set aside, see ``broken``."""
    try:
        return Archive(data)
    except (zipfile.BadZipFile, KeyError, IndexError, NotImplementedError, OSError, zlib.error):
        return None


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name, data in zip(b.book, b.content):
            rows = []
            archive = open_archive(bytes(data))
            for n, (i, m, root, body) in enumerate(archive.documents() if archive else ()):
                text, notes, _ = index_document(body)
                title = next((x.words() for x in select(root, "title")), "")
                rows.append((name, n, m["path"], i, title, text, notes))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DOCS.split(", ")])


def _spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name, data in zip(b.book, b.content):
            rows = []
            archive = open_archive(bytes(data))
            for n, (_, _, _, body) in enumerate(archive.documents() if archive else ()):
                rows += [(name, n, k, *s) for k, s in enumerate(index_document(body)[2])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for name, data in zip(b.book, b.content):
            archive = open_archive(bytes(data))
            rows = [(name, *e.values()) for e in (archive.contents() if archive else ())]
            yield pd.DataFrame(rows, columns=["book", "ordinal_path", "title", "path", "fragment"])


def archives(spark: SparkSession, path: str) -> DataFrame:
    """``book, content`` of the EPUB files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select(F.col("path").alias("book"), "content")


def _rows_of(read, names: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, data in zip(b.book, b.content) for r in read(open_archive(bytes(data)))], columns=["book", *names])

    return run


def broken(files: DataFrame) -> DataFrame:
    """``book`` of the archives that cannot be read."""
    return files.select("book", "content").mapInPandas(_rows_of(lambda a: [] if a else [()], []), "book string")


def metadata(files: DataFrame) -> DataFrame:
    """``book, name, ord, value``: the kept entries of each archive's metadata, in order."""
    read = lambda a: [(k, n, v) for k, vs in a.metadata.items() for n, v in enumerate(vs)] if a else []
    return files.select("book", "content").mapInPandas(_rows_of(read, ["name", "ord", "value"]), "book string, name string, ord int, value string")


def resources(files: DataFrame) -> DataFrame:
    """``book, path, type, content``: what an archive holds beside documents and navigation, style sheets included."""
    read = lambda a: [(p, t, a.zip.read(p)) for p, t in a.resources().items()] if a else []
    return files.select("book", "content").mapInPandas(_rows_of(read, ["path", "type", "content"]), "book string, path string, type string, content binary")


def documents(files: DataFrame) -> DataFrame:
    """Documents of archives (``book, content``) in reading order with their body and note texts."""
    return files.select("book", "content").mapInPandas(_documents, DOCS)


def contents(files: DataFrame) -> DataFrame:
    return files.select("book", "content").mapInPandas(_contents, "book string, ordinal_path array<int>, title string, path string, fragment string")


def spans(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Element spans in the streams of the whole book: places in a document plus what comes before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("book").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, -1)
    before = docs.select("book", "doc_idx", F.coalesce(F.sum(F.length("body")).over(w), F.lit(0)).alias("b0"), F.coalesce(F.sum(F.length("notes")).over(w), F.lit(0)).alias("b1"))
    s = files.select("book", "content").mapInPandas(_spans, RUNS).join(before, ["book", "doc_idx"])
    add = F.when(F.col("stream") == 0, F.col("b0")).otherwise(F.col("b1"))
    return s.withColumn("start", (F.col("start") + add).cast("int")).withColumn("end", (F.col("end") + add).cast("int")).drop("b0", "b1")


def streams(docs: DataFrame) -> DataFrame:
    """``book, stream, raw_text``: the documents' texts one after the other, body (0) and notes (1)."""
    both = docs.select("book", "doc_idx", F.posexplode(F.array("body", "notes")).alias("stream", "_t"))
    return both.groupBy("book", "stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_idx", "_t"))), lambda s: s["_t"]), "").alias("raw_text"))


STYLE = "Styles/quire.css"
CSS = "body { line-height: 1.7; margin: 1em } h1, h2, h3 { text-align: center } .footnote, .pdf-footnotes { font-size: 0.85em }"

_CONTAINER = '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'


def wrap(title: str, inner: str, language: str = "ar", direction: str = "rtl") -> str:
    return (
        f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="{language}" dir="{direction}">'
        f"<head><title>{escape(title)}</title></head><body>{inner}</body></html>"
    )


def build(title: str, language: str, direction: str, identifier: str, files: list[tuple[str, str, str]], nav: str, ncx: str = "", pages: list[tuple[str, str]] = (), extra: dict[str, tuple[str, bytes]] | None = None, more: list[tuple[str, str]] = (), css: str = CSS) -> bytes:
    """An EPUB package: ``files`` are ``(href, title, xhtml body)`` in reading order, ``nav`` nested lists, ``pages``
    a list of page labels and targets, ``extra`` further resources by path (a path the package needs itself is left out;
    one named ``cover`` is the cover image), ``more`` further metadata of the kept kinds. The type comes first, unpacked."""
    taken: set[str] = {"nav", "ncx", "css"}
    reserved = {"nav.xhtml", "toc.ncx", "content.opf", STYLE, *(h for h, _, _ in files)}

    def item(name: str) -> str:
        base = re.sub(r"[^A-Za-z0-9_-]", "_", name)
        out, n = base, 1
        while out in taken:
            n += 1
            out = f"{base}-{n}"
        taken.add(out)
        return out

    docs = [(item(f"d_{h}"), h, t, x) for h, t, x in files]
    rest = [(item(f"r_{p}"), p, m, d) for p, (m, d) in (extra or {}).items() if p not in reserved]
    cover = next((i for i, p, m, _ in rest if m.startswith("image/") and posixpath.basename(p).startswith("cover.")), None)
    page_list = f'<nav epub:type="page-list"><ol>{"".join(f"<li><a href={chr(34)}{escape(h)}{chr(34)}>{escape(p)}</a></li>" for p, h in pages)}</ol></nav>' if pages else ""
    manifest = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>'
    manifest += "".join(f'<item id="{i}" href="{escape(h)}" media-type="application/xhtml+xml"/>' for i, h, _, _ in docs)
    manifest += f'<item id="css" href="{STYLE}" media-type="text/css"/>'
    manifest += "".join(f'<item id="{i}" href="{escape(p)}" media-type="{m}"' + (' properties="cover-image"/>' if i == cover else "/>") for i, p, m, _ in rest)
    dc = "".join(f"<dc:{k}>{escape(v)}</dc:{k}>" for k, v in more if k in DC_KEPT and k not in ("title", "language", "identifier") and v)
    opf = (
        f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="uid" dir="{direction}">'
        f'<metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{escape(identifier)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language>{dc}</metadata>'
        f'<manifest>{manifest}</manifest><spine toc="ncx" page-progression-direction="{direction}">{"".join(f"<itemref idref={chr(34)}{i}{chr(34)}/>" for i, *_ in docs)}</spine></package>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        stamp = (2000, 1, 1, 0, 0, 0)

        def put(name: str, data: str | bytes, how=zipfile.ZIP_DEFLATED):
            z.writestr(zipfile.ZipInfo(name, stamp), data, how)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("OEBPS/content.opf", opf)
        put("OEBPS/nav.xhtml", wrap(title, f'<nav epub:type="toc">{nav or "<ol></ol>"}</nav>{page_list}', language, direction))
        put("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(title)}</text></docTitle><navMap>{ncx}</navMap></ncx>')
        for _, h, t, x in docs:
            put(f"OEBPS/{h}", wrap(t, x, language, direction))
        put(f"OEBPS/{STYLE}", css)
        for _, p, _, d in rest:
            put(f"OEBPS/{p}", d)
    return out.getvalue()


def packages(books: DataFrame, pages: DataFrame, navs: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """``book_id, epub``: a package per book. ``books``: ``book_id, title, lang, direction`` and any of the kept kinds of
    metadata (``publisher``, ``creator`` ...); ``pages``: ``book_id, ord, href, title, xhtml`` (one book's pages are one
    list) and, if it is a page of print, its ``label``; ``navs``: ``book_id, nav`` and ``ncx``; ``extras``: ``book_id, path,
    type, content`` of further resources. Books without pages have none."""
    label = F.col("label") if "label" in pages.columns else F.lit(None).cast("string")
    lists = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("ord", "href", "title", "xhtml", label.alias("label")))).alias("files"))
    ncx = F.col("ncx") if "ncx" in navs.columns else F.lit(None).cast("string")
    rows = books.join(lists, "book_id").join(navs.select("book_id", "nav", ncx.alias("ncx")), "book_id", "left")
    known = [c for c in DC_KEPT if c in books.columns and c != "title"]
    rows = rows.withColumn("more", F.array(*(F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in known)).cast("array<struct<k:string,v:string>>"))
    empty = F.expr("cast(array() as array<struct<path:string,type:string,content:binary>>)")
    if extras is None:
        rows = rows.withColumn("extra", empty)
    else:
        res = extras.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("path", "type", "content"))).alias("extra"))
        rows = rows.join(res, "book_id", "left").withColumn("extra", F.coalesce("extra", empty))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [
                build(
                    t or i, lang or "und", d or "ltr", i, [(f["href"], f["title"] or "", f["xhtml"]) for f in files], nav or "", ncx or "",
                    [(f["label"], f["href"]) for f in files if f["label"]], {e["path"]: (e["type"], bytes(e["content"])) for e in extra}, [(m["k"], m["v"]) for m in more],
                )
                for i, t, lang, d, files, nav, ncx, more, extra in zip(b.book_id, b.title, b.lang, b.direction, b.files, b.nav, b.ncx, b.more, b.extra)
            ]
            yield pd.DataFrame({"book_id": b.book_id, "epub": made})

    return rows.select("book_id", "title", "lang", "direction", "files", "nav", "ncx", "more", "extra").mapInPandas(run, "book_id string, epub binary")
