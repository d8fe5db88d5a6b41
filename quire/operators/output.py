"""Pages of a book as documents of their own: its EPUB cut where pages begin, links and contents led to them.

A book is read once, from front to back. Each run of text goes to the page its place belongs to; where a
cut falls inside elements, they are opened again on the next page as soon as something stands in them
there. The text of all pages is the book's text, whatever the cuts are.
"""

from __future__ import annotations

import posixpath
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources import epub
from quire.sources.html import Node

# Attributes that refer to other places.
REFERENCES = ("href", "src", "data", "poster", "xlink:href")
FOLDER, NAVIGATION = "Text", "nav.xhtml"


def page_name(number: int) -> str:
    return f"page-{number:04d}.xhtml"


@dataclass
class Page:
    number: int
    body: Node = field(default_factory=lambda: Node("body"))
    notes: Node = field(default_factory=lambda: Node("div", attrs={"class": "pdf-footnotes"}))
    ids: set[str] = field(default_factory=set)

    def new_id(self, name: str, doc: int) -> str:
        out, n = name, 1
        while out in self.ids:
            out = f"{name}-d{doc}" + (f"-{n}" if n > 1 else "")
            n += 1
        self.ids.add(out)
        return out


class _Stream:
    """One stream of the book while it is read: where it is, which elements are open, and their copies on the page."""

    def __init__(self, cuts: list[int], end: int, roots: list[Node]):
        self.cuts, self.end, self.roots = cuts, end, roots
        self.at, self.page = 0, -1
        self.open: list[Node] = []
        self.copies: list[Node | None] = []
        self.again: list[Node] = []

    def page_at(self, place: int) -> int:
        return bisect_right(self.cuts, place) - 1 if place < self.end else -1

    def inside(self, page: int) -> Node:
        """The copy of the innermost open element on ``page``; what is missing of the open elements is made."""
        if page != self.page:
            self.page, self.copies = page, [None] * len(self.open)
        parent = self.roots[page]
        for i, source in enumerate(self.open):
            if self.copies[i] is None:
                self.copies[i] = Node(source.tag, attrs={k: v for k, v in source.attrs.items() if k != "id"})
                parent.children.append(self.copies[i])
                self.again.append(self.copies[i])
            parent = self.copies[i]
        return parent

    def text(self, text: str) -> None:
        lo, hi = self.at, self.at + len(text)
        while lo < hi:
            page = self.page_at(lo)
            cut = self.cuts[page + 1] if page + 1 < len(self.cuts) else self.end
            upto = min(hi, cut) if lo < self.end else hi
            if page >= 0:
                self.inside(page).children.append(Node(text=text[lo - self.at : upto - self.at]))
            lo = upto
        self.at = hi

    def start(self, n: Node) -> tuple[int, Node | None]:
        """Open an element; its copy is made where it begins, if that is on a page."""
        page, copy = self.page_at(self.at), None
        if page >= 0:
            parent = self.inside(page)
            copy = Node(n.tag, attrs=dict(n.attrs))
            parent.children.append(copy)
        self.open.append(n)
        self.copies.append(copy)
        return page, copy


@dataclass
class Output:
    pages: list[Page]
    contents: list[dict]
    unresolved: list[str]


def cut_book(archive: epub.Archive, numbers: list[int], cuts: tuple[list[int], list[int]], ends: tuple[int, int], note_classes: tuple[str, ...] = ()) -> Output:
    """The pages ``numbers`` of a book that begin at ``cuts`` of its body and its notes and end at ``ends``."""
    pages = [Page(n) for n in numbers]
    for p in pages:
        mark = f"pg-{p.number:04d}"
        p.ids.add(mark)
        p.body.children.append(Node("span", attrs={"id": mark, "epub:type": "pagebreak", "role": "doc-pagebreak", "aria-label": str(p.number)}))
    streams = [_Stream(cuts[0], ends[0], [p.body for p in pages]), _Stream(cuts[1], ends[1], [p.notes for p in pages])]
    begins, places, refer = {}, {}, []
    for doc, (_, m, _, body) in enumerate(archive.documents()):
        begins[m["path"]] = (doc, streams[0].at)
        todo: list[tuple[Node | None, int]] = [(c, 0) for c in reversed(body.children)]
        while todo:
            n, s = todo.pop()
            stream = streams[s]
            if n is None:  # the end of an element
                stream.open.pop()
                stream.copies.pop()
            elif not n.tag:
                stream.text(n.text)
            else:
                if s == 0 and epub.is_note(n, note_classes):
                    if n.tag == "hr":
                        continue
                    s, stream = 1, streams[1]
                page, copy = stream.start(n)
                name = n.attrs.get("id")
                if name and (doc, name) not in places:
                    final = pages[page].new_id(name, doc) if copy else None
                    places[doc, name] = (s, stream.at, page if copy else None, final)
                    if copy:
                        copy.attrs["id"] = final
                elif name and copy:
                    copy.attrs["id"] = pages[page].new_id(name, doc)
                if copy and any(a in n.attrs for a in REFERENCES):
                    refer.append((copy, m["path"]))
                todo.append((None, s))
                todo += [(c, s) for c in reversed(n.children)]
        for stream in streams:
            refer += [(copy, m["path"]) for copy in stream.again if any(a in copy.attrs for a in REFERENCES)]
            stream.again.clear()

    def lead(path: str, fragment: str | None) -> tuple[str, bool]:
        """Page (and id on it) of a place in a document, and whether the fragment was found."""
        doc, at = begins[path]
        s, at, page, final = places.get((doc, fragment), (0, at, None, None)) if fragment else (0, at, None, None)
        k = page if page is not None else min(max(bisect_right(cuts[s], at) - 1, 0), len(pages) - 1)
        return page_name(numbers[k]) + (f"#{final}" if final else ""), not fragment or final is not None

    folder = posixpath.join(archive.folder, FOLDER)
    known, unresolved = archive.resources(), []
    for copy, path in refer:
        for a in REFERENCES:
            value = copy.attrs.get(a)
            target, fragment = epub.resolve(path, value) if value else (None, None)
            if not target:
                continue
            tail = f"#{fragment}" if fragment else ""
            if target in begins:
                copy.attrs[a], found = lead(target, fragment)
                if not found:
                    unresolved.append(f"{target}{tail}")
            elif archive.nav and target == archive.nav["path"]:
                copy.attrs[a] = posixpath.relpath(posixpath.join(archive.folder, NAVIGATION), folder) + tail
            elif target in known:
                copy.attrs[a] = posixpath.relpath(target, folder) + tail
            else:
                unresolved.append(f"{path}: {a}={value}")
    contents = archive.contents() or [{"ordinal_path": [i], "title": p, "path": p, "fragment": None} for i, p in enumerate(begins, 1)]
    for c in contents:
        c["href"] = f"{FOLDER}/{lead(c['path'], c['fragment'])[0]}" if c["path"] in begins else None
    return Output(pages, contents, unresolved)


def place_images(body: Node, images: list[tuple[str, str, float | None]]) -> None:
    """Images (``href, alt, y_ratio``) put before the block that holds the character at ``y_ratio`` of the text; at the
    end without a ratio."""
    blocks = [c for c in body.children if c.tag and c.attrs.get("epub:type") != "pagebreak"]
    until = np.cumsum([len(b.get_text().strip()) for b in blocks])
    before: list[list[Node]] = [[] for _ in range(len(blocks) + 1)]
    for href, alt, ratio in sorted(images, key=lambda x: -1.0 if x[2] is None else x[2]):
        at = len(blocks) if ratio is None or not blocks else int(np.searchsorted(until, ratio * (until[-1] or 1), side="right"))
        before[at].append(Node("div", attrs={"class": "pdf-page-image"}, children=[Node("img", attrs={"src": href, "alt": alt})]))
    order = {id(b): i for i, b in enumerate(blocks)}
    old, body.children = body.children, []
    for c in old:
        body.children += [*(before[order[id(c)]] if id(c) in order else ()), c]
    body.children += before[-1]


_CUT = "book_id string, page int, xhtml string, body_text string, note_text string, ids array<string>, unresolved array<string>"


def _books(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, Output]]:
    for b in batches:
        for i, data, numbers, los, nlos, end, note_end in zip(b.book_id, b.content, b.pages, b.los, b.nlos, b.end, b.note_end):
            archive = epub.open_archive(bytes(data))
            if archive is not None and len(numbers):
                yield i, cut_book(archive, list(map(int, numbers)), (list(map(int, los)), list(map(int, nlos))), (int(end), int(note_end)))


def _page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for book, out in _books(batches):
        rows = []
        for p in out.pages:
            body, notes = p.body.get_text(), p.notes.get_text()
            if p.notes.children:
                p.body.children.append(Node("hr", attrs={"class": "pdf-footnote-separator"}))
                p.body.children.append(p.notes)
            inner = "".join(c.xhtml() for c in p.body.children)
            rows.append((book, p.number, epub.wrap(f"{book} - {p.number}", inner), body, notes, sorted(p.ids), out.unresolved))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _CUT.split(", ")])


def _content_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for book, out in _books(batches):
        yield pd.DataFrame([(book, c["ordinal_path"], c["title"], c["href"]) for c in out.contents], columns=["book_id", "ordinal_path", "title", "href"])


def book_cuts(cuts: DataFrame, ends: DataFrame) -> DataFrame:
    """``book_id, pages, los, nlos, end, note_end``: a row per book from cuts (``book_id, stream, page, cut``) and ends
    (``book_id, stream, end``). Pages without a cut in the notes begin there with the next page that has one."""
    wide = cuts.groupBy("book_id", "page").agg(F.max(F.when(F.col("stream") == 0, F.col("cut"))).alias("lo"), F.max(F.when(F.col("stream") == 1, F.col("cut"))).alias("nlo"))
    e = ends.groupBy("book_id").agg(*(F.coalesce(F.max(F.when(F.col("stream") == i, F.col("end"))), F.lit(0)).alias(n) for i, n in ((0, "end"), (1, "note_end"))))
    later = Window.partitionBy("book_id").orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)
    filled = wide.join(e, "book_id").select(
        "book_id", "page", *(F.coalesce(F.last(c, True).over(later), F.col(n)).alias(c) for c, n in (("lo", "end"), ("nlo", "note_end"))), "end", "note_end"
    )
    whole = filled.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page", "lo", "nlo"))).alias("_p"), F.first("end").alias("end"), F.first("note_end").alias("note_end"))
    return whole.select("book_id", F.col("_p.page").alias("pages"), F.col("_p.lo").alias("los"), F.col("_p.nlo").alias("nlos"), "end", "note_end")


def page_documents(files: DataFrame, cuts: DataFrame) -> DataFrame:
    """``book_id, page, xhtml, body_text, note_text, ids, unresolved``: a document per page of archives (``book_id,
    content``) cut as ``book_cuts`` has it. Archives that cannot be read give no pages; see ``epub.broken``."""
    return files.select("book_id", "content").join(cuts, "book_id").mapInPandas(_page_rows, _CUT)


def page_contents(files: DataFrame, cuts: DataFrame) -> DataFrame:
    """``book_id, ordinal_path, title, href``: the contents of archives led to the pages; null for places on none."""
    return files.select("book_id", "content").join(cuts, "book_id").mapInPandas(_content_rows, "book_id string, ordinal_path array<int>, title string, href string")


def trimmed(cuts: DataFrame, texts: DataFrame, last_ends: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Cuts and the ends of streams (``book_id, stream, end``). With ``last_ends`` (``book_id, stream, last_cut``) what
    stands before the first page and behind the last is left out; without, the first page begins with the text
    and the last one ends with it."""
    n = texts.select("book_id", "stream", F.length("raw_text").alias("_n"))
    if last_ends is not None:
        top = cuts.groupBy("book_id", "stream").agg(F.max("cut").alias("_top"))
        ends = last_ends.join(top, ["book_id", "stream"]).select("book_id", "stream", F.greatest("_top", "last_cut").alias("end"))
        return cuts, ends
    first = F.row_number().over(Window.partitionBy("book_id", "stream").orderBy("page")) == 1
    return cuts.withColumn("cut", F.when(first, 0).otherwise(F.col("cut"))), n.select("book_id", "stream", (F.col("_n") + 1).alias("end"))


def verified(pages: DataFrame, cuts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``book_id, body_ok, notes_ok, count_ok, ok`` of page documents: whether their texts are what the cuts hold of the
    book (``wanted``: ``book_id, body, notes``, white space aside), and there is a document for each page."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    joined = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page", "body_text", "note_text"))).alias("_p"))
    t = cuts.select("book_id", "pages").join(wanted, "book_id").join(joined, "book_id", "left")
    text = lambda c: bare(F.array_join(F.transform("_p", lambda p: p[c]), ""))
    checks = {
        "body_ok": text("body_text") == bare(F.col("body")),
        "notes_ok": text("note_text") == bare(F.col("notes")),
        "count_ok": F.coalesce(F.transform("_p", lambda p: p["page"]) == F.col("pages"), F.lit(False)),
    }
    t = t.select("book_id", *(F.coalesce(c, F.lit(False)).alias(k) for k, c in checks.items()))
    return t.withColumn("ok", F.col("body_ok") & F.col("notes_ok") & F.col("count_ok"))


def image_modes(pages: DataFrame, matches: DataFrame, fallback: bool = True) -> DataFrame:
    """``book_id, page, mode`` of the pages (``kind``) that get images: ``image`` (the whole is one), ``inline`` (images in
    the text) or ``fallback`` (a page with text the book does not have)."""
    missing = matches.where("status = 'missing'").select("book_id", "page", F.lit(True).alias("_m")).distinct()
    mode = F.when(F.col("kind") == "image", "image").when(F.col("kind") == "mixed", "inline").when(F.lit(fallback) & F.col("_m"), "fallback")
    return pages.join(missing, ["book_id", "page"], "left").select("book_id", "page", mode.alias("mode")).where("mode IS NOT NULL")
