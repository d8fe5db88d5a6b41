"""Pieces of a text by page: which spans a page holds, links to the page that holds their target."""

from __future__ import annotations

from itertools import chain, count

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.cuts import slice_text, snap, to_raw
from quire.operators.asof import asof_join, nearest_join, overlap_join


def paragraphs(texts: DataFrame, column: str) -> DataFrame:
    """``book_id, stream, node_ord, start, end, text``: the lines of a text and their places."""
    t = texts.select("book_id", "stream", F.posexplode(F.split(column, "\n")).alias("node_ord", "text"))
    w = Window.partitionBy("book_id", "stream").orderBy("node_ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("int")
    return t.withColumn("start", start).withColumn("end", (F.col("start") + F.length("text")).cast("int"))


def page_fragments(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Spans (``start, end, text``) cut at page ranges (``page, raw_start, raw_end``) of their stream:
    ``book_id, stream, page, node_ord, piece, keeps_id``; a span's id stays with its first piece."""
    both = overlap_join(spans, pages.select("book_id", "stream", "page", "raw_start", "raw_end"), ["book_id", "stream"], ("start", "end"), ("raw_start", "raw_end"))
    piece = slice_text(F.col("text"), F.col("start"), F.col("raw_start"), F.col("raw_end"))
    return both.select("book_id", "stream", "page", "node_ord", piece.alias("piece"), (F.col("start") >= F.col("raw_start")).alias("keeps_id"))


def page_of(offsets: DataFrame, pages: DataFrame, at: str) -> DataFrame:
    """Places with the page whose range begins last at or before them; before the first page: the first."""
    starts = pages.where("raw_start IS NOT NULL").groupBy("book_id", "stream", "raw_start").agg(F.max("page").alias("page"))
    out = asof_join(offsets, starts, ["book_id", "stream"], at, "raw_start", ["page"])
    lowest = starts.groupBy("book_id", "stream").agg(F.min_by("page", "raw_start").alias("_first"))
    return out.join(lowest, ["book_id", "stream"], "left").withColumn("page", F.coalesce("page", "_first")).drop("_first")


def unique_ids(rows: DataFrame) -> DataFrame:
    """Ids (``book_id, page, ord, doc, id``) made unique on their page as ``new_id``: the first keeps its id, the next of
    document 3 is ``id-d3``, then ``id-d3-2`` and so on; numbers that would meet an id the page has are passed over.

    Which numbers are free hangs on the rows before, so a page's ids are one call; only ids that come
    again, or look like a suffix, go there.
    """
    base = F.regexp_replace("id", r"(-d\d+(-\d+)?)+$", "")
    several = F.count("*").over(Window.partitionBy("book_id", "page", base)) > 1
    t = rows.withColumn("_many", several & F.col("id").isNotNull())

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ord", ignore_index=True)
        taken: set[str] = set()
        out = []
        for doc, name in zip(g.doc, g.id):
            tries = chain([name, f"{name}-d{doc}"], (f"{name}-d{doc}-{n}" for n in count(2)))
            out.append(next(x for x in tries if x not in taken))
            taken.add(out[-1])
        return g.assign(new_id=out)

    schema = StructType([*rows.schema.fields, StructField("new_id", StringType())])
    renamed = t.where("_many").drop("_many").groupBy("book_id", "page").applyInPandas(run, schema)
    return t.where("NOT _many").drop("_many").withColumn("new_id", F.col("id")).unionByName(renamed)


def resolve_links(links: DataFrame, docs: DataFrame, resources: DataFrame, ids: DataFrame) -> DataFrame:
    """Links (``book_id, path, fragment``) with ``href`` and ``kind``: a page that holds the id, the first page of
    a document, a resource, or unresolved. ``docs``: ``book_id, path, first_page``; ``ids``: ``book_id, path, id, page``."""
    i = ids.select("book_id", "path", F.col("id").alias("fragment"), F.col("page").alias("_id_page"))
    t = links.join(i, ["book_id", "path", "fragment"], "left").join(docs, ["book_id", "path"], "left").join(resources.select("book_id", "path", F.lit(True).alias("_res")).distinct(), ["book_id", "path"], "left")
    page = lambda c: F.format_string("page-%04d.xhtml", c)
    href = (
        F.when(F.col("_id_page").isNotNull(), F.concat(page("_id_page"), F.lit("#"), F.col("fragment")))
        .when(F.col("first_page").isNotNull(), page("first_page"))
        .when(F.col("_res"), F.col("path"))
    )
    kind = F.when(F.col("_id_page").isNotNull(), "id").when(F.col("first_page").isNotNull(), "document").when(F.col("_res"), "resource").otherwise("unresolved")
    return t.select(*links.columns, href.alias("href"), kind.alias("kind"))


def raw_cuts(pages: DataFrame, texts: DataFrame, reach: int = 60) -> DataFrame:
    """``book_id, stream, page, cut``: places in raw text where pages (``page, boundary, pdf_chars``) begin, from texts
    (``raw_text, norm_map``). Cuts of pages with text move before openers and out of words; cuts never fall.
    """
    lists = pages.groupBy("book_id", "stream").agg(F.collect_list(F.struct("page", "boundary", "pdf_chars")).alias("_b"))
    raw = lambda b: to_raw(F.col("norm_map"), b["boundary"], F.length("raw_text"))
    around = lambda b: F.substring(F.col("raw_text"), F.greatest(raw(b) - reach, F.lit(0)) + 1, F.lit(2 * reach))
    cut = F.transform("_b", lambda b: F.struct(b["page"].alias("page"), b["pdf_chars"].alias("n"), raw(b).alias("cut"), around(b).alias("near")))
    t = lists.join(texts.select("book_id", "stream", "raw_text", "norm_map"), ["book_id", "stream"]).select(
        "book_id", "stream", F.length("raw_text").alias("_n"), F.explode(cut).alias("_x")
    )
    at = F.least(F.col("_x.cut"), F.lit(reach))
    moved = F.col("_x.cut") + F.when(F.col("_x.n") > 0, snap(F.col("_x.near"), at) - at).otherwise(0)
    w = Window.partitionBy("book_id", "stream").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("book_id", "stream", F.col("_x.page").alias("page"), F.least(moved, F.col("_n")).alias("_m"))
    return t.select("book_id", "stream", "page", F.greatest(F.lit(0), F.max("_m").over(w)).cast("int").alias("cut"))


#: How far a cut moves to the start of a note, and the cut that ends the last page.
NOTE_REACH, END_REACH = 25, 40


def note_cuts(cuts: DataFrame, starts: DataFrame, within: int = NOTE_REACH) -> DataFrame:
    """Cuts (``book_id, stream, page, cut``) moved to the nearest start of a note (``book_id, stream, start``) not farther
    than ``within``, the earlier one on ties; cuts never fall."""
    w = Window.partitionBy("book_id", "stream").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    t = nearest_join(cuts, starts, ["book_id", "stream"], "cut", "start", within).withColumn("cut", F.coalesce("nearest", "cut")).drop("nearest")
    return t.withColumn("cut", F.max("cut").over(w))


def extend_over_headers(pages: DataFrame, notes: DataFrame, max_steps: int = 3, least: int = 8) -> DataFrame:
    """``book_id, stream, page, cut`` of pages (``page, cut, head``) whose cuts move back over short notes they begin with.

    ``head`` is the page's normalised note text, ``notes`` (``start, norm``) where notes begin and their normalised
    text. A page that begins at a note and whose head begins with the notes before it, last note first, takes
    them in, at most ``max_steps`` of at least ``least`` characters, but none before the page with text
    ahead of it begins; pages that began after the new cut begin there too.
    """
    key = ["book_id", "stream"]
    w = Window.partitionBy(*key).orderBy("start")
    back = [(F.lag("start", n).over(w), F.lag("norm", n).over(w)) for n in range(1, max_steps + 1)]
    n = notes.select(*key, "start", *(c.alias(f"_{x}{i}") for i, pair in enumerate(back) for x, c in zip("sn", pair)))
    t = pages.join(n.withColumnRenamed("start", "cut"), [*key, "cut"], "left")
    fits, eaten, steps = F.lit(True), F.lit(""), []
    for i in range(max_steps):  # each step needs the ones before
        eaten = F.concat(eaten, F.col(f"_n{i}"))
        fits = fits & (F.length(f"_n{i}") >= least) & F.startswith("head", eaten)
        steps.append(F.when(fits, F.col(f"_s{i}")))
    t = t.select(*key, "page", "cut", (F.coalesce(F.length("head"), F.lit(0)) > 0).alias("full"), F.array_compact(F.array(*steps)).alias("steps"))

    def floors(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("page", ignore_index=True)
        floor, out = 0, []
        for cut, full, options in zip(g.cut.tolist(), g.full, g.steps):
            for s in options if full else ():
                if s < floor:
                    break
                cut = int(s)
            out.append(cut)
            floor = cut if full else floor
        return g.assign(cut=out)[["book_id", "stream", "page", "cut"]]

    moved = t.groupBy(*key).applyInPandas(floors, "book_id string, stream int, page int, cut int")
    later = Window.partitionBy(*key).orderBy(F.desc("page")).rowsBetween(Window.unboundedPreceding, 0)
    return moved.withColumn("cut", F.min("cut").over(later))
