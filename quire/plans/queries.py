"""Queries of the core operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import digits, urls
from quire.functions.normalize import normalize_map_udf, normalize_udf
from quire.functions.similarity import as_text
from quire.operators import alignment, anchors, asof, blocks, crawl, fragments, output, report, toc
from quire.plans import inputs as I  # noqa: E741
from quire.plans.sql import SQL  # noqa: F401
from quire.sources import epub, html
from quire.sources.tables import table

PAGE_KEY = ["book_id", "stream", "page"]


def text_normalize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", normalize_udf("text").alias("norm"))


def norm_map(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", normalize_map_udf("text")["norm_map"].alias("norm_map"))


def digit_runs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").select("doc_id", F.posexplode(digits.digit_runs(F.col("text"))).alias("n", "v"))
    return t.select("doc_id", F.col("n").cast("int").alias("n"), F.col("v.as_is").cast("string").alias("as_is"), F.col("v.reversed").cast("string").alias("reversed_value"))


def reverse_digits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", digits.reverse_digit_runs(F.col("text")).alias("text"))


def text_order(s: SparkSession, d: str) -> DataFrame:
    b = I.blocks(s, d)
    out = None
    for mode in ("logical", "reverse_chars", "reverse_words"):
        x = b.select("block_id", F.lit(mode).alias("mode"), digits.ordered_lines(F.col("lines"), mode).alias("text"))
        out = x if out is None else out.unionByName(x)
    return out


def url_normalize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "toc").select("url").distinct().select("url", urls.normalize_url(F.col("url")).alias("norm_url"))


def url_dedup(s: SparkSession, d: str) -> DataFrame:
    t = I.toc(s, d).where("url IS NOT NULL").select("book_id", "ord", urls.normalize_url(F.col("url")).alias("url"))
    return crawl.first_seen(t, ["book_id", "url"], "ord").select("book_id", "url", "ord")


def url_scope(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "toc").select("url").distinct().withColumn("_s", urls.book_scope(F.col("url")))
    return t.select("url", "_s.book_ref", "_s.scope", urls.fragment(F.col("url")).alias("fragment"))


def cache_key(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_contents").select("url").distinct().select("url", urls.cache_key(F.col("url")).alias("cache_key"))


def safe_filename(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "book_meta").select("book_id", "title").distinct().select("book_id", "title", urls.safe_filename(F.col("title"), 40).alias("file_name"))


def mime_extension(s: SparkSession, d: str) -> DataFrame:
    t = s.createDataFrame([(m,) for m in ("image/jpeg", "image/png; q=1", "IMAGE/GIF", "image/svg+xml", "image/webp", "text/html", None)], "mime string")
    return t.select("mime", urls.image_extension(F.col("mime")).alias("extension"))


def page_offsets(s: SparkSession, d: str) -> DataFrame:
    return anchors.page_offsets(I.page_texts(s, d)).select(*PAGE_KEY, "offset", F.length("norm").alias("n_chars"))


def rare_gram_index(s: SparkSession, d: str) -> DataFrame:
    return anchors.rare_grams(I.texts(s, d)).select("book_id", "stream", as_text(F.col("g")).alias("g"), "n", F.concat_ws(",", F.transform("places", lambda p: p.cast("string"))).alias("places"))


def unique_page_grams(s: SparkSession, d: str) -> DataFrame:
    return anchors.unique_page_grams(I.page_texts(s, d)).withColumn("g", as_text(F.col("g")))


def anchor_hits(s: SparkSession, d: str) -> DataFrame:
    return anchors.anchor_hits(I.page_texts(s, d), I.texts(s, d))


def anchor_chain(s: SparkSession, d: str) -> DataFrame:
    return anchors.anchor_chain(I.page_texts(s, d), I.texts(s, d))


def _points(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("book_id", "stream").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    j = F.coalesce(F.sum(F.col("pdf_chars") + 1).over(w), F.lit(0)).cast("int")
    return I.matches(s, d).select("book_id", "stream", j.alias("j"), F.col("start_pos").alias("q")).where("q IS NOT NULL")


def diag_filter(s: SparkSession, d: str) -> DataFrame:
    return anchors.diagonal_filter(_points(s, d)).select("book_id", "stream", "j", "q")


def page_alignment(s: SparkSession, d: str) -> DataFrame:
    return alignment.align_pages(I.page_texts(s, d), I.texts(s, d))


def _placed(s: SparkSession, d: str) -> DataFrame:
    n = I.texts(s, d).select("book_id", "stream", F.length("norm").alias("n_e"))
    m = I.matches(s, d).join(n, ["book_id", "stream"])
    return m.select(*PAGE_KEY, "pdf_chars", "start_pos", "end_pos", "n_e", "anchors_hit", "score")


def page_boundaries(s: SparkSession, d: str) -> DataFrame:
    return alignment.boundaries(_placed(s, d)).select(*PAGE_KEY, "boundary", "gap_status")


def extra_text(s: SparkSession, d: str) -> DataFrame:
    return alignment.extra_text(alignment.boundaries(_placed(s, d)))


def _scored(s: SparkSession, d: str) -> DataFrame:
    m = alignment.boundaries(_placed(s, d).drop("score")).join(I.page_texts(s, d), PAGE_KEY)
    return alignment.scores(m, I.texts(s, d))


def page_scores(s: SparkSession, d: str) -> DataFrame:
    return _scored(s, d).select(*PAGE_KEY, "score", "seg_chars")


def page_status(s: SparkSession, d: str) -> DataFrame:
    return alignment.confidence(alignment.statuses(_scored(s, d))).select(*PAGE_KEY, "status", "confidence")


def status_histogram(s: SparkSession, d: str) -> DataFrame:
    return report.histogram(I.matches(s, d), "status")


def confidence_histogram(s: SparkSession, d: str) -> DataFrame:
    return report.histogram(alignment.confidence(I.matches(s, d)), "confidence")


def mean_score(s: SparkSession, d: str) -> DataFrame:
    return report.mean_scores(I.matches(s, d))


def accepted_books(s: SparkSession, d: str) -> DataFrame:
    return report.accepted(I.matches(s, d))


def problem_pages(s: SparkSession, d: str) -> DataFrame:
    return report.problem_pages(alignment.confidence(I.matches(s, d))).select(*PAGE_KEY, "status", "confidence")


def last_text_end(s: SparkSession, d: str) -> DataFrame:
    n = I.texts(s, d).select("book_id", "stream", F.length("norm").alias("n_e"))
    return report.last_text_end(I.matches(s, d).join(n, ["book_id", "stream"]))


def report_json(s: SparkSession, d: str) -> DataFrame:
    return report.report(alignment.confidence(I.matches(s, d)))


def text_hit_rate(s: SparkSession, d: str) -> DataFrame:
    return report.text_hit_rate(I.page_texts(s, d).withColumn("chars", F.length("norm")), I.texts(s, d))


def best_order(s: SparkSession, d: str) -> DataFrame:
    b, p, out = I.blocks(s, d).where("kind = 'body'"), I.pages(s, d), None
    for mode in ("logical", "reverse_chars", "reverse_words"):
        t = b.select("book_id", "page", "block_ord", digits.ordered_lines(F.col("lines"), mode).alias("_t")).groupBy("book_id", "page").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "_t"))), lambda x: x["_t"]), "\n").alias("_t")
        )
        t = p.select("book_id", "page").join(t, ["book_id", "page"]).select("book_id", F.lit(0).alias("stream"), "page", normalize_udf("_t").alias("norm"))
        r = report.text_hit_rate(t.withColumn("chars", F.length("norm")), I.texts(s, d))
        r = r.select("book_id", "stream", F.lit(mode).alias("mode"), (F.col("hits") / F.col("probes")).alias("rate"))
        out = r if out is None else out.unionByName(r)
    return report.best_order(out)


def _paragraphs(s: SparkSession, d: str) -> DataFrame:
    return fragments.paragraphs(I.streams(s, d).where("raw_text IS NOT NULL"), "raw_text")


def page_of_offset(s: SparkSession, d: str) -> DataFrame:
    p = _paragraphs(s, d).select("book_id", "stream", "node_ord", "start")
    return fragments.page_of(p, I.matches(s, d), "start").where("page IS NOT NULL").select("book_id", "stream", "node_ord", "page")


def nearest_note_start(s: SparkSession, d: str) -> DataFrame:
    cuts_ = I.matches(s, d).where("stream = 1 AND raw_start IS NOT NULL").select(*PAGE_KEY, "raw_start")
    starts = _paragraphs(s, d).where("stream = 1 AND text <> ''").select("book_id", "stream", "start")
    return asof.nearest_join(cuts_, starts, ["book_id", "stream"], "raw_start", "start", 25)


def span_overlap(s: SparkSession, d: str) -> DataFrame:
    return fragments.page_fragments(_paragraphs(s, d).where("text <> ''"), I.matches(s, d))


def raw_cuts(s: SparkSession, d: str) -> DataFrame:
    m = I.matches(s, d).where("boundary IS NOT NULL").select(*PAGE_KEY, "boundary", "pdf_chars")
    return fragments.raw_cuts(m, I.streams(s, d).where("norm_text IS NOT NULL"))


def block_classify(s: SparkSession, d: str) -> DataFrame:
    return blocks.classify(I.blocks(s, d).drop("kind"), I.pages(s, d)).select("block_id", "found_kind")


def header_signatures(s: SparkSession, d: str) -> DataFrame:
    r = blocks.repeated_signatures(I.blocks(s, d), I.pages(s, d))
    return r.select("book_id", F.concat_ws(",", "sig.fonts").alias("fonts"), "sig.step", "n")


def body_font_mode(s: SparkSession, d: str) -> DataFrame:
    return blocks.body_font_sizes(I.blocks(s, d).where("kind = 'body'"))


def removed_heads(s: SparkSession, d: str) -> DataFrame:
    b = I.blocks(s, d).withColumn("norm", normalize_udf(F.array_join("lines", " "))).withColumnRenamed("kind", "found_kind")
    return blocks.removed_heads(b)


def page_kinds(s: SparkSession, d: str) -> DataFrame:
    p = I.pages(s, d)
    b = I.blocks(s, d).withColumnRenamed("kind", "found_kind")
    return blocks.page_kinds(b, p, p.where("kind IN ('image', 'mixed')"))


def page_regions(s: SparkSession, d: str) -> DataFrame:
    return blocks.page_regions(I.blocks(s, d))


def separator_check(s: SparkSession, d: str) -> DataFrame:
    p = I.pages(s, d)
    lines = p.where("separator_y IS NOT NULL").select("book_id", "page", F.lit(60.0).alias("x0"), F.col("separator_y").alias("y0"), F.lit(160.0).alias("x1"), (F.col("separator_y") + 1).alias("y1"))
    return blocks.separators(lines, p, I.blocks(s, d))


def consecutive_numbers(s: SparkSession, d: str) -> DataFrame:
    return blocks.number_steps(I.blocks(s, d))


def note_places(s: SparkSession, d: str) -> DataFrame:
    img = I.pages(s, d).where("separator_y IS NOT NULL").select("book_id", "page", F.lit(1).alias("image_ord"), F.col("separator_y").alias("y0"))
    return blocks.image_places(img, I.blocks(s, d).where("kind = 'body'")).select("book_id", "page", F.bround("y_ratio", 6).alias("y_ratio"))


def toc_sections(s: SparkSession, d: str) -> DataFrame:
    return toc.sections(I.toc(s, d)).select("book_id", "ord", "section", "group_no", "page_no", "href")


def _tree(s: SparkSession, d: str) -> DataFrame:
    return toc.tree(toc.sections(I.toc(s, d).repartition("book_id"), "page").where("path IS NOT NULL"))


def toc_tree(s: SparkSession, d: str) -> DataFrame:
    return _tree(s, d).select("book_id", F.array_join("path", " / ").alias("path"), "title", "depth", "preorder", "href")


def ncx_play_order(s: SparkSession, d: str) -> DataFrame:
    t = toc.play_order(toc.first_targets(_tree(s, d)))
    return t.select("book_id", "preorder", "first_href", "play_order")


def navigation(s: SparkSession, d: str) -> DataFrame:
    return toc.navigation(toc.first_targets(_tree(s, d)))


def crawl_frontier(s: SparkSession, d: str) -> DataFrame:
    seeds = I.toc(s, d).where("NOT discovered AND url IS NOT NULL").select("book_id", "ord", urls.normalize_url(F.col("url")).alias("url"))
    w = Window.partitionBy("book_id").orderBy("ord", "page_id")
    p = I.site_pages(s, d).where("url IS NOT NULL").select("book_id", "page_id", "ord", urls.normalize_url(F.col("url")).alias("url"))
    links = p.select("book_id", "url", F.lead("url").over(w).alias("next_url"))
    return crawl.frontier(seeds, links)


def dead_letter(s: SparkSession, d: str) -> DataFrame:
    f = crawl.failed_pages(I.site_pages(s, d)).select("book_id", "url", "error")
    b = crawl.books_without_pages(table(s, d, "book_meta"), I.toc(s, d)).select("book_id", F.lit(None).cast("string").alias("url"), "error")
    return f.unionByName(b)


def html_links(s: SparkSession, d: str) -> DataFrame:
    t = I.site_pages(s, d).where("body IS NOT NULL")
    return t.select("page_id", F.posexplode(F.regexp_extract_all("body", F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))).alias("n", "href"))


def html_text(s: SparkSession, d: str) -> DataFrame:
    t = I.site_pages(s, d).where("body IS NOT NULL")
    bare = F.regexp_replace(F.regexp_replace("body", r"(?s)<!--.*?-->", ""), r"<[^>]*>", "")
    return t.select("page_id", bare.alias("text"))


def html_blocks(s: SparkSession, d: str) -> DataFrame:
    return html.page_blocks(I.site_pages(s, d))


def unique_ids(s: SparkSession, d: str) -> DataFrame:
    t = I.site_pages(s, d).where("title IS NOT NULL").select("book_id", F.lit(1).alias("page"), F.col("page_id").alias("ord"), F.lit(1).alias("doc"), F.col("title").alias("id"))
    return fragments.unique_ids(t).select("book_id", "ord", "new_id")


def note_cuts(s: SparkSession, d: str) -> DataFrame:
    c = I.matches(s, d).where("stream = 1 AND raw_start IS NOT NULL").select(*PAGE_KEY, F.col("raw_start").alias("cut"))
    starts = _paragraphs(s, d).where("stream = 1 AND text <> ''").select("book_id", "stream", "start")
    return fragments.note_cuts(c, starts)


def concat_invariant(s: SparkSession, d: str) -> DataFrame:
    b = I.blocks(s, d).where(~F.array_join("lines", "\n").eqNullSafe(F.col("text")))
    n = I.streams(s, d).where(F.length("norm_text") != F.size("norm_map"))
    return b.select(F.lit("block").alias("kind"), F.col("block_id").alias("id")).unionByName(n.select(F.lit("stream").alias("kind"), F.col("stream_id").alias("id")))


def epub_roundtrip(s: SparkSession, d: str) -> DataFrame:
    b = html.page_blocks(I.site_pages(s, d).where("body IS NOT NULL AND page_id IS NOT NULL"), ["book_id", "ord", "title"])
    files = b.select("book_id", F.struct("ord", "page_id").alias("ord"), F.format_string("p-%d.xhtml", "page_id").alias("href"), "title", F.array_join("blocks", "").alias("xhtml"))
    meta = table(s, d, "book_meta").groupBy("book_id").agg(F.max_by(F.struct("title", "lang", "direction"), "extracted_at").alias("_m")).select("book_id", "_m.*")
    nodes = toc.first_targets(_tree(s, d))
    points = toc.ncx_points(toc.play_order(nodes))
    made = epub.packages(meta, files, toc.navigation(nodes).join(points, "book_id", "left")).select(F.col("book_id").alias("book"), F.col("epub").alias("content"))
    docs = epub.documents(made)
    return docs.groupBy("book").agg(F.count("*").alias("n_docs"), F.sum(F.length("body")).alias("body_chars"), F.sum(F.length("notes")).alias("note_chars"))


def _line_books(s: SparkSession, d: str) -> DataFrame:
    """``book_id, content``: an archive of each book whose paragraphs and notes are the lines of its streams."""
    t = I.streams(s, d).where("raw_text IS NOT NULL").select("book_id", "stream", F.split("raw_text", "\n").alias("_l"))
    line = lambda x: toc.escape(x)
    p = F.transform("_l", lambda x: F.concat(F.lit("<p>"), line(x), F.lit("</p>")))
    n = F.transform("_l", lambda x, i: F.concat(F.lit('<aside epub:type="footnote" id="n'), i.cast("string"), F.lit('">'), line(x), F.lit("</aside>")))
    x = t.select("book_id", "stream", F.array_join(F.when(F.col("stream") == 0, p).otherwise(n), "").alias("xhtml"))
    files = x.select("book_id", F.col("stream").alias("ord"), F.format_string("t-%d.xhtml", "stream").alias("href"), F.lit("t").alias("title"), "xhtml")
    meta = x.select("book_id", F.col("book_id").alias("title"), F.lit("ar").alias("lang"), F.lit("rtl").alias("direction")).distinct()
    none = meta.select("book_id", F.lit("").alias("nav"))
    return epub.packages(meta, files, none).select("book_id", F.col("epub").alias("content"))


def _line_cuts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cuts of ``page_matches`` and the texts they cut, both without the line feeds that no document holds."""
    t = I.streams(s, d).where("raw_text IS NOT NULL").select("book_id", "stream", "raw_text")
    bare = lambda c: F.replace(c, F.lit("\n"), F.lit(""))
    lists = I.matches(s, d).where("raw_start IS NOT NULL").groupBy("book_id", "stream").agg(F.collect_list(F.struct("page", "raw_start")).alias("_p"))
    at = F.transform("_p", lambda p: F.struct(p["page"].alias("page"), F.length(bare(F.substring(F.col("raw_text"), F.lit(1), p["raw_start"]))).alias("cut")))
    w = Window.partitionBy("book_id", "stream").orderBy("_x.page").rowsBetween(Window.unboundedPreceding, 0)
    cuts = lists.join(t, ["book_id", "stream"]).select("book_id", "stream", F.explode(at).alias("_x")).select("book_id", "stream", "_x.page", F.max("_x.cut").over(w).alias("cut"))
    return cuts, t.withColumn("raw_text", bare(F.col("raw_text")))


def page_output(s: SparkSession, d: str) -> DataFrame:
    cuts, texts = _line_cuts(s, d)
    ends = texts.select("book_id", "stream", (F.length("raw_text") + 1).alias("end"))
    p = output.page_documents(_line_books(s, d), output.book_cuts(cuts, ends))
    return p.select("book_id", "page", F.length("body_text").alias("body_chars"), F.md5("body_text").alias("body"), F.length("note_text").alias("note_chars"), F.md5("note_text").alias("notes"))


def output_verified(s: SparkSession, d: str) -> DataFrame:
    cuts, texts = _line_cuts(s, d)
    cuts, ends = output.trimmed(cuts, texts, None)
    wide = output.book_cuts(cuts, ends)
    kept = texts.join(cuts.select("book_id", "stream").distinct(), ["book_id", "stream"], "left_semi")  # notes on no page are on none
    wanted = kept.groupBy("book_id").agg(*(F.coalesce(F.max(F.when(F.col("stream") == i, F.col("raw_text"))), F.lit("")).alias(n) for i, n in ((0, "body"), (1, "notes"))))
    return output.verified(output.page_documents(_line_books(s, d), wide), wide, wanted)


def image_modes(s: SparkSession, d: str) -> DataFrame:
    return output.image_modes(I.pages(s, d), I.matches(s, d).where("stream = 0"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    return page_scores(s, d)


QUERIES = {
    f.__name__: f
    for f in (
        text_normalize, norm_map, digit_runs, reverse_digits, text_order, url_normalize, url_dedup, url_scope, cache_key, safe_filename,
        mime_extension, page_offsets, rare_gram_index, unique_page_grams, anchor_hits, anchor_chain, diag_filter, page_alignment,
        page_boundaries, extra_text, page_scores, page_status, status_histogram, confidence_histogram, mean_score, accepted_books,
        problem_pages, last_text_end, report_json, text_hit_rate, best_order, page_of_offset, nearest_note_start, span_overlap, raw_cuts,
        block_classify, header_signatures, body_font_mode, removed_heads, page_kinds, page_regions, separator_check, consecutive_numbers,
        note_places, toc_sections, toc_tree, ncx_play_order, navigation, crawl_frontier, dead_letter, html_links, html_text, html_blocks,
        unique_ids, note_cuts, concat_invariant, epub_roundtrip, page_output, output_verified, image_modes,
    )
}
