"""Blocks of PDF pages: kinds, fonts, running heads, page kinds, regions, digit direction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.digits import digit_runs
from quire.functions.normalize import normalize_udf

PAGE = ["book_id", "page"]


def signature():
    """Fonts and quarter-height of a block's upper edge (half up to even, in steps of four points)."""
    return F.struct(F.col("fonts"), F.bround(F.col("y0") / 4).cast("int").alias("step"))


def top_signatures(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``book_id, page, sig``: signature of the topmost block in the upper quarter of each page."""
    b = blocks.join(pages.select(*PAGE, "height"), PAGE).where(F.col("y0") < 0.25 * F.col("height"))
    return b.groupBy(*PAGE).agg(F.min_by(signature(), F.struct("y0", "block_ord")).alias("sig"))


def repeated_signatures(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``book_id, sig, n`` of signatures on enough pages of a book to be a running head."""
    n = pages.groupBy("book_id").agg(F.count("*").alias("_pages"))
    least = F.when(F.col("_pages") > 4, F.greatest(F.lit(3), F.floor(0.3 * F.col("_pages")))).otherwise(2)
    return top_signatures(blocks, pages).groupBy("book_id", "sig").agg(F.count("*").alias("n")).join(n, "book_id").where(F.col("n") >= least).select("book_id", "sig", "n")


def classify(blocks: DataFrame, pages: DataFrame, header_frac: float = 0.12, footer_frac: float = 0.06, note_ratio: float = 0.9) -> DataFrame:
    """Blocks with ``found_kind``: header, footer, page_number, footnote or body.

    ``blocks``: ``book_id, page, block_ord, lines, y0, y1, font_size, fonts``; ``pages``: ``book_id, page,
    height, separator_y``. Each block and page once. Blocks of unknown pages are left out.
    """
    heads = top_signatures(blocks, pages).join(repeated_signatures(blocks, pages).select("book_id", "sig"), ["book_id", "sig"])
    t = blocks.join(pages.select(*PAGE, "height", "separator_y"), PAGE).join(heads.withColumnRenamed("sig", "_head"), PAGE, "left")
    t = t.withColumn("norm", normalize_udf(F.array_join(F.coalesce("lines", F.expr("cast(array() as array<string>)")), " ")))
    hit = F.coalesce(signature() == F.col("_head"), F.lit(False))
    top = F.col("y1") <= F.col("height") * header_frac
    bottom = F.col("y0") >= F.col("height") * (1.0 - footer_frac)
    letters = F.regexp_replace("norm", "[0-9]", "")
    banded = F.when(letters == "", "page_number").when(top | hit, "header").otherwise("footer")
    below = (F.col("y0") + F.col("y1")) / 2 >= F.col("separator_y")
    first = F.when(top | bottom | hit, banded).when(F.col("separator_y").isNotNull() & below, "footnote").otherwise("body")
    t = t.withColumn("_first", first)
    size = body_font_sizes(t.where("_first = 'body'"))
    small = F.col("separator_y").isNull() & (F.col("font_size") <= F.col("body_font_size") * note_ratio) & (F.col("y0") > F.col("height") * 0.45)
    kind = F.when((F.col("_first") == "body") & F.coalesce(small & (F.col("body_font_size") > 0), F.lit(False)), "footnote").otherwise(F.col("_first"))
    return t.join(size, "book_id", "left").select(*blocks.columns, "norm", kind.alias("found_kind"))


def body_font_sizes(body: DataFrame) -> DataFrame:
    """``book_id, body_font_size``: the half point size with most characters; of equals the smaller one."""
    chars = F.coalesce(F.aggregate("lines", F.lit(0), lambda n, x: n + F.length(x)), F.lit(0))
    w = body.select("book_id", (F.bround(F.col("font_size") * 2) / 2).alias("_size"), chars.alias("_n"))
    w = w.groupBy("book_id", "_size").agg(F.sum("_n").alias("_n"))
    return w.groupBy("book_id").agg(F.max_by("_size", F.struct("_n", -F.col("_size"))).alias("body_font_size"))


def removed_heads(classified: DataFrame) -> DataFrame:
    """``book_id, signature, n``: running heads and feet by the first 30 letters without digits."""
    sig = F.substring(F.regexp_replace("norm", "[0-9]+", ""), 1, 30)
    return classified.where("found_kind IN ('header', 'footer')").groupBy("book_id", sig.alias("signature")).agg(F.count("*").alias("n"))


def page_kinds(classified: DataFrame, pages: DataFrame, art: DataFrame, min_body_chars: int = 25) -> DataFrame:
    """``book_id, page, found_kind``: image, mixed, blank or text. ``art``: pages with images or drawings."""
    chars = lambda k: F.sum(F.when(F.col("found_kind") == k, F.length(F.regexp_replace(F.array_join("lines", ""), r"(?U)\s+", ""))).otherwise(0))
    n = classified.groupBy(*PAGE).agg(chars("body").alias("_body"), chars("footnote").alias("_note"))
    t = pages.select(*PAGE).join(n, PAGE, "left").join(art.select(*PAGE, F.lit(True).alias("_art")).distinct(), PAGE, "left").na.fill(0, ["_body", "_note"])
    kind = (
        F.when(F.col("_art") & (F.col("_body") < min_body_chars), "image").when(F.col("_art"), "mixed")
        .when(F.col("_body") + F.col("_note") == 0, "blank").otherwise("text")
    )
    return t.select(*PAGE, kind.alias("found_kind"), "_body", "_note").withColumnsRenamed({"_body": "body_chars", "_note": "note_chars"})


def page_regions(boxes: DataFrame) -> DataFrame:
    """``book_id, page, x0, y0, x1, y1``: the smallest box around all boxes of a page."""
    return boxes.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def page_images(images: DataFrame, pages: DataFrame, blocks: DataFrame, least: float = 0.004, full: float = 0.85, text: int = 40) -> DataFrame:
    """Images (``book_id, page, x0, y0, x1, y1``) of substance: at least ``least`` of their page's area, and none that fills
    the page behind ``text`` characters or more of body, which is the scan under a layer of text."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    chars = F.length(F.regexp_replace(F.array_join("lines", ""), r"(?U)\s+", ""))
    body = blocks.where("found_kind = 'body'").groupBy(*PAGE).agg(F.sum(chars).alias("_body"))
    t = images.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("_area")), PAGE).join(body, PAGE, "left")
    behind = (area >= full * F.col("_area")) & (F.coalesce("_body", F.lit(0)) >= text)
    return t.where((area >= least * F.greatest(F.lit(1.0), F.col("_area"))) & ~behind).select(*images.columns)


def drawing_regions(drawings: DataFrame, pages: DataFrame, header_frac: float = 0.12) -> DataFrame:
    """Regions of pages with at least eight drawings of substance that cover 3 % of the page or more."""
    d = drawings.join(pages.select(*PAGE, "width", "height"), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    d = d.where((h > 4) & (w > 4) & (F.col("y0") >= header_frac * F.col("height")) & (w * h < 0.95 * F.col("width") * F.col("height")))
    g = d.groupBy(*PAGE).agg(F.count("*").alias("_n"), F.max(F.col("width") * F.col("height")).alias("_area"), *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))))
    return g.where((F.col("_n") >= 8) & ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= 0.03 * F.col("_area"))).drop("_n", "_area")


def separators(lines: DataFrame, pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """``book_id, page, separator_y``: the lowest thin short line of a page with text at or below it."""
    l = lines.join(pages.select(*PAGE, "width", "height"), PAGE)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    l = l.where((h <= 3) & w.between(25.0, 0.8 * F.col("width")) & (F.col("y0") > 0.30 * F.col("height")) & (F.col("y0") < 0.985 * F.col("height")))
    lowest = blocks.groupBy(*PAGE).agg(F.max("y0").alias("_low"))
    y = F.bround("y0", 1)
    return l.select(*PAGE, y.alias("_y")).join(lowest, PAGE).where(F.col("_low") >= F.col("_y") - 3).groupBy(*PAGE).agg(F.max("_y").alias("separator_y"))


def rotate(box: tuple[str, str, str, str], m: tuple[float, ...]):
    """Columns of a box turned by the matrix ``(a, b, c, d, e, f)``, corners in order."""
    x0, y0, x1, y1 = map(F.col, box)
    a, b, c, d, e, f = m
    px = [a * x + c * y + e for x in (x0, x1) for y in (y0, y1)]
    py = [b * x + d * y + f for x in (x0, x1) for y in (y0, y1)]
    return F.least(*px).alias("x0"), F.least(*py).alias("y0"), F.greatest(*px).alias("x1"), F.greatest(*py).alias("y1")


def blocks_from_spans(spans: DataFrame) -> DataFrame:
    """Blocks from ``book_id, page, block_ord, line_ord, span_ord, text, size, font, flags``: lines, mean font
    size by characters, fonts in order, bold if more than half of the characters are. Blocks without text go."""
    key = [*PAGE, "block_ord"]
    n = F.length(F.trim("text"))
    line = spans.groupBy(*key, "line_ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "text"))), lambda s: s["text"]), "").alias("_line"))
    lines = line.where(F.trim("_line") != "").groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "_line"))), lambda s: s["_line"]).alias("lines"))
    style = spans.where(n > 0).groupBy(*key).agg(
        F.bround(F.sum(F.col("size") * n) / F.sum(n), 2).alias("font_size"),
        F.array_sort(F.collect_set("font")).alias("fonts"),
        (F.sum(F.when(F.col("flags").bitwiseAND(16) > 0, n).otherwise(0)) > 0.5 * F.sum(n)).alias("bold"),
    )
    return lines.join(style, key)


def number_steps(blocks: DataFrame) -> DataFrame:
    """``book_id, as_is, reversed``: how often a run of digits is the one before it plus one, read either way,
    in reading order of body and notes."""
    runs = blocks.where("kind IN ('body', 'footnote')").select(
        "book_id", "page", "block_ord", F.posexplode("lines").alias("line_no", "_line")
    ).select("book_id", "page", "block_ord", "line_no", F.posexplode(digit_runs(F.col("_line"))).alias("n", "_v"))
    w = Window.partitionBy("book_id").orderBy("page", "block_ord", "line_no", "n")
    t = runs.select("book_id", *((F.col(f"_v.{c}") == F.lag(f"_v.{c}").over(w) + 1).alias(c) for c in ("as_is", "reversed")))
    return t.groupBy("book_id").agg(F.count_if("as_is").alias("as_is"), F.count_if("reversed").alias("reversed"))


def digits_reversed(blocks: DataFrame) -> DataFrame:
    """``book_id, digits_reversed``: whether a book's numbers come out turned round."""
    return number_steps(blocks).select("book_id", ((F.col("reversed") >= 5) & (F.col("reversed") > 1.3 * F.col("as_is"))).alias("digits_reversed"))


def image_places(images: DataFrame, body: DataFrame) -> DataFrame:
    """Images (``book_id, page, image_ord, y0``) with ``y_ratio``: share of the body's characters above them."""
    chars = F.length(F.regexp_replace(F.array_join("lines", ""), r"(?U)\s+", ""))
    b = body.groupBy(*PAGE).agg(F.collect_list(F.struct(F.col("y1").alias("y1"), chars.alias("n"))).alias("_b"))
    count = lambda keep: F.aggregate(F.filter("_b", keep), F.lit(0), lambda s, x: s + x["n"])
    above = count(lambda x: x["y1"] <= F.col("y0") + 2)
    total = F.greatest(count(lambda x: F.lit(True)), F.lit(1))
    return images.join(b, PAGE, "left").select(*images.columns, F.coalesce(above / total, F.lit(0.0)).alias("y_ratio"))
