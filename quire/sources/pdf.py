"""PDF files as tables of spans, where PyMuPDF is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPANS = (
    "book_id string, page int, width double, height double, block_ord int, line_ord int, span_ord int, text string,"
    " size double, font string, flags int, x0 double, y0 double, x1 double, y1 double"
)


def read_spans(spark: SparkSession, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Spans of the pages ``first`` to ``last`` of each PDF file under ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz
        except ImportError as e:
            raise RuntimeError("reading PDF files needs PyMuPDF; tables of spans or blocks can be read without") from e
        for b in batches:
            for name, data in zip(b.path, b.content):
                rows = []
                doc = fitz.open(stream=data, filetype="pdf")
                for n in range(max(1, first), min(len(doc), last or len(doc)) + 1):
                    page = doc[n - 1]
                    for i, block in enumerate(page.get_text("dict")["blocks"]):
                        for j, line in enumerate(block.get("lines", [])):
                            for k, s in enumerate(line["spans"]):
                                rows.append((name, n, page.rect.width, page.rect.height, i, j, k, s["text"], s["size"], s["font"], s["flags"], *block["bbox"]))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", "content").mapInPandas(run, SPANS)


def page_range(total: int, first: int | None, last: int | None) -> tuple[int, int]:
    """An inclusive range inside the file; an empty one is an error."""
    lo, hi = max(1, first or 1), min(total, last or total)
    if lo > hi:
        raise ValueError(f"no pages {first}-{last} in a file of {total}")
    return lo, hi


def decode_glyphs(chars: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Characters (``font, gid, uni, width``) with ``text``: from the font's glyph table (``font, gid, text``); fonts
    without a table keep the character; unknown glyphs without width are nothing, others the replacement sign."""
    fonts = glyphs.select("font", F.lit(True).alias("_known")).distinct()
    t = chars.join(glyphs, ["font", "gid"], "left").join(fonts, "font", "left")
    unknown = F.when(F.col("width") == 0, "").otherwise("�")
    return t.withColumn("text", F.when(F.col("_known").isNull(), F.col("uni")).otherwise(F.coalesce("text", unknown))).drop("_known")


def glyph_texts(order: list[str], chars: dict[str, str], substitutes: list[tuple[tuple[str, ...], str]], widths: dict[str, float], rounds: int = 8) -> dict[int, str]:
    """Text of each glyph of a font by its number: what its character map says, else what the glyphs it stands for
    (``substitutes``: parts and the glyph in their place) have for text, found in at most ``rounds`` passes;
    else nothing if it has no width, else the replacement sign."""
    known = dict(chars)
    for _ in range(rounds):
        new: dict[str, str] = {}
        for parts, glyph in substitutes:
            if glyph not in known and glyph not in new and known.keys() >= set(parts):
                new[glyph] = "".join(map(known.__getitem__, parts))
        if not new:
            break
        known |= new
    return {i: known.get(g, "" if widths.get(g, 1) == 0 else "\ufffd") for i, g in enumerate(order)}


def font_glyphs(data: bytes) -> dict[int, str]:
    """``glyph_texts`` of a font file; needs fontTools."""
    from io import BytesIO

    from fontTools.ttLib import TTFont

    font = TTFont(BytesIO(data), lazy=True)
    chars = {glyph: chr(code) for code, glyph in (font.getBestCmap() or {}).items()}
    rules = []
    for lookup in font["GSUB"].table.LookupList.Lookup if "GSUB" in font and font["GSUB"].table.LookupList else ():
        for table in lookup.SubTable:
            table = getattr(table, "ExtSubTable", table)
            rules += [((a,), b) for a, b in getattr(table, "mapping", {}).items() if isinstance(b, str)]
            rules += [((a, *x.Component), x.LigGlyph) for a, xs in getattr(table, "ligatures", {}).items() for x in xs]
    widths = {g: w for g, (w, _) in font["hmtx"].metrics.items()} if "hmtx" in font else {}
    return glyph_texts(font.getGlyphOrder(), chars, rules, widths)


def decode_stats(decoded: DataFrame) -> DataFrame:
    """``book_id, n, n_empty, n_unknown`` of decoded characters (``book_id, text``)."""
    return decoded.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("text") == "").alias("n_empty"), F.count_if(F.col("text") == "\ufffd").alias("n_unknown"))


def decode_choice(native: DataFrame, glyphs: DataFrame, enough: float = 0.25, better: float = 0.1) -> DataFrame:
    """``book_id, decode`` from hit rates (``book_id, rate``; the best counts) of text as extracted and as decoded from
    glyphs: the latter only where the former is poor and clearly beaten."""
    best = lambda df, name: df.groupBy("book_id").agg(F.max("rate").alias(name))
    t = best(native, "_n").join(best(glyphs, "_g"), "book_id", "left")
    n = F.coalesce("_n", F.lit(0.0))
    return t.select("book_id", F.when((n < enough) & (F.col("_g") > n + better), "glyph").otherwise("native").alias("decode"))


def glyph_lines(chars: DataFrame) -> DataFrame:
    """``book_id, page, line_ord, text`` from placed characters (``book_id, page, x, y, size, text``): a sweep down the
    page gathers characters near the line's median height; lines of mostly Arabic letters run from the right."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("y", kind="stable")
        lines: list[list] = []
        for r in g.itertuples(index=False):
            if lines:
                ys = sorted(c.y for c in lines[-1])
                if abs(r.y - ys[len(ys) // 2]) <= 0.55 * max(r.size, 6):
                    lines[-1].append(r)
                    continue
            lines.append([r])
        out = []
        for line in lines:
            letters = [c.text for c in line if c.text.strip()]
            arabic = sum("؀" <= t[0] <= "ۿ" or "ﭐ" <= t[0] <= "ﻼ" for t in letters)
            rtl = 2 * arabic >= len(letters) > 0
            line.sort(key=lambda c: -c.x if rtl else c.x)
            out.append("".join(c.text for c in line))
        return pd.DataFrame({"book_id": g.book_id.iloc[0], "page": g.page.iloc[0], "line_ord": range(len(out)), "text": out})

    return chars.groupBy("book_id", "page").applyInPandas(run, "book_id string, page int, line_ord int, text string")
