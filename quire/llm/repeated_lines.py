"""Lines repeated across the pages of one source.

Each line's pages are a compressed bitmap: of its words of 64 pages only those that are not empty.
Variants of a line (spacing, digits, letter forms) share a key; their words are united by ``bit_or``, which
combines on the map side, and exact cardinalities decide which bitmaps are put together and kept. A line is
deleted if its page's bit is set in the kept bitmap of its key. Lines are keyed once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.digests import digest
from quire.functions.normalize import TABLE
from quire.session import checkpoint

_NO_DIGITS = str.maketrans("", "", "0123456789")


def line_key(line: str) -> str:
    """Matching normalisation with all digits dropped."""
    return line.translate(TABLE).translate(_NO_DIGITS)


@F.pandas_udf(T.BinaryType())
def line_key_digest(s: pd.Series) -> pd.Series:
    """Digest of the key; null for null and for lines with nothing left."""
    seen: dict[str, bytes | None] = {}
    out = []
    for x in s:
        if x is None:
            out.append(None)
            continue
        if x not in seen:
            seen[x] = digest(k) if (k := line_key(x)) else None
        out.append(seen[x])
    return pd.Series(out, dtype=object)


def keyed_lines(blocks: DataFrame) -> DataFrame:
    """A row per line that has a key: block_id, book_id, page, line_no (from 0), key."""
    lines = blocks.select("block_id", "book_id", "page", F.posexplode("lines").alias("line_no", "_line"))
    return lines.select("block_id", "book_id", "page", "line_no", line_key_digest("_line").alias("key")).where(
        "key IS NOT NULL"
    )


def page_bitmaps(lines: DataFrame, min_pages: int = 8) -> DataFrame:
    """``book_id, key, bitmap, n_pages`` of the keys on at least ``min_pages`` pages of their book: ``bitmap`` maps a
    word's number (page div 64) to its 64 bits, in the union of all variants."""
    words = (
        lines.where("page IS NOT NULL AND book_id IS NOT NULL")
        .groupBy("book_id", "key", F.expr("shiftright(page, 6)").alias("chunk"))
        .agg(F.expr("bit_or(shiftleft(1L, pmod(page, 64)))").alias("word"))
    )
    n_pages = F.aggregate("_w", F.lit(0), lambda n, w: n + F.bit_count(w["word"]))
    return (
        words.groupBy("book_id", "key").agg(F.collect_list(F.struct("chunk", "word")).alias("_w"))
        .withColumn("n_pages", n_pages).where(F.col("n_pages") >= min_pages)
        .select("book_id", "key", F.map_from_entries("_w").alias("bitmap"), "n_pages")
    )


def in_bitmap(bitmap: Column, page: Column) -> Column:
    """Whether a page's bit is set; true for a null page, which no bit stands for."""
    word = F.coalesce(F.try_element_at(bitmap, F.shiftright(page, 6)), F.lit(0).cast("long"))
    return page.isNull() | (F.getbit(word, F.pmod(page, F.lit(64))) == 1)


def find_repeated_lines(blocks: DataFrame, min_pages: int = 8) -> DataFrame:
    """``block_id, line_no`` of each line that recurs on ``min_pages`` pages of its book.

    Null lines arrays, null lines and lines without letters are no cases. Rows without a page count
    for no page, but are cases if their line recurs. Repeated rows count once.
    """
    lines = checkpoint(keyed_lines(blocks))
    kept = page_bitmaps(lines, min_pages).select("book_id", "key", "bitmap")
    found = lines.join(kept, ["book_id", "key"]).where(in_bitmap(F.col("bitmap"), F.col("page")))
    return found.select("block_id", "line_no").distinct()


def remove_repeated_lines(blocks: DataFrame, min_pages: int = 8) -> DataFrame:
    """``block_id, text, n_removed``: each block's text from the lines that stay.

    A null ``lines`` gives a null text and 0; a block of nothing but repeated lines an empty text.
    Null lines within a block stay out of the text. Repeated rows give one row.
    """
    found = (
        find_repeated_lines(blocks, min_pages)
        .groupBy("block_id")
        .agg(F.collect_set("line_no").alias("_drop"))
    )
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("_drop", i), F.lit(False)))
    return (
        blocks.select("block_id", "lines")
        .distinct()
        .join(found, "block_id", "left")
        .select(
            "block_id",
            F.array_join(kept, "\n").alias("text"),
            F.coalesce(F.size("_drop"), F.lit(0)).alias("n_removed"),
        )
    )
