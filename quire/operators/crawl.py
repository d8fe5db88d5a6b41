"""The order in which the pages of a book are reached from its table of contents and next-links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import checkpoint


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by ``order``: dedup that keeps first sight."""
    rest = [c for c in rows.columns if c not in keys]
    g = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return g.select(*keys, "_r.*").select(*rows.columns)


def frontier(seeds: DataFrame, links: DataFrame, max_pages: int = 3000, max_levels: int = 10_000) -> DataFrame:
    """``book_id, url, level, place`` of the pages reached: seeds (``book_id, ord, url``) are level 0, then the
    targets of ``links`` (``book_id, url, next_url``) not seen before, level by level, until a level is empty.

    Each level is one anti-join of the whole set of books with what was seen, which is kept as a few written
    parts: a new level is merged with an older part only once it has half its size, so a row is written a
    number of times that grows with the logarithm of the rows. More than ``max_levels`` are an error. ``max_pages``
    is the crawl's page limit per book, a feature: pages beyond it are not visited.
    """
    level = first_seen(seeds.select("book_id", "url", "ord"), ["book_id", "url"], "ord").select("book_id", "url", F.lit(0).alias("level"), F.col("ord").alias("rank"))
    level = checkpoint(level)
    parts = [(level, level.count())]
    for n in range(1, max_levels + 2):
        nxt = level.join(links, ["book_id", "url"]).where("next_url IS NOT NULL").groupBy("book_id", F.col("next_url").alias("url")).agg(F.min("rank").alias("rank"))
        for part, _ in parts:
            nxt = nxt.join(part.select("book_id", "url"), ["book_id", "url"], "left_anti")
        level = checkpoint(nxt.select("book_id", "url", F.lit(n).alias("level"), "rank"))
        rows = level.count()
        if not rows:
            break
        if n > max_levels:
            raise RuntimeError(f"pages are reached beyond {max_levels} levels")
        parts.append((level, rows))
        while len(parts) > 1 and 2 * parts[-1][1] >= parts[-2][1]:
            (late, k), (early, m) = parts.pop(), parts.pop()
            parts.append((checkpoint(early.unionByName(late)), k + m))
    done = parts[0][0]
    for part, _ in parts[1:]:
        done = done.unionByName(part)
    w = Window.partitionBy("book_id").orderBy("level", "rank", "url")
    return done.select("book_id", "url", "level", F.row_number().over(w).alias("place")).where(F.col("place") <= max_pages)


def failed_pages(pages: DataFrame) -> DataFrame:
    """``book_id, url, title, error`` of pages without a body: they are set aside, the rest goes on."""
    return pages.where("body IS NULL OR trim(body) = ''").select("book_id", "url", "title", F.when(F.col("body").isNull(), "no body").otherwise("empty body").alias("error")).distinct()


def books_without_pages(books: DataFrame, toc: DataFrame) -> DataFrame:
    """``book_id, error`` of books whose table of contents has no entry."""
    return books.select("book_id").distinct().join(toc.select("book_id"), "book_id", "left_anti").withColumn("error", F.lit("no entries"))
