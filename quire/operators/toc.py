"""Tables of contents from paths: sections in order of first sight, trees, targets, reading order.

Each reads its input once (windows, no self-joins): one builds on the other, and an input read twice would
double the plan of all that comes before it. Entries dealt by ``book_id`` are not moved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sections(toc: DataFrame, mode: str = "part") -> DataFrame:
    """Entries (``book_id, ord, path``) with ``group_no`` (from 1, in order of first sight of the first path
    element; rows of one group need not be neighbours), ``page_no`` in it and the file name. ``page`` mode
    makes each entry a file of its own. Entries without a path are in a group of their own name, empty."""
    first = F.coalesce(F.get("path", F.lit(0)), F.lit(""))
    t = toc.where("book_id IS NOT NULL").withColumn("section", first)
    t = t.withColumn("_first", F.min("ord").over(Window.partitionBy("book_id", "section")))
    t = t.withColumn("group_no", F.dense_rank().over(Window.partitionBy("book_id").orderBy("_first", "section"))).drop("_first")
    t = t.withColumn("page_no", F.row_number().over(Window.partitionBy("book_id", "section").orderBy("ord")))
    name = F.format_string("chap_%03d.xhtml", "group_no") if mode == "part" else F.format_string("chap_%03d_%03d.xhtml", "group_no", "page_no")
    return t.withColumn("href", name)


def _prefixes(c: str):
    """A path's beginnings, from the first element alone to all of it."""
    return F.transform(F.sequence(F.lit(1), F.size(c)), lambda n: F.slice(c, F.lit(1), n))


def tree(entries: DataFrame) -> DataFrame:
    """Nodes of the trees of ``book_id, ord, path, href``: ``book_id, path, title, depth, preorder, href``.

    A node's target is that of the last entry with its very path; siblings stand in order of first sight.
    """
    rows = entries.where((F.size("path") > 0) & F.col("book_id").isNotNull()).select("book_id", "ord", "href", F.col("path").alias("_full"), F.posexplode(_prefixes("path")).alias("_d", "path"))
    rows = rows.withColumn("_first", F.min("ord").over(Window.partitionBy("book_id", "path")))
    # a node's place: the first sights of its ancestors and itself; an entry has them for all nodes on its path
    steps = rows.groupBy("book_id", "ord", "href", "_full").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.col("_d").alias("d"), F.col("_first").alias("o")))), lambda s: s["o"]).alias("_keys"))
    steps = steps.select("book_id", "ord", "href", "_full", "_keys", F.posexplode(_prefixes("_full")).alias("_d", "path"))
    own = F.when(F.col("path") == F.col("_full"), F.struct("ord", "href"))
    nodes = steps.groupBy("book_id", "path").agg(F.max(own)["href"].alias("href"), F.min(F.slice("_keys", F.lit(1), F.col("_d") + 1)).alias("_key"))
    w = Window.partitionBy("book_id").orderBy("_key", F.size("path"), "path")
    return nodes.select("book_id", "path", F.element_at("path", -1).alias("title"), F.size("path").alias("depth"), F.row_number().over(w).alias("preorder"), "href")


def first_targets(nodes: DataFrame) -> DataFrame:
    """Nodes with ``first_href``: their own target or that of the first descendant that has one."""
    up = nodes.withColumn("_up", F.explode(_prefixes("path")))
    best = F.min(F.when(F.col("href").isNotNull(), F.struct("preorder", "href"))).over(Window.partitionBy("book_id", "_up"))
    return up.withColumn("first_href", best["href"]).where(F.col("_up") == F.col("path")).drop("_up")


def play_order(nodes: DataFrame) -> DataFrame:
    """Nodes with ``play_order``: equal targets share a number, numbers follow first sight."""
    t = nodes.where("first_href IS NOT NULL").withColumn("_p", F.min("preorder").over(Window.partitionBy("book_id", "first_href")))
    return t.withColumn("play_order", F.dense_rank().over(Window.partitionBy("book_id").orderBy("_p"))).drop("_p")


def escape(c):
    """Text for XHTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def navigation(nodes: DataFrame) -> DataFrame:
    """``book_id, nav``: nested lists of the tree (``preorder, depth, title, first_href``), written in order:
    a step down opens a list, steps up close as many."""
    w = Window.partitionBy("book_id").orderBy("preorder")
    before, after = F.lag("depth", 1, 0).over(w), F.lead("depth", 1, 0).over(w)
    link = F.when(F.col("first_href").isNotNull(), F.concat(F.lit('<a href="'), escape(F.col("first_href")), F.lit('">'), escape(F.col("title")), F.lit("</a>"))).otherwise(
        F.concat(F.lit("<span>"), escape(F.col("title")), F.lit("</span>"))
    )
    opens = F.when(F.col("depth") > before, "<ol>").otherwise("")
    closes = F.when(after > F.col("depth"), "").otherwise(F.concat(F.lit("</li>"), F.repeat(F.lit("</ol></li>"), (F.col("depth") - F.greatest(after, F.lit(1))).cast("int")), F.when(after == 0, "</ol>").otherwise("")))
    t = nodes.select("book_id", "preorder", F.concat(opens, F.lit("<li>"), link, closes).alias("_x"))
    return t.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "_x"))), lambda s: s["_x"]), "").alias("nav"))


def ncx_points(nodes: DataFrame) -> DataFrame:
    """``book_id, ncx``: navigation points of ``play_order``'s rows, one inside the other as the tree has them."""
    x = F.format_string('<navPoint id="np-%d" playOrder="%d"><navLabel><text>%s</text></navLabel><content src="%s"/>', "preorder", "play_order", escape(F.col("title")), escape(F.col("first_href")))
    after = F.lead("depth", 1, 1).over(Window.partitionBy("book_id").orderBy("preorder"))
    closes = F.repeat(F.lit("</navPoint>"), F.greatest(F.col("depth") - after + 1, F.lit(0)).cast("int"))
    t = nodes.select("book_id", "preorder", F.concat(x, closes).alias("x"))
    return t.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("preorder", "x"))), lambda s: s["x"]), "").alias("ncx"))
