"""Reports on an alignment and checks of its output."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GOOD = ["exact", "fuzzy", "partial"]
PROBLEMS = ["missing", "partial", "interpolated", "unmatched"]


def histogram(m: DataFrame, column: str) -> DataFrame:
    """``book_id, <column>, n``."""
    return m.groupBy("book_id", column).agg(F.count("*").alias("n"))


def mean_scores(m: DataFrame) -> DataFrame:
    """``book_id, mean_score`` over placed pages, four places; 0 for books without one."""
    mean = F.bround(F.avg(F.when(F.col("status").isin(GOOD), F.col("score"))), 4)
    return m.groupBy("book_id").agg(F.coalesce(mean, F.lit(0.0)).alias("mean_score"))


def accepted(m: DataFrame, share: float = 0.3) -> DataFrame:
    """``book_id, text_pages, good_pages, accepted``: books with too few placed pages are refused."""
    text = F.col("pdf_chars") > 0
    g = m.groupBy("book_id").agg(F.count_if(text).alias("text_pages"), F.count_if(text & F.col("status").isin(GOOD)).alias("good_pages"))
    return g.withColumn("accepted", (F.col("text_pages") == 0) | (F.col("good_pages") >= share * F.col("text_pages")))


def problem_pages(m: DataFrame) -> DataFrame:
    return m.where(F.col("status").isin(PROBLEMS) | (F.col("confidence") == "low"))


def last_text_end(m: DataFrame) -> DataFrame:
    """``book_id, stream, last_end``: where the last placed text page ends in normalised text."""
    t = m.where("pdf_chars > 0 AND status <> 'missing'")
    end = F.least("n_e", F.greatest(F.coalesce("end_pos", F.lit(0)), F.least(F.col("n_e"), F.col("boundary") + F.col("pdf_chars"))))
    return t.groupBy("book_id", "stream").agg(F.max_by(end, "page").alias("last_end"))


def report(m: DataFrame, heads: int = 50) -> DataFrame:
    """``book_id, report``: JSON of a book's pages and totals; unresolved notes are listed up to ``heads``."""
    count = lambda c: F.expr(
        f"map_from_entries(array_sort(transform(array_distinct(collect_list({c})), k -> struct(k, size(filter(collect_list({c}), x -> x = k))))))"
    )
    page = F.struct("page", "stream", "status", "confidence", "score", F.col("anchors_hit").alias("anchors"), "pdf_chars", F.slice(F.coalesce("notes", F.expr("cast(array() as array<string>)")), 1, heads).alias("messages"))
    g = m.groupBy("book_id").agg(
        F.count("*").alias("pages_in_all"), count("status").alias("status"), count("confidence").alias("confidence"),
        F.array_sort(F.collect_list(page)).alias("pages"),
    ).join(mean_scores(m), "book_id")
    return g.select("book_id", F.to_json(F.struct("pages_in_all", "mean_score", "status", "confidence", "pages")).alias("report"))


def lost_text(pieces: DataFrame, whole: DataFrame) -> DataFrame:
    """Streams whose pieces, joined in order, are not the whole (white space aside): no rows are expected.

    ``pieces``: ``book_id, stream, page, ord, piece``; ``whole``: ``book_id, stream, text``.
    """
    joined = pieces.groupBy("book_id", "stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "ord", "piece"))), lambda s: s["piece"]), "").alias("_j"))
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return whole.join(joined, ["book_id", "stream"], "left").where(bare("text") != bare(F.coalesce("_j", F.lit("")))).select("book_id", "stream")


def validator_counts(messages: DataFrame) -> DataFrame:
    """Counts from the text output of an EPUB validator (``file, output, returncode``): the line of totals if it
    is there, else what the output and return code tell; valid if it ended well without fatals and errors."""
    total = r"(\d+)\s+fatals\s*/\s*(\d+)\s+errors\s*/\s*(\d+)\s+warnings\s*/\s*(\d+)\s+infos"
    names = ["fatals", "errors", "warnings", "infos"]
    without = {"fatals": F.col("output").contains("FATAL").cast("int"), "errors": (F.col("returncode") != 0).cast("int")}
    value = lambda i, n: F.when(F.col("output").rlike(total), F.regexp_extract("output", total, i).cast("int")).otherwise(without.get(n, F.lit(0)))
    t = messages.select("file", "returncode", "output", *(value(i, n).alias(n) for i, n in enumerate(names, 1)))
    lines = F.filter(F.split("output", "\n"), lambda x: x.rlike(r"ERROR\(|WARNING\(|FATAL\(|Check finished"))
    ok = (F.col("returncode") == 0) & (F.col("fatals") == 0) & (F.col("errors") == 0)
    return t.select("file", *names, lines.alias("messages"), ok.alias("is_valid"))


def text_hit_rate(pages: DataFrame, texts: DataFrame, sample: int = 12, win: int = 10) -> DataFrame:
    """``book_id, stream, hits, probes``: short pieces of each book's richest pages found verbatim in its text.

    The richest ``sample`` pages by characters are a feature of this measure, as are eight pieces a page.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("book_id", "stream").orderBy(F.desc("chars"), "page")
    rich = pages.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= sample) & (F.length("norm") >= 3 * win))
    probes = rich.select("book_id", "stream", F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring("norm", F.floor((F.length("norm") - win) * i / 7).cast("int") + 1, F.lit(win)))).alias("_p"))
    lists = probes.groupBy("book_id", "stream").agg(F.collect_list("_p").alias("_ps"))
    hit = F.expr("size(filter(_ps, p -> instr(norm, p) > 0))")
    return lists.join(texts.select("book_id", "stream", "norm"), ["book_id", "stream"]).select("book_id", "stream", hit.alias("hits"), F.size("_ps").alias("probes"))


def best_order(rates: DataFrame) -> DataFrame:
    """``book_id, stream, mode`` from ``mode, rate``: the best order, the logical one unless clearly worse."""
    g = rates.groupBy("book_id", "stream").agg(
        F.max("rate").alias("_best"), F.max_by("mode", F.struct("rate", (F.col("mode") == "logical").cast("int"))).alias("_mode"),
        F.max(F.when(F.col("mode") == "logical", F.col("rate"))).alias("_logical"),
    )
    plain = (F.col("_logical") >= F.greatest(0.5 * F.col("_best"), F.lit(0.05))) | (F.col("_best") < 0.1)
    return g.select("book_id", "stream", F.when(plain, "logical").otherwise(F.col("_mode")).alias("mode"))
