"""The test tables without their repeated rows, and page texts made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.normalize import normalize_udf
from quire.sources.tables import table


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_blocks").drop("extracted_at").dropDuplicates(["block_id"])


def pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pdf_pages").dropDuplicates(["book_id", "page"])


def streams(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "streams").dropDuplicates(["book_id", "stream"])
    return s.withColumn("stream", F.col("stream").cast("int"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    """``book_id, stream, norm`` of streams that have one."""
    return streams(spark, d).where("norm_text IS NOT NULL").select("book_id", "stream", F.col("norm_text").alias("norm"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "page_matches").dropDuplicates(["book_id", "stream", "page"])
    return m.withColumn("stream", F.col("stream").cast("int"))


def toc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "toc").dropDuplicates(["book_id", "ord"])


def site_pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_contents").drop("fetched_at").dropDuplicates(["page_id"])


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """``book_id, stream, page, norm`` of all pages: normalised body (0) and notes (1), empty where there are none."""
    kind = F.when(F.col("kind") == "body", 0).when(F.col("kind") == "footnote", 1)
    b = blocks(spark, d).withColumn("stream", kind).where("stream IS NOT NULL")
    t = b.groupBy("book_id", "page", "stream").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "text"))), lambda s: s["text"]), "\n").alias("_t"))
    p = pages(spark, d).select("book_id", "page", F.explode(F.array(F.lit(0), F.lit(1))).alias("stream"))
    return p.join(t, ["book_id", "page", "stream"], "left").select("book_id", "stream", "page", normalize_udf(F.coalesce("_t", F.lit(""))).alias("norm"))
