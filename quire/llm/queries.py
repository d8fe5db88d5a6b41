"""The queries of this package, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import encodings, lookalikes, packing, page_wrappers, repeated_lines, shared_spans, spam_shapes, tokenize
from quire.sources.tables import table


def p1_restored(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "pdf_blocks")
    return encodings.garbled_lines(blocks, encodings.train(blocks))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_restored(spark, d).select("block_id", "line_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "streams").select("book_id", F.col("stream").cast("int").alias("stream"), "norm_text")
    return shared_spans.shared_spans(s, ["book_id", "stream"], "norm_text")


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_by_page(p2_found(spark, d), table(spark, d, "page_matches"))


def p2_streams(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_by_stream(p2_found(spark, d), table(spark, d, "streams"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.find_repeated_lines(table(spark, d, "pdf_blocks"))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(table(spark, d, "pdf_blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return page_wrappers.page_furniture(table(spark, d, "page_contents"))


def p4_wrappers(spark: SparkSession, d: str) -> DataFrame:
    return page_wrappers.infer_wrappers(table(spark, d, "page_contents"))


def p4_own(spark: SparkSession, d: str) -> DataFrame:
    return page_wrappers.own_text(table(spark, d, "page_contents"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    body = table(spark, d, "pdf_blocks").where("kind = 'body'")  # the pairs asked for are of body blocks
    return lookalikes.lookalike_pairs(lookalikes.text_fields(body, table(spark, d, "streams")))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_classes(lookalikes.text_fields(table(spark, d, "pdf_blocks"), table(spark, d, "streams")))


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    rows = lookalikes.text_fields(table(spark, d, "pdf_blocks"), table(spark, d, "streams"))
    return rows.select("field", "id", lookalikes.canonical_udf()("text").alias("text"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_documents(table(spark, d, "documents"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, d), table(spark, d, "pack_specs"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam_shapes.spam_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_shares(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_pages, p2_streams, p3_found, p3_clean, p4_found, p4_wrappers, p4_own, p5_found, p5_classes, p5_canonical, p6_ids, p7_packed, p7_report, p8_found, p8_shares)}
