import os

import pytest

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(D), reason="no test data")


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_packed", "p8_found"])
def test_query_runs(spark, name):
    import __spark_entry__ as e

    columns = {
        "p1_found": {"block_id": "bigint", "line_no": "int"}, "p2_found": {"book_id": "string", "stream": "int", "span_start": "int", "span_end": "int"},
        "p3_found": {"block_id": "bigint", "line_no": "int"}, "p4_found": {"page_id": "bigint", "field": "string", "line_no": "int"},
        "p5_found": {"field": "string", "a_id": "bigint", "b_id": "bigint"}, "p6_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p8_found": {"doc_id": "bigint"},
    }
    df = e.queries()[name](spark, D)
    assert name not in columns or dict(df.dtypes) == columns[name]
    assert df.count() == df.distinct().count()


def test_p5_canonical_has_blocks_of_every_kind(spark):
    import __spark_entry__ as e

    blocks = spark.read.parquet(f"{D}/pdf_blocks.parquet")
    got = e.queries()["p5_canonical"](spark, D).where("field = 'text'").select("id").distinct()
    assert blocks.where("kind IS NULL OR kind <> 'body'").count() > 0
    assert got.exceptAll(blocks.selectExpr("block_id AS id").distinct()).count() == 0
    assert blocks.selectExpr("block_id AS id").distinct().exceptAll(got).count() == 0


def test_p2_streams_has_every_stream(spark):
    import __spark_entry__ as e
    from pyspark.sql import functions as F

    want = spark.read.parquet(f"{D}/streams.parquet").groupBy("book_id", F.col("stream").cast("int").alias("stream")).agg(F.coalesce(F.max(F.length("norm_text")), F.lit(0)).alias("n"))
    got = {r[:2]: r[2:] for r in map(tuple, e.queries()["p2_streams"](spark, D).collect())}
    assert {k: n for k, (n, _) in got.items()} == {(r.book_id, r.stream): r.n for r in want.collect()}
    shared = e.queries()["p2_found"](spark, D).groupBy("book_id", "stream").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    assert {k: m for k, (_, m) in got.items() if m} == {(r.book_id, r.stream): r.n for r in shared.collect()}
