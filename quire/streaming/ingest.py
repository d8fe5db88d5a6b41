"""Streams of new cache files: normalised pages and counts by host as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.normalize import normalize_udf
from quire.functions.urls import cache_key

PAGES = T.StructType([T.StructField(n, t) for n, t in (("page_id", T.LongType()), ("host", T.StringType()), ("url", T.StringType()), ("body", T.StringType()), ("fetched_at", T.TimestampType()))])


def new_pages(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Pages of Parquet files as they appear in a folder, with their cache key and normalised text."""
    s = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", per_trigger).parquet(folder)
    return s.select("page_id", "host", cache_key(F.col("url")).alias("key"), normalize_udf("body").alias("norm"), "fetched_at")


def pages_per_hour(pages: DataFrame, late: str = "1 day") -> DataFrame:
    """``host, hour, n``: pages by host and hour of fetching; repeated pages inside the watermark count once."""
    once = pages.withWatermark("fetched_at", late).dropDuplicatesWithinWatermark(["page_id"])
    return once.groupBy("host", F.window("fetched_at", "1 hour").alias("hour")).agg(F.count("*").alias("n")).select("host", "hour.start", "n")
