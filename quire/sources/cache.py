"""A crawler's cache as tables: pages named by the hash of their URL, images with a file of their type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.urls import cache_key, image_extension, safe_filename

_KEY = r"([0-9a-f]{64})\.[a-z]+$"


def cached_pages(spark: SparkSession, folder: str) -> DataFrame:
    """``key, html`` of the ``.html`` files of a folder, read as UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(folder)
    return files.select(F.regexp_extract("path", _KEY, 1).alias("key"), F.decode("content", "UTF-8").alias("html")).where("key <> ''")


def cached_images(spark: SparkSession, folder: str) -> DataFrame:
    """``key, data, mime, extension``: a hit needs the bytes and the type; parameters of the type go."""
    data = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select(F.regexp_extract("path", _KEY, 1).alias("key"), F.col("content").alias("data"))
    mime = spark.read.format("binaryFile").option("pathGlobFilter", "*.mime").load(folder).select(F.regexp_extract("path", _KEY, 1).alias("key"), F.trim(F.split(F.decode("content", "UTF-8"), ";")[0]).alias("mime"))
    return data.join(mime, "key").withColumn("extension", image_extension(F.col("mime")))


def with_cache(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """URLs with the cached page, or null where it would have to be fetched."""
    return urls.withColumn("key", cache_key(F.col("url"))).join(cache, "key", "left")


def image_names(images: DataFrame) -> DataFrame:
    """Images (``book_id, ord, url``) with ``name``: number by first sight in the book, and a safe short name."""
    from pyspark.sql import Window

    seen = images.groupBy("book_id", "url").agg(F.min("ord").alias("ord"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("ord"))
    base = F.regexp_replace(F.regexp_extract("url", r"([^/?#]*)(?:[?#].*)?$", 1), r"\.[^.]*$", "")
    return seen.withColumn("name", F.concat(F.format_string("img_%03d_", n), safe_filename(base, 25, "image")))


def write_cache(pages: DataFrame, path: str) -> None:
    """Keep fetched pages (``url, html``) as Parquet by key."""
    pages.select(cache_key(F.col("url")).alias("key"), "html").dropDuplicates(["key"]).write.mode("append").parquet(path)
