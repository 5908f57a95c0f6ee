"""Readers of captured crawl data, in batch and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

FETCH_LOG = (
    "url string, status int, final_url string, headers map<string,string>, text string, "
    "redirect_chain array<struct<url:string,status:int,headers:map<string,string>>>, "
    "fetched_at timestamp, seq bigint"
)
PAGES = (
    "site string, url string, final_url string, status int, fetched_at timestamp, "
    "headers map<string,string>, html string"
)
ROBOTS_TXT = ("domain string, status int, content string")
SITEMAP_FILES = ("url string, status int, content string")


def scan_fetch_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fetch results: status, final URL, headers, text, redirect chain."""
    return spark.read.schema(FETCH_LOG).format(fmt).load(path)


def stream_fetch_log(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """The same schema as a stream over the files of a folder."""
    reader = spark.readStream.schema(FETCH_LOG).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def scan_pages(spark: SparkSession, path: str, fmt: str = "parquet", partitions: int | None = None) -> DataFrame:
    """Stored pages; a filter on ``site`` prunes folders. ``partitions`` spreads few large files over
    that many tasks, at the price of moving the bodies once; off by default."""
    rows = spark.read.schema(PAGES).format(fmt).load(path)
    return rows.repartition(partitions) if partitions else rows


def scan_sitemaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured sitemap files as a table (url, status, content)."""
    return spark.read.schema(SITEMAP_FILES).format(fmt).load(path)


def scan_robots(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured robots files as a table (domain, status, content)."""
    return spark.read.schema(ROBOTS_TXT).format(fmt).load(path)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")
    )


def scan_sitemap_folder(spark: SparkSession, path: str) -> DataFrame:
    """Raw XML files, gzipped ones included, as (url, status, content), the file location standing for the URL.

    A file is one row: the sitemap protocol bounds it at 50 MB, and an entry that is no XML would take the rest of
    the file with it in a reader of XML rows. Folders of many files spread over the tasks by themselves.
    """
    return _whole_files(spark, path).select(
        F.col("file").alias("url"), F.lit(200).alias("status"), "content"
    )


def scan_robots_folder(spark: SparkSession, path: str) -> DataFrame:
    """Raw files named ``<domain>.txt`` as (domain, status, content)."""
    return _whole_files(spark, path).select(
        F.regexp_extract("file", r"([^/]+)\.txt\z", 1).alias("domain"),
        F.lit(200).alias("status"),
        "content",
    )


def pages_from_log(log: DataFrame, hold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """HTML fetch results as page rows, keys in storage form, one per URL (the newest). ``hold``: as of ``newest_bodies``."""
    from silkgraph.functions.http import header, headers_normalize, is_retryable
    from silkgraph.functions.urls import site_key, url_kind, url_normalize_storage
    from silkgraph.operators.state import newest_bodies

    target = url_normalize_storage(F.coalesce("final_url", "url"))
    rows = log.filter(~is_retryable(F.col("status"))).select(
        site_key(F.col("url")).alias("site"),
        url_normalize_storage(F.col("url")).alias("url"),
        target.alias("final_url"),
        url_kind(header(F.col("headers"), "content-type"), target).alias("kind"),
        "status", "fetched_at", "seq",
        headers_normalize(F.col("headers")).alias("headers"),
        header(F.col("headers"), "x-robots-tag").alias("x_robots_tag"),
        F.col("text").alias("html"),
    )
    # the body is asked first: the kind of a URL costs far more
    html = rows.filter((F.coalesce("html", F.lit("")) != "") & (F.col("kind") == "html"))
    return newest_bodies(html, ["url"], ["fetched_at", "seq"], hold)
