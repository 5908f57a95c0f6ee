"""Storage by site."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silkgraph.functions.urls import site_key
from silkgraph.operators.state import newest, newest_bodies
from silkgraph.sources.readers import PAGES  # noqa: F401  (the layout written here)


def with_site(df: DataFrame, url: str = "url") -> DataFrame:
    return df if "site" in df.columns else df.withColumn("site", site_key(df[url]))


def write_bucket_tables(tables: dict[str, DataFrame], root: str, buckets: int = 1024, mode: str = "overwrite") -> None:
    """Write every table to ``root/<name>/bucket=<n>/``, a bucket being a hash of the site, rows clustered by
    site inside: the form for a web crawl of very many sites. Only the buckets present are replaced.
    A filter on ``bucket_of(site)`` prunes folders, one on ``site`` prunes row groups by their statistics."""
    for name, df in tables.items():
        placed = with_site(df)
        (
            placed.withColumn("bucket", bucket_of(placed["site"], buckets))
            .hint("rebalance", "bucket", "site")
            .sortWithinPartitions("bucket", "site")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(f"{root}/{name}")
        )


def bucket_of(site: Column, buckets: int = 1024) -> Column:
    return F.pmod(F.crc32(site.cast("binary")), F.lit(buckets)).cast("int")


def write_site_tables(tables: dict[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Write every table to ``root/<name>/site=<site>/``; only the sites present are replaced. One folder per
    site suits up to some thousands of sites; for more see ``write_bucket_tables``.

    The rebalance hint lets AQE merge small sites into few files and split a site that holds a
    large part of the rows, so neither thousands of tiny files nor one huge task come up.
    """
    for name, df in tables.items():
        (
            with_site(df)
            .hint("rebalance", "site")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("site")
            .parquet(f"{root}/{name}")
        )


class BucketStore:
    """A table of one row per key that takes new rows by copy on write.

    Rows lie in hash buckets of their site, under ``root/rows/<version>/bucket=<n>``. A manifest says which
    version of each bucket counts: ``root/manifests/<number>``, a JSON object of one entry per bucket. ``upsert`` reads
    the buckets that the new rows fall into, and no others, writes them anew under a new version, and then makes
    the next manifest. That file is written aside and renamed to its number only if that is free, which is the commit: a
    writer that dies before leaves files that no manifest names, and of two writers one fails. Readers see the last
    manifest, and what they have opened stays.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "url", order: tuple[str, ...] = ("fetched_at", "seq"), buckets: int = 1024):
        self.spark, self.root, self.key, self.order, self.buckets = spark, root.rstrip("/"), key, order, buckets
        self._paths = spark._jvm.org.apache.hadoop.fs
        self._files = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._paths.Path(f"{self.root}/{name}" if name else self.root)

    def manifest(self) -> tuple[int, dict[int, str]]:
        """Number of the last manifest (0: none) and the version of each bucket; bounded by the number of buckets."""
        folder = self._path("manifests")
        if not self._files.exists(folder):
            return 0, {}
        number = max((int(f.getPath().getName()) for f in self._files.listStatus(folder) if f.getPath().getName().isdigit()), default=0)
        if not number:
            return 0, {}
        text = self.spark.read.text(f"{self.root}/manifests/{number}", wholetext=True).first()[0]
        return number, {int(k): v for k, v in json.loads(text).items()}

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as the last manifest has it, or some of its buckets; None if there is nothing."""
        return self._rows(self.manifest()[1], buckets)

    def _rows(self, versions: dict[int, str], buckets: list[int] | None) -> DataFrame | None:
        paths = [f"{self.root}/rows/{v}/bucket={b}" for b, v in sorted(versions.items()) if buckets is None or b in buckets]
        return self.spark.read.option("mergeSchema", True).parquet(*paths) if paths else None

    def upsert(self, rows: DataFrame) -> list[int]:
        """Take the rows over, the newest of each key by ``order`` wins on every column; the buckets written."""
        placed = with_site(rows).withColumn("bucket", bucket_of(F.col("site"), self.buckets))
        touched = sorted(r[0] for r in placed.select("bucket").distinct().collect())
        if not touched:
            return []
        number, versions = self.manifest()
        old = self._rows(versions, touched)
        whole = placed.drop("bucket") if old is None else placed.drop("bucket").unionByName(old, allowMissingColumns=True)
        fold = newest_bodies if "html" in whole.columns else newest
        settled = fold(whole, [self.key], list(self.order)).withColumn("bucket", bucket_of(F.col("site"), self.buckets))
        version = uuid.uuid4().hex
        settled.hint("rebalance", "bucket", "site").sortWithinPartitions("bucket", "site").write.partitionBy("bucket").parquet(f"{self.root}/rows/{version}")
        self._commit(number + 1, {**versions, **{b: version for b in touched}})
        return touched

    def _commit(self, number: int, versions: dict[int, str]) -> None:
        aside, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{number}")
        out = self._files.create(aside)
        try:
            out.write(bytearray(json.dumps(versions).encode()))
        finally:
            out.close()
        context = self._paths.FileContext.getFileContext(place.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self._paths, "Options$Rename"), 0)
        context.rename(aside, place, none)  # fails if the number is taken
