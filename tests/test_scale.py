"""Work is dealt over the cores whatever the files of its input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from silkgraph.llm import url_filter
from silkgraph.plans import catalog_storage
from silkgraph.plans.catalog import QUERIES
from silkgraph.plans.catalog_storage import as_stream, in_files
from silkgraph.sources import captures, derived as d


def part_table(spark, folder, rows):
    """``part`` as one file with one row group; the key of the last row stands twice, and once as NULL."""
    keys = spark.range(1, rows + 1).select("id").unionByName(spark.createDataFrame([(rows,), (None,)], "id bigint"))
    keys.select(F.col("id").alias("p_partkey"), F.concat(F.lit("name "), "id").alias("p_name"), F.lit("Brand#1").alias("p_brand")).coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_pages_of_one_small_file_are_read_by_all_cores(spark, tmp_path):
    sf = part_table(spark, tmp_path, 500)
    dealt = d.part_pages(spark, sf).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(dealt) >= spark.sparkContext.defaultParallelism
    assert sum(r["count"] for r in dealt) == 502
    assert max(r["count"] for r in dealt) < 60


@pytest.mark.parametrize("name", [
    "q_schema_invalid", "q_schema_valid", "register_views", "schema_analysis", "schema_statistics", "json_ld_type", "json_ld_items", "rdfa_items", "microdata_properties",
])
def test_items_of_one_small_file_are_made_by_all_cores(spark, tmp_path, name):
    plan = QUERIES[name](spark, part_table(spark, tmp_path, 9))._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("MapInArrow"):]
    dealt = re.search(r"RoundRobinPartitioning\((\d+)\)", below[: below.index("FileScan")])
    assert dealt and int(dealt[1]) >= spark.sparkContext.defaultParallelism


def test_fetch_results_of_a_batch_are_files_for_all_cores(spark, tmp_path, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    rows = 3 * cores * catalog_storage.PAGES_PER_FILE
    url = F.concat(F.lit("https://a.example.com/en/"), F.col("id") % (rows - 1))  # one page is fetched twice
    spark.range(rows).select(F.col("id").alias("page_id"), url.alias("url"), F.lit("<html><head></head><body></body></html>").alias("html")).coalesce(1).write.parquet(
        str(tmp_path / "pages.parquet")
    )
    seen = []

    class Enough(Exception):
        pass

    def noted(session, path, files_per_trigger):
        seen.append((path, files_per_trigger))
        raise Enough

    monkeypatch.setattr(catalog_storage.readers, "stream_fetch_log", noted)
    with pytest.raises(Enough):
        catalog_storage.ingested(spark, str(tmp_path))
    source, files = seen[0]
    assert files == cores
    written = spark.read.parquet(source).select("url", F.input_file_name().alias("file")).collect()
    assert len(written) == rows and len({r["file"] for r in written}) > 2 * cores
    twice = [r["file"] for r in written if r["url"].endswith("/0")]
    assert len(twice) == 2 and len(set(twice)) == 1


def test_view_over_items_keeps_repeated_pages(spark, tmp_path):
    sf = part_table(spark, tmp_path, 9)
    rows = QUERIES["schema_analysis"](spark, sf).collect()
    own = [r for r in rows if r["url"].endswith("/9") and r["format"] == "rdfa"]
    assert len(own) == 2 and not [r for r in rows if r["url"].endswith("/8")]


def test_batches_of_a_stream_are_files_for_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(2 * 2000 * cores).withColumn("half", F.col("id") % 2)
    source, files = in_files(spark, rows, "half", 2)
    assert files == cores
    assert len(spark.read.parquet(source).inputFiles()) == 2 * cores
    seen = []

    def note(batch, _):
        seen.append((batch.count(), [r[0] for r in batch.select("half").distinct().collect()]))

    as_stream(spark, rows, source, files).writeStream.foreachBatch(note).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [(2000 * cores, [0]), (2000 * cores, [1])]


def test_a_small_or_missing_batch_is_one_file(spark):
    source, files = in_files(spark, spark.range(5000), "CASE WHEN id < 3 THEN 1 WHEN id > 9 THEN 0 END", 3)
    assert files == 1 and spark.read.parquet(source).count() == 4993 and len(spark.read.parquet(source).inputFiles()) == 3


def test_small_ranges_of_large_files_stay_bounded_in_number():
    files = [(0, "a", 1 << 30), (0, "b", 5)]
    found = captures.ranges(files, 20_000)
    assert len(found) <= captures.TASKS + len(files)
    assert all(a.end == b.start for a, b in zip(found, found[1:]) if a.path == b.path)
    assert (found[0].start, found[-2].end, found[-1].end) == (0, 1 << 30, 5)
    assert len(captures.ranges([(0, "a", 100_000)], 20_000)) == 5


def test_url_models_learn_from_all_labelled_urls(spark, monkeypatch):
    seen = []
    learn = url_filter.weights
    monkeypatch.setattr(url_filter, "weights", lambda urls: seen.append(urls.count()) or learn(urls))
    urls = spark.range(8000).select(F.concat(F.lit("http://a.com/"), "id").alias("url"))
    urls = urls.unionByName(spark.range(50).select(F.concat(F.lit("http://b.net/es/"), "id").alias("url")))
    url_filter.filter_urls(urls).count()
    assert seen[0] > 8050 / 2
