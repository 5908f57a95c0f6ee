import re

import pytest
from pyspark.sql import functions as F

from silkgraph.plans import documented, views
from silkgraph.plans.catalog import ORACLES, QUERIES
from silkgraph.sources import derived, readers, writers

SMALL = "/root/testdata/sf0.001"


def test_site_tables(spark, tmp_path):
    rows = [("http://www.a-b.example/1", "x"), ("http://c.example/1", "y")]
    pages = spark.createDataFrame(rows, "url string, html string")
    writers.write_site_tables({"pages": pages}, str(tmp_path))
    writers.write_site_tables({"pages": pages.limit(1).withColumn("html", F.lit("new"))}, str(tmp_path))
    got = readers.scan_pages(spark, f"{tmp_path}/pages")
    assert {(r.site, r.html) for r in got.collect()} == {("a_b_example", "new"), ("c_example", "y")}
    plan = got.filter("site = 'c_example'").select("url")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(site" in plan and "ReadSchema: struct<url:string>" in plan


def test_bucket_tables(spark, tmp_path):
    rows = [(f"http://s{i}.example/{k}", "x") for i in range(9) for k in range(3)]
    writers.write_bucket_tables({"pages": spark.createDataFrame(rows, "url string, html string")}, str(tmp_path), buckets=4)
    got = spark.read.parquet(f"{tmp_path}/pages")
    assert {r.url for r in got.collect()} == {u for u, _ in rows}
    assert got.filter(writers.bucket_of(F.col("site"), 4) != F.col("bucket")).count() == 0


def test_raw_folders(spark, tmp_path):
    (tmp_path / "h.example.txt").write_text("User-agent: *\nDisallow: /a\n")
    (tmp_path / "m.xml").write_text("<urlset><url><loc>u</loc></url></urlset>")
    assert readers.scan_robots_folder(spark, str(tmp_path / "*.txt")).first()["domain"] == "h.example"
    row = readers.scan_sitemap_folder(spark, str(tmp_path / "*.xml")).first()
    assert row.url.endswith("/m.xml") and row.status == 200 and row.content.startswith("<urlset>")


def test_registered_views_answer_sql(spark):
    urls = spark.createDataFrame([("u", "html", "internal"), ("x", "html", "external")], "url string, kind string, classification string")
    items = spark.createDataFrame([("u", "Product", "json-ld", 0, True, [], "r", "p"), ("x", "Product", "rdfa", 0, True, [], "r", "p")],
                                  "url string, type string, format string, position int, is_valid boolean, validation_errors array<string>, raw_data string, parsed_data string")
    names = views.register_views({"urls": urls, "schema_items": items})
    assert names == ["schema_analysis", "schema_items", "urls"]
    sql = re.sub(r"[{}]", "", documented.SCHEMA_COUNTS)
    assert [tuple(r) for r in spark.sql(sql).collect()] == [("Product", "json-ld", 1)]


def test_self_hreflang_slash_rule(spark):
    rows = [("http://h/a", "fr", "http://h/a/"), ("http://h/a", "de", "http://h/a"), ("http://h/a", "x-default", "http://h/a"), ("http://h/b/", "en", "http://h/b"), ("http://h/c", "en", "http://h/c//")]
    df = spark.createDataFrame(rows, "url string, lang string, href_url string")
    assert {tuple(r) for r in views.self_hreflang(df).collect()} == {("http://h/a", "de"), ("http://h/b/", "en")}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


ITERATIVE = {"sitemap_closure", "sitemap_listing", "sitemap_statistics", "redirect_resolve", "redirect_records", "redirect_report", "crawl_reachability", "crawl_depth"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE))
def test_no_cartesian_product(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["page_overview", "page_content", "extract_links", "structured_data", "robots_directives", "canonicals", "link_counts"])
def test_page_work_needs_no_keyed_shuffle(spark, name):
    assert "hashpartitioning" not in plan_of(QUERIES[name](spark, SMALL))


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["html_lang"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,html:string>" in plan
    log = derived.fetch_log(spark, SMALL).filter("seq > 10").select("url")
    assert "PushedFilters: [IsNotNull(event_id), GreaterThan(event_id,10)]" in plan_of(log)


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", ["link_counts", "internal_links", "indexability", "inlink_counts", "canonicals", "internal_links_analysis"])
def test_no_body_in_any_exchange(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    for line, below in zip(plan.splitlines(), plan.splitlines()[1:] + [""]):
        if "Exchange" in line:
            assert "html#" not in line and "html#" not in below


def test_bodies_of_single_keys_stay_where_they_are(spark):
    from silkgraph.operators.state import newest, newest_bodies

    rows = [(k % 7 if k < 20 else k, k, f"<p>{k}</p>") for k in range(40)] + [(None, 1, "a"), (None, 2, "b"), (5, 5, "<p>5</p>")]
    df = spark.createDataFrame(rows, "url long, seq long, html string")
    assert sorted(map(tuple, newest_bodies(df, ["url"], ["seq"]).collect()), key=str) == sorted(map(tuple, newest(df, ["url"], ["seq"]).collect()), key=str)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["url", "classification", "title", "html_lang", "h1", "word_count", "links"]
    assert rows.count() == 50 and set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
