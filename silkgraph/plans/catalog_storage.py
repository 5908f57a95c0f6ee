"""Queries that go through storage, registered views and drained streams."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import functions as F

from silkgraph.functions import http
from silkgraph.functions.urls import host
from silkgraph.operators import robots, sitemaps, state
from silkgraph.operators.scale import row_ranks, shared_folder, stored
from silkgraph.plans import documented, views
from silkgraph.plans.catalog_html import ALL_ITEMS
from silkgraph.plans.catalog_state import FAILED, NOW_SQL, RECORDS, resolved_table
from silkgraph.plans.registry import long, query, stamp, stamp_sql
from silkgraph.sources import captures, derived as d, readers, writers
from silkgraph.sources.derived import oracle
from silkgraph.streaming import jobs


def folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def page_rows(spark, sf):
    """The given pages with all stored columns."""
    return d.pages(spark, sf).select(
        "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("fetched_at"),
        F.create_map(F.lit("server"), F.lit("nginx")).alias("headers"), "html",
    )


SITES = r"regexp_replace(regexp_replace(domain, '^www\.', ''), '[^a-z0-9_]', '_', 'g') AS site"


@query("write_site_tables", oracle("page_urls", f"SELECT {SITES}, url, final_url, 200 AS status, html FROM (SELECT *, url AS final_url FROM page_urls)"))
def write_site_tables(spark, sf):
    root = folder(spark)
    writers.write_site_tables({"pages": page_rows(spark, sf)}, root)
    return readers.scan_pages(spark, f"{root}/pages").select("site", "url", "final_url", long("status").alias("status"), "html")


@query("write_bucket_tables", oracle("page_urls", f"SELECT {SITES}, url, html FROM page_urls"))
def write_bucket_tables(spark, sf):
    root = folder(spark)
    writers.write_bucket_tables({"pages": page_rows(spark, sf)}, root, buckets=16)
    return spark.read.parquet(f"{root}/pages").select("site", "url", "html")


# The second batch: the sites of every eleventh host length, one minute later, with another body.
SECOND = "length(domain) % 11 = 3"


@query("upsert_pages_stored", oracle("page_urls", f"""SELECT url, CASE WHEN {SECOND} THEN 304 ELSE 200 END AS status, CASE WHEN {SECOND} THEN '<p>' || page_id || '</p>' ELSE html END AS html,
        {SECOND} AS replaced FROM page_urls"""))
def upsert_pages_stored(spark, sf):
    """Pages in a bucket store, some of which a second batch replaces; ``replaced``: by the versions of their buckets."""
    rows = page_rows(spark, sf).withColumn("seq", F.lit(0))
    store = writers.BucketStore(spark, folder(spark), buckets=4096)
    store.upsert(rows)
    first = store.manifest()[1]
    again = d.pages(spark, sf).filter(F.length(host(F.col("url"))) % 11 == 3).select("url", F.concat(F.lit("<p>"), "page_id", F.lit("</p>")).alias("html"))
    later = rows.drop("html", "status").join(again, "url").withColumns({
        "status": F.lit(304), "fetched_at": F.timestamp_seconds(F.unix_timestamp("fetched_at") + 60), "seq": F.lit(1),
    })
    store.upsert(later.select(*rows.columns))
    changed = [b for b, version in store.manifest()[1].items() if first.get(b) != version]
    own = writers.bucket_of(F.col("site"), 4096).isin(changed)
    return store.read().select("url", long("status").alias("status"), "html", own.alias("replaced"))


def fetch_results(spark, sf):
    """The page variants as fetch results, in the layout of the captured log."""
    return d.keyed_variants(spark, sf).select(
        "url", F.lit(200).alias("status"), F.col("url").alias("final_url"),
        F.map_concat("headers", F.create_map(F.lit("Content-Type"), F.lit("text/html"))).alias("headers"), F.col("html").alias("text"),
        F.array(F.struct("url", F.lit(200).alias("status"), "headers")).alias("redirect_chain"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("fetched_at"), F.col("page_id").alias("seq"),
    )


@query("scan_fetch_log_stored", oracle("page_urls", "SELECT key_url AS url, 200 AS status, page_id AS seq, 1 AS requests FROM page_urls"))
def scan_fetch_log_stored(spark, sf):
    root = folder(spark)
    fetch_results(spark, sf).write.parquet(root)
    return readers.scan_fetch_log(spark, root).select("url", long("status").alias("status"), "seq", long(F.size("redirect_chain")).alias("requests"))


@query(
    "scan_robots_stored",
    oracle("page_urls hosts robots_txt", r"""SELECT domain, CASE form WHEN 0 THEN E'User-agent: *\nDisallow:\nSitemap: https://' || domain || E'/sitemap_index.xml\n'
        WHEN 1 THEN E'User-agent: *\r\nDisallow: /en/\r\n' WHEN 2 THEN E'User-agent: *\nAllow: /en/6*\nDisallow: /en/\nSitemap: https://' || domain || E'/sitemap_index.xml\n'
        ELSE E'# notes\nUser-agent: examplebot\nDisallow: /fr/\n\nUSER-AGENT : *\nCrawl-delay: 3\nDisallow: /es/\nAllow: /es/5\nSitemap: https://' || domain || E'/sitemap_index.xml\n' END AS content
        FROM robots_txt WHERE status = 200"""),
)
def scan_robots_stored(spark, sf):
    root = folder(spark)
    d.robots_txt(spark, sf).write.parquet(root)
    return robots.robots_files(readers.scan_robots(spark, root)).select("domain", "content")


@query("scan_sitemap_folder", oracle("page_urls hosts all_urls sitemap_rows", """SELECT md5(sitemap_url) AS name, position, url AS loc, CASE WHEN twice THEN 'fr ' || url || '/'
        WHEN even THEN 'en ' || url || '|x-default https://' || domain || '/' ELSE '' END AS alternates FROM sitemap_rows"""))
def scan_sitemap_folder(spark, sf):
    """Entries of sitemap files written to a folder, half of them gzipped, and read back through the reader."""
    root = folder(spark)
    files = sitemaps.sitemap_files(d.sitemap_files(spark, sf)).select(F.md5("url").alias("name"), "content")
    for packed in ("none", "gzip"):
        half = files.filter((F.col("name") < "8") == (packed == "gzip"))
        half.write.mode("append").partitionBy("name").option("compression", packed).text(root)
    read = readers.scan_sitemap_folder(spark, root)
    entries = sitemaps.sitemap_entries(read).withColumn("name", F.regexp_extract("sitemap_url", "name=([0-9a-f]+)/", 1))
    alternates = F.array_join(F.array_sort(F.transform("alternates", lambda a: F.concat_ws(" ", a["lang"], a["href_url"]))), "|")
    return entries.select("name", long("position").alias("position"), "loc", alternates.alias("alternates"))


@query("register_views", oracle("part_keys", ALL_ITEMS + "SELECT type AS schema_type, format, count(*) AS count FROM items JOIN part_keys USING (url) WHERE k % 3 <> 2 GROUP BY type, format"))
def register_views(spark, sf):
    """A documented question as plain SQL over the registered views."""
    from silkgraph.operators.structured import structured_data

    k = F.regexp_extract("url", r"(\d+)\z", 1).cast("bigint")
    urls = d.part_pages(spark, sf).select("url", F.when(k % 3 == 2, "external").otherwise("internal").alias("classification"))
    views.register_views({"schema_items": structured_data(d.part_pages(spark, sf)), "urls": urls})
    return spark.sql(re.sub(r"[{}]", "", documented.SCHEMA_COUNTS))


@query(
    "seed_urls_all",
    """WITH own AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || '/' AS seed, split_part(url, '#', 1) AS key FROM pages)
       SELECT site, url, 0 AS depth, 'queued' AS status FROM (SELECT site, seed AS url FROM own UNION SELECT site, key FROM own)""",
)
def seed_urls_all(spark, sf):
    pages = d.pages(spark, sf).select("page_id", "url", host(F.col("url")).alias("site"))
    origin = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    listing = row_ranks(
        pages.select("site", F.substring_index("url", "#", 1).alias("url"), "page_id"), [F.col("page_id")], ["site"], "sitemap_position"
    )
    seeds = pages.select("site", F.concat(F.upper(origin), F.lit("/#start")).alias("url")).distinct()
    return state.seed_urls(seeds, listing).select("site", "url", long("depth").alias("depth"), "status")


@query(
    "frontier_mark_finished",
    oracle("fetch_log frontier_events", f"""SELECT url, CASE WHEN bool_or(op = 'done') THEN 'done' ELSE 'queued' END AS status,
        {stamp_sql("CASE WHEN bool_or(op = 'done') THEN TIMESTAMP '2030-01-01' ELSE arg_min(at_time, seq) FILTER (WHERE op = 'enqueue') END")} AS updated_at
        FROM frontier_events GROUP BY url HAVING bool_or(op = 'enqueue')"""),
)
def frontier_mark_finished(spark, sf):
    events = d.frontier_events(spark, sf)
    frontier = state.frontier_state(events.filter("op = 'enqueue'"))
    marked = state.frontier_mark_done(frontier, events.filter("op = 'done'"), F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return marked.select("url", "status", stamp("updated_at").alias("updated_at"))


def captured(spark, sf):
    """A folder with the pages as archived responses, in a file for every core, three at least."""
    root = folder(spark)
    files = max(3, spark.sparkContext.defaultParallelism)
    captures.write_captures(page_rows(spark, sf).withColumnRenamed("html", "text").repartition(files, "url"), root)
    captures.register_captures(spark)
    return root


@query(
    "scan_captures",
    f"""SELECT url, 200 AS status, md5(html) AS digest, 'nginx' AS server, {stamp_sql('make_timestamp((1700000000 + page_id) * 1000000)')} AS fetched_at FROM pages""",
)
def scan_captures(spark, sf):
    """Archived responses read back, each file by many tasks."""
    rows = spark.read.format("captures").option("rangeBytes", 20_000).load(captured(spark, sf))
    utc = F.date_format(F.to_utc_timestamp("fetched_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return rows.select("url", long("status").alias("status"), F.md5("text").alias("digest"), http.header(F.col("headers"), "server").alias("server"), utc.alias("fetched_at"))


@query("stream_captures", "SELECT split_part(url, '#', 1) AS url, arg_max(md5(html), page_id) AS digest FROM pages GROUP BY 1")
def stream_captures(spark, sf):
    """The archived responses as a stream, drained through the ingest; the pages that it stored."""
    root = folder(spark)
    log = spark.readStream.format("captures").option("rangeBytes", 50_000).load(captured(spark, sf))
    log = log.withColumn("headers", F.map_concat("headers", F.create_map(F.lit("Content-Type"), F.lit("text/html"))))
    jobs.stream_ingest(log, f"{root}/tables", f"{root}/state").awaitTermination()
    return jobs.current_table(spark, f"{root}/tables", "pages", ["url"]).select("url", F.md5("html").alias("digest"))


#: Pages of a file of the fetch results at least.
PAGES_PER_FILE = 50


def ingested(spark, sf):
    """The folder of the tables that the ingest stream fills from the fetch results, in three batches."""
    source, root = folder(spark), folder(spark)
    # a batch has a file for every core, and all fetches of a page stand in one file
    files = max(1, min(spark.sparkContext.defaultParallelism, d.pages(spark, sf).count() // PAGES_PER_FILE // 3))
    fetch_results(spark, sf).repartition(3 * files, "url").write.parquet(source)
    log = readers.stream_fetch_log(spark, source, files_per_trigger=files)
    jobs.stream_ingest(log, f"{root}/tables", f"{root}/state").awaitTermination()
    return f"{root}/tables"


@query("stream_ingest_content", oracle("stored_urls page_fields", "SELECT key_url AS url, title, meta_description, h1 FROM page_fields"))
def stream_ingest_content(spark, sf):
    """Page fields drained through the ingest stream, those of the newest fetch of a page."""
    rows = jobs.of_newest_pages(spark, ingested(spark, sf), "content")
    return rows.select("url", "title", "meta_description", F.array_join("h1_tags", "|").alias("h1"))


@query(
    "stream_ingest_directives",
    oracle("stored_urls page_fields", """SELECT key_url AS url, 'html_meta' AS source, unnest(string_split(meta_robots, '|')) AS directive FROM page_fields WHERE meta_robots <> ''
        UNION ALL SELECT key_url, 'http_header', unnest(string_split(header_robots, '|')) FROM page_fields WHERE header_robots <> ''"""),
)
def stream_ingest_directives(spark, sf):
    return jobs.of_newest_pages(spark, ingested(spark, sf), "directives").select("url", "source", "directive")


@query("stream_ingest_canonicals", oracle("stored_urls page_fields", "SELECT key_url AS url, canonical_url, 'html_head' AS source FROM page_fields WHERE canonical_url IS NOT NULL"))
def stream_ingest_canonicals(spark, sf):
    return jobs.of_newest_pages(spark, ingested(spark, sf), "canonicals").select("url", "canonical_url", "source")


@query("stream_ingest_urls", oracle("page_urls", f"""SELECT key_url AS url, 'html' AS kind, 'internal' AS classification,
        {stamp_sql('make_timestamp((1700000000 + min(page_id)) * 1000000)')} AS first_seen, {stamp_sql('make_timestamp((1700000000 + max(page_id)) * 1000000)')} AS last_seen
        FROM page_urls GROUP BY key_url"""))
def stream_ingest_urls(spark, sf):
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = jobs.current_urls(spark, ingested(spark, sf))
    return rows.select("url", "kind", "classification", utc("first_seen").alias("first_seen"), utc("last_seen").alias("last_seen"))


@query("stream_ingest_failures", oracle("fetch_log", FAILED + f"""SELECT url, status_code, retry_count, {stamp_sql('next_retry_at')} AS next_retry_at FROM failed"""))
def stream_ingest_failures(spark, sf):
    """Failed URLs from the outcomes that the ingest stream stored, in four batches out of order."""
    log, root = d.fetch_log(spark, sf), folder(spark)
    none = F.lit(None)
    full = log.select(
        "url", "status", none.cast("string").alias("final_url"), none.cast("map<string,string>").alias("headers"), none.cast("string").alias("text"),
        none.cast("array<struct<url:string,status:int,headers:map<string,string>>>").alias("redirect_chain"), "fetched_at", "seq",
    )
    source, files = in_files(spark, full, "seq % 4", 4)
    jobs.stream_ingest(readers.stream_fetch_log(spark, source, files_per_trigger=files), f"{root}/tables", f"{root}/state").awaitTermination()
    failed = jobs.current_failures(spark, f"{root}/tables")
    return failed.select("url", long("status_code").alias("status_code"), "retry_count", stamp("next_retry_at").alias("next_retry_at"))


@query("stream_ingest_redirects", oracle("redirect_responses", RECORDS, recursive=True))
def stream_ingest_redirects(spark, sf):
    """Redirect chains of captured fetches, drained through the ingest stream."""
    chains, root = resolved_table(spark, sf), folder(spark)
    fetched = chains.select(
        "url", "status", "final_url", F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("text"), "redirect_chain",
        F.timestamp_seconds(F.lit(1_700_000_000)).alias("fetched_at"), F.crc32(F.col("url").cast("binary")).alias("seq"),
    )
    source, files = in_files(spark, fetched, "seq % 2", 2)
    jobs.stream_ingest(readers.stream_fetch_log(spark, source, files_per_trigger=files), f"{root}/tables", f"{root}/state").awaitTermination()
    rows = jobs.current_table(spark, f"{root}/tables", "redirects", ["source_url"])
    return rows.select("source_url", "target_url", long("chain_length").alias("chain_length"), long("final_status").alias("final_status"))


@query("stream_ingest_links", oracle("stored_urls nav_links variant_links", """SELECT source_url, u.key_url AS target_url, anchor_text, xpath, href
        FROM variant_links LEFT JOIN page_urls u ON u.key_url = href WHERE variant_links.classification = 'internal'"""))
def stream_ingest_links(spark, sf):
    """Fetch results drained through the ingest stream; links read back over all batches."""
    return jobs.current_links(spark, ingested(spark, sf)).select("source_url", "target_url", "anchor_text", "xpath", "href")


#: Rows of a file of a batch at least, so that none of the files of a batch stays empty.
ROWS_PER_FILE = 1000


def in_files(spark, rows, part, parts):
    """A folder with the rows as ``parts`` batches, written one after the other by the number ``part``, an SQL expression,
    and the number of files of each batch: one for every core, fewer if a batch is small."""
    source = folder(spark)
    kept = stored(rows.withColumn("_part", F.expr(part)), "stream-rows")
    sizes = {r["_part"]: r["count"] for r in kept.groupBy("_part").count().collect()}
    cores = spark.sparkContext.defaultParallelism
    files = max(1, min(cores, min(sizes.get(i, 0) for i in range(parts)) // ROWS_PER_FILE))
    for i in range(parts):
        batch = kept.filter(F.col("_part") == i).drop("_part")
        (batch.repartition(files) if files > 1 else batch.coalesce(1)).write.mode("append").parquet(source)
    return source, files


def as_stream(spark, rows, source, files=1):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source)


def drained(spark, rows, build, mode, part="0", parts=1):
    """``rows`` written as files, read as a stream one file at a time, and what ``build`` makes of it, written batch by batch."""
    root = folder(spark)
    stream = build(as_stream(spark, rows, *in_files(spark, rows, part, parts)))

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={batch_id}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/rows")


@query("stream_url_dedupe", oracle("fetch_log", "SELECT DISTINCT url FROM fetch_log"))
def stream_url_dedupe(spark, sf):
    """First sight of every URL, from a log that comes in four batches; a URL is remembered for 60 days, which bounds the state."""
    build = lambda log: jobs.stream_url_dedupe(log, "60 days")
    return drained(spark, d.fetch_log(spark, sf), build, "append", "seq % 4", 4).select("url")


#: The log in four slices of time; each slice comes as a file, in no order, and some rows come a slice later.
SLICE = "least(3, (dayofmonth(fetched_at) - 1) div 8)"
#: A row of the last hour of a day comes with the next day's; a watermark of two hours waits for it.
LATER = "CASE WHEN seq % 5 = 0 AND hour(fetched_at) = 23 THEN least(3, dayofmonth(fetched_at) div 8) ELSE {} END"


@query(
    "stream_retry_state",
    oracle("fetch_log", FAILED + f"""SELECT url, status_code, CASE status_code WHEN 0 THEN 'Connection/timeout error' ELSE 'Server error 503' END AS failure_reason,
        retry_count, {stamp_sql('last_retry_at')} AS last_retry_at, {stamp_sql('next_retry_at')} AS next_retry_at, {stamp_sql('created_at')} AS created_at,
        next_retry_at > (SELECT max(fetched_at) - INTERVAL 2 HOUR FROM fetch_log) AS waiting FROM failed"""),
)
def stream_retry_state(spark, sf):
    """Retry bookkeeping of a log that comes in four unordered batches, read from the state and the timers of the ended stream."""
    return retry_tables(spark, sf)


@query(
    "stream_retry_ready",
    oracle("fetch_log", FAILED + f"SELECT url, {stamp_sql('next_retry_at')} AS next_retry_at, retry_count FROM failed WHERE next_retry_at <= {NOW_SQL} AND retry_count < 3"),
)
def stream_retry_ready(spark, sf):
    """The retries that are due, by the timers of the ended stream: those whose timer the watermark has passed."""
    return retry_tables(spark, sf).filter("not waiting and retry_count < 3").select("url", "next_retry_at", "retry_count")


def retry_tables(spark, sf):
    log, checkpoint = d.fetch_log(spark, sf), folder(spark)
    source, files = in_files(spark, log.sortWithinPartitions(F.xxhash64("seq")), LATER.format(SLICE), 4)
    with rocksdb(spark):
        stream = jobs.stream_retry_state(as_stream(spark, log, source, files), watermark="2 hours")
        query = stream.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = jobs.retry_state_of(spark, checkpoint).withColumn("status_code", long("status_code"))
    for name in ("last_retry_at", "next_retry_at", "created_at"):
        state = state.withColumn(name, stamp(name))
    return state


@contextlib.contextmanager
def rocksdb(spark):
    """The state store that transformWithState needs, for the stream started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


LATE = "seq % 13 = 0 AND dayofmonth(fetched_at) < 20"


@query(
    "stream_status_appended",
    oracle("fetch_log", f""", first AS (SELECT max(fetched_at) AS at FROM fetch_log WHERE dayofmonth(fetched_at) <= 15 AND NOT ({LATE})),
        rows AS (SELECT *, time_bucket(INTERVAL '10 minutes', fetched_at) AS w, {LATE} AND time_bucket(INTERVAL '10 minutes', fetched_at) + INTERVAL 10 MINUTE <= first.at - INTERVAL 1 DAY AS dropped
                 FROM fetch_log, first),
        closed AS (SELECT max(fetched_at) - INTERVAL 1 DAY AS at FROM fetch_log)
        SELECT {stamp_sql('w')} AS window_start, CASE WHEN status = 0 THEN '0' ELSE (status // 100) || 'xx' END AS status_class, count(*) AS fetches
        FROM rows, closed WHERE NOT dropped AND w + INTERVAL 10 MINUTE <= closed.at GROUP BY 1, 2
        UNION ALL SELECT NULL, 'dropped', count(*) FROM rows WHERE dropped"""),
)
def stream_status_appended(spark, sf):
    """Final windows of a log in three batches, the third late, and how many outcomes came too late for their window."""
    log = d.fetch_log(spark, sf)
    part = f"CASE WHEN {LATE} THEN 2 WHEN dayofmonth(fetched_at) <= 15 THEN 0 ELSE 1 END"
    root = folder(spark)
    windows, dropped, _ = jobs.drain_status_counts(as_stream(spark, log, *in_files(spark, log, part, 3)), f"{root}/windows", f"{root}/state")
    count = spark.range(1).select(F.lit(None).cast("string").alias("window_start"), F.lit("dropped").alias("status_class"), F.lit(dropped).cast("bigint").alias("fetches"))
    return windows.withColumn("window_start", stamp("window_start")).unionByName(count)


@query(
    "stream_status_windows",
    oracle("fetch_log", f"""SELECT {stamp_sql("time_bucket(INTERVAL '10 minutes', fetched_at)")} AS window_start,
        CASE WHEN status = 0 THEN '0' ELSE (status // 100) || 'xx' END AS status_class, count(*) AS fetches FROM fetch_log GROUP BY 1, 2"""),
)
def stream_status_windows(spark, sf):
    """The same windows as the batch query, from a drained stream."""
    counts = drained(spark, d.fetch_log(spark, sf), jobs.status_counts, "complete")
    return counts.withColumn("window_start", stamp("window_start"))
