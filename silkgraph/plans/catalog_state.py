"""Queries over crawl state: pages, URL registry, frontier, retries, redirects, reach, ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkgraph.functions import http
from silkgraph.operators import dictionary, links, reach, redirects, retry, state
from silkgraph.plans.registry import long, query, stamp, stamp_sql
from silkgraph.sources import derived as d
from silkgraph.sources.derived import oracle
from silkgraph.streaming.jobs import status_counts

NOW = "2024-01-20 12:00:00"


#: The moment of the retry questions: some time before the last fetch, so that some retries are due and some are not.
NOW_SQL = "(SELECT max(fetched_at) - INTERVAL 2 HOUR FROM fetch_log)"


def now(spark, sf):
    return d.fetch_log(spark, sf).agg(F.max("fetched_at") - F.expr("INTERVAL 2 HOURS")).scalar()


@query("scan_fetch_log", oracle("fetch_log", f"SELECT url, status, {stamp_sql('fetched_at')} AS fetched_at, seq FROM fetch_log"))
def scan_fetch_log(spark, sf):
    return d.fetch_log(spark, sf).select("url", long("status").alias("status"), stamp("fetched_at").alias("fetched_at"), "seq")


@query("scan_pages", "SELECT page_id, url, length(html) AS chars, md5(html) AS digest FROM pages")
def scan_pages(spark, sf):
    return d.pages(spark, sf).select(
        "page_id", "url", long(F.length("html")).alias("chars"), F.md5("html").alias("digest")
    )


@query(
    "upsert_pages",
    oracle("fetch_log", f"""SELECT url, status, {stamp_sql('fetched_at')} AS fetched_at, seq FROM fetch_log
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) = 1"""),
)
def upsert_pages(spark, sf):
    return state.upsert_pages(d.fetch_log(spark, sf)).select(
        "url", long("status").alias("status"), stamp("fetched_at").alias("fetched_at"), "seq"
    )


@query(
    "seed_urls",
    oracle("page_urls site_urls", """SELECT domain AS site, url, 0 AS depth, 'queued' AS status FROM (
        SELECT domain, origin || '/' AS url FROM page_urls UNION
        SELECT domain, key_url FROM page_urls QUALIFY dense_rank() OVER (PARTITION BY domain ORDER BY page_id) <= 3)"""),
)
def seed_urls(spark, sf):
    from silkgraph.functions.urls import host
    from silkgraph.operators.scale import row_ranks

    pages = d.pages(spark, sf).select("page_id", "url", host(F.col("url")).alias("site"))
    origin = F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)
    listing = row_ranks(
        pages.select("site", F.substring_index("url", "#", 1).alias("url"), "page_id"),
        [F.col("page_id")], ["site"], "sitemap_position",
    )
    seeds = pages.select("site", F.concat(F.upper(origin), F.lit("/#start")).alias("url")).distinct()
    return state.seed_urls(seeds, listing, max_pages=3).select("site", "url", long("depth").alias("depth"), "status")


FRONTIER = """, firsts AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n FROM frontier_events WHERE op = 'enqueue'),
  last_done AS (SELECT url, max(seq) AS seq, max(at_time) AS at_time FROM frontier_events WHERE op = 'done' GROUP BY url),
  frontier AS (SELECT f.url, f.depth, f.parent, CASE WHEN l.seq > f.seq THEN 'done' ELSE 'queued' END AS status,
               f.at_time AS enqueued_at, CASE WHEN l.seq > f.seq THEN l.at_time ELSE f.at_time END AS updated_at
               FROM firsts f LEFT JOIN last_done l USING (url) WHERE n = 1)"""
EVENTS = "fetch_log frontier_events"


def frontier_table(spark, sf):
    return state.frontier_state(d.frontier_events(spark, sf))


@query("frontier_enqueue", oracle(EVENTS, FRONTIER + "SELECT url, depth, parent FROM frontier"))
def frontier_enqueue(spark, sf):
    enqueued = d.frontier_events(spark, sf).filter("op = 'enqueue'")
    return state.frontier_enqueue(enqueued).select("url", long("depth").alias("depth"), "parent")


@query(
    "frontier_mark_done",
    oracle(EVENTS, FRONTIER + f"SELECT url, status, {stamp_sql('updated_at')} AS updated_at FROM frontier"),
)
def frontier_mark_done(spark, sf):
    return frontier_table(spark, sf).select("url", "status", stamp("updated_at").alias("updated_at"))


@query(
    "frontier_next_batch",
    oracle(EVENTS, FRONTIER + "SELECT url, depth, parent FROM frontier WHERE status = 'queued' ORDER BY enqueued_at, url LIMIT 20"),
)
def frontier_next_batch(spark, sf):
    return state.frontier_next_batch(frontier_table(spark, sf), 20).select("url", long("depth").alias("depth"), "parent")


@query(
    "frontier_stats",
    oracle(EVENTS, FRONTIER + "SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'done') AS done FROM frontier"),
)
def frontier_stats(spark, sf):
    return state.frontier_stats(frontier_table(spark, sf))


@query(
    "url_get_or_create",
    oracle("page_urls nav_links site_urls", """SELECT DISTINCT origin || href AS url, 'external' AS classification FROM nav_links
        WHERE origin || href NOT IN (SELECT url FROM site_urls)"""),
)
def url_get_or_create(spark, sf):
    found = links.extract_links(d.pages(spark, sf)).select(F.col("target_url").alias("url"))
    new = state.url_get_or_create(found, d.site_urls(spark, sf), F.lit("example.edu"))
    return new.select("url", "classification")


@query(
    "url_upsert",
    oracle("fetch_log url_observations", f""", last AS (SELECT * FROM url_observations WHERE op = 'upsert'
          QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1),
        made AS (SELECT * FROM url_observations QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
        found AS (SELECT * FROM url_observations WHERE discovered_from IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1),
        listed AS (SELECT DISTINCT url FROM url_observations WHERE classification = 'network')
        SELECT made.url, last.kind, CASE WHEN coalesce(last.classification, made.classification) = 'external' AND made.url IN (FROM listed)
                 THEN 'network' ELSE coalesce(last.classification, made.classification) END AS classification,
               found.discovered_from, {stamp_sql('made.seen_at')} AS first_seen, {stamp_sql('coalesce(last.seen_at, made.seen_at)')} AS last_seen
        FROM made LEFT JOIN last USING (url) LEFT JOIN found USING (url)"""),
)
def url_upsert(spark, sf):
    folded = state.url_upsert(d.url_observations(spark, sf))
    return folded.withColumn("first_seen", stamp("first_seen")).withColumn("last_seen", stamp("last_seen"))


@query(
    "url_discovery_log",
    oracle("page_urls nav_links", """SELECT url, 'html' AS kind, origin || '/' AS discovered_from, 'upsert' AS op FROM page_urls
        UNION ALL SELECT origin || href, CASE WHEN n % 2 = 0 THEN NULL ELSE 'other' END, CASE WHEN n % 2 = 0 THEN NULL ELSE url END,
               CASE WHEN n % 2 = 0 THEN 'touch' ELSE 'upsert' END FROM nav_links"""),
)
def url_discovery_log(spark, sf):
    pages = d.pages(spark, sf)
    found = links.extract_links(pages).select(
        "source_url", "target_url", F.col("link_no").alias("ord"), (F.col("link_no") % 2 == 0).alias("crawlable")
    )
    processed = pages.select(
        "url", F.lit("html").alias("kind"),
        F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), F.lit("/")).alias("parent"),
        F.lit(NOW).cast("timestamp").alias("fetched_at"),
    )
    log = state.url_discovery_log(processed, found, F.lit("https://start.example.com/"), F.lit("example.com"))
    return log.select("url", "kind", "discovered_from", "op")


@query(
    "url_lookup",
    "SELECT page_id, split_part(url, '#', 1) AS url FROM pages",
)
def url_lookup(spark, sf):
    pages = d.pages(spark, sf).select("page_id", F.substring_index("url", "#", 1).alias("key"))
    ids = dictionary.encode_dictionary(pages, "key")
    coded = dictionary.with_ids(pages, "key", ids, "url_id").select("page_id", "url_id")
    return state.url_lookup(coded, ids).select("page_id", "url")


# --- retries ---------------------------------------------------------------------------------

RETRYABLE = "(status = 0 OR status BETWEEN 500 AND 599 OR status IN (408, 420, 423, 429, 451))"


@query("is_retryable", "SELECT c_custkey, c_custkey % 650 AS status, " + RETRYABLE.replace("status", "c_custkey % 650") + " AS retryable FROM customer")
def is_retryable(spark, sf):
    customers = d.table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 650).alias("status"))
    return customers.withColumn("retryable", http.is_retryable(F.col("status")))


@query(
    "failure_reason",
    """SELECT status, CASE status WHEN 0 THEN 'Connection/timeout error' WHEN 408 THEN 'Request timeout (server slow)'
         WHEN 420 THEN 'Rate limited (Twitter)' WHEN 423 THEN 'Resource temporarily locked' WHEN 429 THEN 'Rate limited'
         WHEN 451 THEN 'Unavailable for legal reasons (geo-blocking?)'
         ELSE CASE WHEN status // 100 = 5 THEN 'Server error ' ELSE 'HTTP ' END || status END AS reason, count(*) AS n
       FROM (SELECT c_custkey % 650 AS status FROM customer) GROUP BY status""",
)
def failure_reason(spark, sf):
    customers = d.table(spark, sf, "customer").select((F.col("c_custkey") % 650).alias("status"))
    counted = customers.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("status", http.failure_reason(F.col("status")).alias("reason"), "n")


FAILED = """, runs AS (SELECT *, sum(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS run,
                max(CASE WHEN status = 200 THEN 1 ELSE 0 END) OVER (PARTITION BY url) AS any_ok FROM fetch_log),
  ends AS (SELECT url, max(run) AS run FROM runs GROUP BY url),
  tail AS (SELECT runs.* FROM runs JOIN ends USING (url, run) WHERE status IN (0, 503)),
  failed AS (SELECT url, arg_max(status, seq) AS status_code, count(*) - 1 AS retry_count,
                    date_trunc('second', max(fetched_at)) AS last_retry_at, date_trunc('second', min(fetched_at)) AS created_at,
                    date_trunc('second', max(fetched_at)) + to_seconds(CAST(pow(2, count(*) - 1) AS BIGINT)) AS next_retry_at
             FROM tail GROUP BY url)"""


def failed_table(spark, sf):
    return retry.retry_state(d.fetch_log(spark, sf))


@query(
    "retry_state",
    oracle("fetch_log", FAILED + f"""SELECT url, status_code, CASE status_code WHEN 0 THEN 'Connection/timeout error' ELSE 'Server error 503' END AS failure_reason,
        retry_count, {stamp_sql('last_retry_at')} AS last_retry_at, {stamp_sql('next_retry_at')} AS next_retry_at, {stamp_sql('created_at')} AS created_at FROM failed"""),
)
def retry_state(spark, sf):
    failed = failed_table(spark, sf).withColumn("status_code", long("status_code"))
    for name in ("last_retry_at", "next_retry_at", "created_at"):
        failed = failed.withColumn(name, stamp(name))
    return failed


@query(
    "retry_ready",
    oracle("fetch_log", FAILED + f"SELECT url, {stamp_sql('next_retry_at')} AS next_retry_at, retry_count FROM failed WHERE next_retry_at <= {NOW_SQL} AND retry_count < 3"),
)
def retry_ready(spark, sf):
    return retry.retry_ready(failed_table(spark, sf), now(spark, sf)).withColumn("next_retry_at", stamp("next_retry_at"))


@query(
    "retry_statistics",
    oracle("fetch_log", FAILED + f"""SELECT CASE WHEN grouping(status_code) = 0 THEN 'status_code' WHEN grouping(retry_count) = 0 THEN 'retry_count' ELSE 'total' END AS level,
        CAST(coalesce(status_code, retry_count) AS VARCHAR) AS value, count(*) AS failed, count(*) FILTER (WHERE next_retry_at <= {NOW_SQL}) AS ready
        FROM failed GROUP BY GROUPING SETS ((status_code), (retry_count), ())"""),
)
def retry_statistics(spark, sf):
    stats = retry.retry_statistics(failed_table(spark, sf), now(spark, sf))
    value = F.coalesce(F.col("status_code").cast("string"), F.col("retry_count").cast("string"))
    return stats.select("level", value.alias("value"), "failed", "ready")


@query(
    "stream_status_counts",
    oracle("fetch_log", f"""SELECT {stamp_sql("time_bucket(INTERVAL '10 minutes', fetched_at)")} AS window_start,
        CASE WHEN status = 0 THEN '0' ELSE (status // 100) || 'xx' END AS status_class, count(*) AS fetches FROM fetch_log GROUP BY 1, 2"""),
)
def stream_status_counts(spark, sf):
    return status_counts(d.fetch_log(spark, sf)).withColumn("window_start", stamp("window_start"))


# --- redirects -------------------------------------------------------------------------------

CHAINS = """, chain(k, at_key, steps, trail) AS (
    SELECT k, k, 1, url || '|' || status || '|' || header FROM redirect_responses
    UNION ALL SELECT c.k, r.ahead, steps + 1, trail || ' > ' || n.url || '|' || n.status || '|' || n.header
    FROM chain c JOIN redirect_responses r ON r.k = c.at_key JOIN redirect_responses n ON n.k = r.ahead WHERE at_key % 2 = 0 AND steps < 10),
  ends AS (SELECT k, arg_max(at_key, steps) AS last_key, max(steps) AS steps, arg_max(trail, steps) AS trail FROM chain GROUP BY k),
  resolved AS (SELECT 'https://r.example.com/p/' || ends.k AS url, steps, last_key, trail, r.status,
         'https://r.example.com/p/' || CASE WHEN last_key % 2 = 0 THEN r.ahead ELSE last_key END AS final_url FROM ends JOIN redirect_responses r ON r.k = last_key)"""


def resolved_table(spark, sf):
    responses = d.redirect_responses(spark, sf)
    return redirects.redirect_resolve(responses.select("url"), responses)


@query(
    "redirect_resolve",
    oracle("redirect_responses", CHAINS + "SELECT url, final_url, status, steps, last_key % 2 = 0 AS capped, trail FROM resolved", recursive=True),
)
def redirect_resolve(spark, sf):
    chain = F.col("redirect_chain")
    headers = lambda step: F.array_join(F.transform(F.map_entries(step["headers"]), lambda h: F.concat_ws("=", h["key"], h["value"])), ";")
    trail = F.transform(chain, lambda step: F.concat_ws("|", step["url"], step["status"].cast("string"), headers(step)))
    return resolved_table(spark, sf).select(
        "url", "final_url", long("status").alias("status"), long(F.size(chain)).alias("steps"), "capped", F.array_join(trail, " > ").alias("trail"),
    )


RECORDS = CHAINS + """SELECT url AS source_url, final_url AS target_url, steps - 1 AS chain_length, status AS final_status
    FROM resolved WHERE steps > 1 AND status <> 503"""


@query("redirect_records", oracle("redirect_responses", RECORDS, recursive=True))
def redirect_records(spark, sf):
    return redirects.redirect_records(resolved_table(spark, sf)).select(
        "source_url", "target_url", long("chain_length").alias("chain_length"), long("final_status").alias("final_status")
    )


# --- reach and depth -------------------------------------------------------------------------

REACH = """, best(t, depth) USING KEY (t) AS (
    SELECT CAST(1 AS BIGINT), 0 UNION SELECT e.t, min(w.depth) + 1 FROM best w JOIN link_edges e ON e.s = w.t
    LEFT JOIN recurring.best b ON b.t = e.t WHERE b.t IS NULL AND (w.t % 7 <> 0 OR w.depth = 0) GROUP BY e.t),
  reach AS (SELECT b.t, b.depth, (SELECT min('https://l.example.com/c/' || e.s) FROM link_edges e JOIN best p ON p.t = e.s
                 WHERE e.t = b.t AND p.depth = b.depth - 1 AND (p.t % 7 <> 0 OR p.depth = 0)) AS parent, b.t % 7 = 0 AND b.depth > 0 AS recorded FROM best b)"""


def reach_table(spark, sf):
    seeds = d.table(spark, sf, "customer").filter("c_custkey = 1").select(
        F.lit("https://l.example.com/c/1").alias("url")
    )
    return reach.crawl_reachability(seeds, d.link_edges(spark, sf))


@query(
    "crawl_reachability",
    oracle("link_edges", REACH + "SELECT 'https://l.example.com/c/' || t AS url, depth, parent, NOT recorded AS crawled, recorded FROM reach", recursive=True),
)
def crawl_reachability(spark, sf):
    return reach_table(spark, sf).select("url", long("depth").alias("depth"), "parent", "crawled", "recorded")


@query(
    "crawl_depth",
    oracle("link_edges", REACH + """SELECT 'https://l.example.com/c/' || c_custkey AS url, CAST(r.depth AS VARCHAR) AS crawl_depth
        FROM customer LEFT JOIN (SELECT * FROM reach WHERE NOT recorded) r ON r.t = c_custkey""", recursive=True),
)
def crawl_depth(spark, sf):
    urls = d.table(spark, sf, "customer").select(d.text("https://l.example.com/c/", F.col("c_custkey")).alias("url"))
    queued = reach_table(spark, sf).filter(~F.col("recorded"))
    return links.crawl_depth(urls, queued).withColumn("crawl_depth", F.col("crawl_depth").cast("string"))


@query(
    "graph_inlinks",
    oracle("link_edges", "SELECT 'https://l.example.com/c/' || t AS url, count(*) AS inlinks_count, count(DISTINCT s) AS inlinks_unique_count FROM link_edges GROUP BY t"),
)
def graph_inlinks(spark, sf):
    return links.inlink_counts(d.link_edges(spark, sf))


# --- dictionaries ----------------------------------------------------------------------------


@query("encode_dictionary", "SELECT dense_rank() OVER (ORDER BY anchor) AS id, anchor AS value FROM (SELECT DISTINCT p_name AS anchor FROM part)")
def encode_dictionary(spark, sf):
    return dictionary.encode_dictionary(d.table(spark, sf, "part"), "p_name")


@query(
    "encode_dictionary_known",
    """WITH known AS (SELECT dense_rank() OVER (ORDER BY p_type) AS id, p_type AS value FROM (SELECT DISTINCT p_type FROM part WHERE p_type < 'M')),
         fresh AS (SELECT DISTINCT p_type AS value FROM part WHERE p_type NOT IN (SELECT value FROM known))
       SELECT id, value FROM known UNION ALL SELECT dense_rank() OVER (ORDER BY value) + (SELECT max(id) FROM known), value FROM fresh""",
)
def encode_dictionary_known(spark, sf):
    parts = d.table(spark, sf, "part")
    known = dictionary.encode_dictionary(parts.filter("p_type < 'M'"), "p_type")
    return dictionary.encode_dictionary(parts, "p_type", known)


@query("decode_dictionary", "SELECT p_partkey, p_brand AS brand FROM part")
def decode_dictionary(spark, sf):
    parts = d.table(spark, sf, "part").select("p_partkey", "p_brand")
    ids = dictionary.encode_dictionary(parts, "p_brand", blank_is_null=True)
    coded = dictionary.with_ids(parts, "p_brand", ids, "brand_id").select("p_partkey", "brand_id")
    return dictionary.decode_dictionary(coded, "brand_id", ids, "brand").select("p_partkey", "brand")
