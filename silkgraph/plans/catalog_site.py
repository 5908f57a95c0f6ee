"""Queries over robots files and sitemaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkgraph.operators import robots, sitemaps
from silkgraph.operators.content import page_content
from silkgraph.operators.scale import cut
from silkgraph.plans.catalog_urls import ALLOWED
from silkgraph.plans.registry import bars, long, query
from silkgraph.sources import derived as d
from silkgraph.sources.derived import oracle

ROBOTS = "page_urls hosts robots_txt"
MAPS = "page_urls hosts all_urls sitemap_rows"
START = "CASE WHEN length(domain) % 5 IN (0, 2, 3) THEN 'https://' || domain || '/sitemap_index.xml' WHEN length(domain) % 3 = 0 THEN 'https://' || domain || '/sitemap_index.xml' ELSE 'https://' || domain || '/sitemap.xml' END"


@query("scan_robots", oracle(ROBOTS, "SELECT domain FROM robots_txt WHERE status = 200"))
def scan_robots(spark, sf):
    return robots.robots_files(d.robots_txt(spark, sf)).select("domain")


@query("robots_rules", oracle(ROBOTS + " robots_rules", "SELECT domain, position, agent, kind, path FROM robots_rules"))
def robots_rules(spark, sf):
    return robots.robots_rules(d.robots_txt(spark, sf)).withColumn("position", long("position"))


@query(
    "robots_match",
    oracle(ROBOTS + " robots_rules", """SELECT p.page_id, r.position, starts_with(p.path, rtrim(r.path, '*')) AS matches
        FROM page_urls p JOIN robots_rules r USING (domain) WHERE r.agent = '*' AND r.path <> ''"""),
)
def robots_match(spark, sf):
    from silkgraph.functions.urls import netloc, path

    rules = robots.rules_for_agent(d.robots_txt(spark, sf))
    tried = F.transform(
        "rules",
        lambda r: F.struct(r["position"].alias("position"), robots.rule_matches(F.col("path"), r["prefix"]).alias("matches")),
    )
    pages = d.pages(spark, sf).select(
        "page_id", netloc(F.col("url")).alias("domain"), path(F.col("url")).alias("path")
    )
    return (
        pages.join(rules, "domain")
        .select("page_id", "domain", F.explode(tried).alias("m"))
        .select("page_id", long("m.position").alias("position"), "m.matches")
    )


@query(
    "robots_allowed",
    oracle("page_urls", f"""SELECT page_id, {ALLOWED} AS everyone, {ALLOWED} AND NOT (form = 3 AND starts_with(path, '/fr/')) AS examplebot
        FROM (SELECT *, length(domain) % 5 AS form FROM page_urls)"""),
)
def robots_allowed(spark, sf):
    files = d.robots_txt(spark, sf)
    everyone = robots.robots_allowed(d.pages(spark, sf).select("page_id", "url"), files)
    both = robots.robots_allowed(everyone.withColumnRenamed("robots_allowed", "everyone"), files, "examplebot")
    return both.select("page_id", "everyone", F.col("robots_allowed").alias("examplebot"))


@query(
    "robots_sitemaps",
    oracle(ROBOTS, "SELECT domain, 0 AS position, 'https://' || domain || '/sitemap_index.xml' AS sitemap_url FROM robots_txt WHERE form IN (0, 2, 3)"),
)
def robots_sitemaps(spark, sf):
    return robots.robots_sitemaps(d.robots_txt(spark, sf)).withColumn("position", long("position"))


INDEX = f"""SELECT page_id, key_url AS url, {ALLOWED} AS robots_txt_allows, page_id % 4 <> 1 AS html_meta_allows, page_id % 5 <> 0 AS http_header_allows,
        {ALLOWED} AND page_id % 4 <> 1 AND page_id % 5 <> 0 AS overall_indexable,
        CASE WHEN {ALLOWED} THEN '' ELSE 'disallow' END AS robots_txt_directives,
        meta_robots AS html_meta_directives, header_robots AS http_header_directives FROM page_fields"""


def indexability_table(spark, sf):
    content = d.settled(page_content(d.keyed_variants(spark, sf))).drop("page_id")
    return robots.indexability(content, d.robots_txt(spark, sf))


@query("indexability", oracle("stored_urls page_fields", f"SELECT * EXCLUDE (page_id) FROM ({INDEX})"))
def indexability(spark, sf):
    table = indexability_table(spark, sf)
    for name in ("robots_txt_directives", "html_meta_directives", "http_header_directives"):
        table = table.withColumn(name, bars(name))
    return table


# --- sitemaps --------------------------------------------------------------------------------


@query(
    "scan_sitemaps",
    oracle(MAPS, """SELECT sitemap_url AS url, 200 AS status FROM sitemap_rows GROUP BY sitemap_url
        UNION ALL SELECT 'https://' || domain || '/sitemap_index.xml', 200 FROM hosts
        UNION ALL SELECT 'https://' || domain || '/sitemap.xml', CASE WHEN length(domain) % 3 = 0 THEN 404 ELSE 200 END FROM hosts"""),
)
def scan_sitemaps(spark, sf):
    return d.sitemap_files(spark, sf).select("url", long("status").alias("status"))


@query(
    "sitemap_kind",
    oracle(MAPS, """SELECT sitemap_url AS url, 'sitemap' AS kind FROM sitemap_rows GROUP BY sitemap_url
        UNION ALL SELECT 'https://' || domain || '/sitemap_index.xml', 'sitemap_index' FROM hosts
        UNION ALL SELECT 'https://' || domain || '/sitemap.xml', 'sitemap_index' FROM hosts"""),
)
def sitemap_kind(spark, sf):
    return sitemaps.sitemap_kind(d.sitemap_files(spark, sf))


@query(
    "sitemap_locs",
    oracle(MAPS, """SELECT sitemap_url AS url, 'sitemap' AS kind, url AS loc, count(*) AS times
        FROM (SELECT *, unnest(CASE WHEN twice THEN [0, 1] ELSE [0] END) FROM sitemap_rows) GROUP BY sitemap_url, url
        UNION ALL SELECT DISTINCT 'https://' || domain || '/sitemap_index.xml', 'sitemap_index', sitemap_url, 1 FROM sitemap_rows
        UNION ALL SELECT 'https://' || domain || '/sitemap.xml', 'sitemap_index', 'https://' || domain || unnest(['/sitemap.xml', '/sitemap_index.xml']), 1 FROM hosts"""),
)
def sitemap_locs(spark, sf):
    return sitemaps.sitemap_locs(d.sitemap_files(spark, sf)).groupBy("url", "kind", "loc").agg(
        F.count(F.lit(1)).alias("times")
    )


@query(
    "sitemap_entries",
    oracle(MAPS, """SELECT sitemap_url, position, url AS loc, CASE WHEN twice THEN 'fr ' || url || '/'
        WHEN even THEN 'en ' || url || '|x-default https://' || domain || '/' ELSE '' END AS alternates FROM sitemap_rows"""),
)
def sitemap_entries(spark, sf):
    return sitemaps.sitemap_entries(d.sitemap_files(spark, sf)).select(
        "sitemap_url", long("position").alias("position"), "loc",
        bars(F.transform("alternates", lambda a: F.concat_ws(" ", a["lang"], a["href_url"]))).alias("alternates"),
    )


def starts(spark, sf, files):
    return sitemaps.sitemap_discovery(d.page_hosts(spark, sf), d.robots_txt(spark, sf), files)


def closure_table(spark, sf):
    files = cut(d.sitemap_files(spark, sf))
    return sitemaps.sitemap_closure(starts(spark, sf, files), files)


@query("sitemap_unreadable", oracle(MAPS, """SELECT sitemap_url, CASE WHEN length(domain) % 3 = 1 THEN 1 ELSE 0 END AS unreadable FROM sitemap_rows GROUP BY ALL
        UNION ALL SELECT 'https://' || domain || '/sitemap_index.xml', 0 FROM hosts
        UNION ALL SELECT 'https://' || domain || '/sitemap.xml', 0 FROM hosts WHERE length(domain) % 3 <> 0"""))
def sitemap_unreadable(spark, sf):
    return sitemaps.read_files(d.sitemap_files(spark, sf)).select("sitemap_url", long("unreadable").alias("unreadable"))


@query("sitemap_discovery", oracle("page_urls hosts", f"SELECT domain AS site, 0 AS position, {START} AS sitemap_url FROM hosts"))
def sitemap_discovery(spark, sf):
    return starts(spark, sf, d.sitemap_files(spark, sf)).withColumn("position", long("position"))


VISITS = f""", files AS (
    SELECT 'https://' || domain || '/sitemap.xml' AS parent, unnest([0, 1]) AS position,
           unnest(['https://' || domain || '/sitemap.xml', 'https://' || domain || '/sitemap_index.xml']) AS child FROM hosts
    UNION ALL SELECT DISTINCT 'https://' || domain || '/sitemap_index.xml', chunk, sitemap_url FROM sitemap_rows),
  visits(site, sitemap_url, level) USING KEY (site, sitemap_url) AS (
    SELECT domain, {START}, 0 FROM hosts
    UNION SELECT w.site, f.child, min(w.level) + 1 FROM visits w JOIN files f ON f.parent = w.sitemap_url
    LEFT JOIN recurring.visits v ON v.site = w.site AND v.sitemap_url = f.child WHERE v.site IS NULL GROUP BY w.site, f.child)"""


@query(
    "sitemap_closure",
    oracle(MAPS, VISITS + """SELECT site, url AS loc, sitemap_url, level, position, CASE WHEN twice THEN 'fr ' || url || '/'
          WHEN even THEN 'en ' || url || '|x-default https://' || domain || '/' ELSE '' END AS alternates
        FROM sitemap_rows JOIN visits USING (sitemap_url)""", recursive=True),
)
def sitemap_closure(spark, sf):
    return closure_table(spark, sf).select(
        "site", "loc", "sitemap_url", long("level").alias("level"), long("position").alias("position"),
        bars(F.transform("alternates", lambda a: F.concat_ws(" ", a["lang"], a["href_url"]))).alias("alternates"),
    )


LISTING = VISITS + """, listing AS (
    SELECT site, split_part(url, '#', 1) AS url, sitemap_url,
           row_number() OVER (PARTITION BY site ORDER BY chunk, position) - 1 AS sitemap_position
    FROM sitemap_rows JOIN visits USING (sitemap_url))"""


def listing_table(spark, sf):
    return sitemaps.sitemap_listing(closure_table(spark, sf))


@query("sitemap_listing", oracle(MAPS, LISTING + "SELECT * FROM listing", recursive=True))
def sitemap_listing(spark, sf):
    return listing_table(spark, sf)


def hreflang_table(spark, sf):
    return sitemaps.hreflang_sitemap(
        sitemaps.sitemap_entries(d.sitemap_files(spark, sf)), d.site_urls(spark, sf)
    )


HREFLANG = MAPS + " sitemap_alternates site_urls"


@query("hreflang_sitemap", oracle(HREFLANG, "SELECT DISTINCT url, lang, href_url, split_part(href_url, '#', 1) AS href_key FROM (SELECT * FROM sitemap_alternates WHERE lang = 'fr' OR loc NOT IN (SELECT loc FROM sitemap_alternates WHERE lang = 'fr'))"))
def hreflang_sitemap(spark, sf):
    return hreflang_table(spark, sf).select("url", "lang", "href_url", "href_key")


@query(
    "hreflang_new_urls",
    oracle(HREFLANG, """SELECT DISTINCT href_url AS url, 'other' AS kind, 'internal' AS classification FROM sitemap_alternates
        WHERE href_url NOT IN (SELECT url FROM site_urls) AND (lang = 'fr' OR loc NOT IN (SELECT loc FROM sitemap_alternates WHERE lang = 'fr'))"""),
)
def hreflang_new_urls(spark, sf):
    return sitemaps.hreflang_new_urls(hreflang_table(spark, sf), d.site_urls(spark, sf))


@query(
    "crawl_edges",
    oracle(MAPS + " nav_links", f"""SELECT DISTINCT source_url, target_url, {ALLOWED} AS crawlable FROM (
        SELECT url AS source_url, origin || href AS target_url, href AS path, length(domain) % 5 AS form FROM nav_links
        UNION ALL SELECT sitemap_url, split_part(url, '#', 1), regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), length(domain) % 5 FROM sitemap_rows
        UNION ALL SELECT 'https://' || domain || '/sitemap_index.xml', sitemap_url, '/', length(domain) % 5 FROM sitemap_rows
        UNION ALL SELECT 'https://' || domain || '/sitemap.xml', 'https://' || domain || unnest(['/sitemap.xml', '/sitemap_index.xml']), '/', length(domain) % 5 FROM hosts)"""),
)
def crawl_edges(spark, sf):
    """Edges from page links and sitemap children, under robots.txt and the crawl policy."""
    from silkgraph.operators.links import extract_links
    from silkgraph.operators.reach import crawl_edges as edges_of

    found = extract_links(d.pages(spark, sf)).withColumnRenamed("link_no", "ord")
    listed = sitemaps.sitemap_locs(d.sitemap_files(spark, sf)).select(
        F.col("url").alias("source_url"), F.col("loc").alias("target_url"), F.col("position").alias("ord")
    )
    return edges_of(found, d.robots_txt(spark, sf), listed).select("source_url", "target_url", "crawlable").distinct()
