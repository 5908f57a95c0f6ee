"""Queries over the four views and the documented questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkgraph.operators import dictionary, links, redirects, robots, structured
from silkgraph.operators.content import content_columns, has_content, page_content, page_facts
from silkgraph.operators.dom import CONTENT, scan_html
from silkgraph.operators.scale import cut, stored
from silkgraph.functions.urls import host, url_classification, url_normalize_storage
from silkgraph.plans import documented, views
from silkgraph.plans.catalog_html import ALL_ITEMS, COUNTS, LINKS, whole_text
from silkgraph.plans.catalog_site import HREFLANG, INDEX, LISTING, MAPS, hreflang_table, indexability_table, listing_table
from silkgraph.plans.catalog_state import RECORDS, resolved_table
from silkgraph.plans.registry import bars, long, query, stamp, stamp_sql
from silkgraph.sources import derived as d
from silkgraph.sources.derived import oracle

# --- inputs of the views ---------------------------------------------------------------------

STATUS = "CASE page_id % 6 WHEN 5 THEN 404 WHEN 4 THEN 500 ELSE 200 END"


def stored_pages(spark, sf):
    """(url, status, fetched_at): one row per page URL; every seventh page was not fetched."""
    k = F.col("page_id")
    return d.page_keys(spark, sf).filter(k % 7 != 6).select(
        "url",
        F.when(k % 6 == 5, 404).when(k % 6 == 4, 500).otherwise(200).alias("status"),
        F.timestamp_seconds(F.lit(1_700_000_000) + k).alias("fetched_at"),
    )


def page_frontier(spark, sf):
    k = F.col("page_id")
    return d.page_keys(spark, sf).filter(k % 8 != 7).select(
        "url",
        (k % 4).alias("depth"),
        F.when(k % 3 == 0, "queued").otherwise("done").alias("status"),
    )


def page_analysis_table(spark, sf):
    # One pass over the HTML; what it found is written once, and the inputs below read that.
    facts = cut(page_facts(d.keyed_variants(spark, sf).select("page_id", "url", "html", "headers"), gate=False, hrefs=True))
    own = facts.select(F.col("url").alias("source_url"), F.explode("internal_hrefs").alias("href"))
    content = cut(d.settled(has_content(facts.drop("internal_hrefs"))).drop("page_id"))
    return views.page_analysis(
        d.site_urls(spark, sf),
        content,
        robots.indexability(content, d.robots_txt(spark, sf)),
        hreflang_table(spark, sf),
        inlinks=links.inlink_counts(own, target="href"),
        frontier=page_frontier(spark, sf),
    )


ANALYSIS_INPUTS = "stored_urls hosts all_urls sitemap_rows sitemap_alternates site_urls nav_links variant_links all_nav_links all_variant_links page_fields"
ANALYSIS = f""", indexability AS ({INDEX}), counts AS ({COUNTS}),
  analysis AS (SELECT u.url, u.kind, u.classification, f.page_id, f.title, f.meta_description, f.h1 AS h1_tags, '' AS h2_tags, f.word_count + 3 AS word_count, f.html_lang,
         c.internal_links_count, c.external_links_count, c.internal_links_unique_count, c.external_links_unique_count,
         i.robots_txt_allows, i.html_meta_allows, i.http_header_allows, i.overall_indexable, i.robots_txt_directives, i.html_meta_directives, i.http_header_directives,
         f.canonical_url AS canonical_urls,
         CASE WHEN f.canonical_url IS NOT NULL THEN 'html_head' END AS canonical_sources,
         n.inlinks_count, n.inlinks_unique_count, CASE WHEN f.page_id % 8 <> 7 THEN f.page_id % 4 END AS crawl_depth,
         (SELECT min(lang) FROM sitemap_alternates a WHERE a.url = u.url AND lang <> 'x-default'
             AND (href_url = u.url OR href_url = u.url || '/' OR u.url = href_url || '/')) AS self_hreflang
  FROM site_urls u JOIN page_fields f ON f.key_url = u.url JOIN counts c ON c.source_url = u.url JOIN indexability i ON i.page_id = f.page_id
  LEFT JOIN (SELECT href, count(*) AS inlinks_count, count(DISTINCT source_url) AS inlinks_unique_count FROM all_variant_links
             WHERE classification = 'internal' GROUP BY href) n ON n.href = u.url
  WHERE u.classification IN ('internal', 'network'))"""


@query("page_analysis", oracle(ANALYSIS_INPUTS, ANALYSIS + "SELECT * EXCLUDE (page_id) FROM analysis"))
def page_analysis(spark, sf):
    rows = page_analysis_table(spark, sf).withColumn("crawl_depth", F.col("crawl_depth").cast("bigint"))
    for name in ("h1_tags", "h2_tags", "robots_txt_directives", "html_meta_directives", "http_header_directives"):
        rows = rows.withColumn(name, bars(name))
    return rows.withColumn("word_count", long("word_count"))


def internal_links_table(spark, sf):
    return links.internal_links(
        links.page_links(d.keyed_variants(spark, sf)), d.site_urls(spark, sf)
    )


INTERNAL = """SELECT source_url, u.url AS target_url, anchor_text, xpath, href, 'internal' AS href_classification, url_fragment, url_parameters
        FROM variant_links LEFT JOIN site_urls u ON u.url = href WHERE variant_links.classification = 'internal'"""


@query("internal_links_analysis", oracle(LINKS, INTERNAL))
def internal_links_analysis(spark, sf):
    return views.internal_links_analysis(internal_links_table(spark, sf))


# --- the same tables with ids in place of texts ------------------------------------------------


def data_model(spark, sf):
    """The tables whose texts have dictionaries."""
    content = page_content(d.page_variants(spark, sf))
    return {
        "internal_links": internal_links_table(spark, sf),
        "directives": robots.robots_directives(content),
        "content": content,
        "hreflang": hreflang_table(spark, sf),
        "schema_items": structured.structured_data(d.part_pages(spark, sf)),
    }


@query(
    "encode_dictionaries",
    oracle("page_urls nav_links page_links site_urls page_fields hosts all_urls sitemap_rows sitemap_alternates part_keys", ALL_ITEMS + """, texts AS (
        SELECT 'anchor_texts' AS dictionary, anchor_text AS value FROM variant_links WHERE classification = 'internal'
        UNION SELECT 'xpaths', xpath FROM variant_links WHERE classification = 'internal'
        UNION SELECT 'robots_directive_strings', unnest(string_split(meta_robots, '|')) FROM page_fields WHERE meta_robots <> ''
        UNION SELECT 'robots_directive_strings', unnest(string_split(header_robots, '|')) FROM page_fields WHERE header_robots <> ''
        UNION SELECT 'meta_descriptions', meta_description FROM page_fields WHERE meta_description <> ''
        UNION SELECT 'html_languages', html_lang FROM page_fields WHERE html_lang <> ''
        UNION SELECT 'hreflang_languages', lang FROM sitemap_alternates WHERE lang = 'fr' OR loc NOT IN (SELECT loc FROM sitemap_alternates WHERE lang = 'fr')
        UNION SELECT 'schema_types', type FROM items)
        SELECT dictionary, row_number() OVER (PARTITION BY dictionary ORDER BY value) AS id, value FROM texts"""),
)
def encode_dictionaries(spark, sf):
    """All seven dictionaries of the data model."""
    return dictionary.encode_dictionaries(data_model(spark, sf))


def through_ids(spark, sf, name):
    """A table written with ids, beside the dictionaries, and read back through them."""
    rows = stored(data_model(spark, sf)[name], f"plain-{name}")
    ids = stored(dictionary.encode_dictionaries({name: rows}), "dictionaries")
    coded = stored(dictionary.encoded_table(name, rows, ids), f"coded-{name}")
    return dictionary.decoded_table(name, coded, ids)


@query("internal_links_analysis_decoded", oracle(LINKS, INTERNAL))
def internal_links_analysis_decoded(spark, sf):
    """The view over the links as they are exported: anchor texts and XPaths as ids."""
    return views.internal_links_analysis(through_ids(spark, sf, "internal_links"))


@query(
    "sitemap_statistics",
    oracle(MAPS, LISTING + f""", rows AS (SELECT l.sitemap_url, l.url, p.page_id, l.sitemap_position FROM listing l
          JOIN (SELECT split_part(url, '#', 1) AS url, max(page_id) AS page_id FROM pages GROUP BY 1) p USING (url))
        SELECT sitemap_url, count(*) AS total_urls, count(DISTINCT url) AS unique_urls,
          {stamp_sql("min(make_timestamp((1700000000 + sitemap_position) * 1000000))")} AS first_discovered,
          {stamp_sql("max(make_timestamp((1700000000 + sitemap_position) * 1000000))")} AS last_discovered,
          count(*) FILTER (WHERE page_id % 8 <> 7 AND page_id % 3 <> 0) AS crawled_urls,
          count(*) FILTER (WHERE page_id % 8 <> 7 AND page_id % 3 = 0) AS queued_urls,
          count(*) FILTER (WHERE page_id % 8 = 7) AS not_in_frontier,
          count(*) FILTER (WHERE page_id % 7 <> 6 AND page_id % 6 < 4) AS successful_urls,
          count(*) FILTER (WHERE page_id % 7 <> 6 AND page_id % 6 >= 4) AS error_urls
        FROM rows GROUP BY sitemap_url""", recursive=True),
)
def sitemap_statistics(spark, sf):
    listing = listing_table(spark, sf).withColumn(
        "discovered_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sitemap_position"))
    )
    table = views.sitemap_statistics(listing, page_frontier(spark, sf), stored_pages(spark, sf))
    utc = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return table.withColumn("first_discovered", utc("first_discovered")).withColumn("last_discovered", utc("last_discovered"))


def schema_table(spark, sf, items=None):
    items = structured.structured_data(d.part_pages(spark, sf)) if items is None else items
    k = F.regexp_extract("url", r"(\d+)\z", 1).cast("bigint")
    urls = d.part_pages(spark, sf).select(
        "url", F.when(k % 3 == 0, "network").when(k % 3 == 1, "internal").otherwise("external").alias("classification")
    )
    return views.schema_analysis(items, urls)


SCHEMA = ALL_ITEMS + """, analysis AS (SELECT url, type AS schema_type, format, position, parsed_data, problem = '' AS is_valid, problem
    FROM items JOIN part_keys USING (url) WHERE k % 3 <> 2)"""


def problem(errors="validation_errors"):
    return bars(F.transform(errors, whole_text))


@query("schema_analysis_decoded", oracle("part_keys", SCHEMA + "SELECT url, schema_type, format, position, parsed_data, is_valid, problem FROM analysis"))
def schema_analysis_decoded(spark, sf):
    """The view over items whose types are ids."""
    return schema_table(spark, sf, through_ids(spark, sf, "schema_items")).select(
        "url", "schema_type", "format", long("position").alias("position"), "parsed_data", "is_valid", problem().alias("problem")
    )


@query("schema_analysis", oracle("part_keys", SCHEMA + "SELECT url, schema_type, format, position, parsed_data, is_valid, problem FROM analysis"))
def schema_analysis(spark, sf):
    return schema_table(spark, sf).select(
        "url", "schema_type", "format", long("position").alias("position"), "parsed_data", "is_valid", problem().alias("problem")
    )


# --- documented questions --------------------------------------------------------------------


@query(
    "q_ok_pages",
    oracle(ANALYSIS_INPUTS, ANALYSIS + f"""SELECT url, 200 AS status_code, title, meta_description, 1 AS h1_count, 0 AS h2_count,
        {stamp_sql("make_timestamp((1700000000 + page_id) * 1000000)")} AS discovered_at FROM analysis WHERE page_id % 7 <> 6 AND page_id % 6 < 4"""),
)
def q_ok_pages(spark, sf):
    rows = documented.ask(
        documented.OK_PAGES, page_analysis=page_analysis_table(spark, sf), pages=stored_pages(spark, sf)
    )
    utc = F.date_format(F.to_utc_timestamp("discovered_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    for name in ("status_code", "h1_count", "h2_count"):
        rows = rows.withColumn(name, long(name))
    return rows.withColumn("discovered_at", utc)


@query("redirect_report", oracle("redirect_responses", RECORDS.replace("AS source_url", "AS source").replace("AS target_url", "AS target"), recursive=True))
def redirect_report(spark, sf):
    rows = documented.ask(documented.REDIRECTS, redirects=redirects.redirect_records(resolved_table(spark, sf)))
    return rows.withColumn("chain_length", long("chain_length")).withColumn("final_status", long("final_status"))


@query(
    "q_hreflang",
    oracle(HREFLANG, """SELECT DISTINCT url, lang AS hreflang, href_url AS target_url FROM sitemap_alternates
        WHERE lang = 'fr' OR loc NOT IN (SELECT loc FROM sitemap_alternates WHERE lang = 'fr')"""),
)
def q_hreflang(spark, sf):
    return documented.ask(documented.HREFLANG, hreflang=hreflang_table(spark, sf))


@query(
    "q_disallowed",
    oracle("stored_urls page_fields", f"SELECT url, robots_txt_allows, html_meta_allows, overall_indexable FROM ({INDEX}) WHERE NOT robots_txt_allows"),
)
def q_disallowed(spark, sf):
    return documented.ask(documented.DISALLOWED, indexability=indexability_table(spark, sf))


@query(
    "q_links_of_site",
    oracle(LINKS, f"SELECT source_url, target_url, anchor_text, xpath, href FROM ({INTERNAL}) WHERE source_url LIKE '%example.com%'"),
)
def q_links_of_site(spark, sf):
    return documented.ask(
        documented.LINKS_OF_SITE, {"pattern": "%example.com%"},
        internal_links_analysis=views.internal_links_analysis(internal_links_table(spark, sf)),
    )


@query("q_schema_valid", oracle("part_keys", SCHEMA + "SELECT url, schema_type, format, is_valid FROM analysis WHERE is_valid"))
def q_schema_valid(spark, sf):
    return documented.ask(documented.SCHEMA_VALID, schema_analysis=schema_table(spark, sf)).drop("validation_errors")


@query("q_schema_invalid", oracle("part_keys", SCHEMA + "SELECT url, schema_type, problem FROM analysis WHERE NOT is_valid"))
def q_schema_invalid(spark, sf):
    rows = documented.ask(documented.SCHEMA_INVALID, schema_analysis=schema_table(spark, sf))
    return rows.select("url", "schema_type", problem().alias("problem"))


@query("q_schema_counts", oracle("part_keys", SCHEMA + "SELECT schema_type, format, count(*) AS count FROM analysis GROUP BY schema_type, format"))
def q_schema_counts(spark, sf):
    return documented.ask(documented.SCHEMA_COUNTS, schema_analysis=schema_table(spark, sf))


# --- the flagship: pages with their fields and link counts, in one pass over the HTML ---------


def page_overview(pages):
    """(url, site, classification, title, html_lang, h1, word_count, links): one scan, no shuffle."""
    scanned = scan_html(pages.select("url", "html"), {**CONTENT, "tags": CONTENT["tags"] | {"a"}})
    counted = scanned.withColumn(
        "links",
        F.size(F.filter("nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href"))),
    )
    return has_content(content_columns(counted)).select(
        url_normalize_storage(F.col("url")).alias("url"),
        url_classification(F.col("url"), host(F.col("url"))).alias("classification"),
        "title", "html_lang", bars("h1_tags").alias("h1"),
        long("word_count").alias("word_count"), long("links").alias("links"),
    )


@query(
    "page_overview",
    oracle("page_urls nav_links page_fields", """SELECT key_url AS url, 'internal' AS classification, title, html_lang, h1, word_count,
        (SELECT count(*) FROM nav_links n WHERE n.page_id = f.page_id) AS links FROM page_fields f"""),
)
def page_overview_(spark, sf):
    return page_overview(d.pages(spark, sf))
