"""Queries over the HTML scan: nodes, links, page fields, structured data."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkgraph.operators import content, dom, links, robots, structured
from silkgraph.operators.content import page_content
from silkgraph.plans.registry import bars, long, query
from silkgraph.sources import derived as d
from silkgraph.sources.derived import oracle


@query(
    "html_nodes",
    r"""SELECT page_id, tag, count(*) AS elements FROM (
          SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
                 '<(script|style)>.*?</', '<\1></', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
        GROUP BY page_id, tag""",
)
def html_nodes(spark, sf):
    nodes = dom.html_nodes(d.pages(spark, sf).select("page_id", "html"), dom.wanted(text_tags=()))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("elements"))


# A stack over the tokens of a page, for all pages at once: the order and the parent of every element, and the texts inside.
NODE_TOKENS = r""", decoded AS (
  SELECT page_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM (
    SELECT page_id, regexp_extract_all(replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '"</p>"', '"' || chr(1) || '/p>"'), '<[^>]*>|[^<]+') AS tokens FROM pages)),
  tokens AS (
  SELECT page_id, i, token, regexp_extract(token, '^</?([a-z][a-z0-9]*)', 1) AS tag,
         CASE WHEN token LIKE '</%' THEN 'end' WHEN token LIKE '<!%' THEN 'other' WHEN token LIKE '<%' THEN 'start' ELSE 'text' END AS kind,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(token, chr(1), '<'), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g') AS plain FROM decoded),
  walk(page_id, i, kind, ord, parent_ord, tag, plain, open, tags, n) AS (
    SELECT page_id, CAST(-1 AS BIGINT), 'other', NULL::BIGINT, NULL::BIGINT, '', '', []::BIGINT[], []::VARCHAR[], CAST(0 AS BIGINT) FROM pages
    UNION ALL
    SELECT t.page_id, t.i, t.kind, CASE WHEN t.kind = 'start' THEN n END, CASE WHEN t.kind = 'start' THEN coalesce(open[-1], -1) END, t.tag, t.plain,
           CASE WHEN t.kind = 'start' AND t.tag NOT IN ('meta', 'br') THEN list_append(open, n)
                WHEN t.kind = 'end' AND list_contains(tags, t.tag) THEN open[1:len(tags) - list_position(list_reverse(tags), t.tag)] ELSE open END,
           CASE WHEN t.kind = 'start' AND t.tag NOT IN ('meta', 'br') THEN list_append(tags, t.tag)
                WHEN t.kind = 'end' AND list_contains(tags, t.tag) THEN tags[1:len(tags) - list_position(list_reverse(tags), t.tag)] ELSE tags END,
           CASE WHEN t.kind = 'start' THEN n + 1 ELSE n END
    FROM walk w JOIN tokens t ON t.page_id = w.page_id AND t.i = w.i + 1),
  texts AS (
    SELECT page_id, ord, string_agg(plain, '' ORDER BY i) AS text FROM (
      SELECT page_id, i, plain, unnest(CASE WHEN tags[-1] IN ('script', 'style') THEN [open[-1]] ELSE open END) AS ord
      FROM walk WHERE kind = 'text')
    GROUP BY page_id, ord)"""
NODES_QUESTION = """
SELECT p.page_id, n.ord, n.parent_ord, n.tag, array_join(transform(map_entries(n.attrs), e -> e.key || '=' || e.value), ' ') AS attributes, n.text
FROM page_bodies p, LATERAL html_nodes(p.html) n
"""


@query(
    "html_nodes_in_sql",
    "WITH RECURSIVE " + NODE_TOKENS.lstrip(", ") + r""", sides AS (SELECT DISTINCT page_id, ord, text FROM texts)
        SELECT w.page_id, w.ord, w.parent_ord, w.tag, regexp_replace(array_to_string(regexp_extract_all(w.plain, '[a-z-]+="[^"]*"'), ' '), '"', '', 'g') AS attributes,
               regexp_replace(coalesce(s.text, ''), '^\s+|\s+$', '', 'g') AS text
        FROM walk w LEFT JOIN sides s USING (page_id, ord) WHERE w.kind = 'start'""",
)
def html_nodes_in_sql(spark, sf):
    dom.register_html_nodes(spark)
    d.pages(spark, sf).select("page_id", "html").createOrReplaceTempView("page_bodies")
    nodes = spark.sql(NODES_QUESTION)
    return nodes.withColumn("ord", long("ord")).withColumn("parent_ord", long("parent_ord"))


@query(
    "extract_links",
    oracle("page_urls nav_links", "SELECT url AS source_url, n AS link_no, origin || href AS target_url FROM nav_links"),
)
def extract_links(spark, sf):
    return links.extract_links(d.pages(spark, sf)).withColumn("link_no", long("link_no"))


@query(
    "extract_links_detailed",
    oracle("page_urls nav_links page_links", "SELECT source_url, link_no, link_url AS target_url, anchor_text, raw_href AS href FROM variant_links"),
)
def extract_links_detailed(spark, sf):
    rows = links.extract_links_detailed(d.keyed_variants(spark, sf), xpath=False)
    return rows.withColumn("link_no", long("link_no")).drop("xpath")


@query("element_xpath", oracle("page_urls nav_links page_links", "SELECT source_url, link_no, xpath FROM variant_links"))
def element_xpath(spark, sf):
    return links.extract_links_detailed(d.keyed_variants(spark, sf)).select(
        "source_url", long("link_no").alias("link_no"), "xpath"
    )


def _fields(spark, sf):
    return page_content(d.page_variants(spark, sf))


FIELDS = "page_urls page_fields"


@query("page_title", oracle(FIELDS, "SELECT page_id, title FROM page_fields"))
def page_title(spark, sf):
    scanned = dom.scan_html(d.pages(spark, sf).select("page_id", "html"), dom.wanted(tags=("title",)))
    return scanned.select("page_id", content.page_title(F.col("nodes")).alias("title"))


@query("meta_description", oracle(FIELDS, "SELECT page_id, meta_description FROM page_fields"))
def meta_description(spark, sf):
    return _fields(spark, sf).select("page_id", "meta_description")


@query("meta_robots", oracle(FIELDS, "SELECT page_id, meta_robots AS directives FROM page_fields"))
def meta_robots(spark, sf):
    return _fields(spark, sf).select("page_id", bars("html_meta_directives").alias("directives"))


@query("header_robots", oracle(FIELDS, "SELECT page_id, header_robots AS directives FROM page_fields"))
def header_robots(spark, sf):
    return d.page_variants(spark, sf).select(
        "page_id", bars(content.header_robots(F.col("headers"))).alias("directives")
    )


@query("canonical_url", oracle(FIELDS, "SELECT page_id, canonical_url FROM page_fields"))
def canonical_url(spark, sf):
    return _fields(spark, sf).select("page_id", "canonical_url")


@query("html_lang", oracle(FIELDS, "SELECT page_id, html_lang FROM page_fields"))
def html_lang(spark, sf):
    scanned = dom.scan_html(d.pages(spark, sf).select("page_id", "html"), dom.wanted(tags=("html",)))
    return scanned.select("page_id", content.html_lang(F.col("nodes")).alias("html_lang"))


@query("headings", oracle(FIELDS, "SELECT page_id, h1, '' AS h2 FROM page_fields"))
def headings(spark, sf):
    scanned = dom.scan_html(d.pages(spark, sf).select("page_id", "html"), dom.wanted(tags=("h1", "h2")))
    return scanned.select(
        "page_id",
        bars(content.headings(F.col("nodes"), "h1")).alias("h1"),
        bars(content.headings(F.col("nodes"), "h2")).alias("h2"),
    )


@query("word_count", oracle(FIELDS, "SELECT page_id, word_count FROM page_fields"))
def word_count(spark, sf):
    scanned = dom.scan_html(d.pages(spark, sf).select("page_id", "html"), dom.wanted(tags=()))
    return scanned.select("page_id", long("word_count").alias("word_count"))


@query(
    "page_content",
    oracle(FIELDS, """SELECT page_id, title, meta_description, h1 AS h1_tags, '' AS h2_tags, word_count + 3 AS word_count,
        meta_robots AS html_meta_directives, header_robots AS http_header_directives, canonical_url, html_lang FROM page_fields"""),
)
def page_content_(spark, sf):
    return _fields(spark, sf).select(
        "page_id", "title", "meta_description", bars("h1_tags").alias("h1_tags"), bars("h2_tags").alias("h2_tags"),
        long("word_count").alias("word_count"), bars("html_meta_directives").alias("html_meta_directives"),
        bars("http_header_directives").alias("http_header_directives"), "canonical_url", "html_lang",
    )


# --- structured data -------------------------------------------------------------------------

JSON_LD = r""", json_ld AS (
    SELECT k, url, kind, position, nth, broken,
           CASE WHEN kind = 'Unknown' THEN '{"name": "x"}' WHEN broken OR kind = 'ParseError' THEN NULL ELSE
             '{"@type": ' || CASE WHEN k % 11 = 9 THEN '["http://schema.org/Product", "Thing"]' ELSE '"https://schema.org/Product"' END
             || CASE WHEN k % 4 <> 1 THEN ', "name": "' || name || '"' ELSE '' END
             || CASE WHEN k % 4 <> 2 THEN ', "offers": {"price": ' || k || ', "link": "https://shop.example.com/o/' || k || '"}' ELSE '' END
             || CASE WHEN k % 4 = 3 THEN ', "url": "part/' || k || '"}' ELSE ', "url": "https://shop.example.com/part/' || k || '"}' END END AS parsed_data,
           CASE WHEN broken THEN 'JSON decode error' WHEN kind = 'ParseError' THEN 'Parse error: ''list'' object has no attribute ''lower''' WHEN kind = 'Unknown' THEN ''
                WHEN k % 4 = 1 THEN 'Product missing required ''name'' property'
                WHEN k % 4 = 2 THEN 'Product missing required ''offers'' property'
                WHEN k % 4 = 3 THEN 'Invalid URL format for url: part/' || k ELSE '' END AS problem
    FROM (SELECT *, CASE WHEN k % 7 = 6 THEN 'InvalidJSON' WHEN k % 11 = 10 THEN 'ParseError'
                         WHEN nth = 1 THEN 'Unknown' ELSE 'Product' END AS kind,
                 k % 7 = 6 AS broken,
                 CASE WHEN k % 7 = 6 OR k % 11 = 10 THEN 1 WHEN k % 7 = 5 THEN 100 + nth * 2 ELSE 1 END AS position
          FROM (SELECT *, unnest(CASE WHEN k % 7 = 5 AND k % 11 <> 10 THEN [0, 1] ELSE [0] END) AS nth FROM part_keys)))"""

# Column ``fields_json`` of the expected items, written member by member.
MICRO = r""", element_items AS (
    SELECT k, url, 'microdata' AS format, 'Product' AS type, 0 AS position,
           '{"@type": "Product", "name": ' || to_json(name) || ', "url": "https://shop.example.com/m/' || k
           || '", "tag": ["a","b"], "offers": "soon", "price": "' || k || '", "until": "2024-01-01"}' AS parsed_data, '' AS problem FROM part_keys
    UNION ALL
    SELECT k, url, 'microdata', 'Offer', 2, '{"@type": "Offer", "price": "' || k || '", "until": "2024-01-01"}', '' FROM part_keys
    UNION ALL
    SELECT k, url, 'rdfa', 'Organization', 0,
           '{"@type": "Organization", "' || CASE WHEN k % 4 = 1 THEN 'legalName' ELSE 'name' END || '": ' || to_json(brand)
           || ', "logoUrl": "' || CASE WHEN k % 4 = 2 THEN 'logo.png' ELSE 'https://shop.example.com/logo.png' END || '"}',
           CASE k % 4 WHEN 1 THEN 'Organization missing required ''name'' property'
                      WHEN 2 THEN 'Invalid URL format for logoUrl: logo.png' ELSE '' END FROM part_keys)"""

# The source of the element items, written down from the markup of the input.
RAW = r""", offer AS (SELECT k, '<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><meta itemprop="price" content="' || k
           || '"><time itemprop="until" datetime="2024-01-01">soon</time></div>' AS html FROM part_keys),
  raw AS (
    SELECT k, 'Offer' AS type, html AS raw_data FROM offer
    UNION ALL SELECT k, 'Product', '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name"> ' || name || ' </span><a itemprop="url" href="/m/' || k
           || '">x</a><i itemprop="tag">a</i><i itemprop="tag">b</i><div itemscope></div>' || html || '</div>' FROM offer JOIN part_keys USING (k)
    UNION ALL SELECT k, 'Organization', '<div vocab="https://schema.org/" typeof="Organization"><b property="https://schema.org/'
           || CASE WHEN k % 4 = 1 THEN 'legalName' ELSE 'name' END || '">' || brand || '</b><img property="logoUrl" src="'
           || CASE WHEN k % 4 = 2 THEN 'logo.png' ELSE '/logo.png' END || '"></div>' FROM part_keys)"""


def whole_text(error):
    """An error text as it is; only the wording of the JSON decoder, which is the parser's own, is left out."""
    return F.when(error.startswith("JSON decode error: "), "JSON decode error").otherwise(error)


def _items(spark, sf, *formats, rules=None):
    items = structured.structured_data(d.part_pages(spark, sf), formats or structured.FORMATS, rules)
    return items.withColumn("problem", bars(F.transform("validation_errors", whole_text))).withColumn("position", long("position"))


@query("json_ld_items", oracle("part_keys", JSON_LD + "SELECT url, kind AS type, position, parsed_data, problem = '' AS is_valid, problem FROM json_ld"))
def json_ld_items(spark, sf):
    return _items(spark, sf, "json-ld").select("url", "type", "position", "parsed_data", "is_valid", "problem")


@query("json_ld_type", oracle("part_keys", JSON_LD + "SELECT kind AS type, count(*) AS items FROM json_ld GROUP BY kind"))
def json_ld_type(spark, sf):
    return _items(spark, sf, "json-ld").groupBy("type").agg(F.count(F.lit(1)).alias("items"))


@query("microdata_items", oracle("part_keys", MICRO + RAW + "SELECT url, type, position, raw_data FROM element_items JOIN raw USING (k, type) WHERE format = 'microdata'"))
def microdata_items(spark, sf):
    return _items(spark, sf, "microdata").select("url", "type", "position", "raw_data")


@query("microdata_properties", oracle("part_keys", MICRO + "SELECT url, position, parsed_data FROM element_items WHERE format = 'microdata'"))
def microdata_properties(spark, sf):
    return _items(spark, sf, "microdata").select("url", "position", "parsed_data")


@query("rdfa_items", oracle("part_keys", MICRO + RAW + "SELECT url, type, position, raw_data, problem FROM element_items JOIN raw USING (k, type) WHERE format = 'rdfa'"))
def rdfa_items(spark, sf):
    return _items(spark, sf, "rdfa").select("url", "type", "position", "raw_data", "problem")


@query("rdfa_properties", oracle("part_keys", MICRO + "SELECT url, position, parsed_data FROM element_items WHERE format = 'rdfa'"))
def rdfa_properties(spark, sf):
    return _items(spark, sf, "rdfa").select("url", "position", "parsed_data")


ALL_ITEMS = JSON_LD + MICRO + """, items AS (
    SELECT url, 'json-ld' AS format, kind AS type, position, parsed_data, problem FROM json_ld
    UNION ALL SELECT url, format, type, position, parsed_data, problem FROM element_items)"""


@query("structured_data", oracle("part_keys", ALL_ITEMS + "SELECT url, format, type, position, parsed_data, problem = '' AS is_valid, problem FROM items"))
def structured_data(spark, sf):
    return _items(spark, sf).select("url", "format", "type", "position", "parsed_data", "is_valid", "problem")


@query("schema_normalize", oracle("part_keys", JSON_LD + "SELECT url, position, parsed_data->>'$.offers.link' AS link, parsed_data->>'$.url' AS target FROM json_ld WHERE parsed_data IS NOT NULL"))
def schema_normalize(spark, sf):
    items = _items(spark, sf, "json-ld").filter(F.col("parsed_data").isNotNull())
    return items.select(
        "url", "position", F.get_json_object("parsed_data", "$.offers.link").alias("link"),
        F.get_json_object("parsed_data", "$.url").alias("target"),
    )


@query("schema_validate", oracle("part_keys", ALL_ITEMS + "SELECT url, format, position, problem FROM items WHERE problem <> ''"))
def schema_validate(spark, sf):
    return _items(spark, sf).filter(~F.col("is_valid")).select("url", "format", "position", "problem")


OFFER_RULES = [("Offer", "required", "price", 0), ("Offer", "required", "seller", 1), ("Organization", "url", "logo", 1)]


@query("schema_validate_rules", oracle("part_keys", ALL_ITEMS + """, checked AS (
        SELECT url, format, position, CASE WHEN type = 'Offer' THEN 'Offer missing required ''seller'' property' ELSE problem END AS problem FROM items)
        SELECT url, format, position, problem FROM checked WHERE problem <> ''"""))
def schema_validate_rules(spark, sf):
    """Validation by a table of rules: the built-in ones, a fifth type and one more URL key added as rows."""
    rules = structured.built_in_rules(spark).unionByName(spark.createDataFrame(OFFER_RULES, structured.RULES))
    return _items(spark, sf, rules=rules).filter(~F.col("is_valid")).select("url", "format", "position", "problem")


# All errors: those of ``problem``, but for the decoder its whole text, which says where the one brace too many stands.
ALL_ERRORS = """, errors AS (
    SELECT problem FROM items WHERE problem NOT IN ('', 'JSON decode error')
    UNION ALL SELECT 'JSON decode error: Extra data: line 1 column ' || (n + 1) || ' (char ' || n || ')' FROM (
      SELECT length('{"@type":' || CASE k % 11 WHEN 10 THEN '[]' WHEN 9 THEN '["http://schema.org/Product","Thing"]' ELSE '"https://schema.org/Product"' END
             || CASE WHEN k % 4 <> 1 THEN ',"name":"' || name || '"' ELSE '' END
             || CASE WHEN k % 4 <> 2 THEN ',"offers":{"price":' || k || ',"link":"/o/' || k || '"}' ELSE '' END
             || CASE WHEN k % 4 = 3 THEN ',"url":"part/' ELSE ',"url":"/part/' END || k || '"}') AS n FROM part_keys WHERE k % 7 = 6))"""


@query(
    "schema_statistics",
    oracle("part_keys", ALL_ITEMS + ALL_ERRORS + """SELECT CASE WHEN grouping(format) = 0 THEN 'format' WHEN grouping(type) = 0 THEN 'type' ELSE 'total' END AS level,
        format, type, NULL AS validation_error, count(*) AS total, count(*) FILTER (WHERE problem = '') AS valid_count, count(*) FILTER (WHERE problem <> '') AS invalid_count
        FROM items GROUP BY GROUPING SETS ((format), (type), ())
        UNION ALL SELECT 'validation_error', NULL, NULL, problem, count(*), 0, count(*) FROM errors GROUP BY problem"""),
)
def schema_statistics(spark, sf):
    return structured.schema_statistics(_items(spark, sf)).select(
        "level", "format", "type", "validation_error", "total", "valid_count", "invalid_count"
    )


@query(
    "schema_error_counts",
    oracle("part_keys", ALL_ITEMS + "SELECT problem, count(*) AS occurrences FROM items WHERE problem <> '' GROUP BY problem"),
)
def schema_error_counts(spark, sf):
    counts = structured.schema_error_counts(_items(spark, sf))
    # the decoder's wordings meet in one row; every other text is counted as it is
    return counts.groupBy(whole_text(F.col("validation_error")).alias("problem")).agg(F.sum("occurrences").alias("occurrences"))


# --- links -----------------------------------------------------------------------------------

LINKS = "page_urls nav_links page_links site_urls"


def _links(spark, sf):
    return links.page_links(d.keyed_variants(spark, sf))


@query(
    "internal_links",
    oracle(LINKS, """SELECT source_url, u.url AS target_url, anchor_text, xpath, href, url_fragment, url_parameters
        FROM variant_links LEFT JOIN site_urls u ON u.url = href WHERE variant_links.classification = 'internal'"""),
)
def internal_links(spark, sf):
    return links.internal_links(_links(spark, sf), d.site_urls(spark, sf)).select(
        "source_url", "target_url", "anchor_text", "xpath", "href", "url_fragment", "url_parameters"
    )


COUNTS = """SELECT source_url, count(*) FILTER (WHERE classification = 'internal') AS internal_links_count,
        count(*) FILTER (WHERE classification <> 'internal') AS external_links_count,
        count(DISTINCT href) FILTER (WHERE classification = 'internal') AS internal_links_unique_count,
        count(DISTINCT href) FILTER (WHERE classification <> 'internal') AS external_links_unique_count
        FROM variant_links GROUP BY source_url"""


@query("link_counts", oracle("page_urls nav_links page_links", f"SELECT * EXCLUDE (page_id) FROM ({COUNTS.replace('SELECT source_url', 'SELECT page_id, source_url').replace('BY source_url', 'BY page_id, source_url')})"))
def link_counts(spark, sf):
    return links.page_link_counts(d.keyed_variants(spark, sf))


@query("link_counts_of_table", oracle("page_urls nav_links page_links", COUNTS))
def link_counts_of_table(spark, sf):
    return links.link_counts(_links(spark, sf))


@query(
    "inlink_counts",
    oracle("page_urls nav_links page_links", """SELECT href AS url, count(*) AS inlinks_count, count(DISTINCT source_url) AS inlinks_unique_count
        FROM variant_links WHERE classification = 'internal' GROUP BY href"""),
)
def inlink_counts(spark, sf):
    own = links.page_links(d.keyed_variants(spark, sf), columns=["href", "classification"]).filter(F.col("classification") == "internal")
    return links.inlink_counts(own, target="href")


@query(
    "robots_directives",
    oracle(FIELDS, """SELECT url, 'html_meta' AS source, unnest(string_split(meta_robots, '|')) AS directive FROM page_fields WHERE meta_robots <> ''
        UNION ALL SELECT url, 'http_header', unnest(string_split(header_robots, '|')) FROM page_fields WHERE header_robots <> ''"""),
)
def robots_directives(spark, sf):
    return robots.robots_directives(_fields(spark, sf))


@query("canonicals", oracle(FIELDS, "SELECT url, canonical_url, 'html_head' AS source FROM page_fields WHERE canonical_url IS NOT NULL"))
def canonicals(spark, sf):
    return robots.canonicals(_fields(spark, sf))
