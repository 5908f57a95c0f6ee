"""Inputs derived from the driver tables: crawl data with everything the operators look at.

Each input is given twice, as a DataFrame and as DuckDB SQL (``ORACLE_INPUTS``), both over the whole
tables and from columns only, so that the two sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silkgraph.functions.urls import host
from silkgraph.operators.scale import spread
from silkgraph.operators.state import newest

ENTRIES_PER_SITEMAP = 50_000  # Fixed value: the sitemap protocol allows no more per file.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, fetched_at, seq) from ``events``."""
    user, kind = F.col("user_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(
        text("https://s", user % 10, ".example.com/p/", user).alias("url"),
        F.when(kind == "view", 200)
        .when(kind == "click", 301)
        .when(kind == "purchase", 404)
        .when(kind == "signup", 503)
        .otherwise(0)
        .alias("status"),
        F.col("ts").cast("timestamp").alias("fetched_at"),
        F.col("event_id").alias("seq"),
    )


def url_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, kind, classification, discovered_from, seen_at, seq, op) from ``events``."""
    seq = F.col("seq")
    names = F.array(*map(F.lit, ["html", "image", "asset", "other", "sitemap", "html"]))
    return fetch_log(spark, sf_dir).select(
        "url",
        F.when(seq % 3 != 0, F.element_at(names, (seq % 6 + 1).cast("int"))).alias("kind"),
        F.when(seq % 50 == 1, "network").when(seq % 7 == 0, "internal").otherwise("external").alias("classification"),
        F.when((seq % 3 != 0) & (seq % 4 != 0), text("https://s0.example.com/from/", seq % 100)).alias("discovered_from"),
        F.col("fetched_at").alias("seen_at"),
        "seq",
        F.when(seq % 3 == 0, "touch").otherwise("upsert").alias("op"),
    )


def frontier_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, depth, parent, op, at, seq) from ``events``; every seventh fetch also queues a page that no fetch ends."""
    seq = F.col("seq")
    log = fetch_log(spark, sf_dir)
    own = log.select(
        "url",
        (seq % 4).cast("int").alias("depth"),
        F.when(seq % 5 != 0, text("https://s0.example.com/from/", seq % 100)).alias("parent"),
        F.when(F.col("status").isin(200, 404), "done").otherwise("enqueue").alias("op"),
        F.col("fetched_at").alias("at"),
        "seq",
    )
    found = log.filter(seq % 7 == 3).select(
        text("https://s0.example.com/new/", seq % 1000).alias("url"), (seq % 4 + 1).cast("int").alias("depth"),
        F.col("url").alias("parent"), F.lit("enqueue").alias("op"), F.col("fetched_at").alias("at"), "seq",
    )
    return own.unionByName(found)


def page_source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table that pages come from; ``silkgraph.pages.partitions`` in the session spreads a small single
    file of page bodies, off by default."""
    partitions = spark.conf.get("silkgraph.pages.partitions", None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(partitions)) if partitions else rows


def part_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shop pages are made of, dealt over all cores: a row is a few bytes of its file and a whole page to read."""
    rows = page_source(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return rows if spark.conf.get("silkgraph.pages.partitions", None) else spread(rows)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source(spark, sf_dir, "pages")


EXTRA_LINKS = (
    '<a href="?page=2">next</a><a href="#top">top</a>'
    '<a href="https://www.facebook.com/share?u=1">fb</a><a href="//cdn.example.org/a.png">cdn</a>'
    '<a href="../up;v=1?q=a%20b&amp;q=c&amp;z=&amp;y=1+2#part"> up <b>one</b> </a>'
)


def page_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html, headers): ``pages`` with head tags, five more links, and headers."""
    k = F.col("page_id")
    description = text('<meta name="description" content=" About page ', k, ' ">')
    head = (
        F.when(k % 4 == 0, F.concat(description, text('<link rel="canonical" href="', F.col("url"), '">')))
        .when(k % 4 == 1, F.lit('<meta name="robots" content="noindex, Follow">'))
        .when(
            k % 4 == 2,
            F.concat(
                description,
                F.lit('<meta name="robots" content="INDEX,FOLLOW"><link rel="alternate canonical" href=" /c ">'),
            ),
        )
        .otherwise("")
    )
    tag = F.when(k % 5 == 0, "noindex").when(k % 5 == 1, "NoArchive, nofollow")
    html = F.replace(F.col("html"), F.lit("<head>"), F.concat(F.lit("<head>"), head))
    return pages(spark, sf_dir).select(
        k,
        "url",
        F.replace(html, F.lit("<body>"), F.lit("<body>" + EXTRA_LINKS)).alias("html"),
        F.when(tag.isNotNull(), F.create_map(F.lit("X-Robots-Tag"), tag))
        .otherwise(F.create_map(F.lit("Server"), F.lit("nginx")))
        .alias("headers"),
    )


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain) the hosts of ``pages``."""
    return pages(spark, sf_dir).select(host(F.col("url")).alias("domain")).distinct()


def robots_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, status, content): one of five files per host, by the length of its name."""
    d, n = F.col("domain"), F.length("domain") % 5
    sitemap = text("Sitemap: https://", d, "/sitemap_index.xml\n")
    return page_hosts(spark, sf_dir).select(
        d,
        F.when(n == 4, 404).otherwise(200).alias("status"),
        F.when(n == 0, F.concat(F.lit("User-agent: *\nDisallow:\n"), sitemap))
        .when(n == 1, "User-agent: *\r\nDisallow: /en/\r\n")
        .when(n == 2, F.concat(F.lit("User-agent: *\nAllow: /en/6*\nDisallow: /en/\n"), sitemap))
        .when(
            n == 3,
            F.concat(
                F.lit(
                    "# notes\nUser-agent: examplebot\nDisallow: /fr/\n\n"
                    "USER-AGENT : *\nCrawl-delay: 3\nDisallow: /es/\nAllow: /es/5\n"
                ),
                sitemap,
            ),
        )
        .otherwise("not found")
        .alias("content"),
    )


def sitemap_entries_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(domain, chunk, again, page_id, xml): the entries of the sitemaps; every tenth page stands
    twice, with other alternates the second time; some are not well-formed XML."""
    k, url = F.col("page_id"), F.col("url")
    # every ninth page is listed with a bare ampersand
    loc = F.when(k % 9 == 4, url).otherwise(F.replace(url, F.lit("&"), F.lit("&amp;")))

    def entry(links: Column) -> Column:
        return F.concat(F.lit("<url><loc> "), loc, F.lit("</loc>"), links, F.lit("</url>"))

    def link(lang: str, href: Column) -> Column:
        return F.concat(
            F.lit(f'<xhtml:link rel="alternate" hreflang="{lang}" href="'), href, F.lit('"/>')
        )

    base = pages(spark, sf_dir).withColumn("domain", host(url)).withColumn(
        "chunk", F.floor(k / ENTRIES_PER_SITEMAP)
    )
    first = F.when(
        k % 2 == 0,
        F.concat(link("en", loc), link("x-default", text("https://", F.col("domain"), "/"))),
    ).otherwise("")
    once = base.select("domain", "chunk", F.lit(0).alias("again"), k, entry(first).alias("xml"))
    twice = base.filter(k % 10 == 3).select(
        "domain", "chunk", F.lit(1).alias("again"), k,
        entry(F.concat(link("fr", F.concat(loc, F.lit("/"))), F.lit('<xhtml:link rel="alternate" href="/no-language"/>'))).alias("xml"),
    )
    return once.unionByName(twice)


def sitemap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, content): per host sitemaps of at most ENTRIES_PER_SITEMAP entries, an index of
    them, and an index of the index (with itself in it; missing for every third name length)."""
    entries = sitemap_entries_xml(spark, sf_dir)
    body = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("again", "page_id", "xml"))), lambda e: e["xml"]
        ),
        "",
    )
    n = F.length("domain")
    sheets = entries.groupBy("domain", "chunk").agg(body.alias("body"))
    # some files begin with an entry that cannot be read
    sheets = sheets.withColumn("body", F.concat(F.when(n % 3 == 1, "<url><loc>cut <b></loc></url>").otherwise(""), F.col("body")))
    sheets = sheets.select(
        "domain",
        text("https://", F.col("domain"), "/sitemap-", F.col("chunk"), ".xml").alias("url"),
        F.lit(200).alias("status"),
        F.concat(
            F.lit(
                '<?xml version="1.0" encoding="UTF-8"?><urlset '
                'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" '
                'xmlns:xhtml="http://www.w3.org/1999/xhtml">'
            ),
            F.col("body"),
            F.lit("</urlset>"),
        ).alias("content"),
    )
    # some files write all names with a prefix, and others than usual
    prefixed = F.regexp_replace(F.replace("content", F.lit("xhtml:"), F.lit("x:")), r"<(/?)(urlset|url|loc)\b", "<$1sm:$2")
    sheets = sheets.select("url", "status", F.when(n % 2 == 1, prefixed).otherwise(F.col("content")).alias("content"))
    d = F.col("domain")

    def index_of(children: Column) -> Column:
        plain = F.concat(
            F.lit('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'),
            children,
            F.lit("</sitemapindex>"),
        )
        names = r"<(/?)(sitemapindex|sitemap|loc)\b"
        dashed, dotted = F.regexp_replace(plain, names, "<$1s-m:$2"), F.regexp_replace(plain, names, "<$1s.m:$2")
        return F.when(F.length(d) % 4 == 1, dashed).when(F.length(d) % 4 == 3, dotted).otherwise(plain)

    def nested(url: Column) -> Column:
        return F.concat(F.lit("<sitemap><loc>"), url, F.lit("</loc></sitemap>"))

    chunks = entries.select("domain", "chunk").distinct().groupBy("domain").agg(
        F.array_sort(F.collect_list("chunk")).alias("chunks")
    )
    indexes = chunks.select(
        text("https://", d, "/sitemap_index.xml").alias("url"),
        F.lit(200).alias("status"),
        index_of(
            F.array_join(
                F.transform("chunks", lambda c: nested(text("https://", d, "/sitemap-", c, ".xml"))), ""
            )
        ).alias("content"),
    )
    tops = page_hosts(spark, sf_dir).select(
        text("https://", d, "/sitemap.xml").alias("url"),
        F.when(F.length(d) % 3 == 0, 404).otherwise(200).alias("status"),
        index_of(
            F.concat(
                nested(text("https://", d, "/sitemap.xml")),
                nested(text("https://", d, "/sitemap_index.xml")),
            )
        ).alias("content"),
    )
    return sheets.unionByName(indexes).unionByName(tops)


def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, page_id): the storage keys of the pages; of several pages under one key the last
    counts."""
    return (
        pages(spark, sf_dir)
        .groupBy(F.substring_index("url", "#", 1).alias("url"))
        .agg(F.max("page_id").alias("page_id"))
    )


def site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, kind, classification): the URL registry of the pages, keys in storage form."""
    k = F.col("page_id")
    return page_keys(spark, sf_dir).select(
        "url",
        F.lit("html").alias("kind"),
        F.when(k % 5 == 4, "external").when(k % 5 == 3, "network").otherwise("internal").alias("classification"),
    )


def keyed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_variants`` under their storage keys."""
    return page_variants(spark, sf_dir).withColumn("url", F.substring_index("url", "#", 1))


def settled(rows: DataFrame) -> DataFrame:
    """Rows with (url, page_id), one row per storage key. What is wanted of a page body is to be taken from
    it before, so that no body is moved."""
    return newest(rows.withColumn("url", F.substring_index("url", "#", 1)), ["url"], ["page_id"])


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_url, target_url, ord, crawlable) from ``customer``: cycles and repeats included."""
    c = F.col("c_custkey")
    targets = F.array(2 * c, 2 * c + 1, F.col("c_nationkey").cast("bigint") + 1)
    return (
        table(spark, sf_dir, "customer")
        .select(c.alias("s"), F.posexplode(targets).alias("ord", "t"))
        .select(
            text("https://l.example.com/c/", F.col("s")).alias("source_url"),
            text("https://l.example.com/c/", F.col("t")).alias("target_url"),
            "ord",
            (F.col("t") % 7 != 0).alias("crawlable"),
        )
    )


def redirect_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, status, location, headers) from ``part``: even keys lead to their half, odd ones end; keys that
    leave 46 and 48 (mod 50) lead to each other, a loop; halves ending in 5 were answered with 503."""
    k = F.col("p_partkey")
    ahead = F.when(k % 50 == 46, k + 2).when(k % 50 == 48, k - 2).otherwise(F.floor(k / 2))
    location = F.when(
        k % 2 == 0,
        F.when(k % 4 == 0, text("/p/", ahead)).otherwise(text("https://r.example.com/p/", ahead)),
    )
    return table(spark, sf_dir, "part").select(
        text("https://r.example.com/p/", k).alias("url"),
        F.when(k % 2 == 0, 301).when(k % 10 == 5, 503).otherwise(200).alias("status"),
        location.alias("location"),
        F.when(location.isNotNull(), F.create_map(F.lit("location"), location))
        .otherwise(F.create_map(F.lit("server"), F.lit("nginx")))
        .alias("headers"),
    )


def part_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, html) from ``part``: a shop page with JSON-LD, microdata and RDFa.

    JSON-LD by key: field left out or bad (mod 4), an array with a non-object (mod 7 = 5), broken
    (mod 7 = 6), an empty type list (mod 11 = 10), a type list (mod 11 = 9).
    """
    k, name = F.col("p_partkey"), F.col("p_name")
    kind = (
        F.when(k % 11 == 10, "[]")
        .when(k % 11 == 9, '["http://schema.org/Product","Thing"]')
        .otherwise('"https://schema.org/Product"')
    )
    product = F.concat(
        F.lit('{"@type":'), kind,
        F.when(k % 4 != 1, text(',"name":"', name, '"')).otherwise(""),
        F.when(k % 4 != 2, text(',"offers":{"price":', k, ',"link":"/o/', k, '"}')).otherwise(""),
        F.when(k % 4 == 3, text(',"url":"part/', k, '"')).otherwise(text(',"url":"/part/', k, '"')),
        F.lit("}"),
    )
    script = (
        F.when(k % 7 == 5, F.concat(F.lit("["), product, F.lit(',7,{"name":"x"}]')))
        .when(k % 7 == 6, F.concat(product, F.lit("}")))
        .otherwise(product)
    )
    micro = text(
        '<div itemscope itemtype="https://schema.org/Product"><span itemprop="name"> ', name,
        ' </span><a itemprop="url" href="/m/', k, '">x</a><i itemprop="tag">a</i><i itemprop="tag">b</i>'
        '<div itemscope></div><div itemprop="offers" itemscope itemtype="http://schema.org/Offer">'
        '<meta itemprop="price" content="', k, '"><time itemprop="until" datetime="2024-01-01">soon</time></div></div>',
    )
    rdfa = text(
        '<div vocab="https://schema.org/" typeof="Organization"><b property="https://schema.org/',
        F.when(k % 4 == 1, "legalName").otherwise("name"), '">', F.col("p_brand"),
        '</b><img property="logoUrl" src="', F.when(k % 4 == 2, "logo.png").otherwise("/logo.png"), '"></div>',
    )
    return part_source(spark, sf_dir).select(
        text("https://shop.example.com/part/", k).alias("url"),
        F.concat(
            F.lit("<html><head><title>"), name,
            F.lit('</title><script type="application/ld+json"> </script><script type="application/ld+json">'),
            script, F.lit("</script></head><body>"), micro, rdfa, F.lit("</body></html>"),
        ).alias("html"),
    )


PAGE_URLS = r"""
        SELECT page_id, url, html, split_part(url, '#', 1) AS key_url,
               regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain,
               regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS origin,
               regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages"""

ORACLE_INPUTS = {
    "fetch_log": """
        SELECT 'https://s' || (user_id % 10) || '.example.com/p/' || user_id AS url,
               CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301 WHEN 'purchase' THEN 404
                    WHEN 'signup' THEN 503 ELSE 0 END AS status,
               ts AS fetched_at, event_id AS seq FROM events""",
    "url_observations": """
        SELECT url,
               CASE WHEN seq % 3 <> 0 THEN ['html','image','asset','other','sitemap','html'][seq % 6 + 1] END AS kind,
               CASE WHEN seq % 50 = 1 THEN 'network' WHEN seq % 7 = 0 THEN 'internal' ELSE 'external' END AS classification,
               CASE WHEN seq % 3 <> 0 AND seq % 4 <> 0 THEN 'https://s0.example.com/from/' || (seq % 100) END AS discovered_from,
               fetched_at AS seen_at, seq,
               CASE WHEN seq % 3 = 0 THEN 'touch' ELSE 'upsert' END AS op FROM fetch_log""",
    "frontier_events": """
        SELECT url, seq % 4 AS depth,
               CASE WHEN seq % 5 <> 0 THEN 'https://s0.example.com/from/' || (seq % 100) END AS parent,
               CASE WHEN status IN (200, 404) THEN 'done' ELSE 'enqueue' END AS op,
               fetched_at AS at_time, seq FROM fetch_log
        UNION ALL SELECT 'https://s0.example.com/new/' || (seq % 1000), seq % 4 + 1, url, 'enqueue', fetched_at, seq FROM fetch_log WHERE seq % 7 = 3""",
    "page_urls": PAGE_URLS,
    "all_urls": PAGE_URLS,
    # Stands in for page_urls where the pages are stored: one per key.
    "stored_urls": PAGE_URLS + " QUALIFY row_number() OVER (PARTITION BY split_part(url, '#', 1) ORDER BY page_id DESC) = 1",
    "hosts": "SELECT DISTINCT domain FROM page_urls",
    "robots_txt": """
        SELECT domain, length(domain) % 5 AS form, CASE WHEN length(domain) % 5 = 4 THEN 404 ELSE 200 END AS status
        FROM hosts""",
    # What the files say, written down as data instead of being parsed.
    "robots_rules": """
        SELECT domain, position, agent, kind, path
        FROM robots_txt JOIN (VALUES
            (0, 0, '*', 'disallow', ''), (1, 0, '*', 'disallow', '/en/'),
            (2, 0, '*', 'allow', '/en/6*'), (2, 1, '*', 'disallow', '/en/'),
            (3, 0, 'examplebot', 'disallow', '/fr/'), (3, 1, '*', 'disallow', '/es/'),
            (3, 2, '*', 'allow', '/es/5')) v(form, position, agent, kind, path) USING (form)""",
    "sitemap_rows": """
        SELECT domain, page_id // 50000 AS chunk, page_id, url,
               'https://' || domain || '/sitemap-' || (page_id // 50000) || '.xml' AS sitemap_url,
               row_number() OVER (PARTITION BY domain, page_id // 50000 ORDER BY page_id) - 1 AS position,
               page_id % 10 = 3 AS twice, page_id % 2 = 0 AS even FROM all_urls""",
    "sitemap_alternates": """
        SELECT sitemap_url, url AS loc, split_part(url, '#', 1) AS url, 'fr' AS lang, url || '/' AS href_url FROM sitemap_rows WHERE twice
        UNION ALL SELECT sitemap_url, url, split_part(url, '#', 1), 'en', url FROM sitemap_rows WHERE even
        UNION ALL SELECT sitemap_url, url, split_part(url, '#', 1), 'x-default', 'https://' || domain || '/' FROM sitemap_rows WHERE even""",
    "site_urls": """
        SELECT split_part(url, '#', 1) AS url, 'html' AS kind,
               CASE max(page_id) % 5 WHEN 4 THEN 'external' WHEN 3 THEN 'network' ELSE 'internal' END AS classification
        FROM pages GROUP BY split_part(url, '#', 1)""",
    "nav_links": """
        SELECT page_id, url, key_url, domain, origin, path, unnest(hrefs) AS href, unnest(anchors) AS anchor,
               unnest(range(len(hrefs))) AS n, len(hrefs) AS links
        FROM (SELECT *, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs,
                     regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS anchors FROM page_urls)""",
    # The links of the variants: the five added ones first, then the navigation.
    "variant_links": r"""
        SELECT key_url AS source_url, domain, n + 5 AS link_no, href AS raw_href, origin || href AS link_url, anchor AS anchor_text,
               '/[document]/html/body/nav/ul/li' || CASE WHEN links > 1 THEN '[' || (n + 1) || ']' ELSE '' END || '/a' AS xpath,
               origin || href AS href, NULL AS url_fragment, NULL AS url_parameters, 'internal' AS classification FROM nav_links
        UNION ALL
        SELECT key_url, domain, link_no, raw_href,
               CASE link_no WHEN 0 THEN origin || path || '?page=2' WHEN 1 THEN key_url
                    WHEN 2 THEN raw_href WHEN 3 THEN split_part(key_url, ':', 1) || ':' || raw_href
                    ELSE origin || up || 'up;v=1?q=a%20b&q=c&z=&y=1+2' END,
               ['next','top','fb','cdn','upone'][link_no + 1], '/[document]/html/body/a[' || (link_no + 1) || ']',
               CASE link_no WHEN 2 THEN 'https://www.facebook.com/share' WHEN 3 THEN raw_href
                    WHEN 4 THEN origin || up || 'up;v=1' ELSE key_url END,
               CASE link_no WHEN 1 THEN 'top' WHEN 4 THEN 'part' END,
               CASE link_no WHEN 0 THEN 'page=2' WHEN 2 THEN 'u=1' WHEN 4 THEN 'q=a b&y=1 2' END,
               CASE link_no WHEN 2 THEN 'social' WHEN 3 THEN 'external' ELSE 'internal' END
        FROM (SELECT *, CASE WHEN path LIKE '%/%/%/' THEN regexp_replace(path, '[^/]+/$', '')
                             ELSE regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]+/$', '') END AS up FROM page_urls),
             (VALUES (0, '?page=2'), (1, '#top'), (2, 'https://www.facebook.com/share?u=1'), (3, '//cdn.example.org/a.png'),
                     (4, '../up;v=1?q=a%20b&q=c&z=&y=1+2#part')) v(link_no, raw_href)""",
    "page_fields": r"""
        SELECT page_id, url, key_url, domain, path, form, title, meta_description, h1, word_count, meta_robots, header_robots, canonical_url, html_lang
        FROM (SELECT *, length(domain) % 5 AS form,
               trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g')) AS title,
               CASE WHEN page_id % 4 IN (0, 2) THEN 'About page ' || page_id END AS meta_description,
               trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g')) AS h1,
               CASE page_id % 4 WHEN 1 THEN 'noindex|follow' WHEN 2 THEN 'index|follow' ELSE '' END AS meta_robots,
               CASE page_id % 5 WHEN 0 THEN 'noindex' WHEN 1 THEN 'noarchive|nofollow' ELSE '' END AS header_robots,
               CASE page_id % 4 WHEN 0 THEN url WHEN 2 THEN '/c' END AS canonical_url,
               regexp_extract(html, '<html lang="([^"]*)"', 1) AS html_lang,
               len(regexp_extract_all(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
                   '<(script|style)[^>]*>.*?</(script|style)>', '', 'gs'), '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs'),
                   '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '[^\s\x{a0}]+')) AS word_count
              FROM page_urls)""",
    "part_keys": "SELECT p_partkey AS k, p_name AS name, p_brand AS brand, 'https://shop.example.com/part/' || p_partkey AS url FROM part",
    "redirect_responses": """
        SELECT k, 'https://r.example.com/p/' || k AS url, CASE WHEN k % 2 = 0 THEN 301 WHEN k % 10 = 5 THEN 503 ELSE 200 END AS status, ahead,
               CASE WHEN k % 2 = 1 THEN 'server=nginx' WHEN k % 4 = 0 THEN 'location=/p/' || ahead ELSE 'location=https://r.example.com/p/' || ahead END AS header
        FROM (SELECT p_partkey AS k, CASE p_partkey % 50 WHEN 46 THEN p_partkey + 2 WHEN 48 THEN p_partkey - 2 ELSE p_partkey // 2 END AS ahead FROM part)""",
    "link_edges": """
        SELECT c_custkey AS s, unnest([2 * c_custkey, 2 * c_custkey + 1, c_nationkey + 1]) AS t, unnest([0, 1, 2]) AS ord FROM customer""",
}

# The links of all pages, beside those of the stored ones.
ORACLE_INPUTS["all_nav_links"] = ORACLE_INPUTS["nav_links"].replace("FROM page_urls", "FROM all_urls")
ORACLE_INPUTS["all_variant_links"] = ORACLE_INPUTS["variant_links"].replace("FROM page_urls", "FROM all_urls").replace("FROM nav_links", "FROM all_nav_links")
# Stands in for variant_links where pages under the same key are told apart.
ORACLE_INPUTS["page_links"] = (
    ORACLE_INPUTS["variant_links"].replace("SELECT key_url AS source_url", "SELECT page_id, key_url AS source_url").replace("SELECT key_url, domain, link_no", "SELECT page_id, key_url, domain, link_no")
)


def oracle(inputs: str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named inputs, in order, as common table expressions."""
    called = {"stored_urls": "page_urls", "page_links": "variant_links"}
    ctes = [f"{called.get(n, n)} AS ({ORACLE_INPUTS[n].strip()})" for n in inputs.split()]
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}" if ctes else ""
    if body.lstrip().upper().startswith("WITH "):
        raise ValueError("give further common table expressions with a leading comma")
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"
