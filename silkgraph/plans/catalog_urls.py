"""Queries over the URL and header functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from silkgraph.functions import http, urls
from silkgraph.operators.robots import robots_allowed
from silkgraph.plans.registry import long, query
from silkgraph.sources import derived as d
from silkgraph.sources.derived import oracle

REGEX = r"'^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?'"


@query(
    "url_split",
    f"""SELECT page_id, regexp_extract(url, {REGEX}, 2) AS scheme, regexp_extract(url, {REGEX}, 4) AS netloc,
        regexp_extract(url, {REGEX}, 5) AS path, regexp_extract(url, {REGEX}, 7) AS query,
        regexp_extract(url, {REGEX}, 9) AS fragment FROM pages""",
)
def url_split(spark, sf):
    return d.pages(spark, sf).select("page_id", urls.url_split(F.col("url")).alias("u")).select("page_id", "u.*")


@query("url_resolve", oracle("page_urls nav_links page_links", "SELECT source_url, link_no, raw_href, link_url FROM variant_links"))
def url_resolve(spark, sf):
    from silkgraph.operators.links import page_links

    # The raw href is resolved again by the Column function, apart from the staged operator.
    links = page_links(d.keyed_variants(spark, sf))
    return links.select(
        "source_url", long("link_no").alias("link_no"), "raw_href",
        urls.url_resolve(F.col("source_url"), F.col("raw_href")).alias("link_url"),
    )


@query("url_normalize_storage", "SELECT page_id, split_part(url, '#', 1) AS storage_url FROM pages")
def url_normalize_storage(spark, sf):
    scheme, host = urls.scheme(F.col("url")), urls.netloc(F.col("url"))
    tail = F.expr("substring(url, length(regexp_extract(url, '^[a-z]+://[^/?#]*', 0)) + 1)")
    loud = F.concat(F.upper(scheme), F.lit("://"), F.upper(host), tail)
    return d.pages(spark, sf).select("page_id", urls.url_normalize_storage(loud).alias("storage_url"))


@query(
    "url_kind",
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'html' ELSE
         CASE page_id % 8 WHEN 0 THEN 'image' WHEN 1 THEN 'image' WHEN 2 THEN 'asset' WHEN 3 THEN 'asset'
              WHEN 4 THEN 'asset' ELSE 'other' END END AS kind FROM pages""",
)
def url_kind(spark, sf):
    k = F.col("page_id")
    content_type = (
        F.when(k % 6 == 0, "Application/Sitemap+XML").when(k % 6 == 1, "text/HTML; charset=utf-8")
        .when(k % 6 == 2, "application/xml").when(k % 6 == 3, "image/png")
    )
    names = ["/logo.PNG", "/a.b.svg", "/site.css", "/x.woff2", "/doc.Pdf", "/x.png?v=1", "/page", "/png"]
    url = F.concat("url", F.element_at(F.array(*map(F.lit, names)), (k % 8 + 1).cast("int")))
    return d.pages(spark, sf).select("page_id", urls.url_kind(content_type, url).alias("kind"))


@query(
    "url_classification",
    oracle("page_urls", """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'internal' WHEN 1 THEN 'internal'
        WHEN 2 THEN 'social' WHEN 3 THEN 'external' WHEN 4 THEN 'network' ELSE 'social' END AS classification FROM page_urls"""),
)
def url_classification(spark, sf):
    k, own = F.col("page_id"), urls.host(F.col("url"))
    bare = F.regexp_replace(own, r"^www\.", "")
    target = (
        F.when(k % 6 == 0, F.concat(F.lit("https://"), F.upper(bare), F.lit("/x")))
        .when(k % 6 == 1, F.concat(F.lit("http://www."), bare))
        .when(k % 6 == 2, F.lit("https://m.facebook.com/share"))
        .when(k % 6 == 3, F.lit("https://notx.com/"))
        .when(k % 6 == 4, F.lit("https://other.example.edu/"))
        .otherwise(F.lit("http://X.com/user"))
    )
    return d.pages(spark, sf).select(
        "page_id", urls.url_classification(target, own, k % 6 == 4).alias("classification")
    )


@query(
    "url_components",
    oracle("page_urls", """SELECT page_id,
        CASE WHEN page_id % 3 = 2 THEN 'http://h.example/p' ELSE origin || '/a/' || page_id || ';v=1' END AS href,
        CASE WHEN page_id % 3 = 0 THEN 'frag' END AS url_fragment,
        CASE page_id % 3 WHEN 0 THEN 'q=' || page_id || '&c= x&d e=1%zz' WHEN 1 THEN '' END AS url_parameters FROM page_urls"""),
)
def url_components(spark, sf):
    k = F.col("page_id")
    href = (
        F.when(k % 3 == 0, d.text("/a/", k, ";v=1?q=", k, "&q=z&b=&c=%20x&flag&d+e=1%zz#frag"))
        .when(k % 3 == 1, d.text("/a/", k, ";v=1?b=&flag"))
        .otherwise("http://h.example/p")
    )
    return d.pages(spark, sf).select(
        "page_id", urls.url_components(href, F.col("url")).alias("c")
    ).select("page_id", "c.*")


@query(
    "site_key",
    oracle("page_urls", r"""SELECT page_id, regexp_replace(regexp_replace(domain, '^www\.', ''), '[^a-z0-9_]', '_', 'g') AS site FROM page_urls"""),
)
def site_key(spark, sf):
    return d.pages(spark, sf).select("page_id", urls.site_key(F.col("url")).alias("site"))


@query("same_host", "SELECT page_id, true AS upper_case, page_id % 2 = 0 AS other FROM pages")
def same_host(spark, sf):
    url, own = F.col("url"), urls.netloc(F.col("url"))
    other = F.when(F.col("page_id") % 2 == 0, own).otherwise(F.concat(F.lit("x"), own))
    return d.pages(spark, sf).select(
        "page_id",
        urls.same_host(url, F.concat(F.lit("HTTP://"), F.upper(own), F.lit("/a?b"))).alias("upper_case"),
        urls.same_host(url, F.concat(F.lit("//"), other)).alias("other"),
    )


@query(
    "headers_normalize",
    """SELECT page_id, 'text/html' AS content_type, 'e' || page_id AS etag, CASE WHEN page_id % 2 = 0 THEN 'nginx' END AS server,
        CASE WHEN page_id % 2 = 0 THEN 3 ELSE 2 END AS kept FROM pages""",
)
def headers_normalize(spark, sf):
    k = F.col("page_id")
    etag = d.text(" e", k, " ")
    raw = F.when(
        k % 2 == 0,
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("ETAG"), etag, F.lit("Server"), F.lit("nginx"),
            F.lit("Set-Cookie"), F.lit("a=b"),
        ),
    ).otherwise(
        F.create_map(F.lit("CONTENT-TYPE"), F.lit("x"), F.lit("content-type"), F.lit("text/html "), F.lit("ETag"), etag)
    )
    return d.pages(spark, sf).select("page_id", http.headers_normalize(raw).alias("h")).select(
        "page_id",
        F.col("h")["content-type"].alias("content_type"),
        F.col("h")["etag"].alias("etag"),
        F.col("h")["server"].alias("server"),
        long(F.size("h")).alias("kept"),
    )


ALLOWED = r"""
    CASE form WHEN 1 THEN NOT starts_with(path, '/en/') WHEN 2 THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/6')
         WHEN 3 THEN NOT starts_with(path, '/es/') ELSE true END"""


@query(
    "crawl_policy",
    oracle("page_urls", f"""SELECT page_id, classification,
          CASE classification WHEN 'internal' THEN allowed WHEN 'network' THEN allowed ELSE false END AS crawl,
          CASE classification WHEN 'internal' THEN allowed WHEN 'network' THEN allowed WHEN 'external' THEN true ELSE false END AS crawl_offsite
        FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'internal' WHEN 1 THEN 'network' WHEN 2 THEN 'external' ELSE 'social' END AS classification,
              {ALLOWED} AS allowed FROM (SELECT *, length(domain) % 5 AS form FROM page_urls))"""),
)
def crawl_policy(spark, sf):
    k = F.col("page_id")
    pages = d.pages(spark, sf).select(
        k, "url",
        F.when(k % 4 == 0, "internal").when(k % 4 == 1, "network").when(k % 4 == 2, "external")
        .otherwise("social").alias("classification"),
    )
    answered = robots_allowed(pages, d.robots_txt(spark, sf))
    cls, ok = F.col("classification"), F.col("robots_allowed")
    return answered.select(
        "page_id", "classification",
        urls.crawl_policy(cls, ok).alias("crawl"),
        urls.crawl_policy(cls, ok, allow_external=True).alias("crawl_offsite"),
    )
