from urllib.parse import parse_qs, urljoin, urlparse, urlsplit, urlunparse, urlunsplit

import golden_urls as g
from pyspark.sql import functions as F

from silkgraph.functions import urls


def pairs(spark):
    rows = [(b, h) for b in g.BASES for h in g.HREFS]
    return rows, spark.createDataFrame(rows, "base string, href string").coalesce(1)


def test_resolve_equals_standard_library(spark):
    rows, df = pairs(spark)
    got = df.select(urls.url_resolve(F.col("base"), F.col("href"))).collect()
    for (base, href), (value,) in zip(rows, got):
        parts = list(urlsplit(urljoin(base, href)))
        parts[4] = ""
        assert value == urlunsplit(parts), (base, href)


def test_components(spark):
    rows, df = pairs(spark)
    got = df.select(urls.url_components(F.col("href"), F.col("base")).alias("c")).select("c.*").collect()
    for (base, href), row in zip(rows, got):
        p = urlparse(href)
        bare = urlunparse((p.scheme, p.netloc, p.path, p.params, "", ""))
        want = bare if p.netloc else urljoin(base, bare)
        params = "&".join(f"{k}={v[0]}" for k, v in parse_qs(p.query).items()) if p.query else None
        assert tuple(row) == (want, p.fragment or None, params), (base, href)


def test_storage_form(spark):
    cases = g.STORAGE + [urljoin(b, h) for b in g.BASES for h in g.HREFS]
    df = spark.createDataFrame([(u,) for u in cases], "url string").coalesce(1)
    once = urls.url_normalize_storage(F.col("url"))
    for url, (got, again) in zip(cases, df.select(once, urls.url_normalize_storage(once)).collect()):
        p = urlparse(url)
        want = urlunparse((p.scheme.lower(), p.netloc.lower(), p.path, p.params, p.query, ""))
        assert got == want, url
        assert again == got, url


def test_split(spark):
    cases = g.STORAGE + g.HREFS + g.BASES
    df = spark.createDataFrame([(u,) for u in cases], "url string").coalesce(1)
    for url, row in zip(cases, df.select(urls.url_split(F.col("url")).alias("u")).select("u.*").collect()):
        assert tuple(row) == tuple(urlsplit(url)), url


def test_kind(spark):
    cases = [
        (None, "http://h/a.PNG", "image"), ("text/html; charset=x", "http://h/a.png", "html"),
        ("application/xml; sitemap", "http://h/x", "sitemap"), ("application/xml", "http://h/sitemap.xml", "other"),
        (None, "http://h/a.js", "asset"), (None, "http://h/a.js?v=1", "other"), (None, "png", "other"),
        ("image/png", "http://h/x", "other"), (None, "http://h/f.woff2", "asset"), ("", "http://h/a.b.avif", "image"),
    ]
    df = spark.createDataFrame(cases, "ct string, url string, want string")
    for row in df.select("*", urls.url_kind(F.col("ct"), F.col("url")).alias("got")).collect():
        assert row.got == row.want, row


def test_classification(spark):
    cases = [
        ("https://www.h.example/", "h.example", False, "internal"), ("https://h.example/", "www.h.example", False, "internal"),
        ("https://sub.h.example/", "h.example", False, "external"), ("https://sub.h.example/", "h.example", True, "network"),
        ("https://x.com/a", "h.example", True, "social"), ("https://M.Facebook.com/a", "facebook.com", False, "social"),
        ("https://notx.com/", "h.example", False, "external"), ("https://h.example:8080/", "h.example", False, "external"),
        ("/relative", "h.example", False, "external"), ("https://www.www.h.example/", "www.h.example", False, "external"),
        ("https://zoom.us", "h.example", False, "social"), ("https://facebook.com:443/", "h.example", False, "external"),
    ]
    df = spark.createDataFrame(cases, "url string, base string, listed boolean, want string")
    got = df.select("*", urls.url_classification(F.col("url"), F.col("base"), F.col("listed")).alias("got"))
    for row in got.collect():
        assert row.got == row.want, row


def test_site_key(spark):
    cases = [("https://www.My-Shop.example.com/a", "my_shop_example_com"), ("http://h:8080/", "h_8080"), ("http://bücher.example/", "bücher_example")]
    df = spark.createDataFrame(cases, "url string, want string")
    for row in df.select("*", urls.site_key(F.col("url")).alias("got")).collect():
        assert row.got == row.want
