from pyspark.sql import functions as F

from silkgraph.operators import robots, sitemaps
from silkgraph.operators.scale import row_ranks


def files(spark, *contents, status=200):
    return spark.createDataFrame([(f"h{i}", status, c) for i, c in enumerate(contents)], "domain string, status int, content string")


def allowed(spark, content, path, agent="*", status=200):
    urls = spark.createDataFrame([(f"http://h0{path}",)], "url string")
    return robots.robots_allowed(urls, files(spark, content, status=status), agent).first()["robots_allowed"]


def test_rules_table(spark):
    text = "Disallow: /early\r\n# c\r\nUser-Agent: a\rUser-agent: b\nDisallow: /x # note\n\nAllow:/y\nnonsense\nUser-agent:\nDisallow: /z\nUSER-AGENT : *\nSitemap: http://s\nDisallow:\n"
    rows = robots.robots_rules(files(spark, text)).orderBy("position").collect()
    assert [(r.agent, r.kind, r.path) for r in rows] == [
        ("b", "disallow", "/x # note"), ("b", "allow", "/y"), ("*", "disallow", ""),
    ]


def test_allowed(spark):
    assert allowed(spark, "User-agent: *\nDisallow:", "/a")
    assert not allowed(spark, "User-agent: *\nDisallow: /", "")
    assert not allowed(spark, "User-agent: *\nDisallow: /a*", "/abc")
    assert allowed(spark, "User-agent: *\nDisallow: /a*b", "/axb")
    assert allowed(spark, "User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b/c")
    assert not allowed(spark, "User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c")
    assert not allowed(spark, "User-agent: bot\nDisallow: /a\nUser-agent: *\nAllow: /", "/a", "bot")
    assert allowed(spark, "User-agent: bot\nDisallow: /a\nUser-agent: *\nAllow: /", "/a", "Bot")
    assert allowed(spark, "User-agent: *\nDisallow: /", "/a", status=404)
    assert allowed(spark, "", "/a?/private")
    assert allowed(spark, "User-agent: *\nDisallow: /*?q", "/a?q")


def sitemap(spark, *pairs):
    return spark.createDataFrame([(u, 200, c) for u, c in pairs], "url string, status int, content string")


URLSET = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:xhtml="http://www.w3.org/1999/xhtml">{}</urlset>'


def test_sitemaps_lose_nothing_to_prefixes_and_bad_entries(spark):
    prefixed = '<sm:urlset xmlns:sm="x" xmlns:alt="y"><sm:url><sm:loc>http://h/1</sm:loc><alt:link rel="alternate" hreflang="en" href="http://h/e?a=1&b=2"/></sm:url><!-- <sm:url><sm:loc>no</sm:loc></sm:url> --></sm:urlset>'
    index = '<sm:sitemapindex xmlns:sm="x"><sm:sitemap><sm:loc>http://h/s</sm:loc></sm:sitemap></sm:sitemapindex>'
    bare = "<urlset><url><loc>http://h/a?x=1&y=2</loc></url><url><loc>bad <b></loc></url><url/><url><loc><![CDATA[http://h/b?p&q]]></loc></url><url><loc>http://h/&#38;c&quot;</loc></url><url><lastmod>1</lastmod></url></urlset>"
    cut = "<urlset><url><loc>http://h/1</loc></url><url><loc>http://h/2</lo"
    rows = sitemap(spark, ("p", prefixed), ("i", index), ("b", bare), ("c", cut), ("n", None))
    read = {r.sitemap_url: ([(e.loc, [tuple(a) for a in e.alternates]) for e in r.entries or []], r.nested, r.unreadable) for r in sitemaps.read_files(rows).collect()}
    assert read["p"] == ([("http://h/1", [("en", "http://h/e?a=1&b=2")])], [], 0)
    assert read["i"] == ([], ["http://h/s"], 0)
    assert read["b"] == ([("http://h/a?x=1&y=2", []), ("http://h/b?p&q", []), ('http://h/&c"', [])], [], 2)
    assert read["c"] == ([("http://h/1", [])], [], 1)
    assert {r.url: r.kind for r in sitemaps.sitemap_kind(rows).collect()} == {"p": "sitemap", "i": "sitemap_index", "b": "sitemap", "c": "sitemap", "n": "sitemap"}
    assert [r.loc for r in sitemaps.sitemap_locs(rows).filter("url = 'i'").collect()] == ["http://h/s"]


def test_sitemap_entries(spark):
    body = (
        "<url><loc> http://h/1 </loc><xhtml:link rel='alternate' hreflang='en' href='http://h/en'/></url><url><loc></loc></url><url/>"
        "<url><loc><![CDATA[http://h/2?a=1&b]]></loc><xhtml:link hreflang='de'/><xhtml:link href='/x'/></url>"
        "<url><loc>http://h/1</loc><xhtml:link rel='alternate' hreflang='fr' href='http://h/fr'/></url>"
    )
    rows = sitemaps.sitemap_entries(sitemap(spark, ("s", URLSET.format(body)))).orderBy("position").collect()
    assert [(r.loc, r.position, [tuple(a) for a in r.alternates]) for r in rows] == [
        ("http://h/1", 0, [("fr", "http://h/fr")]), ("http://h/2?a=1&b", 1, []),
    ]


def test_broken_and_mixed_files(spark):
    cut_off = URLSET.format("<url><loc>http://h/1</loc></url><url><loc>http://h/2")[: -len("</urlset>") - 3]
    mixed = "<x><sitemap><loc>http://h/s</loc></sitemap><url><loc>http://h/u</loc></url></x>"
    rows = sitemap(spark, ("cut", cut_off), ("mixed", mixed), ("junk", "hello"), ("empty", ""), ("null", None))
    read = {r.sitemap_url: ([e.loc for e in r.entries or []], r.nested) for r in sitemaps.read_files(rows).collect()}
    assert read["cut"] == (["http://h/1"], [])
    assert read["mixed"] == ([], ["http://h/s"])
    assert read["junk"] == ([], []) and read["empty"] == ([], [])
    kinds = {r.url: r.kind for r in sitemaps.sitemap_kind(rows).collect()}
    assert set(kinds.values()) == {"sitemap"}
    assert {r.url for r in sitemaps.sitemap_locs(rows).collect()} == {"mixed", "cut"}
    index = "<?xml version='1.0'?><!-- c --><SitemapIndex><sitemap><loc>a</loc></sitemap></SitemapIndex>"
    assert sitemaps.sitemap_kind(sitemap(spark, ("i", index))).first()["kind"] == "sitemap_index"


def test_closure_order(spark):
    index = "<sitemapindex>{}</sitemapindex>"
    entry = "<sitemap><loc>{}</loc></sitemap>"
    leaf = "<urlset>{}</urlset>"
    url = "<url><loc>{}</loc></url>"
    rows = sitemap(
        spark,
        ("top", index.format(entry.format("b") + entry.format("top") + entry.format("idx") + entry.format("a"))),
        ("idx", index.format(entry.format("c") + entry.format("a"))),
        ("a", leaf.format(url.format("1") + url.format("2"))), ("b", leaf.format(url.format("2") + url.format("3"))),
        ("c", leaf.format(url.format("3") + url.format("4"))),
    )
    starts = spark.createDataFrame([("s", 0, "top"), ("t", 0, "a"), ("t", 1, "missing")], "site string, position int, sitemap_url string")
    closure = sitemaps.sitemap_closure(starts, rows)
    listing = sitemaps.sitemap_listing(closure).orderBy("site", "sitemap_position").collect()
    # Walk: top, b, idx, a, c. First places 2 3 1 4; sources of the last listing.
    assert [(r.site, r.url, r.sitemap_url) for r in listing] == [
        ("s", "2", "a"), ("s", "3", "c"), ("s", "1", "a"), ("s", "4", "c"), ("t", "1", "a"), ("t", "2", "a"),
    ]
    assert [r.sitemap_position for r in listing] == [0, 1, 2, 3, 0, 1]


def test_discovery(spark):
    robots_rows = files(spark, "Sitemap: http://h0/a\nSITEMAP : no\nsitemap:http://h0/b\nSitemap:", "User-agent: *")
    found = sitemap(spark, ("https://h1/sitemaps.xml", "x"), ("https://h1/sitemap_index.xml", "x"), ("https://h0/sitemap.xml", "x"))
    domains = spark.createDataFrame([("h0",), ("h1",), ("h2",)], "domain string")
    got = sitemaps.sitemap_discovery(domains, robots_rows, found).orderBy("site", "position").collect()
    assert [tuple(r) for r in got] == [("h0", 0, "http://h0/a"), ("h0", 1, "http://h0/b"), ("h1", 0, "https://h1/sitemap_index.xml")]
    only_places = sitemaps.sitemap_discovery(domains, robots_rows, found, skip_robots=True).orderBy("site").collect()
    assert [r.sitemap_url for r in only_places] == ["https://h0/sitemap.xml", "https://h1/sitemap_index.xml"]


def test_ranks_with_a_hot_group(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 100)).alias("g"),
        F.xxhash64("id").alias("v"), "id",
    )
    ranked = row_ranks(rows, [F.col("v")], ["g"]).toPandas()
    want = ranked.sort_values(["g", "v"]).groupby("g").cumcount()
    assert (ranked.sort_values(["g", "v"])["rank"] == want).all() and len(ranked) == 30_000
    whole = row_ranks(rows, [F.col("v")]).toPandas().sort_values("v")["rank"].tolist()
    assert whole == list(range(30_000))
