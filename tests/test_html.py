from pyspark.sql import functions as F

from silkgraph.operators import content, dom, links
from silkgraph.operators.robots import canonicals, robots_directives


def page(spark, html, headers=None, url="http://h.example/d/p?x=1#f"):
    schema = "url string, html string, headers map<string,string>"
    return spark.createDataFrame([(url, html, headers or {})], schema)


def fields(spark, html, headers=None, gate=False):
    rows = content.page_content(page(spark, html, headers), gate).collect()
    return rows[0].asDict() if rows else None


def test_no_title_and_empty_page(spark):
    got = fields(spark, "<html lang=' de '><body>one <b>two</b>three</body></html>")
    assert (got["title"], got["html_lang"], got["word_count"], got["h1_tags"]) == (None, "de", 2, [])
    assert fields(spark, "")["word_count"] == 0
    assert fields(spark, None)["title"] is None
    assert fields(spark, "<p>text only</p>", gate=True) is None


def test_title_headings_and_words(spark):
    html = (
        "<HTML><HEAD><TITLE> A &amp; B&nbsp;</TITLE><style>p{}</style></HEAD><BODY><!-- no words here -->"
        "<H1> </H1><h1>x <i>y</i>\n<u>z</u></h1><h2>s<script>var a;</script>t</h2>"
        "<script>if (a < b) { '<h1>no</h1>' }</script><p>glued</p><p>words</p><template>hidden</template></BODY></HTML>"
    )
    got = fields(spark, html)
    assert got["title"] == "A & B"
    assert got["h1_tags"] == ["x y\nz"]
    assert got["h2_tags"] == ["st"]
    # A, &, B, then " x", y, "z" + "st" + "gluedwords" run together.
    assert got["word_count"] == 6
    assert got["html_lang"] == ""


def test_description_robots_canonical(spark):
    html = (
        "<head><meta name=description content=' d1 '><meta name=description content=d2>"
        "<meta name=robots content=' NoIndex ,follow,'><link rel='shortcut icon' href=/i>"
        "<link rel='a canonical' href=' /c '><link rel=canonical href=/second></head>"
    )
    got = fields(spark, html, {"x-ROBOTS-tag": "None, NOARCHIVE"})
    assert got["meta_description"] == "d1"
    assert got["html_meta_directives"] == ["noindex", "follow", ""]
    assert got["http_header_directives"] == ["none", "noarchive"]
    assert got["canonical_url"] == "/c"
    bare = fields(spark, "<meta name=description><title></title>")
    assert (bare["meta_description"], bare["title"], bare["html_meta_directives"]) == ("", "", [])


def test_directive_and_canonical_tables(spark):
    rows = content.page_content(
        page(spark, "<title>t</title><meta name=robots content='a,a,b'><link rel=canonical href=x>", {"X-Robots-Tag": "c"})
    )
    assert sorted(map(tuple, robots_directives(rows).drop("url").collect())) == [
        ("html_meta", "a"), ("html_meta", "b"), ("http_header", "c"),
    ]
    assert canonicals(rows).first()["canonical_url"] == "x"


def test_nodes_nesting(spark):
    html = "<div><p>a<br>b<p>c</div><i>d</p>e</i></b>"
    got = [
        (n.ord, n.parent_ord, n.subtree_end, n.tag, n.text_pieces)
        for n in dom.html_nodes(page(spark, html), dom.wanted(text_tags=("div", "i", "p"))).collect()
    ]
    assert got == [
        (0, -1, 3, "div", ["a", "b", "c"]), (1, 0, 3, "p", ["a", "b", "c"]), (2, 1, 2, "br", None),
        (3, 1, 3, "p", ["c"]), (4, -1, 4, "i", ["d", "e"]),
    ]


def test_links_in_order_with_duplicates(spark):
    html = (
        "<a href='x'> one <b> two </b></a><a name=n>skip</a><a href=''>self</a><a HREF='x'>again</a>"
        "<a href='//o.example/q'>o</a><a href='mailto:a@b'>m</a>"
    )
    rows = links.extract_links_detailed(page(spark, html)).orderBy("link_no").collect()
    assert [(r.link_no, r.target_url, r.anchor_text, r.href) for r in rows] == [
        (0, "http://h.example/d/x", "onetwo", "x"), (1, "http://h.example/d/p?x=1", "self", ""),
        (2, "http://h.example/d/x", "again", "x"), (3, "http://o.example/q", "o", "//o.example/q"),
        (4, "mailto:a@b", "m", "mailto:a@b"),
    ]
    assert [r.target_url for r in links.extract_links(page(spark, html)).orderBy("link_no").collect()] == [
        r.target_url for r in rows
    ]


def test_xpath(spark):
    html = "<html><body><div><a href=1>x</a></div><div><ul><li><a href=2>x</a></li><li><p><a href=3>x</a><a href=4>y</a></p></li></ul></div></body></html>"
    rows = links.extract_links_detailed(page(spark, html)).orderBy("link_no").collect()
    root = "/[document]/html/body/"
    assert [r.xpath for r in rows] == [
        root + "div[1]/a", root + "div[2]/ul/li[1]/a", root + "div[2]/ul/li[2]/p/a[1]", root + "div[2]/ul/li[2]/p/a[2]",
    ]


def test_link_counts_and_internal_links(spark):
    html = "<a href='/a?1'>1</a><a href='/a?2'>2</a><a href='http://other.example/'>3</a><a href='https://x.com/'>4</a>"
    found = links.page_links(page(spark, html))
    row = links.link_counts(found).first()
    assert (row.internal_links_count, row.external_links_count) == (2, 2)
    assert (row.internal_links_unique_count, row.external_links_unique_count) == (1, 2)
    known = spark.createDataFrame([("http://h.example/a",)], "url string")
    got = links.internal_links(found, known).orderBy("link_no").collect()
    assert [(r.target_url, r.url_parameters) for r in got] == [("http://h.example/a", ""), ("http://h.example/a", "")]


def test_inlinks(spark):
    edges = spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "t"), ("b", None)], "source_url string, target_url string")
    assert [tuple(r) for r in links.inlink_counts(edges).collect()] == [("t", 3, 2)]


def test_base_domain_argument(spark):
    found = links.page_links(page(spark, "<a href='/a'>1</a>"), base_domain=F.lit("elsewhere.example"))
    assert found.first()["classification"] == "external"
