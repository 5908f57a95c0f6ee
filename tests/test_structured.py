import json
from collections import Counter

from silkgraph.functions.element_rows import page_record
from silkgraph.operators.dom import wanted_items
from silkgraph.operators.structured import FORMATS, schema_error_counts, schema_statistics, structured_data
from silkgraph.plans.catalog import QUERIES
from silkgraph.sources import derived as d

URL = "http://h.example/dir/p"


def items(spark, html, *formats):
    pages = spark.createDataFrame([(URL, html)], "url string, html string")
    rows = structured_data(pages, formats or ("json-ld", "microdata", "rdfa")).collect()
    return [r.asDict() for r in rows]


def script(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_json_ld_shapes(spark):
    html = (
        script(" ") + script('{"@type":"http://schema.org/Article","headline":"h","author":""}')
        + script('[{"@type":["Organization","Thing"],"name":"n"}, 5, {"@graph":[{"@type":"Product"}]}]')
        + script("{broken") + script('[{"name":"kept"},{"@type":[]},{"name":"lost"}]') + script('{"@type":""}')
        + script('{}')
    )
    got = items(spark, html, "json-ld")
    brief = [(i["type"], i["position"], i["is_valid"], i["validation_errors"]) for i in got]
    assert brief == [
        ("Article", 1, False, ["Article missing required 'author' property"]),
        ("Organization", 200, True, []),
        ("Unknown", 202, True, []),
        ("InvalidJSON", 3, False, ["JSON decode error: Expecting property name enclosed in double quotes: line 1 column 2 (char 1)"]),
        ("Unknown", 400, True, []),
        ("ParseError", 4, False, ["Parse error: 'list' object has no attribute 'lower'"]),
        ("", 5, True, []),
        ("Unknown", 6, True, []),
    ]
    assert got[5]["raw_data"] == script('[{"name":"kept"},{"@type":[]},{"name":"lost"}]')
    assert got[3]["parsed_data"] is None and got[7]["parsed_data"] is None


def test_json_ld_relative_values(spark):
    data = '{"@type":"X","url":"/a","o":{"u":"/b"},"l":["/c",{"u":"/d"},[{"u":"/e"}]],"dup":1,"dup":2,"badUrl":"q","n":NaN}'
    (item,) = items(spark, script(data))
    want = {"@type": "X", "url": "http://h.example/a", "o": {"u": "http://h.example/b"},
            "l": ["/c", {"u": "http://h.example/d"}, [{"u": "/e"}]], "dup": 2, "badUrl": "q"}
    parsed = json.loads(item["parsed_data"])
    assert parsed.pop("n") != 0
    assert parsed == want
    assert item["validation_errors"] == ["Invalid URL format for badUrl: q"]


def test_required_fields(spark):
    html = script('[{"@type":"PRODUCT"},{"@type":"breadcrumblist"},{"@type":"organization","name":""},{"@type":"article","headline":[],"author":{}}]')
    assert [i["validation_errors"] for i in items(spark, html)] == [
        ["Product missing required 'name' property", "Product missing required 'offers' property"],
        ["BreadcrumbList missing required 'itemListElement' property"],
        ["Organization missing required 'name' property"],
        ["Article missing required 'headline' property", "Article missing required 'author' property"],
    ]


MICRO = """<div itemscope itemtype="https://schema.org/Product" id=p><h1 itemprop="name"> A <b> B </b></h1>
<div itemscope></div><img itemprop="image" src="/i.png"><img itemprop="image" src="j.png"><a itemprop="url" href="/u#f">t</a>
<meta itemprop="sku" content=""><time itemprop="made">May</time><time itemprop="sold" datetime="2024">x</time>
<div itemprop="offers" itemscope itemtype="http://schema.org/Offer"><span itemprop="price">9 "q"</span><span itemprop="">no</span></div></div>
<p itemscope itemtype="">none</p>"""


def test_microdata(spark):
    product, offer = items(spark, MICRO)
    assert (product["type"], product["position"], offer["type"], offer["position"]) == ("Product", 0, "Offer", 2)
    assert json.loads(product["parsed_data"]) == {
        "@type": "Product", "name": "AB", "image": ["http://h.example/i.png", "j.png"], "url": "http://h.example/u#f",
        "sku": "", "made": "May", "sold": "2024", "offers": '9 "q"no', "price": '9 "q"',
    }
    assert json.loads(offer["parsed_data"]) == {"@type": "Offer", "price": '9 "q"'}
    assert product["is_valid"] and list(json.loads(product["parsed_data"]))[:3] == ["@type", "name", "image"]
    assert product["raw_data"].startswith('<div itemscope itemtype="https') and product["raw_data"].endswith("</span></div></div>")
    assert offer["raw_data"].startswith('<div itemprop="offers"') and offer["raw_data"].endswith("no</span></div>")


def test_rdfa(spark):
    html = '<div typeof="schema:Thing"><i property="https://schema.org/name">x</i><b property="https://schema.org/pageUrl">rel</b></div><div typeof></div>'
    (item,) = items(spark, html)
    assert (item["format"], item["type"]) == ("rdfa", "schema:Thing")
    assert json.loads(item["parsed_data"]) == {"@type": "schema:Thing", "name": "x", "pageUrl": "rel"}
    assert item["validation_errors"] == ["Invalid URL format for pageUrl: rel"]


def test_statistics(spark):
    pages = spark.createDataFrame([(URL, MICRO + script("{") + script('{"@type":"Product"}'))], "url string, html string")
    found = structured_data(pages)
    stats = {(r.level, r.format or r.type): (r.total, r.valid_count, r.invalid_count) for r in schema_statistics(found).collect()}
    assert stats[("total", None)] == (4, 2, 2)
    assert stats[("format", "json-ld")] == (2, 0, 2) and stats[("type", "Product")] == (2, 1, 1)
    assert schema_error_counts(found).count() == 3


def listed_errors(rows):
    return Counter({r.validation_error: r.total for r in rows if r.level == "validation_error"})


def test_statistics_list_every_error_of_the_invalid_items(spark):
    rows = [
        ("json-ld", "A", False, ["e", "f"]), ("json-ld", "A", False, ["e"]), ("rdfa", "B", True, ["of a valid item"]),
        ("rdfa", "B", False, None), ("rdfa", "e", False, []), ("rdfa", "e", False, ["e", "e"]), (None, None, None, ["g"]),
    ]
    found = spark.createDataFrame(rows, "format string, type string, is_valid boolean, validation_errors array<string>")
    got = schema_statistics(found).collect()
    assert listed_errors(got) == Counter(e=4, f=1, g=1)
    stats = {(r.level, r.format, r.type, r.validation_error): (r.total, r.valid_count, r.invalid_count) for r in got}
    assert len(stats) == len(got) == 11
    assert stats[("total", None, None, None)] == (7, 1, 6) and stats[("format", "rdfa", None, None)] == (4, 1, 3)
    assert stats[("type", None, "e", None)] == (2, 0, 2) and stats[("validation_error", None, None, "e")] == (4, 0, 4)
    assert stats[("format", "unknown", None, None)] == stats[("type", None, "unknown", None)] == (1, 0, 1)


def test_query_of_statistics_lists_whole_errors_as_often_as_they_occur(spark, tmp_path):
    parts = [(k, f"name {k}", "Brand#1") for k in [*range(90), 6, 89, None]]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    items = structured_data(d.part_pages(spark, str(tmp_path))).collect()
    got = listed_errors(QUERIES["schema_statistics"](spark, str(tmp_path)).collect())
    assert got == Counter(e for i in items for e in i["validation_errors"])
    assert max(got.values()) > 20 and sum(1 for e in got if e.startswith("JSON decode error: Extra data: line 1 column ")) > 1


MIXED = """<html>
<p itemprop=x property=y>out</p><div itemscope>
<div itemscope
 itemtype=http://schema.org/Offer typeof=Offer property=offers><b itemprop=price>1</b>
<i property=price>2</i><img itemprop=logo property=logo src=/l></div></div>
<script type="application/ld+json">{"@type":"Article"}</script><span property=late>3</span></html>"""


def test_one_format_alone_is_what_it_is_among_all(spark):
    every = items(spark, MIXED)
    for name in FORMATS:
        assert items(spark, MIXED, name) == [i for i in every if i["format"] == name] != []
    (offer,) = items(spark, MIXED, "microdata")
    assert offer["position"] == 1 and offer["raw_data"].startswith("<div itemscope\n itemtype=") and offer["raw_data"].endswith("src=/l></div>")


def test_elements_of_other_formats_stay_in_the_task():
    tags = {name: [n[3] for n in page_record(MIXED, wanted_items((name,)), URL)[0]] for name in FORMATS}
    assert tags == {"json-ld": ["script"], "microdata": ["p", "div", "div", "b", "img"], "rdfa": ["p", "div", "i", "img", "span"]}
