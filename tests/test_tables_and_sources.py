"""Bucketed and versioned tables, dictionaries, rules, archived responses, SQL table functions, and the entry."""

import gzip
import json
import os
import random
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from silkgraph.operators import dictionary, reach, redirects, scale, sitemaps, structured
from silkgraph.operators.dom import register_html_nodes
from silkgraph.plans.catalog import QUERIES
from silkgraph.sources import captures, writers

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- redirects ---------------------------------------------------------------------------------


def chain_by_hand(start, hops, known, most):
    """URLs asked for, and whether the chain was stopped."""
    url, asked = start, []
    while len(asked) < most:
        asked.append(url)
        if url not in hops:
            return [u for u in asked if u in known], False, url if url in known else start
        url = hops[url]
    return asked, True, url


@pytest.mark.parametrize("most", [10, 3, 1, 16])
def test_redirect_paths_by_doubling_equal_a_walk(spark, most):
    rnd = random.Random(most)
    names = [f"http://h/{i}" for i in range(120)]
    hops = {n: rnd.choice([names[(i + 1) % 120], rnd.choice(names), "http://gone/x"]) for i, n in enumerate(names) if rnd.random() < 0.85}
    rows = [(n, 301 if n in hops else 200, hops.get(n), {"at": n}) for n in names]
    responses = spark.createDataFrame(rows, "url string, status int, location string, headers map<string,string>")
    starts = responses.select("url").unionByName(responses.select("url").limit(5))
    got = {r.url: r for r in redirects.redirect_resolve(starts, responses, most).collect()}
    assert set(got) == set(names)
    for n in names:
        urls, capped, final = chain_by_hand(n, hops, set(names), most)
        r = got[n]
        assert [s.url for s in r.redirect_chain] == urls and (r.capped, r.final_url) == (capped, final)
        assert all(s.headers == {"at": s.url} and s.status == (301 if s.url in hops else 200) for s in r.redirect_chain)
        assert r.status == (301 if capped else 200 if urls and urls[-1] not in hops else 0)


def test_ten_requests_take_four_rounds(spark, monkeypatch):
    rounds = []
    real = redirects.cut
    monkeypatch.setattr(redirects, "cut", lambda df: rounds.append(df) or real(df))
    rows = [(f"http://h/{i}", 301, f"/{i + 1}", {"x": "y" * 50}) for i in range(40)]
    responses = spark.createDataFrame(rows, "url string, status int, location string, headers map<string,string>")
    assert redirects.redirect_resolve(responses.select("url"), responses).filter("capped").count() == 30 + 1
    assert len(rounds) == 1 + 4 and not any("headers" in plan_of(df).split("Scan")[0] for df in rounds[1:])


# --- reach ------------------------------------------------------------------------------------


def test_a_crawl_level_leaves_the_edges_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    edges, seen = scale.BucketTable(spark, "edges", "source_url"), scale.BucketTable(spark, "seen", "url")
    try:
        assert edges.add(spark.range(200).select(F.col("id").cast("string").alias("source_url"), (F.col("id") + 1).cast("string").alias("target_url"), F.lit(True).alias("crawlable"))) == 200
        assert seen.add(spark.range(3).select(F.col("id").cast("string").alias("url"), F.lit(0).alias("depth"))) == 3
        near, rows = edges.read(), seen.read()
        level = rows.filter("depth = 0").select("url")
        found = reach.found_by(level, [near], rows)
        plan = plan_of(found)
        assert plan.count("Exchange hashpartitioning") == 1  # of the targets met
        exchange = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
        assert "url" in exchange and "SortMergeJoin" in plan
        assert [r.url for r in found.collect()] == ["3"]
    finally:
        edges.close()
        seen.close()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [t for t in spark.catalog.listTables() if t.name in (edges.name, seen.name)]


def test_reach_is_the_same_with_a_busy_source(spark, monkeypatch):
    rnd = random.Random(3)
    links = [("hub", f"n{i}", i % 9 > 0) for i in range(80)] + [(f"n{rnd.randrange(80)}", f"n{rnd.randrange(120)}", True) for _ in range(200)]
    frame = spark.createDataFrame(links, "source_url string, target_url string, crawlable boolean")
    seeds = spark.createDataFrame([("hub",)], "url string")
    want = sorted(map(tuple, reach.crawl_reachability(seeds, frame).collect()))
    monkeypatch.setattr(reach, "MANY", 20)
    assert sorted(map(tuple, reach.crawl_reachability(seeds, frame).collect())) == want
    assert reach.crawl_reachability(seeds.limit(0), frame).count() == 0


# --- storage ----------------------------------------------------------------------------------


def store_rows(spark, rows):
    return spark.createDataFrame(rows, "url string, html string, fetched_at long, seq long")


def test_bucket_store_rewrites_only_what_is_touched(spark, tmp_path):
    store = writers.BucketStore(spark, str(tmp_path), buckets=64)
    assert store.read() is None and store.upsert(store_rows(spark, []).limit(0)) == []
    first = [(f"http://site{i}.example/p{k}", f"<p>{i}-{k}</p>", 1, k) for i in range(30) for k in range(3)]
    assert store.upsert(store_rows(spark, first))
    before = store.manifest()[1]
    again = [("http://site3.example/p1", "new", 2, 0), ("http://site4.example/p1", "old", 0, 0), ("http://site4.example/p9", "more", 1, 0)]
    touched = store.upsert(store_rows(spark, again))
    after = store.manifest()[1]
    assert 1 <= len(touched) <= 2 and {b for b in after if after[b] != before.get(b)} == set(touched)
    want = {u: h for u, h, _, _ in first} | {"http://site3.example/p1": "new", "http://site4.example/p9": "more"}
    assert {r.url: r.html for r in store.read().collect()} == want
    assert {r.url for r in store.read(touched).collect()} == {u for u in want if "site3." in u or "site4." in u or u in {r.url for r in store.read(touched).collect()}}


def test_bucket_store_survives_a_writer_that_dies(spark, tmp_path):
    store = writers.BucketStore(spark, str(tmp_path), buckets=8)
    store.upsert(store_rows(spark, [("http://a/1", "x", 1, 1), ("http://b/1", "y", 1, 1)]))
    # rows of a version that no manifest names, and a manifest that was not renamed
    store_rows(spark, [("http://a/1", "lost", 9, 9)]).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/rows/dead")
    (tmp_path / "manifests" / ".dead").write_text("{")
    assert {r.html for r in store.read().collect()} == {"x", "y"}
    number, versions = store.manifest()
    with pytest.raises(Exception, match="exists"):
        store._commit(number, versions)
    assert store.manifest() == (number, versions)


def test_run_folder_goes(spark):
    with scale.RunFolder(spark, "test") as run:
        assert run.stored(spark.range(5)).count() == 5
        folder = run.path.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


# --- dictionaries and rules -------------------------------------------------------------------


def test_dictionaries_keep_their_ids_and_tables_come_back(spark):
    links = spark.createDataFrame([("a", "home", "/x"), ("b", "", "/y"), ("c", None, "/x")], "source_url string, anchor_text string, xpath string")
    content = spark.createDataFrame([("a", "", "en"), ("b", "text", None)], "url string, meta_description string, html_lang string")
    known = scale.cut(dictionary.encode_dictionaries({"internal_links": links, "content": content}))
    assert {(r.dictionary, r.id, r.value) for r in known.collect()} == {
        ("anchor_texts", 1, ""), ("anchor_texts", 2, "home"), ("xpaths", 1, "/x"), ("xpaths", 2, "/y"), ("meta_descriptions", 1, "text"), ("html_languages", 1, "en"),
    }
    more = spark.createDataFrame([("d", "aaa", "/x"), ("e", "home", "/0")], "source_url string, anchor_text string, xpath string")
    items = spark.createDataFrame([("d", "Product")], "url string, type string")
    ids = scale.cut(dictionary.encode_dictionaries({"internal_links": more, "schema_items": items}, known))
    fresh = {(r.dictionary, r.id, r.value) for r in ids.collect()} - {(r.dictionary, r.id, r.value) for r in known.collect()}
    assert fresh == {("anchor_texts", 3, "aaa"), ("xpaths", 3, "/0"), ("schema_types", 1, "Product")} and ids.count() == known.count() + 3
    coded = dictionary.encoded_table("internal_links", links, ids)
    assert set(coded.columns) == {"source_url", "anchor_text_id", "xpath_id"}
    back = dictionary.decoded_table("internal_links", coded, ids).select(*links.columns)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, links.collect()), key=repr)
    with pytest.raises(ValueError, match="coded"):
        dictionary.encode_dictionaries({"other": links})


def script(text):
    return f'<script type="application/ld+json">{text}</script>'


def test_rules_are_rows(spark):
    html = script('[{"@type":"Event"},{"@type":"EVENT","name":"n","ticketHref":"x","homeUrl":"y"},{"@type":"Product","name":"p"},{"@type":"None"}]')
    pages = spark.createDataFrame([("http://h/", html)], "url string, html string")
    rules = structured.built_in_rules(spark).unionByName(
        spark.createDataFrame([("Event", "required", "name", 1), ("Event", "required", "startDate", 0), ("Event", "url", "href", 0)], structured.RULES)
    )
    got = [(r.type, r.validation_errors) for r in structured.structured_data(pages, ("json-ld",), rules).orderBy("position").collect()]
    assert got == [
        ("Event", ["Event missing required 'startDate' property", "Event missing required 'name' property"]),
        ("EVENT", ["Event missing required 'startDate' property", "Invalid URL format for ticketHref: x", "Invalid URL format for homeUrl: y"]),
        ("Product", ["Product missing required 'offers' property"]), ("None", []),
    ]
    built_in = structured.structured_data(pages, ("json-ld",)).orderBy("position").collect()
    same = structured.structured_data(pages, ("json-ld",), structured.built_in_rules(spark)).orderBy("position").collect()
    assert [r.validation_errors for r in built_in] == [r.validation_errors for r in same]


def test_json_ld_takes_no_second_python_pass(spark):
    plan = plan_of(QUERIES["json_ld_items"](spark, SMALL))
    assert "EvalPython" not in plan and plan.count("MapInArrow") == 1


def test_json_ld_types_and_fields_by_variants(spark):
    cases = ['{"@type":5}', '{"@type":null}', '{"@type":{}}', '{"@type":1.5}', '{"@type":true}', '{"@type":[7]}', '{"@type":[true]}', '{"@type":[null]}', '"text"', "[[1]]", "7"]
    pages = spark.createDataFrame([("http://h/", "".join(map(script, cases)))], "url string, html string")
    got = [(r.type, r.position, r.validation_errors) for r in structured.structured_data(pages, ("json-ld",)).orderBy("position").collect()]
    kinds = ["int", "NoneType", "dict", "float", "bool"]
    assert got == [("ParseError", i, [f"Parse error: '{k}' object has no attribute 'lower'"]) for i, k in enumerate(kinds)] + [("7", 5, []), ("True", 6, []), ("None", 7, [])]
    truthy = '{"@type":"Organization","name":%s}'
    values = {'"x"': True, '""': False, "0": False, "0.0": False, "3": True, "-1e3": True, "true": True, "false": False, "null": False, "[]": False, "[0]": True, "{}": False, '{"a":null}': True, "NaN": True}
    pages = spark.createDataFrame([(f"http://h/{i}", script(truthy % v)) for i, v in enumerate(values)], "url string, html string")
    found = {int(r.url.rsplit("/", 1)[1]): r.is_valid for r in structured.structured_data(pages, ("json-ld",)).collect()}
    assert [found[i] for i in range(len(values))] == list(values.values())


# --- SQL over elements, sitemaps --------------------------------------------------------------


def test_html_nodes_in_sql(spark):
    register_html_nodes(spark)
    spark.createDataFrame([(1, "<div id=a><p>one<p>two <b>x</b></div><i>z"), (2, None), (3, "")], "k int, html string").createOrReplaceTempView("bodies")
    rows = spark.sql("SELECT k, n.ord, n.parent_ord, n.tag, n.attrs, n.text FROM bodies, LATERAL html_nodes(html) n ORDER BY k, n.ord").collect()
    assert [(r.k, r.ord, r.parent_ord, r.tag, r.attrs, r.text) for r in rows] == [
        (1, 0, -1, "div", {"id": "a"}, "onetwo x"), (1, 1, 0, "p", {}, "onetwo x"), (1, 2, 1, "p", {}, "two x"), (1, 3, 2, "b", {}, "x"), (1, 4, -1, "i", {}, "z"),
    ]
    kept = spark.sql("SELECT k, count(n.ord) AS n FROM bodies LEFT JOIN LATERAL html_nodes(html) n ON true GROUP BY k ORDER BY k").collect()
    assert [tuple(r) for r in kept] == [(1, 5), (2, 0), (3, 0)]


@pytest.mark.parametrize("prefix", ["", "sm:", "s-m:", "s.m:"])
def test_indexes_of_any_prefix_are_followed(spark, prefix):
    def tagged(text):
        return text.replace("</", f"<//{prefix}").replace("<", f"<{prefix}").replace(f"<{prefix}//{prefix}", f"</{prefix}") if prefix else text

    index = tagged("<sitemapindex><sitemap><loc>http://h/s.xml</loc></sitemap></sitemapindex>")
    files = spark.createDataFrame([("http://h/i.xml", 200, index), ("http://h/s.xml", 200, "<urlset><url><loc>http://h/1</loc></url></urlset>")], "url string, status int, content string")
    starts = spark.createDataFrame([("h", 0, "http://h/i.xml")], "site string, position int, sitemap_url string")
    assert [(r.loc, r.sitemap_url) for r in sitemaps.sitemap_closure(starts, files).collect()] == [("http://h/1", "http://h/s.xml")]


# --- archived responses ------------------------------------------------------------------------


def warc(url, body, kind="response", **more):
    content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Length: {len(content)}\r\n\r\n"
    return head.encode() + content + b"\r\n\r\n"


def test_captures_are_the_same_for_any_ranges(spark, tmp_path):
    captures.register_captures(spark)
    rnd = random.Random(1)
    data, want = b"", []
    for i in range(60):
        body = bytes(rnd.choice(b"ab\r\n<>") for _ in range(rnd.randrange(0, 400))) + (b"\r\n\r\nWARC/1.0\r\nno record" if i % 7 == 0 else b"")
        kind = "request" if i % 10 == 9 else "response"
        data += warc(f"http://h/{i}", body, kind)
        want += [(f"http://h/{i}", body.decode())] if kind == "response" else []
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "_hidden").write_bytes(data)
    for size in (64, 777, 4096, 1 << 20):
        rows = spark.read.format("captures").option("rangeBytes", size).load(str(tmp_path)).select("url", "text", "status", "seq").collect()
        assert sorted((r.url, r.text) for r in rows) == sorted(want) and {r.status for r in rows} == {200}
        assert len({r.seq for r in rows}) == len(want)


def test_broken_captures_leave_the_others_alone(spark, tmp_path):
    captures.register_captures(spark)
    whole = [warc(f"http://h/{i}", b"x" * 50) for i in range(6)]
    whole[2] = re.sub(rb"Content-Length: \d+", b"Content-Length: 20", whole[2])  # a wrong length
    (tmp_path / "a.warc").write_bytes(b"".join(whole)[:-30])  # cut off
    (tmp_path / "b.warc").write_bytes(b"no archive at all")
    (tmp_path / "c.warc").write_bytes(b"")
    for size in (40, 1 << 20):
        rows = spark.read.format("captures").option("rangeBytes", size).load(str(tmp_path)).collect()
        assert sorted(r.url for r in rows) == [f"http://h/{i}" for i in (0, 1, 3, 4)]
        assert all(r.fetched_at.year == 2024 and r.headers == {"Content-Type": "text/html"} for r in rows)


def test_captures_as_a_stream(spark, tmp_path):
    captures.register_captures(spark)
    source = tmp_path / "in"
    source.mkdir()

    def drain():
        log = spark.readStream.format("captures").load(str(source))
        query = log.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (source / "a.warc").write_bytes(warc("http://h/a", b"1"))
    os.utime(source / "a.warc", ns=(10**18, 10**18))
    assert drain() == ["http://h/a"]
    (source / "b.warc").write_bytes(warc("http://h/b", b"2"))
    os.utime(source / "b.warc", ns=(10**18, 10**18))  # of the same time, but later
    (source / "c.warc").write_bytes(warc("http://h/c", b"3"))
    assert drain() == ["http://h/a", "http://h/b", "http://h/c"]


# --- entry --------------------------------------------------------------------------------------


def test_entry_lists_the_core_without_what_the_subpackage_needs():
    code = (
        "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; from silkgraph.plans.catalog import QUERIES;"
        "import json; print(json.dumps([sorted(e.queries()) == sorted(QUERIES), len(QUERIES), len(e.oracle_sql())]))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    same, queries, oracles = json.loads(out.splitlines()[-1])
    assert same and queries == oracles >= 106


def test_gzipped_sitemaps_are_read(spark, tmp_path):
    from silkgraph.sources.readers import scan_sitemap_folder

    with gzip.open(tmp_path / "s.xml.gz", "wt") as f:
        f.write("<urlset><url><loc>http://h/1</loc></url></urlset>")
    (row,) = sitemaps.sitemap_entries(scan_sitemap_folder(spark, str(tmp_path))).collect()
    assert row.loc == "http://h/1" and row.sitemap_url.endswith("s.xml.gz")
