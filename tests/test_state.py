import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from silkgraph.functions import http
from silkgraph.operators import dictionary, reach, redirects, retry, state

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "url string, status int, fetched_at timestamp, seq bigint"


def log_rows(n=3000, urls=40, seed=1):
    """Two thirds of the rows belong to one URL."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        url = "hot" if rnd.random() < 0.66 else f"u{rnd.randrange(urls)}"
        status = rnd.choice([503, 0, 429, 200, 404, 301]) if url != "hot" else rnd.choice([503] * 9 + [404] * 9 + [200] * (i < n // 2))
        rows.append((url, status, T0 + timedelta(seconds=rnd.randrange(n), milliseconds=rnd.randrange(1000)), i))
    return rows


def retry_by_hand(rows, delay, factor):
    failed = {}
    for url, status, at, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        if 200 <= status < 300:
            failed.pop(url, None)
        elif status == 0 or 500 <= status < 600 or status in (408, 420, 423, 429, 451):
            now = at.replace(microsecond=0)
            count = failed[url][1] + 1 if url in failed else 0
            made = failed[url][4] if url in failed else now
            due = now.timestamp() + int(delay * factor**count)
            failed[url] = (status, count, now.timestamp(), due, made)
    return {u: (s, c, last, due, made.timestamp()) for u, (s, c, last, due, made) in failed.items()}


def test_retry_state_equals_replay(spark):
    rows = log_rows()
    for delay, factor in ((1.0, 2.0), (2.5, 1.1)):
        short = rows if factor < 2 else [r for r in rows if r[3] % 40 == 0]
        got = retry.retry_state(spark.createDataFrame(short, LOG), delay, factor)
        got = got.select(
            "url", "status_code", "retry_count",
            *[F.unix_timestamp(c) for c in ("last_retry_at", "next_retry_at", "created_at")],
        ).collect()
        assert {r[0]: tuple(r)[1:] for r in got} == retry_by_hand(short, delay, factor)


def test_retry_reports(spark):
    rows = [("a", 503, T0, 0), ("b", 0, T0, 1), ("b", 0, T0 + timedelta(seconds=5), 2), ("c", 404, T0, 3), ("d", 500, T0, 4), ("d", 204, T0, 5)]
    failed = retry.retry_state(spark.createDataFrame(rows, LOG))
    now = F.lit("2024-01-01 00:00:02").cast("timestamp")
    assert [r.url for r in retry.retry_ready(failed, now).collect()] == ["a"]
    stats = {(r.level, r.status_code, r.retry_count): (r.failed, r.ready) for r in retry.retry_statistics(failed, now).collect()}
    assert stats == {
        ("total", None, None): (2, 1), ("status_code", 503, None): (1, 1), ("status_code", 0, None): (1, 0),
        ("retry_count", None, 0): (1, 1), ("retry_count", None, 1): (1, 0),
    }


def test_status_functions(spark):
    codes = spark.createDataFrame([(c,) for c in range(0, 700)], "s int")
    rows = codes.select("s", http.is_retryable(F.col("s")).alias("r"), http.failure_reason(F.col("s")).alias("t"), http.status_class(F.col("s")).alias("c")).collect()
    assert {r.s for r in rows if r.r} == {0, 408, 420, 423, 429, 451, *range(500, 600)}
    texts = {r.s: r.t for r in rows}
    assert (texts[429], texts[507], texts[404]) == ("Rate limited", "Server error 507", "HTTP 404")
    assert {r.c for r in rows} == {"0", "0xx", "1xx", "2xx", "3xx", "4xx", "5xx", "6xx"}


def test_headers(spark):
    df = spark.createDataFrame([({"Content-Type": " a ", "X": "y", "ETag": "e"},), (None,), ({},)], "h map<string,string>")
    assert [r[0] for r in df.select(http.headers_normalize(F.col("h"))).collect()] == [{"content-type": "a", "etag": "e"}, None, {}]


def test_upsert_and_folds_do_not_depend_on_partitions(spark):
    rnd = random.Random(3)
    rows = [
        ("hot" if rnd.random() < 0.5 else f"u{rnd.randrange(20)}", rnd.choice(["html", None, "image"]), rnd.choice(["internal", "external", "network"]),
         rnd.choice([None, "p", "q"]), T0 + timedelta(seconds=i), i, rnd.choice(["touch", "upsert"]))
        for i in range(500)
    ]
    by_hand = {}
    for url, kind, cls, found, at, _, op in rows:
        row = by_hand.setdefault(url, {"kind": None, "cls": cls, "found": None, "first": at, "last": at, "listed": False})
        row["listed"] |= cls == "network"
        if op == "upsert":
            row.update(kind=kind, cls=cls, found=row["found"] or found, last=at)
    want = {u: (r["kind"], "network" if r["cls"] == "external" and r["listed"] else r["cls"], r["found"]) for u, r in by_hand.items()}
    schema = "url string, kind string, classification string, discovered_from string, seen_at timestamp, seq bigint, op string"
    df = spark.createDataFrame(rows, schema)
    for parts in (1, 7):
        got = state.url_upsert(df.repartition(parts, F.rand(parts))).collect()
        assert {r.url: (r.kind, r.classification, r.discovered_from) for r in got} == want
        assert {r.url: r.last_seen.timestamp() for r in got} == {u: r["last"].timestamp() for u, r in by_hand.items()}


def test_frontier(spark):
    events = spark.createDataFrame(
        [("a", 2, "p", "enqueue", T0, 1), ("a", 0, None, "enqueue", T0, 2), ("b", 1, None, "done", T0, 3), ("b", 1, "q", "enqueue", T0, 4), ("a", 9, None, "done", T0, 5), ("z", 0, None, "done", T0, 6)],
        "url string, depth int, parent string, op string, at timestamp, seq bigint",
    )
    frontier = state.frontier_state(events)
    assert {(r.url, r.depth, r.parent, r.status) for r in frontier.collect()} == {("a", 2, "p", "done"), ("b", 1, "q", "queued")}
    assert tuple(state.frontier_stats(frontier).first()) == (1, 1)
    assert [r.url for r in state.frontier_next_batch(frontier, 5).collect()] == ["b"]
    done = state.frontier_mark_done(frontier, spark.createDataFrame([("b",), ("x",)], "url string"), F.lit("2025-01-01").cast("timestamp"))
    assert tuple(state.frontier_stats(done).first()) == (0, 2)
    new = spark.createDataFrame([("b", 0, None, 1), ("c", 3, "m", 2), ("c", 1, "n", 3)], "url string, depth int, parent string, seq int")
    assert [tuple(r) for r in state.frontier_enqueue(new, frontier).collect()] == [("c", 3, "m", "queued")]


def test_seeds(spark):
    seeds = spark.createDataFrame([("s", "HTTP://S.example/#x")], "site string, url string")
    listing = spark.createDataFrame([("s", f"http://s.example/{i}", i) for i in range(5)], "site string, url string, sitemap_position bigint")
    first = state.seed_urls(seeds, listing, max_pages=2)
    assert {r.url for r in first.collect()} == {"http://s.example/", "http://s.example/0", "http://s.example/1"}
    later = state.seed_urls(seeds, listing, first.withColumn("status", F.lit("done")))
    assert (later.filter("status = 'done'").count(), later.count()) == (3, 6)
    assert state.seed_urls(seeds, None, first, reset=True).count() == 1


def responses(spark, edges):
    return spark.createDataFrame([(u, s, loc, {"location": loc} if loc else {}) for u, s, loc in edges], "url string, status int, location string, headers map<string,string>")


def test_redirect_cases(spark):
    h = "http://h/"
    chain = [(f"{h}c{i}", 301, f"c{i + 1}") for i in range(12)] + [(f"{h}c12", 200, None)]
    data = responses(spark, [
        (h + "ok", 200, None), (h + "rel", 302, "ok"), (h + "noloc", 301, None), (h + "loop", 307, "/loop"),
        (h + "gone", 308, "http://elsewhere/x"), (h + "to500", 303, "/e"), (h + "e", 500, None), *chain,
    ])
    got = {r.url.removeprefix(h): (r.final_url, r.status, len(r.redirect_chain)) for r in redirects.redirect_resolve(data.select("url"), data).collect()}
    assert got["ok"] == (h + "ok", 200, 1) and got["rel"] == (h + "ok", 200, 2) and got["noloc"] == (h + "noloc", 301, 1)
    assert got["loop"] == (h + "loop", 307, 10)
    assert got["gone"] == (h + "gone", 0, 1)
    assert got["c3"] == (h + "c12", 200, 10) and got["c2"] == (h + "c12", 301, 10) and got["c0"] == (h + "c10", 301, 10)
    assert max(n for _, _, n in got.values()) == 10
    records = redirects.redirect_records(redirects.redirect_resolve(data.select("url"), data))
    names = {r.source_url.removeprefix(h): (r.chain_length, r.final_status) for r in records.collect()}
    assert "to500" not in names and "ok" not in names and names["loop"] == (9, 307) and names["rel"] == (1, 200)


def bfs(edges, blocked, seeds, max_depth, max_pages):
    seen = {s: (0, None) for s in seeds}
    crawled, level = set(), sorted(seeds)
    for depth in range(max_depth + 1):
        queued = [u for u in level if depth == 0 or u not in blocked]
        if max_pages:
            queued = queued[: max_pages - len(crawled)]
        crawled |= set(queued)
        if depth == max_depth:
            break
        found = {}
        for s, t in edges:
            if s in queued and t not in seen:
                found[t] = min(found.get(t, s), s)
        seen.update({t: (depth + 1, p) for t, p in found.items()})
        level = sorted(found)
    return {u: (d, p, u in crawled) for u, (d, p) in seen.items()}


def test_reachability_is_breadth_first(spark):
    rnd = random.Random(5)
    nodes = [f"n{i:02d}" for i in range(60)]
    edges = [(rnd.choice(nodes), "n00" if rnd.random() < 0.3 else rnd.choice(nodes)) for _ in range(150)]
    blocked = set(nodes[::7]) - {"n00"}
    links = spark.createDataFrame([(s, t, t not in blocked) for s, t in edges], "source_url string, target_url string, crawlable boolean")
    seeds = spark.createDataFrame([("n00",), ("n01",)], "url string")
    for depth, pages in ((3, 0), (8, 0), (8, 12)):
        got = {r.url: (r.depth, r.parent, r.crawled) for r in reach.crawl_reachability(seeds, links, depth, pages).collect()}
        assert got == bfs(edges, blocked, ["n00", "n01"], depth, pages), (depth, pages)


def test_dictionary(spark):
    values = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("",)], "v string")
    known = dictionary.encode_dictionary(values, "v", blank_is_null=True)
    assert sorted(map(tuple, known.collect())) == [(1, "a"), (2, "b")]
    more = dictionary.encode_dictionary(spark.createDataFrame([("c",), ("a",), ("0",)], "v string"), "v", known)
    assert sorted(map(tuple, more.collect())) == [(1, "a"), (2, "b"), (3, "0"), (4, "c")]
    coded = dictionary.with_ids(values, "v", known, "id")
    assert coded.filter("id is null").count() == 2
    back = dictionary.decode_dictionary(coded.select("id"), "id", known, "v")
    assert sorted(r.v or "" for r in back.collect()) == ["", "", "a", "b", "b"]


def test_discovery_log(spark):
    pages = spark.createDataFrame([("http://h/a", "html", None, T0)], "url string, kind string, parent string, fetched_at timestamp")
    found = spark.createDataFrame([("http://h/a", "http://h/b", 0, True), ("http://h/a", "http://o/", 1, False)], "source_url string, target_url string, ord int, crawlable boolean")
    rows = state.url_discovery_log(pages, found, F.lit("http://h/"), F.lit("h")).collect()
    assert {(r.url, r.kind, r.classification, r.discovered_from, r.op) for r in rows} == {
        ("http://h/a", "html", "internal", "http://h/", "upsert"), ("http://h/b", None, "internal", None, "touch"),
        ("http://o/", "other", "external", "http://h/a", "upsert"),
    }
