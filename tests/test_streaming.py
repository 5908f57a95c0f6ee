import random
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_state import LOG, T0, log_rows, retry_by_hand

from silkgraph.operators.retry import retry_state
from silkgraph.plans import views
from silkgraph.sources import readers
from silkgraph.streaming import jobs
from silkgraph.streaming.retry_processor import RetryProcessor

PAGE = "<html><head><title>t{0}</title></head><body><h1>h</h1><a href='/n{0}'>x</a></body></html>"


def log_files(spark, folder, rows, schema, files):
    rows = sorted(rows, key=lambda r: r[-1] if schema is not LOG else (r[2], r[3]))
    step = -(-len(rows) // files)
    for i in range(files):
        spark.createDataFrame(rows[i * step : (i + 1) * step], schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.mark.parametrize(("files", "shuffled"), [(1, False), (3, False), (3, True)])
def test_retry_stream_equals_batch(spark, tmp_path, files, shuffled):
    rows = [r for r in log_rows(400, urls=8) if r[3] % 3 == 0]
    if shuffled:  # places in the log do not follow the order in which the rows come
        mixed = random.Random(5).sample(rows, len(rows))
        for i in range(files):
            spark.createDataFrame(mixed[i::files], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    else:
        log_files(spark, str(tmp_path / "in"), rows, LOG, files)
    out = jobs.stream_retry_state(stream(spark, str(tmp_path / "in"), LOG), 1.0, 1.1, "30 days")
    name = f"t{uuid.uuid4().hex}"
    got = jobs.run_to_table(out, name, str(tmp_path / "cp"), "update").toPandas()
    last = {}
    for r in got[got.event != "ready"].itertuples():
        key = (r.event == "failed", r.last_retry_at, r.retry_count)
        last.setdefault(r.url, []).append((r.event, r.status_code, r.retry_count, r.last_retry_at, r.next_retry_at))
    state = {u: v[-1] for u, v in last.items() if v[-1][0] == "failed"}
    want = retry_by_hand(rows, 1.0, 1.1)
    assert {u: (s, c, a.timestamp(), n.timestamp()) for u, (_, s, c, a, n) in state.items()} == {u: w[:4] for u, w in want.items()}


def test_retry_stream_timer(spark, tmp_path):
    rows = [("a", 503, T0, 0), ("b", 503, T0, 1), ("b", 200, T0 + timedelta(seconds=1), 2), ("late", 404, T0, 3), ("z", 200, T0 + timedelta(days=1), 4), ("z", 200, T0 + timedelta(days=2), 5)]
    for part in (rows[:4], rows[4:5], rows[5:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = jobs.stream_retry_state(stream(spark, str(tmp_path / "in"), LOG), watermark="1 minute")
    got = jobs.run_to_table(out, f"t{uuid.uuid4().hex}", str(tmp_path / "cp"), "update").collect()
    assert [r.url for r in got if r.event == "ready"] == ["a"]


def test_first_sight(spark, tmp_path):
    rows = [("http://h/A", 200, T0, 0), ("HTTP://H/A#x", 200, T0 + timedelta(minutes=1), 1), ("http://h/b", 200, T0, 2)]
    log_files(spark, str(tmp_path / "in"), rows, LOG, 3)
    out = jobs.stream_url_dedupe(stream(spark, str(tmp_path / "in"), LOG)).select("url")
    got = jobs.run_to_table(out, f"t{uuid.uuid4().hex}", str(tmp_path / "cp")).collect()
    assert sorted(r.url for r in got) == ["http://h/A", "http://h/b"]


def test_status_windows_stream_equals_batch(spark, tmp_path):
    rows = log_rows(300)
    closing = ("end", 200, T0 + timedelta(days=3), 10**6)
    log_files(spark, str(tmp_path / "in"), [*rows, closing], LOG, 3)
    out = jobs.run_to_table(jobs.status_counts(stream(spark, str(tmp_path / "in"), LOG)), f"t{uuid.uuid4().hex}", str(tmp_path / "cp"))
    batch = jobs.status_counts(spark.createDataFrame(rows, LOG))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.collect()))


def fetch_rows(n=12):
    rows = []
    for i in range(n):
        k = i % 7
        url = f"http://H.example/p{k}"
        status = 503 if i == 3 else 200
        chain = [(url, 301, {}), (f"http://h.example/q{k}", 200, {})] if k == 2 else [(url, status, {})]
        rows.append((url, status, f"http://h.example/q{k}" if k == 2 else url, {"Content-Type": "text/html", "X-Robots-Tag": "noindex"}, PAGE.format(i), chain, T0 + timedelta(minutes=i), i))
    return rows


@pytest.mark.parametrize("files", [1, 3])
def test_ingest_equals_batch(spark, tmp_path, files):
    rows = fetch_rows()
    schema = readers.FETCH_LOG
    log_files(spark, str(tmp_path / "in"), rows, schema, files)
    root = str(tmp_path / "out")
    log = readers.stream_fetch_log(spark, str(tmp_path / "in"), files_per_trigger=1)
    jobs.stream_ingest(log, root, str(tmp_path / "cp")).awaitTermination()
    whole = jobs.batch_tables(spark.createDataFrame(rows, schema))

    def same(got, want, *columns):
        assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)

    same(jobs.current_table(spark, root, "pages", ["url"]), whole["pages"], "url", "final_url", "status", "html", "x_robots_tag")
    same(jobs.current_table(spark, root, "content", ["url"]), whole["content"], "url", "title", F.concat_ws("|", "http_header_directives"))
    same(jobs.current_table(spark, root, "redirects", ["source_url"]), whole["redirects"], "source_url", "target_url", "chain_length")
    same(jobs.current_urls(spark, root), whole["urls"], "url", "kind", "first_seen", "last_seen")
    same(jobs.current_links(spark, root), whole["links"], *whole["links"].columns)
    for name in ("content", "directives", "canonicals", "schema_items"):
        same(jobs.of_newest_pages(spark, root, name), whole[name], *whole[name].columns)
    same(jobs.of_newest_pages(spark, root, "children", "source_url"), whole["children"], "source_url", "target_url", "ord")
    same(jobs.current_failures(spark, root), retry_state(whole["outcomes"]), "url", "status_code", "retry_count", "next_retry_at")
    robots_files = spark.createDataFrame([("h.example", 200, "User-agent: *\nDisallow: /n11\n")], "domain string, status int, content string")
    alternates = spark.createDataFrame([("http://h.example/p1", "en", "http://h.example/p1")], "url string, lang string, href_url string")
    seeds = spark.createDataFrame([("http://h.example/p1",)], "url string")
    tables = jobs.current_tables(spark, root, robots_files, alternates, seeds)
    built = views.build_views(tables)
    assert set(built) == {"page_analysis", "internal_links_analysis", "schema_analysis"}
    page = {r.url: r for r in built["page_analysis"].collect()}
    assert len(page) == 7 and page["http://h.example/p1"].self_hreflang == "en" and page["http://h.example/p1"].crawl_depth == 0
    assert all(r.title and r.robots_txt_allows and r.overall_indexable is False for r in page.values())
    reached = {r.url: (r.depth, r.recorded, r.status) for r in tables["frontier"].collect()}
    assert reached == {"http://h.example/p1": (0, False, "done"), "http://h.example/n8": (1, False, "queued")}
    assert whole["pages"].count() == 7


def test_links_of_several_batches(spark, tmp_path):
    """A target that was fetched in an earlier or later batch is known; a link taken off a page goes."""
    def page(i, url, *hrefs):
        html = "<html><head><title>t</title></head><body>" + "".join(f"<a href='{h}'>x</a>" for h in hrefs) + "</body></html>"
        return (url, 200, url, {"Content-Type": "text/html"}, html, [(url, 200, {})], T0 + timedelta(minutes=i), i)

    for row in (page(0, "http://h.example/b", "/gone", "/c"), page(1, "http://h.example/a", "/b"), page(2, "http://h.example/b", "/c"), page(3, "http://h.example/c")):
        spark.createDataFrame([row], readers.FETCH_LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    log = readers.stream_fetch_log(spark, str(tmp_path / "in"), files_per_trigger=1)
    jobs.stream_ingest(log, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.source_url, r.href, r.target_url) for r in jobs.current_links(spark, str(tmp_path / "out")).collect()}
    b, c = "http://h.example/b", "http://h.example/c"
    assert got == {("http://h.example/a", b, b), (b, c, c)}


def test_a_url_of_the_retry_stream_costs_no_frame_operations(monkeypatch):
    """Rows of a URL are read as lists: no frame is filtered or compared, which costs more than the rows themselves."""
    import pandas as pd

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

        put = update

        def clear(self):
            self.held = None

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    class Handle(dict):
        def getValueState(self, name, _):
            return self.setdefault(name, Value())

        getListState = getValueState

        def listTimers(self):
            return iter(())

        def registerTimer(self, due):
            self["due"] = due

    frame = pd.DataFrame({"us": [1_000_000, 3_000_000, 3_000_000, 2_000_000], "seq": [1, 4, 3, 2], "status": [503, 0, 503, 200]})
    handle, processor = Handle(), RetryProcessor(1.0, 2.0)
    processor.init(handle)
    monkeypatch.setattr(pd.Series, "__ge__", lambda *_: (_ for _ in ()).throw(AssertionError("frame operation")))
    (row,) = processor.handleInputRows(("u",), iter([frame]), Times())
    assert row.values.tolist() == [["u", "failed", 0, 1, 3, 5]]
    assert handle["success"].held == (2_000_000, 2) and handle["open"].held == [(3_000_000, 4, 0), (3_000_000, 3, 503)] and handle["due"] == 5000
