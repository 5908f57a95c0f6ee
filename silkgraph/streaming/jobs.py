"""Streaming forms: ingest, first sight of URLs, retry state, outcome counts."""

from __future__ import annotations


import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from silkgraph.functions.http import failure_reason, header, is_retryable, is_success, status_class
from silkgraph.operators.content import content_columns, has_content
from silkgraph.operators.dom import EVERYTHING, scan_html
from silkgraph.operators.links import inlink_counts, internal_links, links_of_scan
from silkgraph.operators.reach import crawl_edges, crawl_reachability
from silkgraph.operators.redirects import redirect_records
from silkgraph.operators.retry import next_retry_at, retry_state
from silkgraph.operators.robots import canonicals, indexability, robots_directives
from silkgraph.operators.scale import RunFolder
from silkgraph.operators.state import newest, newest_bodies, url_upsert
from silkgraph.operators.structured import items_of_scan
from silkgraph.functions.urls import host, url_classification, url_kind, url_normalize_storage
from silkgraph.sources.readers import pages_from_log
from silkgraph.streaming.retry_processor import STATE_OUTPUT, RetryProcessor


def batch_tables(
    log: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df
) -> dict[str, DataFrame]:
    """What a set of fetch results adds to the tables: the batch operators, side by side.

    ``hold`` is applied to the two intermediate results that several tables share, the settled page
    rows and their scan; the ingest job writes them so that the HTML is read once.
    """
    pages = hold(pages_from_log(log, hold))
    target = url_normalize_storage(F.coalesce("final_url", "url"))
    url = url_normalize_storage(F.col("url"))
    observed = log.filter(~is_retryable(F.col("status"))).select(
        url.alias("url"),
        url_kind(header(F.col("headers"), "content-type"), target).alias("kind"),
        url_classification(url, host(url)).alias("classification"),
        F.lit(None).cast("string").alias("discovered_from"),
        F.col("fetched_at").alias("seen_at"),
        F.lit("upsert").alias("op"),
        "fetched_at",
        "seq",
    )
    scanned = hold(
        scan_html(
            pages.select(
                "url",
                F.col("url").alias("source_url"),
                F.col("final_url").alias("_from"),
                host(F.col("url")).alias("_site"),
                F.create_map(F.lit("x-robots-tag"), "x_robots_tag").alias("headers"),
                "html",
            ),
            EVERYTHING,
        )
    )
    content = has_content(content_columns(scanned.drop("source_url", "_from", "_site")))
    chains = log.filter(F.size("redirect_chain") > 1).select(
        "url", F.coalesce("final_url", "url").alias("final_url"), "status", "redirect_chain", "fetched_at"
    )
    return {
        "pages": pages,
        "urls": url_upsert(observed, ("fetched_at", "seq")),
        "content": content,
        "links": internal_links(links_of_scan(scanned.drop("url", "headers"))),
        "children": links_of_scan(scanned.drop("url", "headers")).select("source_url", F.col("link_url").alias("target_url"), F.col("link_no").alias("ord")),
        "directives": robots_directives(content),
        "canonicals": canonicals(content),
        "schema_items": items_of_scan(scanned.select("url", "nodes", "word_count", "parsed")),
        "outcomes": log.select(url.alias("url"), "status", "fetched_at", "seq"),
        "redirects": redirect_records(chains, "fetched_at"),
    }


def stream_ingest(
    log: DataFrame, root: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Run the batch operators on every micro-batch and write their rows under
    ``root/<table>/batch=<id>``.

    A batch that runs again replaces its own folder, so the sink is idempotent by batch id. Rows of
    one URL in several batches are settled on read (``current_table``).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # what several tables share is written once to the shared folder, where every executor finds it,
        # and goes as soon as the tables of the batch are there
        with RunFolder(batch.sparkSession, "ingest") as run:
            for name, df in batch_tables(run.stored(batch), run.stored).items():
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

    return (
        log.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_table(spark, root: str, name: str, key: list[str]) -> DataFrame:
    """The newest row per key over all batches of a table written by ``stream_ingest``: by the time of the
    fetch where the table has it, whatever the batch in which it came."""
    rows = spark.read.parquet(f"{root}/{name}")
    times = [c for c in ("fetched_at", "discovered_at", "seq") if c in rows.columns]
    wide = "html" in rows.columns
    return (newest_bodies if wide else newest)(rows, key, [*times, "batch"]).drop("batch")


def of_newest_pages(spark, root: str, name: str, url: str = "url") -> DataFrame:
    """Rows of a table of page parts (content, links, items, directives...) that belong to the newest fetch
    of their page, so that what was taken off a page goes, whatever the batch in which a fetch came."""
    pages = spark.read.parquet(f"{root}/pages").select(F.col("url").alias(url), "fetched_at", "seq", "batch")
    pages = pages.groupBy(url).agg(F.max_by("batch", F.struct("fetched_at", "seq")).alias("batch"))
    return spark.read.parquet(f"{root}/{name}").join(pages, [url, "batch"], "left_semi").drop("batch")


def current_links(spark, root: str) -> DataFrame:
    """Links over all batches, with targets resolved against the pages of all batches."""
    own = of_newest_pages(spark, root, "links", "source_url")
    known = spark.read.parquet(f"{root}/pages").select(F.col("url").alias("target_url")).distinct()
    return own.join(known, own["href"] == known["target_url"], "left")


def current_failures(spark, root: str, delay: float = 1.0, factor: float = 2.0) -> DataFrame:
    """Failed URLs after all batches, whatever the order in which their outcomes came."""
    return retry_state(spark.read.parquet(f"{root}/outcomes").drop("batch"), delay, factor)


def current_frontier(spark, root: str, seeds: DataFrame, robots: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(url, depth, parent, crawled, recorded, status): the crawl from ``seeds`` over the stored children and the
    ``listed`` sitemap children; a URL whose page is stored is done."""
    edges = crawl_edges(of_newest_pages(spark, root, "children", "source_url"), robots, listed)
    done = spark.read.parquet(f"{root}/pages").select("url").distinct().withColumn("done", F.lit(True))
    reached = crawl_reachability(seeds, edges).join(done, "url", "left")
    return reached.withColumn("status", F.when(F.col("done"), "done").otherwise("queued")).drop("done")


def current_tables(spark, root: str, robots: DataFrame, hreflang: DataFrame, seeds: DataFrame, listed: DataFrame | None = None) -> dict[str, DataFrame]:
    """The inputs of the views, from the tables that ``stream_ingest`` has stored."""
    content = of_newest_pages(spark, root, "content")
    links = current_links(spark, root)
    return {
        "pages": current_table(spark, root, "pages", ["url"]),
        "urls": current_urls(spark, root),
        "content": content,
        "indexability": indexability(content, robots),
        "canonicals": of_newest_pages(spark, root, "canonicals"),
        "hreflang": hreflang,
        "internal_links": links,
        "inlinks": inlink_counts(links),
        "schema_items": of_newest_pages(spark, root, "schema_items"),
        "frontier": current_frontier(spark, root, seeds, robots, listed),
    }


def current_urls(spark, root: str) -> DataFrame:
    """The URL registry over all batches: the fold of the per-batch folds."""
    rows = spark.read.parquet(f"{root}/urls")
    return url_upsert(
        rows.select(
            "url", "kind", "classification", "discovered_from", "first_seen", "last_seen", "batch",
            F.lit("upsert").alias("op"), F.col("last_seen").alias("seen_at"),
        ),
        ("batch",),
    ).drop("first_seen").join(
        rows.groupBy("url").agg(F.min("first_seen").alias("first_seen")), "url"
    )


def stream_url_dedupe(log: DataFrame, delay: str | None = None, at: str = "fetched_at") -> DataFrame:
    """First sight of every URL, once and for all: every URL stays in the state. With ``delay`` the state is
    bounded instead: a URL is forgotten after it (and then new again), and rows that late are dropped by Spark."""
    rows = log.withColumn("url", url_normalize_storage(F.col("url")))
    if delay is None:
        return rows.dropDuplicates(["url"])
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"])


def stream_retry_state(
    log: DataFrame, delay: float = 1.0, factor: float = 2.0, watermark: str = "1 hour"
) -> DataFrame:
    """Retry bookkeeping kept per URL: a row for every change of its failed state, and a ``ready``
    row when the event time passes next_retry_at. Needs the RocksDB state store."""
    events = (
        log.filter(is_success(F.col("status")) | is_retryable(F.col("status")))
        .withWatermark("fetched_at", watermark)
        .select("url", "status", "fetched_at", "seq", F.unix_micros("fetched_at").alias("us"))
    )
    changes = events.groupBy("url").transformWithStateInPandas(
        statefulProcessor=RetryProcessor(delay, factor),
        outputStructType=STATE_OUTPUT,
        outputMode="Update",
        timeMode="EventTime",
    )
    return changes.select(
        "url", "event", "status_code", "retry_count",
        F.timestamp_seconds("last_s").alias("last_retry_at"),
        F.timestamp_seconds("next_s").alias("next_retry_at"),
    )


def retry_state_of(spark: SparkSession, checkpoint: str, delay: float = 1.0, factor: float = 2.0) -> DataFrame:
    """``retry_state`` as a running or ended retry stream holds it, read from its state store: the columns of the
    batch form and ``waiting``, whether its timer still stands, that is whether the watermark has not come to
    ``next_retry_at`` yet.

    Every variable of the state is read as a table of its own; they meet by URL, each reduced to one row.
    """
    def variable(name: str) -> DataFrame:
        rows = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        return rows.select(F.col("key.url").alias("url"), F.col("list_element" if "list_element" in rows.columns else "value").alias("v"))

    settled = variable("settled").filter(F.col("v").isNotNull()).select("url", "v.n", "v.first_us", F.struct("v.us", "v.seq", "v.status").alias("last"))
    held = variable("open").select("url", F.lit(1).cast("long").alias("n"), F.col("v.us").alias("first_us"), F.struct("v.us", "v.seq", "v.status").alias("last"))
    timers = spark.read.format("statestore").option("readRegisteredTimers", True).load(checkpoint)
    waiting = timers.select(F.col("key.url").alias("url")).distinct().withColumn("waiting", F.lit(True))
    failed = settled.unionByName(held).groupBy("url").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last").alias("last"))
    count = F.col("n") - 1
    last = F.timestamp_seconds(F.floor(F.col("last.us") / 1_000_000))
    return failed.join(waiting, "url", "left").select(
        "url", F.col("last.status").alias("status_code"), failure_reason(F.col("last.status")).alias("failure_reason"),
        count.alias("retry_count"), last.alias("last_retry_at"), next_retry_at(last, count, delay, factor).alias("next_retry_at"),
        F.timestamp_seconds(F.floor(F.col("first_us") / 1_000_000)).alias("created_at"), F.coalesce("waiting", F.lit(False)).alias("waiting"),
    )


class FetchCounts(StreamingQueryListener):
    """What a stream of outcome windows says of its batches: rows seen (observed under ``name``), and the rows
    of the aggregation that came after their window was closed."""

    def __init__(self, name: str):
        self.name, self.batches = name, {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            late = sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
            self.batches[event.progress.batchId] = (seen["rows"], late)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    @property
    def seen(self) -> int:
        return sum(rows for rows, _ in self.batches.values())


def drain_status_counts(
    log: DataFrame, path: str, checkpoint: str, width: str = "10 minutes", delay: str = "1 day"
) -> tuple[DataFrame, int, FetchCounts]:
    """Windows of ``status_counts`` written once they are final, the number of outcomes that came too late for
    theirs, and the counts of the batches.

    Every outcome is in a final window, in one that is still open, or it was dropped: the rows seen are
    observed while the stream runs, the open windows are read from its state store. What is left is the number dropped.
    """
    spark = log.sparkSession
    counts = FetchCounts(f"fetches-{uuid.uuid4().hex}")
    spark.streams.addListener(counts)
    try:
        seen = log.observe(counts.name, F.count(F.lit(1)).alias("rows"))
        query = (
            status_counts(seen, width, delay).writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        last = query.lastProgress.batchId
        for _ in range(100):  # progress comes to listeners a little later than the query ends
            if last in counts.batches:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counts)
    final = spark.read.schema("window_start timestamp, status_class string, fetches bigint").parquet(path)
    still = spark.read.format("statestore").load(checkpoint).agg(F.coalesce(F.sum("value.count"), F.lit(0))).first()[0]
    done = final.agg(F.coalesce(F.sum("fetches"), F.lit(0))).first()[0]
    return final, counts.seen - done - still, counts


def status_counts(log: DataFrame, width: str = "10 minutes", delay: str = "1 day") -> DataFrame:
    """Fetch outcomes per time window; on a stream, windows come out once the watermark passes, and an
    outcome more than ``delay`` behind the newest one is dropped by Spark."""
    rows = log.withWatermark("fetched_at", delay) if log.isStreaming else log
    return (
        rows.groupBy(F.window("fetched_at", width), status_class(F.col("status")).alias("status_class"))
        .agg(F.count(F.lit(1)).alias("fetches"))
        .select(F.col("window.start").alias("window_start"), "status_class", "fetches")
    )


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a memory table; for tests and small jobs."""
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.table(name)


