"""Breadth-first expansion over captured links."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.urls import crawl_policy, host, url_classification, url_normalize_storage
from silkgraph.operators.robots import robots_allowed

from silkgraph.operators.scale import BucketTable, cut, stored
from silkgraph.operators.state import first_pages


#: Edges of a source from which on they are not kept in its bucket, where one task would read them.
MANY = 100_000


def found_by(done: DataFrame, edges: list[DataFrame], seen: DataFrame) -> DataFrame:
    """(url, parent, crawlable) of the targets of the pages ``done`` (url) that are not in ``seen`` (url)."""
    ahead = None
    for part in edges:
        rows = part.join(done.select(F.col("url").alias("source_url")), "source_url")
        ahead = rows if ahead is None else ahead.unionByName(rows)
    met = ahead.groupBy(F.col("target_url").alias("url")).agg(
        F.min("source_url").alias("parent"), F.max("crawlable").alias("crawlable")
    )
    return met.join(seen.select("url"), "url", "left_anti")


def crawl_reachability(
    seeds: DataFrame, links: DataFrame, max_depth: int | None = None, max_pages: int = 0
) -> DataFrame:
    """(url, depth, parent, crawled, recorded): what a crawl from ``seeds`` (url) meets.

    ``links`` is (source_url, target_url, crawlable). Levels follow until no new page turns up, or, if
    the caller sets ``max_depth``, pages of lesser depth are expanded. A link that may not be crawled is
    recorded and not queued. ``max_pages`` cuts the processed pages in queue order (depth, then URL);
    queued pages beyond it have crawled = false. The smallest parent URL wins a tie.

    Edges are reduced to one per (source, target) and stored once in buckets of their source; everything
    seen is stored in buckets of its URL, a level after the other. A level therefore reads both where
    they lie, and only the (target, source) pairs of the pages found by the level before are exchanged. Edges
    of a source that has very many stand in a table without buckets, whose joins may be split.
    """
    spark = seeds.sparkSession
    reduced = stored(
        links.select("source_url", "target_url", "crawlable")
        .groupBy("source_url", "target_url")
        .agg(F.max("crawlable").alias("crawlable")),
        "crawl-edges",
    )
    busy = stored(reduced.groupBy("source_url").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MANY).select("source_url"), "crawl-busy")
    some = not busy.isEmpty()
    near, seen = BucketTable(spark, "crawl_edges", "source_url"), BucketTable(spark, "crawl_seen", "url")
    try:
        near.add(reduced.join(busy, "source_url", "left_anti") if some else reduced)
        edges = [near.read()]
        if some:
            edges.append(stored(reduced.join(busy, "source_url", "left_semi"), "crawl-busy-edges"))
        level = seeds.select(
            "url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"),
            F.lit(False).alias("recorded"),
        ).dropDuplicates(["url"])
        left, ranked = max_pages, None
        for depth in itertools.count():
            if not seen.add(level):
                break
            rows = seen.read()
            level = rows.filter(F.col("depth") == depth)
            done = level.filter(~F.col("recorded")).select("url")
            if max_pages > 0:
                if left <= 0:
                    break
                done = cut(first_pages(done, [F.col("url")], left))
                left -= done.count()
                ranked = done if ranked is None else ranked.unionByName(done)
            if depth == max_depth:
                break
            level = found_by(done, edges, rows).select(
                "url", F.lit(depth + 1).alias("depth"), "parent", (~F.col("crawlable")).alias("recorded")
            )
        out = seen.read()
    finally:
        near.close()
        seen.close()
    if max_pages > 0 and ranked is not None:
        out = out.join(ranked.withColumn("crawled", F.lit(True)), "url", "left").withColumn("crawled", F.coalesce("crawled", F.lit(False)))
    else:
        out = out.withColumn("crawled", ~F.col("recorded"))
    return out.select("url", "depth", "parent", "crawled", "recorded")


def crawl_edges(
    links: DataFrame, robots: DataFrame, listed: DataFrame | None = None, base_domain: Column | None = None,
    agent: str = "*", allow_external: bool = False, respect_robots: bool = True,
) -> DataFrame:
    """(source_url, target_url, ord, crawlable): the edges that a crawl follows or only records.

    ``links`` are page links and ``listed`` the children of sitemap files, both (source_url, target_url, ord).
    Targets are taken in storage form and classified against ``base_domain`` (the host of the source, if
    not given); robots.txt is asked once for each distinct target, whatever the number of its links.
    """
    base = host(F.col("source_url")) if base_domain is None else base_domain

    def edges(rows: DataFrame, sitemap: bool) -> DataFrame:
        target = url_normalize_storage(F.col("target_url"))
        return rows.select("source_url", target.alias("target_url"), "ord").withColumn(
            "classification", url_classification(F.col("target_url"), base, F.lit(sitemap))
        )

    every = edges(links, False)
    if listed is not None:
        every = every.unionByName(edges(listed, True))
    answered = robots_allowed(every.select("target_url").distinct(), robots, agent, url="target_url")
    crawlable = crawl_policy(F.col("classification"), F.col("robots_allowed"), allow_external, respect_robots)
    return every.join(answered, "target_url", "left").select("source_url", "target_url", "ord", crawlable.alias("crawlable"))
