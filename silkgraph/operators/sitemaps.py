"""Sitemap files: kind, entries, nested indexes, discovery, listings, language alternates."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.text import strip
from silkgraph.functions.urls import netloc, url_classification, url_normalize_storage
from silkgraph.operators.robots import robots_files, robots_sitemaps
from silkgraph.operators.scale import cut, row_ranks, stored

# One entry, prefixes taken off its tags.
_ENTRY = "loc string, link array<struct<_hreflang:string,_href:string>>, unreadable string"
_OPTIONS = {"columnNameOfCorruptRecord": "unreadable", "mode": "PERMISSIVE"}
_OPEN = r"<(?:[\w.-]+:)?(?:url|sitemap)(?:\s[^>]*)?>"
_CLOSE = r"</(?:[\w.-]+:)?(?:url|sitemap)\s*>"

# Where a sitemap is looked for when robots.txt names none.
USUAL_PLACES = ["/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml"]


def _entries(content: Column) -> Column:
    """All ``<url>`` and ``<sitemap>`` entries: array of (kind, loc, link, unreadable).

    The text is cut at the opening tags, whatever their prefix, and every entry is read on its own, a
    lone ``&`` outside CDATA standing for itself; so what is wrong in one entry, or behind the last whole one,
    leaves the others alone. An entry that cannot be read has no loc.
    """
    bare = F.regexp_replace(content, r"(?s)<!--.*?-->", "")
    chunks = F.filter(F.split(bare, f"(?={_OPEN})"), lambda c: c.rlike(rf"\A{_OPEN}"))

    def read(chunk: Column) -> Column:
        body = F.regexp_extract(chunk, rf"(?s)\A{_OPEN}(.*?){_CLOSE}", 1)
        plain = F.regexp_replace(F.regexp_replace(body, r"<(/?)[\w.-]+:", "<$1"), r"&(?!#?\w+;)(?![^<]*\]\]>)", "&amp;")
        return F.struct(
            F.regexp_extract(chunk, r"\A<(?:[\w.-]+:)?(url|sitemap)", 1).alias("kind"),
            F.from_xml(F.concat(F.lit("<entry>"), plain, F.lit("</entry>")), F.lit(_ENTRY), _OPTIONS).alias("e"),
        )

    return F.transform(F.transform(chunks, read), lambda x: F.struct(
        x["kind"].alias("kind"),
        F.when(x["e"]["unreadable"].isNull(), F.nullif(strip(x["e"]["loc"]), F.lit(""))).alias("loc"),
        F.coalesce(x["e"]["link"], F.array().cast("array<struct<_hreflang:string,_href:string>>")).alias("link"),
    ))


def _root(content: Column) -> Column:
    prolog = r"(?s)\A\uFEFF?(?:\s|<\?.*?\?>|<!--.*?-->|<![^>-][^>]*>)*<([^\s/>]+)"
    return F.lower(F.regexp_extract(content, prolog, 1))


def sitemap_files(files: DataFrame) -> DataFrame:
    """Files that were answered with 200."""
    return files.filter(F.col("status") == 200)


def sitemap_kind(files: DataFrame) -> DataFrame:
    """(url, kind): sitemap_index or sitemap, by the root element; what is no XML counts as sitemap."""
    index = F.coalesce(_root(F.col("content")).endswith("sitemapindex"), F.lit(False))
    return files.select("url", F.when(index, "sitemap_index").otherwise("sitemap").alias("kind"))


def sitemap_locs(files: DataFrame) -> DataFrame:
    """(url, kind, position, loc) of a sitemap met inside the crawl: the nested files of an index, else
    the listed URLs."""
    index = F.coalesce(_root(F.col("content")).endswith("sitemapindex"), F.lit(False))
    parsed = files.select("url", index.alias("index"), _entries(F.col("content")).alias("found"))
    own = F.filter("found", lambda e: e["loc"].isNotNull() & ((e["kind"] == "sitemap") == F.col("index")))
    return parsed.select(
        "url",
        F.when(F.col("index"), "sitemap_index").otherwise("sitemap").alias("kind"),
        F.posexplode(F.transform(own, lambda e: e["loc"])).alias("position", "loc"),
    )


def read_files(files: DataFrame) -> DataFrame:
    """(sitemap_url, nested array<string>, entries array<struct<loc, alternates>>, unreadable).

    A file with any ``<sitemap>`` gives nested files only. A repeated loc keeps its first place and
    its last alternates. ``unreadable`` counts the entries without a loc that could be read.
    """
    parsed = sitemap_files(files).select(F.col("url").alias("sitemap_url"), _entries(F.col("content")).alias("found"))
    whole = F.filter("found", lambda e: e["loc"].isNotNull())
    nested = F.transform(F.filter(whole, lambda e: e["kind"] == "sitemap"), lambda e: e["loc"])
    entries = F.transform(
        F.filter(whole, lambda e: e["kind"] == "url"),
        lambda e: F.struct(
            e["loc"].alias("loc"),
            F.filter(
                F.transform(e["link"], lambda l: F.struct(l["_hreflang"].alias("lang"), l["_href"].alias("href_url"))),
                lambda l: (F.coalesce(l["lang"], F.lit("")) != "") & (F.coalesce(l["href_url"], F.lit("")) != ""),
            ).alias("alternates"),
        ),
    )
    is_index = F.exists("found", lambda e: e["kind"] == "sitemap")
    return parsed.select(
        "sitemap_url",
        nested.alias("nested"),
        F.when(is_index, F.slice(entries, 1, 0)).otherwise(entries).alias("entries"),
        (F.size("found") - F.size(whole)).alias("unreadable"),
    )


def entries_of(read: DataFrame) -> DataFrame:
    """(sitemap_url, position, loc, alternates) of the plain sitemaps among files read, one row per loc.

    The aggregate is per (file, loc): repeats meet inside the task that reads the file.
    """
    rows = read.select("sitemap_url", F.posexplode("entries").alias("at", "e"))
    return rows.groupBy("sitemap_url", F.col("e.loc").alias("loc")).agg(
        F.min("at").alias("position"), F.max_by("e.alternates", "at").alias("alternates")
    )


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(sitemap_url, position, loc, alternates) of the plain sitemaps, one row per loc."""
    return entries_of(read_files(files))


def edges_of(read: DataFrame) -> DataFrame:
    """(parent, position, child) of the sitemap indexes among files read."""
    return read.select(F.col("sitemap_url").alias("parent"), F.posexplode("nested").alias("position", "child"))


def sitemap_visits(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, sitemap_url, level, trail): every file reached from the starts of a site, once, by the ``edges`` of
    the indexes (parent, position, child).

    ``starts`` is (site, position, sitemap_url). ``trail`` holds the positions from the start to the
    file. Within a level, trails in array order are the order of a first-in first-out walk, so
    (level, trail) replaces a visit counter. A round touches only the files found by the round
    before; rounds end when nothing new turns up, whatever the nesting depth: a file already seen by
    the site is not visited again.
    """

    def first(found: DataFrame) -> DataFrame:
        return found.groupBy("site", "sitemap_url").agg(F.min("trail").alias("trail"))

    level = cut(
        first(starts.select("site", "sitemap_url", F.array("position").alias("trail"))).withColumn(
            "level", F.lit(0)
        )
    )
    seen = level
    for depth in itertools.count(1):
        found = level.join(edges, level["sitemap_url"] == edges["parent"]).select(
            "site",
            F.col("child").alias("sitemap_url"),
            F.concat("trail", F.array(edges["position"])).alias("trail"),
        )
        level = cut(
            first(found)
            .join(seen.select("site", "sitemap_url"), ["site", "sitemap_url"], "left_anti")
            .withColumn("level", F.lit(depth))
        )
        if level.isEmpty():
            return seen
        seen = seen.unionByName(level)


def sitemap_closure(starts: DataFrame, files: DataFrame) -> DataFrame:
    """(site, loc, sitemap_url, alternates, level, trail, position): every URL listed in the files
    reached by a site. Place from its first listing, source file and alternates from its last.

    Every file is parsed once: what was read is written, and both the edges and the entries come from that table.
    """
    read = stored(read_files(files), "sitemaps-read")
    visits = sitemap_visits(starts, stored(edges_of(read), "sitemap-edges"))
    listed = visits.join(entries_of(read), "sitemap_url").withColumn(
        "at", F.struct("level", "trail", "position")
    )
    return (
        listed.groupBy("site", "loc")
        .agg(
            F.min("at").alias("at"),
            F.max_by(F.struct("sitemap_url", "alternates"), "at").alias("last"),
        )
        .select("site", "loc", "last.*", "at.*")
    )


def sitemap_discovery(
    domains: DataFrame, robots: DataFrame, files: DataFrame, skip_robots: bool = False
) -> DataFrame:
    """(site, position, sitemap_url): the Sitemap lines of robots.txt, else the first usual place
    that has a file."""
    places = domains.select(
        F.col("domain").alias("site"),
        F.posexplode(
            F.array(
                *[F.concat(F.lit("https://"), F.col("domain"), F.lit(p)) for p in USUAL_PLACES]
            )
        ).alias("place", "sitemap_url"),
    )
    existing = (
        places.join(
            sitemap_files(files).select(F.col("url").alias("sitemap_url")), "sitemap_url", "left_semi"
        )
        .groupBy("site")
        .agg(F.min_by("sitemap_url", "place").alias("sitemap_url"))
        .select("site", F.lit(0).alias("position"), "sitemap_url")
    )
    if skip_robots:
        return existing
    named = (
        robots_sitemaps(robots)
        .join(domains, "domain", "left_semi")
        .select(F.col("domain").alias("site"), "position", "sitemap_url")
    )
    return named.unionByName(existing.join(named, "site", "left_anti"))


def sitemap_listing(closure: DataFrame) -> DataFrame:
    """(site, url, sitemap_url, sitemap_position): position in the whole discovery of the site."""
    ranked = row_ranks(
        closure.select("site", "loc", "sitemap_url", "level", "trail", "position"),
        order=[F.col("level"), F.col("trail"), F.col("position")],
        by=["site"],
        name="sitemap_position",
    )
    return ranked.select(
        "site", url_normalize_storage(F.col("loc")).alias("url"), "sitemap_url", "sitemap_position"
    )


def hreflang_sitemap(entries: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, lang, href_url, href_key, source): language alternates of known URLs, without repeats."""
    rows = entries.select(
        url_normalize_storage(F.col("loc")).alias("url"), F.explode("alternates").alias("a")
    ).select("url", "a.lang", "a.href_url")
    return (
        rows.distinct()
        .join(urls.select("url"), "url", "left_semi")
        .withColumn("href_key", url_normalize_storage(F.col("href_url")))
        .withColumn("source", F.lit("sitemap"))
    )


def hreflang_new_urls(hreflang: DataFrame, urls: DataFrame) -> DataFrame:
    """(url, kind, classification) of alternate targets missing in ``urls``. A target is classified
    against its own host."""
    target = F.col("href_url")
    return (
        hreflang.select(target.alias("url"))
        .distinct()
        .join(urls.select("url"), "url", "left_anti")
        .select(
            "url",
            F.lit("other").alias("kind"),
            url_classification(F.col("url"), netloc(F.col("url")), F.lit(True)).alias("classification"),
        )
    )
