"""Links of a page, their components, counts per page and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.text import stripped_pieces
from silkgraph.functions.urls import (
    bare_parts,
    components_from,
    host,
    host_classification,
    join_parts,
    let,
    unsplit,
    url_classification,
    url_parts,
)
from silkgraph.operators.dom import LINKS, LINKS_WITHOUT_TEXT, LINKS_WITH_PATH, scan_html


def _anchor_nodes() -> Column:
    return F.filter(
        "nodes", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")
    )


def _link_rows(scanned: DataFrame, keys: list[str], base: Column, describe) -> DataFrame:
    """One row per ``<a href>``: keys, ``link_no`` and the fields ``describe`` gives for an element
    and the parts of the base and of the href.

    The links of a page are described inside its row and exploded last. The base is taken apart
    once per page and an href once per link, and filters of later steps stop at the explode
    instead of repeating the URL work below it.
    """
    described = let(
        url_parts(base),
        lambda b: F.transform(
            _anchor_nodes(),
            lambda n: let(url_parts(n["attrs"]["href"]), lambda h: describe(n, b, h)),
        ),
    )
    return scanned.select(*keys, F.posexplode(described).alias("link_no", "l")).select(
        *keys, "link_no", "l.*"
    )


def _scan(pages: DataFrame, base: str, want: dict) -> DataFrame:
    return scan_html(
        pages.select(F.col("url").alias("source_url"), F.col(base).alias("_from"), "html"), want
    )


def _target(b: Column, h: Column) -> Column:
    return let(join_parts(b, h), lambda t: unsplit(t))


def extract_links(pages: DataFrame, base: str = "url") -> DataFrame:
    """(source_url, link_no, target_url): every ``<a href>``, resolved, in document order."""
    return _link_rows(
        _scan(pages, base, LINKS_WITHOUT_TEXT), ["source_url"], F.col("_from"),
        lambda n, b, h: F.struct(_target(b, h).alias("target_url")),
    )


def extract_links_detailed(pages: DataFrame, base: str = "url", xpath: bool = True) -> DataFrame:
    """As ``extract_links`` with anchor text, raw href and XPath."""
    return _link_rows(
        _scan(pages, base, LINKS_WITH_PATH if xpath else LINKS), ["source_url"], F.col("_from"),
        lambda n, b, h: F.struct(
            _target(b, h).alias("target_url"),
            stripped_pieces(n["text_pieces"]).alias("anchor_text"),
            n["xpath"].alias("xpath"),
            n["attrs"]["href"].alias("href"),
        ),
    )


def page_links(
    pages: DataFrame, base_domain: Column | None = None, base: str = "url", columns: list[str] | None = None
) -> DataFrame:
    """All links with components and classification, ``target_key`` being the key of the target in
    the URL table. ``base_domain`` defaults to the host of the page. Only the named ``columns`` are built, if given."""
    slim = pages.select(
        F.col("url").alias("source_url"),
        F.col(base).alias("_from"),
        (host(F.col("url")) if base_domain is None else base_domain).alias("_site"),
        "html",
    )
    want = LINKS_WITH_PATH if columns is None or "xpath" in columns else LINKS if "anchor_text" in columns else LINKS_WITHOUT_TEXT
    return links_of_scan(scan_html(slim, want), columns)


def links_of_scan(scanned: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``page_links`` for a table scanned already (columns source_url, _from, _site, nodes)."""
    site = F.col("_site")

    def describe(n: Column, b: Column, h: Column) -> Column:
        joined = F.struct(join_parts(b, h).alias("t"), join_parts(b, bare_parts(h)).alias("j"))
        return let(
            joined,
            lambda v: let(
                components_from(h, v["j"]),
                lambda c: F.struct(*[value().alias(name) for name, value in {
                    "raw_href": lambda: n["attrs"]["href"],
                    "link_url": lambda: unsplit(v["t"]),
                    "target_key": lambda: unsplit(v["t"], lower_host=True),
                    "anchor_text": lambda: stripped_pieces(n["text_pieces"]),
                    "xpath": lambda: n["xpath"],
                    "href": lambda: c["href"],
                    "url_fragment": lambda: c["url_fragment"],
                    "url_parameters": lambda: c["url_parameters"],
                    "classification": lambda: host_classification(v["t"]["netloc"], site),
                    "href_classification": lambda: url_classification(c["href"], site),
                }.items() if columns is None or name in columns]),
            ),
        )

    return _link_rows(scanned, ["source_url"], F.col("_from"), describe)


def internal_links(links: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """Internal links with the target filled in when the URL is known; without ``urls`` the target is left out.

    One page row per source makes (source, XPath) unique by construction, because every element has
    its own path; so nothing has to be grouped. The known URLs join on their unique key, and no
    aggregation follows, so AQE may split a target that very many links share.
    """
    own = links.filter(F.col("classification") == "internal")
    columns = ["anchor_text", "xpath", "href", "href_classification", "url_fragment", "url_parameters", "link_no"]
    if urls is None:
        return own.select("source_url", *columns)
    known = urls.select(F.col("url").alias("target_url"))
    return own.join(known, own["href"] == known["target_url"], "left").select("source_url", "target_url", *columns)


COUNTS = (
    "internal_links_count", "external_links_count", "internal_links_unique_count",
    "external_links_unique_count",
)


def count_columns(base: Column, site: Column, hrefs: bool = False) -> Column:
    """Struct of the four link counts of a scanned page (needs ``nodes``), computed in its row; with ``hrefs`` also
    the targets of its internal links, repeats included."""

    def counts(seen: Column) -> Column:
        own = F.transform(F.filter(seen, lambda s: s["internal"]), lambda s: s["href"])
        other = F.transform(F.filter(seen, lambda s: ~s["internal"]), lambda s: s["href"])
        sizes = [F.size(own), F.size(other), F.size(F.array_distinct(own)), F.size(F.array_distinct(other))]
        more = [own.alias("internal_hrefs")] if hrefs else []
        return F.struct(*[v.cast("bigint").alias(n) for n, v in zip(COUNTS, sizes)], *more)

    def seen(b: Column, h: Column) -> Column:
        joined = F.struct(join_parts(b, h).alias("t"), join_parts(b, bare_parts(h)).alias("j"))
        return let(
            joined,
            lambda v: F.struct(
                (host_classification(v["t"]["netloc"], site) == "internal").alias("internal"),
                components_from(h, v["j"])["href"].alias("href"),
            ),
        )

    return let(
        let(
            url_parts(base),
            lambda b: F.transform(
                _anchor_nodes(),
                lambda n: let(url_parts(n["attrs"]["href"]), lambda h: seen(b, h)),
            ),
        ),
        counts,
    )


def page_link_counts(pages: DataFrame, base: str = "url") -> DataFrame:
    """(source_url, four counts) straight from the pages: no explode, no shuffle."""
    scanned = _scan(pages, base, LINKS_WITHOUT_TEXT)
    return scanned.select(
        "source_url", count_columns(F.col("_from"), host(F.col("source_url"))).alias("c")
    ).select("source_url", "c.*")


def link_counts(links: DataFrame) -> DataFrame:
    """The four counts from a stored link table, unique ones by href without query.

    Equal hrefs of a source are counted first, so a source with very many links spreads over the
    (source, href) partitions before its totals meet.
    """
    inner = F.col("internal")
    return (
        links.withColumn("internal", F.col("classification") == "internal")
        .groupBy("source_url", "href", "internal")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("source_url")
        .agg(
            F.sum(F.when(inner, F.col("n")).otherwise(0)).alias("internal_links_count"),
            F.sum(F.when(~inner, F.col("n")).otherwise(0)).alias("external_links_count"),
            F.count_if(inner).alias("internal_links_unique_count"),
            F.count_if(~inner).alias("external_links_unique_count"),
        )
    )


def inlink_counts(edges: DataFrame, source: str = "source_url", target: str = "target_url") -> DataFrame:
    """Incoming links per target, all and by distinct source."""
    return (
        edges.filter(F.col(target).isNotNull())
        .groupBy(target, source)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(F.col(target).alias("url"))
        .agg(
            F.sum("n").alias("inlinks_count"),
            F.count(F.lit(1)).alias("inlinks_unique_count"),
        )
    )


def crawl_depth(urls: DataFrame, frontier: DataFrame) -> DataFrame:
    """(url, crawl_depth): the depth of the frontier, NULL for URLs never queued."""
    return urls.select("url").join(
        frontier.select("url", F.col("depth").alias("crawl_depth")), "url", "left"
    )
