"""The four views of the data model as DataFrames, and their registration for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _without_slashes(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def self_hreflang(hreflang: DataFrame) -> DataFrame:
    """(url, self_hreflang): the smallest language, x-default aside, whose target is the page
    itself, one trailing slash more or less on either side."""
    url, target = F.col("url"), F.col("href_url")
    same = (_without_slashes(url) == _without_slashes(target)) & (
        F.abs(F.length(url) - F.length(target)) <= 1
    )
    return (
        hreflang.filter(same & (F.col("lang") != "x-default"))
        .groupBy("url")
        .agg(F.min("lang").alias("self_hreflang"))
    )


def page_analysis(
    urls: DataFrame, content: DataFrame, indexability: DataFrame, hreflang: DataFrame,
    canonicals: DataFrame | None = None, inlinks: DataFrame | None = None, frontier: DataFrame | None = None,
) -> DataFrame:
    """Internal and network URLs with everything known about their page.

    ``content``, ``indexability``, ``inlinks`` (``links.inlink_counts``) and ``frontier`` have one row per URL
    and languages are reduced to one before the join, so no join multiplies rows and no group-by follows.
    A page names one canonical URL at most, in its own row; ``canonicals`` is only needed for a stored table
    that may hold several.
    """
    named = F.coalesce("canonical_url", F.lit("")) != ""
    fields = content.select(
        "url", "title", "meta_description", "h1_tags", "h2_tags", "word_count", "html_lang",
        *[
            F.col(c) if c in content.columns else F.lit(None).cast("bigint").alias(c)
            for c in (
                "internal_links_count", "external_links_count", "internal_links_unique_count",
                "external_links_unique_count",
            )
        ],
        *([] if canonicals is not None else [
            F.when(named, F.col("canonical_url")).alias("canonical_urls"), F.when(named, F.lit("html_head")).alias("canonical_sources"),
        ]),
    )
    joined = (
        urls.filter(F.col("classification").isin("internal", "network"))
        .select("url", "kind", "classification")
        .join(fields, "url", "left")
        .join(indexability, "url", "left")
        .join(self_hreflang(hreflang), "url", "left")
        .withColumn("meta_description", F.when(F.col("meta_description") != "", F.col("meta_description")))
        .withColumn("html_lang", F.when(F.col("html_lang") != "", F.col("html_lang")))
    )
    if canonicals is not None:
        joined = joined.join(
            canonicals.groupBy("url").agg(
                F.array_join(F.array_sort(F.collect_set("canonical_url")), ",").alias("canonical_urls"),
                F.array_join(F.array_sort(F.collect_set("source")), ",").alias("canonical_sources"),
            ),
            "url", "left",
        )
    counts = ("inlinks_count", "inlinks_unique_count")
    if inlinks is not None:
        joined = joined.join(inlinks.select("url", *counts), "url", "left")
    else:
        joined = joined.withColumns({c: F.lit(None).cast("bigint") for c in counts})
    if frontier is not None:
        return joined.join(frontier.select("url", F.col("depth").alias("crawl_depth")), "url", "left")
    return joined.withColumn("crawl_depth", F.lit(None).cast("bigint"))


def internal_links_analysis(internal_links: DataFrame) -> DataFrame:
    """Internal links with their values in place of ids."""
    time = ["discovered_at"] if "discovered_at" in internal_links.columns else []
    return internal_links.select(
        "source_url", "target_url", "anchor_text", "xpath", "href", "href_classification",
        "url_fragment", "url_parameters", *time,
    )


def sitemap_statistics(listing: DataFrame, frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Per sitemap: listed and unique URLs, first and last sight, crawl and HTTP outcome.

    ``frontier`` and ``pages`` have one row per URL. Listings are counted per (sitemap, URL) first,
    which spreads a sitemap with very many URLs; the joins by URL come between two aggregations by
    other keys, so AQE may split a URL that very many sitemaps list.
    """
    per_url = listing.groupBy("sitemap_url", "url").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("discovered_at").alias("first"),
        F.max("discovered_at").alias("last"),
    )
    rows = per_url.join(
        frontier.select("url", F.col("status").alias("queue")), "url", "left"
    ).join(pages.select("url", F.col("status").alias("http")), "url", "left")

    def hits(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    return (
        rows.groupBy("sitemap_url")
        .agg(
            F.sum("n").alias("total_urls"),
            F.count(F.lit(1)).alias("unique_urls"),
            F.min("first").alias("first_discovered"),
            F.max("last").alias("last_discovered"),
            hits(F.col("queue") == "done", "crawled_urls"),
            hits(F.col("queue") == "queued", "queued_urls"),
            hits(F.col("queue").isNull(), "not_in_frontier"),
            hits(F.col("http") == 200, "successful_urls"),
            hits(F.col("http") >= 400, "error_urls"),
        )
    )


def schema_analysis(items: DataFrame, urls: DataFrame) -> DataFrame:
    """Structured items of internal and network URLs, by URL and position."""
    own = urls.filter(F.col("classification").isin("internal", "network")).select("url")
    time = ["discovered_at"] if "discovered_at" in items.columns else []
    return (
        items.join(own, "url", "left_semi")
        .select(
            "url", F.col("type").alias("schema_type"), "format", "position", "is_valid",
            "validation_errors", "raw_data", "parsed_data", *time,
        )
    )


VIEW_INPUTS = {
    "page_analysis": (page_analysis, ("urls", "content", "indexability", "hreflang"), ("canonicals", "inlinks", "frontier")),
    "internal_links_analysis": (internal_links_analysis, ("internal_links",), ()),
    "sitemap_statistics": (sitemap_statistics, ("sitemaps_listed", "frontier", "pages"), ()),
    "schema_analysis": (schema_analysis, ("schema_items", "urls"), ()),
}


def build_views(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Every view whose inputs are there; what it can do without is taken where it is given."""
    return {
        name: build(*[tables[t] for t in inputs], **{t: tables[t] for t in more if t in tables})
        for name, (build, inputs, more) in VIEW_INPUTS.items()
        if all(t in tables for t in inputs)
    }


def register_views(tables: dict[str, DataFrame]) -> list[str]:
    """Make tables and views known to ``spark.sql`` under their names."""
    everything = {**tables, **build_views(tables)}
    for name, df in everything.items():
        df.createOrReplaceTempView(name)
    return sorted(everything)
