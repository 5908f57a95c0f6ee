"""Page fields: title, description, directives, canonical, language, headings, word count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.http import header
from silkgraph.functions.text import directives, joined_text, strip
from silkgraph.functions.urls import host
from silkgraph.operators.dom import CONTENT, attribute, first_node, node_text, scan_html, with_tag
from silkgraph.operators.links import count_columns


def _named_meta(nodes: Column, name: str) -> Column:
    return strip(
        attribute(
            first_node(
                with_tag(nodes, "meta", lambda a: F.try_element_at(a, F.lit("name")) == name)
            ),
            "content",
        )
    )


def page_title(nodes: Column) -> Column:
    return node_text(first_node(with_tag(nodes, "title")))


def meta_description(nodes: Column) -> Column:
    return _named_meta(nodes, "description")


def meta_robots(nodes: Column) -> Column:
    return directives(_named_meta(nodes, "robots"))


def header_robots(headers: Column) -> Column:
    return directives(header(headers, "x-robots-tag"))


def canonical_url(nodes: Column) -> Column:
    """``href`` of the first canonical link, as written."""
    links = with_tag(
        nodes,
        "link",
        lambda a: F.array_contains(F.split(F.try_element_at(a, F.lit("rel")), r"\s+"), "canonical"),
    )
    return strip(attribute(first_node(links), "href"))


def html_lang(nodes: Column) -> Column:
    return strip(attribute(first_node(with_tag(nodes, "html")), "lang"))


def headings(nodes: Column, tag: str) -> Column:
    """Non-empty texts of a heading level, in document order."""
    return F.filter(
        F.transform(with_tag(nodes, tag), lambda n: joined_text(n["text_pieces"])),
        lambda t: t != "",
    )


def content_columns(scanned: DataFrame) -> DataFrame:
    """Page fields of a scanned page table (needs ``nodes``); other columns stay."""
    nodes = F.col("nodes")
    headers = F.col("headers") if "headers" in scanned.columns else F.lit(None).cast("map<string,string>")
    keys = [c for c in scanned.columns if c not in ("nodes", "word_count", "parsed", "headers")]
    return scanned.select(
        *keys,
        page_title(nodes).alias("title"),
        meta_description(nodes).alias("meta_description"),
        headings(nodes, "h1").alias("h1_tags"),
        headings(nodes, "h2").alias("h2_tags"),
        F.col("word_count"),
        meta_robots(nodes).alias("html_meta_directives"),
        F.when(F.col("parsed"), header_robots(headers))
        .otherwise(F.array().cast("array<string>"))
        .alias("http_header_directives"),
        canonical_url(nodes).alias("canonical_url"),
        html_lang(nodes).alias("html_lang"),
    )


def has_content(df: DataFrame) -> DataFrame:
    """Keep pages with a title, a description or a heading."""
    return df.filter(
        (F.coalesce("title", F.lit("")) != "")
        | (F.coalesce("meta_description", F.lit("")) != "")
        | (F.size("h1_tags") > 0)
        | (F.size("h2_tags") > 0)
    )


def page_content(pages: DataFrame, gate: bool = True) -> DataFrame:
    """One row per page with its fields; pages without any of title, description, h1 and h2 drop
    out unless ``gate`` is off."""
    out = content_columns(scan_html(pages, CONTENT))
    return has_content(out) if gate else out


def page_facts(pages: DataFrame, gate: bool = True, hrefs: bool = False) -> DataFrame:
    """``page_content`` with the four link counts of the page, in one pass over the HTML; with ``hrefs`` also the
    targets of its internal links.

    ``pages`` is (url, html, headers). Every column is computed in the page row.
    """
    scanned = scan_html(pages, {**CONTENT, "tags": CONTENT["tags"] | {"a"}})
    counted = scanned.withColumn("_counts", count_columns(F.col("url"), host(F.col("url")), hrefs))
    fields = content_columns(counted)
    fields = has_content(fields) if gate else fields
    return fields.select(*[c for c in fields.columns if c != "_counts"], "_counts.*")
