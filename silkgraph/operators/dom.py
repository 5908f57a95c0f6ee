"""HTML scan (one Python pass per page) and the shared lookups in its result."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from silkgraph.functions.element_rows import HtmlNodes, scan_batches
from silkgraph.functions.text import joined_text

DOM_COLUMNS = ("nodes", "word_count", "parsed")


def dom_fields() -> list[T.StructField]:
    """Columns the scan adds: the elements of a page, its word count, whether it could be read."""
    node = T.StructType(
        [
            T.StructField("ord", T.IntegerType()),
            T.StructField("parent_ord", T.IntegerType()),
            T.StructField("subtree_end", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
            T.StructField("text_pieces", T.ArrayType(T.StringType())),
            T.StructField("xpath", T.StringType()),
            T.StructField("spans", T.ArrayType(T.IntegerType())),
            T.StructField("raw", T.StringType()),
            T.StructField("parts", T.ArrayType(T.StructType([
                T.StructField("at", T.IntegerType()), T.StructField("data", T.StringType()), T.StructField("error", T.StringType()),
            ]))),
        ]
    )
    types = [T.ArrayType(node), T.IntegerType(), T.BooleanType()]
    return [T.StructField(n, t) for n, t in zip(DOM_COLUMNS, types)]


TEXT_TAGS = ("title", "h1", "h2", "a")
CONTENT_TAGS = ("title", "meta", "link", "html", "h1", "h2")
#: Attributes of the elements that the items of a format are made of; JSON-LD stands in scripts.
FORMAT_ATTRIBUTES = {"json-ld": (), "microdata": ("itemscope", "itemprop"), "rdfa": ("typeof", "property")}
ITEM_ATTRIBUTES = tuple(a for own in FORMAT_ATTRIBUTES.values() for a in own)


def wanted(
    tags=None, attributes=(), text_tags=TEXT_TAGS, xpath=False, json_ld=False, raw=False
) -> dict:
    """What the scan hands back: the column pruning of the HTML pass. None means all tags, or the text of all tags."""
    return {
        "tags": None if tags is None else frozenset(tags),
        "attrs": tuple(attributes),
        "text_tags": None if text_tags is None else frozenset(text_tags),
        "xpath": xpath,
        "json_ld": json_ld,
        "raw": raw,
    }


LINKS = wanted(tags=("a",))
LINKS_WITHOUT_TEXT = wanted(tags=("a",), text_tags=())
LINKS_WITH_PATH = wanted(tags=("a",), xpath=True)
CONTENT = wanted(tags=CONTENT_TAGS)
ITEMS = wanted(tags=(), attributes=ITEM_ATTRIBUTES, json_ld=True, raw=True)


def wanted_items(formats) -> dict:
    """What the items of some formats need: the elements of the others stay in the task."""
    return {**ITEMS, "attrs": tuple(a for f, own in FORMAT_ATTRIBUTES.items() if f in formats for a in own), "json_ld": "json-ld" in formats}


EVERYTHING = wanted(tags=(*CONTENT_TAGS, "a"), attributes=ITEM_ATTRIBUTES, xpath=True,
                    json_ld=True, raw=True)


def scan_html(pages: DataFrame, want: dict, html: str = "html") -> DataFrame:
    """Replace the page body by ``nodes`` (array of elements), ``word_count`` and ``parsed``.

    One row per page in and out: what belongs to a page is later computed inside its row, without
    a shuffle. Only the wanted elements leave the Python worker.
    """
    source = pages.select(*[c for c in pages.columns if c != html], html)
    schema = T.StructType(source.schema.fields[:-1] + dom_fields())
    return source.mapInArrow(partial(scan_batches, want=want), schema)


def html_nodes(pages: DataFrame, want: dict | None = None, html: str = "html") -> DataFrame:
    """One row per element: ord, parent_ord, subtree_end, tag, attrs, text_pieces, xpath, spans, raw, parts."""
    scanned = scan_html(pages, want or wanted(), html)
    keys = [c for c in scanned.columns if c not in DOM_COLUMNS]
    return scanned.select(*keys, F.explode("nodes").alias("node")).select(*keys, "node.*")


NODE_COLUMNS = "ord int, parent_ord int, subtree_end int, tag string, attrs map<string,string>, text string, xpath string"


def register_html_nodes(spark: SparkSession, name: str = "html_nodes") -> None:
    """Make ``html_nodes(html)`` a table function of the session's SQL: one row for each element of a page, to be
    joined by ``LATERAL``. A page that the parser gives up, or NULL, has no rows. Rows come in Arrow batches."""
    spark.udtf.register(name, F.udtf(HtmlNodes, returnType=NODE_COLUMNS, useArrow=True))


def with_tag(nodes: Column, tag: str, test=None) -> Column:
    """The elements of a tag, optionally those for which ``test(attrs)`` holds."""
    return F.filter(
        nodes,
        lambda n: (n["tag"] == tag) if test is None else (n["tag"] == tag) & test(n["attrs"]),
    )


def first_node(found: Column) -> Column:
    return F.try_element_at(found, F.lit(1))


def attribute(node: Column, name: str) -> Column:
    """Attribute of an element, empty when it is missing, NULL without element."""
    return F.when(
        node.isNotNull(), F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))
    )


def node_text(node: Column) -> Column:
    return F.when(node.isNotNull(), joined_text(node["text_pieces"]))
