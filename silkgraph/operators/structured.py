"""Structured data of a page: JSON-LD, microdata, RDFa; validation and statistics.

The scan hands back only the item and property elements of a page, and everything below happens
inside the page row. One explode at the end makes the item table, so no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silkgraph.functions.json_items import item_records
from silkgraph.functions.text import json_string, strip, stripped_pieces
from silkgraph.functions.urls import join_parts, let, unsplit, url_parts
from silkgraph.operators.dom import scan_html, wanted_items
from silkgraph.operators.scale import stored

FIELDS = "array<struct<key:string,truthy:boolean,text:string>>"
RECORD = f"struct<type:string,raw_data:string,parsed_data:string,position:int,error:string,fields:{FIELDS}>"
FORMATS = ("json-ld", "microdata", "rdfa")

# Schema.org prefixes, required fields by type, elements whose value is an attribute.
PREFIXES = ["https://schema.org/", "http://schema.org/"]
REQUIRED = {
    "Article": ["headline", "author"],
    "Product": ["name", "offers"],
    "Organization": ["name"],
    "BreadcrumbList": ["itemListElement"],
}
MEDIA_TAGS = ["img", "audio", "video", "source"]
# A key that holds this holds a URL, and how its text may begin.
URL_KEY = "url"
URL_STARTS = ["http://", "https://", "/"]


def bare_type(name: Column) -> Column:
    """Type or property name without the schema.org prefix."""
    for prefix in PREFIXES:
        name = F.replace(name, F.lit(prefix), F.lit(""))
    return name


def _has(node: Column, name: str) -> Column:
    return F.map_contains_key(node["attrs"], name)


def _attr(node: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(node["attrs"], F.lit(name)), F.lit(""))


def json_ld_scripts(nodes: Column) -> Column:
    """Array of (number, text, raw, parts) of the non-blank JSON-LD scripts."""
    blocks = F.filter(
        nodes, lambda n: (n["tag"] == "script") & (_attr(n, "type") == "application/ld+json")
    )
    numbered = F.transform(
        blocks,
        lambda n, i: F.struct(
            i.alias("number"),
            strip(F.array_join(n["text_pieces"], "")).alias("text"),
            n["raw"].alias("raw"),
            n["parts"].alias("parts"),
        ),
    )
    return F.filter(numbered, lambda s: s["parts"].isNotNull())


def _property_value(node: Column, base: Column) -> Column:
    text = stripped_pieces(node["text_pieces"])
    value = (
        F.when(node["tag"].isin(MEDIA_TAGS), _attr(node, "src"))
        .when(node["tag"] == "a", _attr(node, "href"))
        .when(node["tag"] == "meta", _attr(node, "content"))
        .when(
            node["tag"] == "time", F.coalesce(F.try_element_at(node["attrs"], F.lit("datetime")), text)
        )
        .otherwise(text)
    )
    return let(
        value,
        lambda v: F.when(
            v.startswith("/"),
            let(
                url_parts(v),
                lambda h: let(join_parts(base, h), lambda t: unsplit(t, with_fragment=True)),
            ),
        ).otherwise(v),
    )


def element_properties(nodes: Column, attribute: str, base: Column, rename=lambda c: c) -> Column:
    """Array of (name, value) of the property elements, in document order."""
    named = F.filter(nodes, lambda n: _attr(n, attribute) != "")
    return F.transform(
        named,
        lambda n: F.struct(
            rename(_attr(n, attribute)).alias("name"),
            _property_value(n, base).alias("value"),
        ),
    )


def _grouped(mine: Column) -> Column:
    """Values per property name, names by first occurrence."""
    return F.transform(
        F.array_distinct(F.transform(mine, lambda p: p["name"])),
        lambda name: F.struct(
            name.alias("key"),
            F.transform(F.filter(mine, lambda p: p["name"] == name), lambda p: p["value"]).alias("values"),
        ),
    )


def _with_type(fields: Column, kind: Column) -> Column:
    own = F.filter(fields, lambda f: f["key"] == "@type")
    first = F.struct(
        F.lit("@type").alias("key"),
        F.coalesce(F.try_element_at(own, F.lit(1))["values"], F.array(kind)).alias("values"),
    )
    return F.concat(F.array(first), F.filter(fields, lambda f: f["key"] != "@type"))


def element_items(nodes: Column, scope: str, type_attribute: str, properties: Column, span: int) -> Column:
    """Array of (type, raw_data, position, values): elements with ``scope`` and a type. Properties
    of nested items count for the outer item too; the position counts untyped elements.

    ``span`` says where in an element's spans its part of ``properties`` begins, so an item takes its
    properties as a slice and does not look at those of the others.
    """
    numbered = F.transform(
        F.filter(nodes, lambda n: _has(n, scope)),
        lambda n, i: F.struct(n.alias("n"), i.alias("position")),
    )
    typed = F.filter(numbered, lambda e: _attr(e["n"], type_attribute) != "")

    def item(e: Column, all_properties: Column) -> Column:
        kind = bare_type(_attr(e["n"], type_attribute))
        mine = F.slice(all_properties, e["n"]["spans"][span] + 1, e["n"]["spans"][span + 1])
        return F.struct(
            kind.alias("type"),
            e["n"]["raw"].alias("raw_data"),
            e["position"].alias("position"),
            let(let(mine, _grouped), lambda fields: _with_type(fields, kind)).alias("values"),
        )

    return let(properties, lambda held: F.transform(typed, lambda e: item(e, held)))


def _as_record(item: Column) -> Column:
    def text(f):
        return F.when(F.size(f["values"]) == 1, json_string(f["values"][0])).otherwise(
            F.to_json(f["values"])
        )

    def field(f):
        single = F.size(f["values"]) == 1
        return F.struct(
            f["key"].alias("key"),
            (~single | (f["values"][0] != "")).alias("truthy"),
            F.when(single, f["values"][0]).alias("text"),
        )

    members = F.transform(
        item["values"], lambda f: F.concat(json_string(f["key"]), F.lit(": "), text(f))
    )
    return F.struct(
        item["type"].alias("type"),
        item["raw_data"].alias("raw_data"),
        F.concat(F.lit("{"), F.array_join(members, ", "), F.lit("}")).alias("parsed_data"),
        item["position"].alias("position"),
        F.lit(None).cast("string").alias("error"),
        F.transform(item["values"], field).alias("fields"),
    )


def _labelled(records: Column, name: str) -> Column:
    return F.transform(records, lambda r: F.struct(F.lit(name).alias("format"), r.alias("r")))


RULES = "type string, rule string, property string, position int"
RULE_SET = "struct<name:string,required:array<string>,urls:array<string>>"


def built_in_rules(spark: SparkSession) -> DataFrame:
    """The rules of the four known types as rows (type, rule, property, position): ``required`` properties, and keys
    whose texts must be URLs (``url``: a part of the key, for every type when the type is NULL)."""
    rows = [(name, "required", r, i) for name, required in REQUIRED.items() for i, r in enumerate(required)]
    return spark.createDataFrame([*rows, (None, "url", URL_KEY, 0)], RULES)


def rule_sets(rules: DataFrame) -> DataFrame:
    """One row per type in lower case: the rules of the type and those of every type."""
    places = F.struct("position", "property")
    listed = lambda rule, some: F.transform(F.array_sort(F.collect_list(F.when((F.col("rule") == rule) & some, places))), lambda p: p["property"])
    of_type = F.col("type").isNotNull()
    sets = rules.filter(of_type).groupBy(F.lower("type").alias("low")).agg(
        F.min("type").alias("name"), listed("required", F.lit(True)).alias("required"), listed("url", F.lit(True)).alias("own_urls")
    )
    every = rules.filter(~of_type).agg(listed("url", F.lit(True)).alias("urls")).select("urls").scalar()
    return sets.select("low", F.struct("name", "required", F.array_union(every, F.col("own_urls")).alias("urls")).cast(RULE_SET).alias("rules")).unionByName(
        # what holds for a type without rules of its own
        rules.filter(~of_type).agg(listed("url", F.lit(True)).alias("urls")).select(
            F.lit(None).cast("string").alias("low"), F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("required"), "urls").cast(RULE_SET).alias("rules")
        )
    )


def known_rules(kind: Column) -> Column:
    """The built-in rule set of a type, as a column; no join."""
    low = F.lower(kind)
    urls = F.array(F.lit(URL_KEY))
    out = F.struct(F.lit(None).cast("string").alias("name"), F.array().cast("array<string>").alias("required"), urls.alias("urls")).cast(RULE_SET)
    for name, required in REQUIRED.items():
        own = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, required)).alias("required"), urls.alias("urls")).cast(RULE_SET)
        out = F.when(low == name.lower(), own).otherwise(out)
    return out


def validation_errors(rules: Column, fields: Column) -> Column:
    """Messages for missing required fields, then for texts that are no URL under a key that must hold one."""
    def errors(rules: Column) -> Column:
        missing = F.filter(rules["required"], lambda r: ~F.exists(fields, lambda f: (f["key"] == r) & f["truthy"]))
        bad_urls = F.filter(
            fields,
            lambda f: F.exists(rules["urls"], lambda u: F.lower(f["key"]).contains(u))
            & f["text"].isNotNull()
            & ~F.exists(F.array(*map(F.lit, URL_STARTS)), lambda s: f["text"].startswith(s)),
        )
        return F.concat(
            F.transform(missing, lambda r: F.concat(rules["name"], F.lit(" missing required '"), r, F.lit("' property"))),
            F.transform(bad_urls, lambda f: F.concat(F.lit("Invalid URL format for "), f["key"], F.lit(": "), f["text"])),
        )

    return let(rules, errors)


def items_of_scan(scanned: DataFrame, formats=FORMATS, rules: DataFrame | None = None) -> DataFrame:
    """Item rows of a scanned page table; ``url`` is the base of relative values. Items are checked against ``rules``
    (rows as of ``built_in_rules``), joined by type; without them the built-in rules stand in the plan."""
    keys = [c for c in scanned.columns if c not in ("nodes", "word_count", "parsed")]
    step = scanned.select(*keys, "nodes", url_parts(F.col("url")).alias("base"))
    nodes, base = F.col("nodes"), F.col("base")
    staged, parts = [], []
    if "json-ld" in formats:
        staged.append(item_records(json_ld_scripts(nodes), let).cast(f"array<{RECORD}>").alias("json_ld"))
        parts.append(
            _labelled(
                F.transform(
                    "json_ld", lambda r: r.withField("type", bare_type(r["type"]))
                ),
                "json-ld",
            )
        )
    if "microdata" in formats:
        staged.append(element_properties(nodes, "itemprop", base).alias("micro_properties"))
        parts.append(
            _labelled(
                F.transform(
                    element_items(nodes, "itemscope", "itemtype", F.col("micro_properties"), 0),
                    _as_record,
                ),
                "microdata",
            )
        )
    if "rdfa" in formats:
        staged.append(element_properties(nodes, "property", base, bare_type).alias("rdfa_properties"))
        parts.append(
            _labelled(
                F.transform(
                    element_items(nodes, "typeof", "typeof", F.col("rdfa_properties"), 2), _as_record
                ),
                "rdfa",
            )
        )
    items = step.select(*keys, "nodes", *staged).select(
        *keys, F.explode(F.concat(*parts)).alias("i")
    )
    held = items.withColumn("rules", known_rules(F.col("i.r.type"))) if rules is None else with_rules(items, rules)
    checked = held.select(
        *keys,
        F.col("i.r.type").alias("type"),
        F.col("i.format").alias("format"),
        F.col("i.r.raw_data").alias("raw_data"),
        F.col("i.r.parsed_data").alias("parsed_data"),
        F.col("i.r.position").alias("position"),
        F.when(F.col("i.r.error").isNotNull(), F.array("i.r.error"))
        .otherwise(validation_errors(F.col("rules"), F.col("i.r.fields")))
        .alias("validation_errors"),
    )
    return checked.withColumn("is_valid", F.size("validation_errors") == 0)


def with_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Items with the rule set of their type. The sets are written, so the planner knows their size: few types
    are sent to the items, and items of a type that very many have are not moved; else both are dealt by type."""
    sets = stored(rule_sets(rules), "schema-rules")
    general = sets.filter("low is null").select("rules").scalar()
    own = sets.filter("low is not null").withColumnRenamed("rules", "own_rules")
    joined = items.join(own, F.lower(F.col("i.r.type")) == own["low"], "left")
    return joined.withColumn("rules", F.coalesce("own_rules", general)).drop("low", "own_rules")


def structured_data(pages: DataFrame, formats=FORMATS, rules: DataFrame | None = None) -> DataFrame:
    """All structured items of the pages: (url, type, format, raw_data, parsed_data, position,
    validation_errors, is_valid); ``rules`` as of ``items_of_scan``."""
    return items_of_scan(scan_html(pages.select("url", "html"), wanted_items(formats)), formats, rules)


def schema_statistics(items: DataFrame) -> DataFrame:
    """Totals, and counts by format and by type, with valid and invalid items; and all validation errors of the invalid
    items: a row for every text, ``total`` times in the list. All in one pass, so the pages are scanned once."""
    valid = F.coalesce("is_valid", F.lit(False))

    def entry(level: str, value: Column | None = None) -> Column:
        keys = [(value if name == level else F.lit(None).cast("string")).alias(name) for name in ("format", "type", "validation_error")]
        return F.struct(F.lit(level).alias("level"), *keys)

    counted = F.array(entry("total"), *[entry(name, F.coalesce(name, F.lit("unknown"))) for name in ("format", "type")])
    errors = F.transform("validation_errors", lambda e: entry("validation_error", e))
    listed = F.when(valid | F.col("validation_errors").isNull(), counted).otherwise(F.concat(counted, errors))
    entries = items.select(valid.alias("is_valid"), F.inline(listed))
    return entries.groupBy("level", "format", "type", "validation_error").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
    )


def schema_error_counts(items: DataFrame) -> DataFrame:
    """Every validation error with its number of occurrences."""
    return (
        items.select(F.explode("validation_errors").alias("validation_error"))
        .groupBy("validation_error")
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )
