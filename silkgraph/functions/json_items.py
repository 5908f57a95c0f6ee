"""JSON-LD scripts: what a task does while it holds the page, and the items as columns over VARIANT values.

The task only settles what needs the whole text: whether it is JSON, which objects it lists, and relative
values made absolute at any depth. Types, fields and validity are columns. The functions of the task travel
to the executors by value, like the HTML scan that calls them.
"""

from __future__ import annotations

import json
import sys
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def absolute(value, base):
    """Leading-slash strings made absolute, in objects and in the objects of their lists."""
    if isinstance(value, dict):
        return {
            k: urljoin(base, v) if isinstance(v, str) and v[:1] == "/" else absolute(v, base)
            for k, v in value.items()
        }
    if isinstance(value, list):
        return [absolute(v, base) if isinstance(v, dict) else v for v in value]
    return value


def script_parts(text, base):
    """(place in the list or None, JSON text, error) of the objects of one script, or of what is wrong with it."""
    try:
        data = json.loads(text)
        many = isinstance(data, list)
        return [
            (j if many else None, json.dumps(absolute(item, base)), None)
            for j, item in enumerate(data if many else [data])
            if isinstance(item, dict)
        ]
    except json.JSONDecodeError as e:
        return [(None, None, f"JSON decode error: {e}")]
    except RecursionError as e:
        return [(None, None, f"Parse error: {e}")]


# --- columns -----------------------------------------------------------------------------------

#: How an error text calls a type that is no text, by the start of its variant schema.
CALLED = {"ARRAY": "list", "OBJECT": "dict", "BIGINT": "int", "DOUBLE": "float", "DECIMAL": "float", "BOOLEAN": "bool", "VOID": "NoneType"}
#: Numbers that JSON does not know but some writers use; anything but zero stands for them.
ODD_NUMBERS = r"(?<=[:\[,] |\[)-?(?:NaN|Infinity)(?=[,\]}])"


def plain_json(data: Column) -> Column:
    """JSON text that a variant can hold; only a text that it cannot is changed."""
    return F.when(F.try_parse_json(data).isNotNull(), data).otherwise(F.regexp_replace(data, ODD_NUMBERS, "1"))


def item_type(item: Column) -> tuple[Column, Column]:
    """``@type`` of a variant object, the first of a list, and what it is called if it is no text."""
    kind = F.try_variant_get(item, "$['@type']", "variant")
    schema = F.schema_of_variant(kind)
    first = F.try_variant_get(item, "$['@type'][0]", "variant")
    listed = F.when(F.is_variant_null(first), F.lit("None")).when(
        F.schema_of_variant(first) == "BOOLEAN", F.initcap(F.try_variant_get(first, "$", "string"))
    ).otherwise(F.coalesce(F.try_variant_get(first, "$", "string"), F.to_json(first)))
    name = F.when(kind.isNull(), "Unknown").when(schema == "STRING", F.try_variant_get(kind, "$", "string")).when(
        schema.startswith("ARRAY"), listed
    )
    called = F.lit("object")
    for start, word in CALLED.items():
        called = F.when(schema.startswith(start), word).otherwise(called)
    return name, F.when(name.isNull(), called)


def item_fields(item: Column, keys: Column) -> Column:
    """Array of (key, truthy, text) of a variant object, in the order of ``keys``."""
    values = F.try_variant_get(item, "$", "map<string,variant>")

    def field(key: Column) -> Column:
        value = F.try_element_at(values, key)
        schema, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
        number = F.try_variant_get(value, "$", "double")
        truthy = (
            F.when(schema == "STRING", text != "")
            .when(schema == "BOOLEAN", text == "true")
            .when(schema == "VOID", F.lit(False))
            .when(schema.startswith("ARRAY"), F.try_variant_get(value, "$[0]", "variant").isNotNull())
            .when(schema.startswith("OBJECT"), schema != "OBJECT<>")
            .otherwise(F.coalesce(number != 0, F.lit(True)))
        )
        return F.struct(key.alias("key"), truthy.alias("truthy"), F.when(schema == "STRING", text).alias("text"))

    return F.transform(F.coalesce(keys, F.array().cast("array<string>")), field)


def item_records(scripts: Column, let) -> Column:
    """Array of item records of the scripts, each (number, text, raw, parts), in order.

    A type that is no text ends its script with an error item. A relative value is absolute already.
    """
    def record(kind, raw, parsed, position, error, fields):
        return F.struct(
            kind.alias("type"), raw.alias("raw_data"), parsed.cast("string").alias("parsed_data"), position.cast("int").alias("position"),
            error.cast("string").alias("error"), fields.alias("fields"),
        )

    nothing = F.array().cast("array<struct<key:string,truthy:boolean,text:string>>")

    def held(part):
        data = plain_json(part["data"])
        return let(F.struct(F.try_parse_json(data).alias("item"), F.json_object_keys(data).alias("keys")), lambda v: let(
            F.struct(*[c.alias(n) for n, c in zip(("name", "called"), item_type(v["item"]))], v["item"].alias("item"), v["keys"].alias("keys")),
            lambda t: F.struct(part["at"].alias("at"), part["data"].alias("data"), part["error"].alias("error"),
                               t["name"].alias("name"), t["called"].alias("called"),
                               F.when(part["data"].isNotNull(), item_fields(t["item"], t["keys"])).alias("fields")),
        ))

    def of_script(script):
        def whole(part):
            position = F.coalesce(script["number"] * 100 + part["at"], script["number"])
            broken = F.when(part["error"].startswith("JSON"), record(F.lit("InvalidJSON"), script["text"], F.lit(None), position, part["error"], nothing))
            broken = broken.otherwise(record(F.lit("ParseError"), script["raw"], F.lit(None), script["number"], part["error"], nothing))
            return F.when(part["error"].isNotNull(), broken).otherwise(
                record(part["name"], script["text"], F.nullif(part["data"], F.lit("{}")), position, F.lit(None), part["fields"])
            )

        def ended(parts):
            wrong = F.filter(parts, lambda p: p["called"].isNotNull() & p["error"].isNull())
            last = F.array_position(F.transform(parts, lambda p: p["called"].isNotNull() & p["error"].isNull()), True)
            error = F.concat(F.lit("Parse error: '"), F.try_element_at(wrong, F.lit(1))["called"], F.lit("' object has no attribute 'lower'"))
            end = F.array(record(F.lit("ParseError"), script["raw"], F.lit(None), script["number"], error, nothing))
            return F.when(last == 0, F.transform(parts, whole)).otherwise(
                F.concat(F.transform(F.slice(parts, 1, F.greatest(last - 1, F.lit(0)).cast("int")), whole), end)
            )

        return let(F.transform(script["parts"], held), ended)

    return F.flatten(F.transform(scripts, of_script))
