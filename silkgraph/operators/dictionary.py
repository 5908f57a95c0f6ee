"""Surrogate ids for text values, used when tables are exported in normalised form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silkgraph.operators.scale import row_ranks

#: The dictionaries of the data model, each with the table and the column that fill it, and whether
#: a blank counts as no value.
DICTIONARIES = {
    "anchor_texts": ("internal_links", "anchor_text", False),
    "xpaths": ("internal_links", "xpath", False),
    "robots_directive_strings": ("directives", "directive", False),
    "meta_descriptions": ("content", "meta_description", True),
    "html_languages": ("content", "html_lang", True),
    "hreflang_languages": ("hreflang", "lang", False),
    "schema_types": ("schema_items", "type", False),
}


def encode_dictionary(
    values: DataFrame, column: str, known: DataFrame | None = None, blank_is_null: bool = False
) -> DataFrame:
    """(id, value): ``known`` plus an id for every unseen value, in value order after the last id.

    Ids come from a distributed rank; no task sees all values.
    """
    text = F.col(column)
    present = text.isNotNull() & (text != "") if blank_is_null else text.isNotNull()
    unseen = values.filter(present).select(text.alias("value")).distinct()
    if known is None:
        return row_ranks(unseen, [F.col("value")], name="_r").select(
            (F.col("_r") + 1).alias("id"), "value"
        )
    last = known.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    fresh = row_ranks(
        unseen.join(known, "value", "left_anti"), [F.col("value")], name="_r"
    ).select((F.col("_r") + 1 + last).alias("id"), "value")
    return known.select("id", "value").unionByName(fresh)


def encode_dictionaries(
    tables: dict[str, DataFrame], known: DataFrame | None = None, dictionaries: dict[str, tuple[str, str, bool]] = DICTIONARIES
) -> DataFrame:
    """(dictionary, id, value): all dictionaries of the given tables in one table, ``known`` and what is new.

    Every table is read once, whatever the number of its coded columns. Values are made distinct where they are
    read and once more by (dictionary, value); one distributed rank numbers those of all dictionaries, in value
    order after the last id of their own. Ids that were given stay.
    """
    values = None
    for table, rows in tables.items():
        coded = [(name, column, blank) for name, (home, column, blank) in dictionaries.items() if home == table and column in rows.columns]
        if not coded:
            continue
        pairs = F.array(*[
            F.struct(F.lit(name).alias("dictionary"), (F.nullif(F.col(column), F.lit("")) if blank else F.col(column)).alias("value"))
            for name, column, blank in coded
        ])
        found = rows.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").distinct()
        values = found if values is None else values.unionByName(found)
    if values is None:
        raise ValueError("none of the tables has a coded column")
    if known is not None:
        values = values.join(known, ["dictionary", "value"], "left_anti")
    fresh = row_ranks(values, [F.col("value")], ["dictionary"], "_r").select("dictionary", (F.col("_r") + 1).alias("id"), "value")
    if known is None:
        return fresh
    last = known.groupBy("dictionary").agg(F.max("id").alias("last"))  # one row per dictionary
    fresh = fresh.join(last, "dictionary", "left").select("dictionary", (F.col("id") + F.coalesce("last", F.lit(0))).alias("id"), "value")
    return known.select("dictionary", "id", "value").unionByName(fresh)


def _coded(table: str, columns: list[str], dictionaries: dict[str, tuple[str, str, bool]]) -> list[tuple[str, str]]:
    return [(name, column) for name, (home, column, _) in dictionaries.items() if home == table and (column in columns or f"{column}_id" in columns)]


def encoded_table(
    table: str, rows: DataFrame, ids: DataFrame, dictionaries: dict[str, tuple[str, str, bool]] = DICTIONARIES
) -> DataFrame:
    """``rows`` of a table of the data model with ``<column>_id`` in place of every coded column. ``ids`` is what
    ``encode_dictionaries`` gives. Joins by value with one row per value, so a value of very many rows may be split."""
    for name, column in _coded(table, rows.columns, dictionaries):
        own = ids.filter(F.col("dictionary") == name).select(F.col("id").alias(f"{column}_id"), F.col("value").alias(column))
        rows = rows.join(own, column, "left").drop(column)
    return rows


def decoded_table(
    table: str, rows: DataFrame, ids: DataFrame, dictionaries: dict[str, tuple[str, str, bool]] = DICTIONARIES
) -> DataFrame:
    """The rows of ``encoded_table`` with their values again, for the views."""
    for name, column in _coded(table, rows.columns, dictionaries):
        rows = decode_dictionary(rows, f"{column}_id", ids.filter(F.col("dictionary") == name), column).drop(f"{column}_id")
    return rows


def with_ids(df: DataFrame, column: str, dictionary: DataFrame, name: str) -> DataFrame:
    """``df`` with the id of ``column``; NULL where the dictionary has no such value."""
    return df.join(
        dictionary.select(F.col("id").alias(name), F.col("value").alias(column)), column, "left"
    )


def decode_dictionary(df: DataFrame, id_column: str, dictionary: DataFrame, name: str) -> DataFrame:
    """``df`` with the value of ``id_column``. The planner broadcasts a small dictionary."""
    return df.join(
        dictionary.select(F.col("id").alias(id_column), F.col("value").alias(name)), id_column, "left"
    )
