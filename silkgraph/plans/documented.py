"""The documented questions, as SQL over the tables and views.

Each takes DataFrames by name, so that it can run without registering anything; the same text works
on registered views with the braces taken away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

OK_PAGES = """
SELECT a.url, p.status AS status_code, a.title, a.meta_description,
       size(a.h1_tags) AS h1_count, size(a.h2_tags) AS h2_count, p.fetched_at AS discovered_at
FROM {page_analysis} a JOIN {pages} p ON p.url = a.url
WHERE p.status = 200
ORDER BY p.fetched_at DESC, a.url
"""

REDIRECTS = """
SELECT source_url AS source, target_url AS target, chain_length, final_status FROM {redirects}
"""

HREFLANG = """
SELECT h.url, h.lang AS hreflang, h.href_url AS target_url FROM {hreflang} h WHERE h.source = 'sitemap'
"""

DISALLOWED = """
SELECT url, robots_txt_allows, html_meta_allows, overall_indexable
FROM {indexability} WHERE NOT robots_txt_allows
"""

LINKS_OF_SITE = """
SELECT source_url, target_url, anchor_text, xpath, href
FROM {internal_links_analysis} WHERE source_url LIKE :pattern
"""

SCHEMA_VALID = """
SELECT url, schema_type, format, is_valid, validation_errors FROM {schema_analysis} WHERE is_valid
"""

SCHEMA_COUNTS = """
SELECT schema_type, format, count(*) AS count FROM {schema_analysis}
GROUP BY schema_type, format ORDER BY count DESC, schema_type, format
"""

SCHEMA_INVALID = """
SELECT url, schema_type, validation_errors FROM {schema_analysis} WHERE NOT is_valid
"""


def ask(question: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """Run one of the questions on the given tables."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(question, args=args, **tables)
