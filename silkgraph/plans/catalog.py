"""All registered queries and their oracle texts."""

from __future__ import annotations

from silkgraph.plans import catalog_html, catalog_site, catalog_state, catalog_storage, catalog_urls, catalog_views  # noqa: F401
from silkgraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
