"""HTTP headers and status codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from silkgraph.functions.text import strip

# Headers worth keeping, redirect statuses, statuses worth another attempt.
KEPT_HEADERS = ["content-type", "content-length", "last-modified", "etag", "server"]
REDIRECT_STATUSES = [301, 302, 303, 307, 308]
RETRYABLE_CLIENT_STATUSES = [408, 420, 423, 429, 451]

# Wording of the failure reasons.
FAILURE_REASONS = {
    0: "Connection/timeout error",
    408: "Request timeout (server slow)",
    423: "Resource temporarily locked",
    429: "Rate limited",
    420: "Rate limited (Twitter)",
    451: "Unavailable for legal reasons (geo-blocking?)",
}


def headers_normalize(headers: Column) -> Column:
    """Lower-case names, only the kept ones, values stripped. A name given twice in different
    case keeps its last value."""
    entries = F.filter(
        F.transform(
            F.map_entries(headers),
            lambda e: F.struct(F.lower(e["key"]).alias("key"), strip(e["value"]).alias("value")),
        ),
        lambda e: e["key"].isin(KEPT_HEADERS),
    )
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"],
        ),
    )


def header(headers: Column, name: str) -> Column:
    """Value of a header whatever the case of its name; NULL when absent."""
    return F.try_element_at(
        F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), F.lit(1)
    )["value"]


def is_success(status: Column) -> Column:
    return status.between(200, 299)


def is_retryable(status: Column) -> Column:
    return (status == 0) | status.between(500, 599) | status.isin(RETRYABLE_CLIENT_STATUSES)


def failure_reason(status: Column) -> Column:
    text = status.cast("string")
    out = None
    for code, reason in FAILURE_REASONS.items():
        out = F.when(status == code, reason) if out is None else out.when(status == code, reason)
    return out.when(
        status.between(500, 599), F.concat(F.lit("Server error "), text)
    ).otherwise(F.concat(F.lit("HTTP "), text))


def status_class(status: Column) -> Column:
    """``0`` for no answer, else ``2xx`` and so on."""
    return F.when(status == 0, "0").otherwise(
        F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))
    )
