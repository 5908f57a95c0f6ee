"""Redirect chains over captured responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from silkgraph.functions.http import REDIRECT_STATUSES, is_retryable
from silkgraph.functions.urls import join_parts, unsplit, url_normalize_storage, url_parts
from silkgraph.operators.scale import cut
from silkgraph.operators.state import newest

STEP = "struct<url:string,status:int,headers:map<string,string>>"
# Fixed value: how many requests a chain may take.
MAX_REQUESTS = 10


def redirect_hops(responses: DataFrame) -> DataFrame:
    """(url, next_url) of the responses that send the client elsewhere. ``responses`` is
    (url, status, location, headers), one row per URL."""
    return (
        responses.filter(
            F.col("status").isin(REDIRECT_STATUSES) & (F.coalesce("location", F.lit("")) != "")
        )
        .withColumn("b", url_parts(F.col("url")))
        .withColumn("h", url_parts(F.col("location")))
        .withColumn("j", join_parts(F.col("b"), F.col("h")))
        .select(
            "url",
            F.when(F.col("location").rlike("^https?://"), F.col("location"))
            .otherwise(unsplit(F.col("j"), with_fragment=True))
            .alias("next_url"),
        )
    )


def redirect_paths(hops: DataFrame, most: int) -> DataFrame:
    """(url, path, next_url) of every redirecting URL: the URLs of its next hops, at most ``most`` of them, itself
    first, and where the last one leads.

    Pointer doubling: a round joins the open paths with the paths of the URLs that they lead to, so paths
    of two, four, eight hops take as many rounds. A path that ends before its full length is set
    aside and only looked at from then on. Loops are cut at ``most`` like long chains.
    """
    now = cut(hops.select("url", F.array("url").alias("path"), "next_url"))
    length = 1
    while length < most:
        ahead = now.select(F.col("url").alias("next_url"), F.col("path").alias("more"), F.col("next_url").alias("then"))
        # Shorter paths are whole: the URL behind them is no redirect.
        closed = now.filter(F.size("path") < length)
        doubled = cut(now.filter(F.size("path") == length).join(ahead, "next_url", "left"))
        left = F.col("more").isNull()
        if doubled.filter(~left).isEmpty():
            break
        now = closed.unionByName(doubled.select(
            "url",
            F.when(left, F.col("path")).otherwise(F.concat("path", "more")).alias("path"),
            F.when(left, F.col("next_url")).otherwise(F.col("then")).alias("next_url"),
        ))
        length *= 2
    cropped = F.size("path") > most
    return now.select(
        "url",
        F.when(cropped, F.slice("path", 1, most)).otherwise(F.col("path")).alias("path"),
        F.when(cropped, F.element_at("path", most + 1)).otherwise(F.col("next_url")).alias("next_url"),
    )


def redirect_resolve(
    starts: DataFrame, responses: DataFrame, max_requests: int = MAX_REQUESTS
) -> DataFrame:
    """(url, final_url, status, redirect_chain, capped) for every start URL, repeated ones once; ``capped``
    marks the chains that were stopped at ``max_requests``.

    Paths are narrow rows of URLs, doubled in ``log2(max_requests)`` joins whatever the number of
    starts. Statuses and headers are joined once, when the paths are known. At the cap the chain ends
    with its last redirect status and the next URL; a URL that was never captured ends the chain like a
    failed request (status 0, the start URL).
    """
    paths = redirect_paths(redirect_hops(responses), max_requests)
    begun = starts.select("url").distinct().join(paths, "url", "left").select(
        "url", F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("next_url", "url").alias("last")
    )
    capped = F.size("path") == max_requests
    asked = begun.select(
        "url", "last", capped.alias("capped"),
        F.posexplode(F.when(capped, F.col("path")).otherwise(F.concat("path", F.array("last")))).alias("at", "current"),
    )
    answers = responses.select(F.col("url").alias("current"), F.struct("url", "status", "headers").cast(STEP).alias("step"))
    steps = asked.join(answers, "current", "left").groupBy("url").agg(
        F.array_sort(F.collect_list(F.when(F.col("step").isNotNull(), F.struct("at", "step"))), lambda a, b: a["at"] - b["at"]).alias("steps"),
        F.max("at").alias("at"), F.first("last").alias("last"), F.first("capped").alias("capped"),
    )
    chain = steps.withColumn("redirect_chain", F.col("steps.step"))
    whole = F.size("redirect_chain") > F.col("at")
    return chain.select(
        "url",
        F.when(F.col("capped") | whole, F.col("last")).otherwise(F.col("url")).alias("final_url"),
        F.when(whole, F.element_at("redirect_chain", -1)["status"]).otherwise(F.lit(0)).alias("status"),
        "redirect_chain",
        "capped",
    )


def redirect_records(resolved: DataFrame, discovered_at: str | None = None) -> DataFrame:
    """(source_url, target_url, redirect_chain, chain_length, final_status) of chains with at least
    one redirect; the newest per source if ``discovered_at`` names a time column. Retryable final
    statuses are not recorded, since such a fetch is tried again."""
    rows = resolved.filter((F.size("redirect_chain") > 1) & ~is_retryable(F.col("status"))).select(
        url_normalize_storage(F.col("url")).alias("source_url"),
        url_normalize_storage(F.col("final_url")).alias("target_url"),
        "redirect_chain",
        (F.size("redirect_chain") - 1).alias("chain_length"),
        F.col("status").alias("final_status"),
        *([F.col(discovered_at).alias("discovered_at")] if discovered_at else []),
    )
    return newest(rows, ["source_url"], ["discovered_at"]) if discovered_at else rows
