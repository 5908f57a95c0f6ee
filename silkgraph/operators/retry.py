"""Retry accounting over the log of fetch results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.functions.http import failure_reason, is_retryable, is_success
from silkgraph.operators.scale import cut

#: A URL with one part in so many of the log is joined where its rows are.
SHARE = 1000


def next_retry_at(last: Column, retry_count: Column, delay: float, factor: float) -> Column:
    """Last failure (whole second) plus ``int(delay * factor ** retry_count)`` seconds."""
    wait = F.floor(F.lit(float(delay)) * F.pow(F.lit(float(factor)), retry_count)).cast("bigint")
    return F.timestamp_seconds(F.unix_timestamp(last) + wait)


def retry_state(log: DataFrame, delay: float = 1.0, factor: float = 2.0) -> DataFrame:
    """failed_urls after the whole log (url, status, fetched_at, seq).

    A success forgets the failures before it, so a URL is failed iff a retryable answer follows its
    last success; retry_count is the number of those minus one. That needs two aggregates, not a
    running window. URLs that hold at least one thousandth of the log (by arithmetic never more than a
    thousand of them) get their last success by a broadcast where their rows are; only the rows of the
    others move for the join. The final aggregate combines on the map side. The summary is written once.
    """
    at = F.struct("fetched_at", "seq")
    log = log.filter(is_success(F.col("status")) | is_retryable(F.col("status")))
    summary = cut(
        log.groupBy("url").agg(
            F.count(F.lit(1)).alias("rows"),
            F.max(F.when(is_success(F.col("status")), at)).alias("last_ok"),
        )
    )
    failures = log.filter(is_retryable(F.col("status")))
    total = summary.agg(F.sum("rows")).scalar()
    often = F.col("rows") * SHARE >= total
    hot = F.broadcast(summary.filter(often).select("url", "last_ok", F.lit(True).alias("hot")))
    marked = failures.join(hot, "url", "left")
    here = marked.filter(F.col("hot")).select("url", "status", "fetched_at", "seq", "last_ok")
    away = marked.filter(F.col("hot").isNull()).select("url", "status", "fetched_at", "seq")
    away = away.join(summary.filter(~often & F.col("last_ok").isNotNull()).select("url", "last_ok"), "url", "left")
    open_failures = here.unionByName(away).filter(F.col("last_ok").isNull() | (at > F.col("last_ok")))
    total = open_failures.groupBy("url").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("status", at).alias("status"), F.max(at).alias("last_at"), F.min("fetched_at").alias("first_at")
    )
    count = F.col("n") - 1
    last = F.date_trunc("second", F.col("last_at.fetched_at"))
    return total.select(
        "url",
        F.col("status").alias("status_code"),
        failure_reason(F.col("status")).alias("failure_reason"),
        count.alias("retry_count"),
        last.alias("last_retry_at"),
        next_retry_at(last, count, delay, factor).alias("next_retry_at"),
        F.date_trunc("second", F.col("first_at")).alias("created_at"),
    )


def retry_ready(failed: DataFrame, now: Column, max_retries: int = 3) -> DataFrame:
    """Failed URLs whose time has come and that have attempts left, the longest due first."""
    return (
        failed.filter((F.col("next_retry_at") <= now) & (F.col("retry_count") < max_retries))
        .orderBy("next_retry_at", "url")
        .select("url", "next_retry_at", "retry_count")
    )


def retry_statistics(failed: DataFrame, now: Column) -> DataFrame:
    """Failed URLs in total, by status and by retry count, and how many of them are due."""
    return failed.groupingSets(
        [[F.col("status_code")], [F.col("retry_count")], []],
        F.col("status_code"),
        F.col("retry_count"),
    ).agg(
        F.when(F.grouping("status_code") == 0, "status_code")
        .when(F.grouping("retry_count") == 0, "retry_count")
        .otherwise("total")
        .alias("level"),
        F.count(F.lit(1)).alias("failed"),
        F.count_if(F.col("next_retry_at") <= now).alias("ready"),
    )
