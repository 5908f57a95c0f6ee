"""Session settings that suit these jobs; every one of them can be set by the cluster instead."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # No call-site capture for every Column made in Python: these plans hold many of them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Page bodies go to the Python workers in batches bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
    # Checkpoint files go with the tables that they hold.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # transformWithState keeps its state in RocksDB.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("crawl-analytics")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
