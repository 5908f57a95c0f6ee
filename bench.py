"""Headline queries: seconds per query (median of BENCH_RUNS) as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "page_overview", "page_content", "extract_links", "internal_links", "link_counts", "inlink_counts",
    "structured_data", "robots_allowed", "indexability", "sitemap_entries", "sitemap_closure",
    "upsert_pages", "url_upsert", "frontier_mark_done", "retry_state", "redirect_resolve",
    "crawl_reachability", "encode_dictionary", "page_analysis", "sitemap_statistics", "schema_analysis",
    "stream_status_counts",
]


def main() -> None:
    from silkgraph.plans.catalog import QUERIES
    from silkgraph.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
        # the bench reads one small file per table; a cluster's input has splits enough
        silkgraph__pages__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median of runs)",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
