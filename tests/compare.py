"""Run registered queries against their oracle: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of_oracle(con, sql: str):
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr
    )


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def check(name, run, sql, spark, sf_dir, con) -> str | None:
    """None if equal, otherwise what differs."""
    names, got = rows_of_spark(run(spark, sf_dir))
    want_names, want = rows_of_oracle(con, sql)
    if names != want_names:
        return f"columns {names} != {want_names}"
    if not want:
        return "nothing to compare: no rows on both sides"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 50000 else []
        missing = [r for r in want if r not in set(got)][:2] if len(got) < 50000 else []
        return f"{len(got)} rows vs {len(want)}\n   spark only {extra}\n   oracle only {missing}"
    return None


def main():
    from silkgraph.plans.catalog import ORACLES, QUERIES
    from silkgraph.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connection(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = check(name, QUERIES[name], ORACLES[name], spark, sf_dir, con)
            else:
                problem = None if QUERIES[name](spark, sf_dir).count() >= 0 else "none"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")


if __name__ == "__main__":
    main()
