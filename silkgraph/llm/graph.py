"""Connected components over edges in tables, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import written


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); the root is the smallest node of a component.

    Each round hooks every neighbour to the smallest node around (large star, then small star) and writes
    the new edges; it ends when they no longer change. Minima are pre-aggregated before the shuffle and
    written, so that both joins are plain equi-joins over tables, which adaptive execution splits where a
    node has very many edges.
    """
    now = written(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == before or mark["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), name)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = written(
            small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter(F.col("u") != F.col("v")).distinct(), name
        )
