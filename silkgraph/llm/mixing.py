"""Mixing sources to target weights by temperature.

Weights are token shares to the power of an exponent. The exponent is found by bisection (in 256 parts at
once, one small aggregation over the table of sources each time) so that the entropy of the weights meets its
target; if that would repeat a source more often than allowed, a second bisection takes the exponent back
to the limit. A source's quota then becomes full passes and a rest. Documents of a source are dealt into
blocks of bounded tokens by key hash; every pass takes the blocks in an order of its own, and the rest is
the beginning of such an order, cut inside one block.

All decisions on a row come from the row and from one row of its source, so texts are never shuffled.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

SPACE = 1 << 60
WAYS = 256


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the texts of ``parts``, the same in any SQL engine that has md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def token_count(text: Column) -> Column:
    """Words between ASCII blanks; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def exponent(sources: DataFrame, tokens: str, entropy_share: float, most_passes: float, ratio: float) -> tuple[float, float]:
    """Exponent and the sum of powered shares, for ``sources`` with positive ``tokens``: a written table, since each step reads it.

    The exponents of a step are rows, not expressions: every step has the same small plan, compiled once, whatever ``WAYS``.
    """
    share = F.col("share")
    total = sources.agg(F.sum(tokens)).first()[0]
    table = sources.select((F.col(tokens) / F.lit(total)).alias("share"))

    def measured(exponents: list[float]) -> list[tuple[float, float, float]]:
        """Powered sum, entropy and largest number of passes at each exponent; only scalars come back."""
        tried = table.select(share, F.posexplode(F.lit(np.array(exponents))).alias("i", "x"))
        power = F.pow(share, F.col("x"))
        found = tried.groupBy("i").agg(
            F.sum(power).alias("z"), F.sum(power * F.log(share) * F.col("x")).alias("slope"), F.max(F.pow(share, F.col("x") - 1)).alias("top")
        )
        return [(r["z"], math.log(r["z"]) - r["slope"] / r["z"], r["top"] / r["z"] * ratio) for r in sorted(found.collect())]

    def search(low: float, high: float, enough) -> float:
        """Where ``enough`` turns from false at ``low`` to true at ``high``, to a billionth."""
        while abs(high - low) > 1e-9:
            inner = [low + (high - low) * i / WAYS for i in range(1, WAYS)]
            met = [enough(m) for m in measured(inner)]
            first = met.index(True) if True in met else len(inner)
            low, high = (inner[first - 1] if first else low), (inner[first] if first < len(inner) else high)
        return high

    now, flat = measured([1.0, 0.0])
    target = now[1] + entropy_share * (flat[1] - now[1])
    found = 1.0 if flat[1] - now[1] < 1e-12 or entropy_share <= 0 else search(1.0, 0.0, lambda m: m[1] >= target)
    norm, _, top = measured([found])[0]
    if top > most_passes:
        # back towards the natural shares, where every source is passed ``ratio`` times
        found = 1.0 if ratio >= most_passes else search(found, 1.0, lambda m: m[2] <= most_passes)
        norm = measured([found])[0][0]
    return found, norm


#: Slices of [0, 1) that running sums are taken over first.
SLICES = 1024


def running(rows: DataFrame, by: str, spot: str, order: list[str]) -> DataFrame:
    """Of ``rows`` (``by``, ``spot`` in [0, 1), ``rest``, tokens, ...) those around the place where the running sum of tokens
    reaches ``rest``, with ``before``, the sum before each.

    Sums of slices come first: a group has ``SLICES`` of them at most, whatever its rows, and only the rows of the
    slice that holds the place are then put in order, a part in about ``SLICES`` of the group.
    """
    cut = rows.withColumn("slice", F.floor(F.col(spot) * SLICES).cast("int"))
    slices = cut.groupBy(by, "slice").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    along = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("tokens").over(along), F.lit(0)))
    held = slices.filter((F.col("base") < F.col("rest")) & (F.col("base") + F.col("tokens") >= F.col("rest")))
    held = held.groupBy(by).agg(F.min(F.struct("slice", "base")).alias("at")).select(F.col(by).alias("group"), "at.*")
    near = cut.alias("c").join(held.withColumnRenamed("slice", "here"), F.col(f"c.{by}").eqNullSafe(F.col("group")) & (F.col("slice") == F.col("here")))
    inside = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return near.withColumn("before", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).drop("slice", "here", "group", "base")


def mixture(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", entropy_share: float = 0.5,
    most_passes: float = 4.0, ratio: float = 1.0, block_tokens: int = 1 << 16, prefix: str = "mix_",
) -> DataFrame:
    """Rows of ``docs`` drawn to the target weights, with columns ``<prefix>epoch``, ``block``, ``position``, ``tokens``.

    ``entropy_share`` places the target between the entropy of the natural shares (0) and that of equal
    ones (1); ``most_passes`` limits how often a source is repeated; ``ratio`` is the budget in tokens over
    the tokens of the corpus. ``position`` in [0, 1) orders the mixture: blocks of all sources interleave in
    proportion to their weights. A row is returned once for each pass that takes it, in full.

    A NULL source is a source of its own, a NULL key has the hash of a fixed text, NULL texts have no
    tokens; rows of a source without any token are passed once. Rows with the same key are taken or left
    together, so the rest of a quota is met to within the rows of one key. An empty table stays empty.
    Columns of the names made here are replaced.
    """
    counted = written(
        docs.select(F.col(source).alias("source"), F.col(key).cast("string").alias("key"), token_count(F.col(text)).alias("tokens")), "mix-counts"
    )
    sources = written(counted.groupBy("source").agg(F.sum("tokens").alias("total")), "mix-totals")
    some = sources.filter("total > 0")
    names = [prefix + c for c in ("epoch", "block", "position", "tokens")]
    corpus = some.agg(F.sum("total")).first()[0] or 0
    if corpus:
        power, norm = exponent(some, "total", entropy_share, most_passes, ratio)
        quota = F.pow(F.col("total") / corpus, F.lit(power)) / norm * (ratio * corpus)
        quota = F.when(F.col("total") > 0, quota).otherwise(0.0)
    else:
        quota = F.lit(0.0)
    passes = F.when(F.col("total") > 0, quota / F.col("total")).otherwise(1.0)
    # a quota that is a whole number of passes up to rounding has no rest
    whole = F.floor(passes + 1e-9).cast("int")
    sources = written(
        sources.withColumn("passes", passes).withColumn("full", whole)
        .withColumn("rest", F.greatest((F.col("passes") - F.col("full")) * F.col("total"), F.lit(0.0)))
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / block_tokens)).cast("int")),
        "mix-sources",
    )
    spot = unit(F.col("key"))
    placed = (
        counted.alias("c").join(sources.select(F.col("source").alias("s"), "full", "rest", "blocks"), F.col("c.source").eqNullSafe(F.col("s")))
        .select("source", "full", "rest", "tokens", spot.alias("spot"), F.floor(spot * F.col("blocks")).cast("int").alias("block"))
        .filter("rest > 0")
    )
    blocks = placed.groupBy("source", "full", "rest", "block").agg(F.sum("tokens").alias("tokens"))
    blocks = blocks.withColumn("turn", unit(F.col("source"), F.col("full"), F.col("block")))
    blocks = running(blocks, "source", "turn", ["turn", "block"])
    cut = written(
        blocks.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("turn", "block", "before")).alias("at")).select(F.col("source").alias("s"), "at.*"),
        "mix-cuts",
    )
    inner = placed.join(cut, F.col("source").eqNullSafe(F.col("s")) & (placed["block"] == cut["block"])).select("s", "spot", "tokens", "rest", "before")
    inner = inner.groupBy("s", "spot").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    along = Window.partitionBy("s").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    taken = inner.withColumn("done", F.col("before") + F.coalesce(F.sum("tokens").over(along), F.lit(0)))
    last = taken.filter(F.col("done") < F.col("rest")).groupBy("s").agg(F.max("spot").alias("last"))
    plan = sources.join(cut, sources["source"].eqNullSafe(cut["s"]), "left").select("source", "passes", "full", "rest", "blocks", "turn", F.col("block").alias("cut"))
    plan = plan.join(last, plan["source"].eqNullSafe(last["s"]), "left").select(
        F.struct("source", "passes", "full", "rest", "blocks", "turn", "cut", "last").alias("plan")
    )
    plan = written(plan, "mix-plan")
    # the row stands in a struct of its own, so that no column of it can clash with those used here
    rows = docs.drop(*names).select(F.struct("*").alias("own"))
    own_source, own_key = F.col("own")[source], F.col("own")[key]
    rows = rows.join(plan, own_source.eqNullSafe(F.col("plan.source")))
    rows = rows.withColumn("spot", unit(own_key)).withColumn("block", F.floor(F.col("spot") * F.col("plan.blocks")).cast("int"))
    turn = unit(own_source, F.col("plan.full"), F.col("block"))
    part = F.coalesce(
        (F.col("plan.rest") > 0)
        & ((turn < F.col("plan.turn")) | ((turn == F.col("plan.turn")) & (F.col("block") < F.col("plan.cut")))
           | ((F.col("block") == F.col("plan.cut")) & (F.col("spot") <= F.col("plan.last")))),
        F.lit(False),
    )
    rows = rows.withColumn("epochs", F.col("plan.full") + part.cast("int")).filter(F.col("epochs") > 0)
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    position = (F.col("epoch") + unit(own_source, F.col("epoch"), F.col("block"))) / F.greatest(F.ceil(F.col("plan.passes") - 1e-9), F.lit(1))
    return rows.select(
        "own.*", F.col("epoch").alias(names[0]), F.col("block").alias(names[1]), position.alias(names[2]), token_count(F.col("own")[text]).alias(names[3])
    )
