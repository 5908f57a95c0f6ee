"""Helpers of the training-data operators: tables, folds, bounded samples, written intermediate tables."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from silkgraph.operators.scale import shared_folder, stored as written

__all__ = ["fold", "held_out", "line_fit", "sampled", "sigmoid", "table", "written", "written_by"]


def written_by(df: DataFrame, name: str, column: str) -> DataFrame:
    """``df`` written to the shared folder with a folder for each value of ``column``, and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; NULL for a NULL key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def held_out(key: Column | str, parts: int, rest: int = 0) -> Column:
    """Whether the row is kept from learning. A NULL key is never learned from, so it counts as held out."""
    return F.coalesce(fold(key, parts) == rest, F.lit(True))


def sampled(df: DataFrame, key: str, groups: str | None, bound: int) -> DataFrame:
    """A sample by key hash of about ``bound`` rows for each value of ``groups`` (of all rows if None).

    The rate of a group is bound / rows, so that small groups are taken whole; the choice depends on the
    key alone. Nothing is sorted and no group meets in one task. The values of ``groups`` are class
    labels or languages, a set of fixed size.
    """
    def taken(rows: int) -> Column:
        rate = min(1.0, bound / max(1, rows))
        return F.pmod(F.xxhash64(F.col(key), F.lit(77)), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))

    if groups is None:
        return df.filter(taken(df.count()))
    counts = df.groupBy(groups).count().collect()
    wanted = F.lit(False)
    for row in counts:
        wanted = wanted | (F.col(groups).eqNullSafe(F.lit(row[0])) & taken(row[1]))
    return df.filter(wanted)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def line_fit(rows: list[tuple[list[float], int]], weights: list[float], rounds: int = 50, ridge: float = 1e-3) -> list[float]:
    """Coefficients (the last is the constant) of a small logistic regression by Newton steps.

    For the calibration of a handful of statistics over a bounded sample of labelled rows.
    """
    import numpy as np

    if not rows or len({y for _, y in rows}) < 2:
        return [0.0] * (len(rows[0][0]) if rows else 0) + [-math.log(3)]
    x = np.array([[*r, 1.0] for r, _ in rows])
    y = np.array([y for _, y in rows], dtype=float)
    w = np.array(weights)
    scale = np.maximum(x[:, :-1].std(axis=0), 1e-9)
    x[:, :-1] /= scale
    beta = np.zeros(x.shape[1])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (beta**2).sum())

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - ridge * beta
        hessian = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        while (then := loss(beta + step)) > now and abs(step).max() > 1e-9:
            step /= 2
        if abs(step).max() <= 1e-9:
            break
        beta, now = beta + step, then
    return [*(beta[:-1] / scale), float(beta[-1])]
