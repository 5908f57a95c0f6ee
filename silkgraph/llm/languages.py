"""Language ID by nearest centroid: hashed character n-grams, TF-IDF, several centroids per language.

Learning takes a sample of bounded size for each language, gathers document frequencies over it in Spark
and clusters each language in one task (bounded rows of bounded vectors). Predicting is one pass: the
n-grams of all texts of a slice are counted by one ``bincount`` and compared with all centroids by one
matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import sampled, written
from .tokens import LOWER, SYMBOLS, slices

BUCKETS = 4096
ROWS = 256
_digits = np.zeros(256, dtype=bool)
_digits[48:58] = True
_other = SYMBOLS | _digits


@dataclass
class Centroids:
    """Inverse document frequencies, one row of ``vectors`` per centroid, its language and its rejection limit."""

    idf: np.ndarray
    vectors: np.ndarray
    langs: list[str]
    limits: np.ndarray


def gram_counts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of hashed 1- to 3-grams of bytes, a row per text. Blanks, digits and signs count as one boundary."""
    rows = len(at) - 1
    if not len(raw):
        return np.zeros((rows, BUCKETS), dtype=np.float32)
    letters = LOWER[raw]
    gap = _other[letters]
    letters = np.where(gap, np.uint8(32), letters)
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    heads = at[:-1][np.diff(at) > 0]  # a text begins without a boundary, whatever stands before it in the batch
    keep[heads] = ~gap[heads]
    row = np.repeat(np.arange(rows), np.diff(at))[keep]
    a = letters[keep].astype(np.uint32)
    out = np.zeros(rows * BUCKETS, dtype=np.float32)
    h = a * np.uint32(2654435761)
    for size in range(1, 4):
        if size > 1:
            h = (h[:-1] * np.uint32(31) + a[size - 1 :] * np.uint32(40503)) * np.uint32(2654435761)
        n = len(h)
        if n <= 0:
            break
        same = row[:n] == row[size - 1 :][:n]
        key = row[:n][same] * BUCKETS + (h[same] >> np.uint32(20)).astype(np.int64)
        out += np.bincount(key, minlength=len(out)).astype(np.float32)
    return out.reshape(rows, BUCKETS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows; a text without n-grams stays zero."""
    x = np.log1p(counts) * idf
    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.maximum(length, 1e-12)


def count_slices(texts: pa.Array) -> Iterator[np.ndarray]:
    """Counts of n-grams of all texts, by ``ROWS`` rows at most."""
    for _, _, raw, at in slices(texts):
        for i in range(0, len(at) - 1, ROWS):
            j = min(i + ROWS, len(at) - 1)
            yield gram_counts(raw[at[i] : at[j]], at[i : j + 1] - at[i])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blocks = [c.astype("<f4").tobytes() for counts in count_slices(batch.column("text")) for c in counts]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(blocks, pa.binary())], names=["lang", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, n): texts that have each kind of n-gram; kind -1 counts the texts."""
    seen, rows = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for block in batch.column("counts"):
            seen += np.frombuffer(block.as_buffer(), dtype="<f4") > 0
            rows += 1
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], rows))], names=["kind", "n"])


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from spread-out rows: centroids and each row's cluster."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centers = x[chosen].copy()
    own = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].sum(axis=0)
                centers[c] /= max(float(np.sqrt((centers[c] ** 2).sum())), 1e-12)
    return centers, own


def learn(docs: DataFrame, text: str, lang: str, key: str, bound: int = 600, per_lang: int = 4, reject: float = 0.005) -> Centroids:
    """Centroids from rows with a language.

    ``bound`` is the documented size of the sample of each language; ``reject`` the share of a cluster's
    sample that its rejection limit leaves outside. No row gives no centroid.
    """
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = sampled(known, "key", "lang", bound)
    vectors = written(sample.mapInArrow(_vectors, "lang string, counts binary"), "language-sample")
    # summed in Spark: a number for each kind of n-gram comes back, whatever the number of files
    found = vectors.mapInArrow(_frequencies, "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    sums = {r["kind"]: r["n"] for r in found}
    seen = np.array([sums.get(k, 0) for k in range(BUCKETS)], dtype=float)
    idf = np.log((1 + sums.get(-1, 0)) / (1 + seen)).astype(np.float32) + 1

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        x = weighted(np.stack([np.frombuffer(b, dtype="<f4") for b in pdf["counts"]]), idf)
        centers, own = clusters(x, per_lang)
        fit = (x * centers[own]).sum(axis=1)
        used = [c for c in range(len(centers)) if (own == c).any()]
        return pd.DataFrame(
            {
                "lang": pdf["lang"].iloc[0],
                "vector": [centers[c].astype("<f4").tobytes() for c in used],
                "edge": [float(np.quantile(fit[own == c], reject)) for c in used],
            }
        )

    found = vectors.groupBy("lang").applyInPandas(grouped, "lang string, vector binary, edge double").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    stacked = np.stack([np.frombuffer(r["vector"], dtype="<f4") for r in found]) if found else np.zeros((0, BUCKETS), np.float32)
    return Centroids(idf, stacked, [r["lang"] for r in found], np.array([r["edge"] for r in found]))


def language_of(text: Column, model: Centroids, spark) -> Column:
    """Struct (lang, score, rejected): the nearest centroid's language and the cosine.

    A NULL text or one without a letter is ``und`` with score 0. ``rejected`` says that the text is
    farther from its centroid than nearly all of that centroid's own sample.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, score double, rejected boolean")
    def nearest(texts: pa.Array) -> pa.Array:
        m = shared.value
        langs: list[str] = []
        scores: list[float] = []
        rejected: list[bool] = []
        for counts in count_slices(texts):
            if not len(m.langs):
                langs += ["und"] * len(counts)
                scores += [0.0] * len(counts)
                rejected += [True] * len(counts)
                continue
            near = weighted(counts, m.idf) @ m.vectors.T
            best = near.argmax(axis=1)
            value = np.clip(near[np.arange(len(best)), best].astype(float), 0, 1)
            langs += [m.langs[b] for b in best]
            scores += value.tolist()
            rejected += (value < m.limits[best]).tolist()
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            names=["lang", "score", "rejected"],
        )

    blank = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), nearest(text)).otherwise(blank)


def identify_languages(docs: DataFrame, model: Centroids, text: str = "text", out: str = "language") -> DataFrame:
    """All rows of ``docs`` with the struct column ``out``; no shuffle, extra columns stay."""
    return docs.withColumn(out, language_of(F.col(text), model, docs.sparkSession))
