"""Toxicity by class-conditional Kneser-Ney models.

One model is learned from toxic rows and one from ordinary rows, every bigram counted once per text. A word's probability backs off from the class's bigrams to the class's words, and at
last to shared continuation counts: in how many contexts a word stands in both classes. Discounts are those
of modified Kneser-Ney, estimated from the counts. Bigrams of fewer than ``CUT`` texts, or whose first word
either class hardly knows, leave it to the words, and no word or bigram falls below half a count; so an
expression that was rarely seen weighs nearly alike on both sides.

The difference of the two log-likelihoods is a sum over the words of a text: every known bigram and word
adds its own share and every known context its backoff weight, so that scoring is a look-up in sorted
arrays of bounded size. A text is judged by its length-normalised difference, as a whole, in its most
suspicious window of ``WINDOW`` words and in its most suspicious words (the single insult in a long page),
calibrated on labelled rows that the models have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import line_fit, sampled, sigmoid, written
from .tokens import SYMBOLS, looked_up, rows_of, slices, words

WINDOW = 5
LIKELY, SURE = 2.0, 3.5
CUT = 5
NAMES = ["mean", "top", "likely", "sure", "words"]
PAIR = np.uint64(0x2545F4914F6CDD1D)


@dataclass
class Difference:
    """Sorted hashes of words and bigrams with what each adds to the toxic minus the ordinary log-likelihood."""

    words: np.ndarray
    word_weight: np.ndarray
    context_weight: np.ndarray
    pairs: np.ndarray
    pair_weight: np.ndarray
    unseen: float
    line: list[float]


def pairs_of(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each word with the one before it; at the start of a row the word before is 0."""
    before = np.concatenate([[np.uint64(0)], hashes[:-1]])
    before[first[:-1][np.diff(first) > 0]] = 0
    return (before * PAIR + hashes) * np.uint64(0x9E3779B97F4A7C15)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts by class: (toxic, before, word, n), gathered per slice."""
    for batch in batches:
        flags = np.array(batch.column("toxic").to_pylist(), dtype=np.int64)
        for i, j, raw, at in slices(batch.column("text")):
            h, _, first = words(raw, at, SYMBOLS)
            if not len(h):
                continue
            before = np.concatenate([[np.uint64(0)], h[:-1]])
            before[first[:-1][np.diff(first) > 0]] = 0
            # once per text: a word that one text repeats is no sign of its class
            row = rows_of(first)
            order = np.lexsort((h, before, row))
            again = np.zeros(len(h), dtype=bool)
            again[1:] = (row[order][1:] == row[order][:-1]) & (before[order][1:] == before[order][:-1]) & (h[order][1:] == h[order][:-1])
            own = order[~again]
            h, before, flag = h[own], before[own], flags[i:j][row[own]]
            order = np.lexsort((h, before, flag))
            columns = [flag, before.view(np.int64), h.view(np.int64)]
            columns = [x[order] for x in columns]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]) | (columns[2][1:] != columns[2][:-1])
            places = np.flatnonzero(fresh)
            n = np.diff(np.append(places, len(h)))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x[places]) for x in columns), pa.array(n)], names=["toxic", "a", "b", "n"]
            )


def discounts(n: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes off counts of 1, 2 and more; of 0 nothing."""
    ones, twos, threes, fours = (max(1.0, float((n == k).sum())) for k in range(1, 5))
    y = ones / (ones + 2 * twos)
    kinds = np.clip([0, 1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes], 0, [0, 0.95, 1.9, 2.8])
    return kinds[np.minimum(n, 3).astype(int)]


def fitted(counts: dict[str, np.ndarray]) -> Difference:
    """Both models from the bigram counts of a bounded sample, folded into weights."""
    t, n = counts["toxic"], counts["n"].astype(float)
    a, b = counts["a"].view(np.uint64), counts["b"].view(np.uint64)
    # places by search, since those of np.unique take three times the memory of the counts
    vocabulary = np.unique(np.concatenate([b, a]))
    size = len(vocabulary)
    b_at, a_at = np.searchsorted(vocabulary, b), np.searchsorted(vocabulary, a)
    pair_key = (a * PAIR + b) * np.uint64(0x9E3779B97F4A7C15)
    pair = np.unique(pair_key)
    pair_at = np.searchsorted(pair, pair_key)
    pair_a, pair_b = np.zeros(len(pair), np.int64), np.zeros(len(pair), np.int64)
    pair_a[pair_at], pair_b[pair_at] = a_at, b_at

    def smoothed(n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, float]:
        off = discounts(n)
        rest = max(off.sum(), 1e-6) / max(n.sum(), 1.0)
        return (n - off) / max(n.sum(), 1.0) + rest * lower, rest

    follows = [np.bincount(b_at[t == flag], minlength=size).astype(float) for flag in (1, 0)]
    shared, shared_rest = smoothed(np.minimum(*follows), np.full(size, 1 / (size + 1)))
    counted = [np.bincount(pair_at[t == flag], weights=n[t == flag], minlength=len(pair)) for flag in (1, 0)]
    context = [np.bincount(pair_a, weights=x, minlength=size) for x in counted]
    used = (np.minimum(*context)[pair_a] >= CUT) & (sum(counted) >= CUT)
    pair, pair_a, pair_b = pair[used], pair_a[used], pair_b[used]
    kinds = np.bincount(pair_a, minlength=size)
    found = []
    for flag in (1, 0):
        own = t == flag
        word_n = np.bincount(b_at[own], weights=n[own], minlength=size)
        total = max(word_n.sum(), 1.0)
        word, rest = smoothed(word_n, shared)
        word = (total * word + 0.5) / (total + 0.5 * (size + 1))
        unseen = (total * rest * shared_rest / (size + 1) + 0.5) / (total + 0.5 * (size + 1))
        pair_n, context_n = counted[1 - flag][used], np.maximum(context[1 - flag], 1)
        off = discounts(counted[1 - flag])[used]
        backoff = np.maximum(1 - np.bincount(pair_a, weights=pair_n - off, minlength=size) / context_n, 1e-4)
        both = (pair_n - off) / context_n[pair_a] + backoff[pair_a] * word[pair_b]
        both = (context_n[pair_a] * both + 0.5) / (context_n + 0.5 * kinds)[pair_a]
        backoff *= context_n / (context_n + 0.5 * kinds)
        found.append((np.log(word), np.log(backoff), np.log(both), np.log(unseen)))
    word, context_weight, both, unseen = (x - y for x, y in zip(*found, strict=True))
    pair_weight = both - context_weight[pair_a] - word[pair_b]
    kept = np.abs(pair_weight) > 1e-4
    return Difference(
        vocabulary, word.astype(np.float32), context_weight.astype(np.float32),
        pair[kept], pair_weight[kept].astype(np.float32), float(unseen), [],
    )


def values_of(h: np.ndarray, first: np.ndarray, m: Difference) -> np.ndarray:
    """What each word adds to the difference."""
    value, context = np.full(len(h), m.unseen), np.zeros(len(h))
    if len(m.words):
        where, known = looked_up(m.words, h)
        value[known] = m.word_weight[where[known]]
        context[1:] = np.where(known, m.context_weight[where], 0)[:-1]
        start, there = looked_up(m.words, np.zeros(1, np.uint64))
        context[first[:-1][np.diff(first) > 0]] = m.context_weight[start[0]] if there[0] else 0
        value += context
    if len(m.pairs):
        where, known = looked_up(m.pairs, pairs_of(h, first))
        value[known] += m.pair_weight[where[known]]
    return value


def statistics(texts: pa.Array, m: Difference) -> tuple[np.ndarray, ...]:
    """Mean difference of each whole text, the largest mean of ``WINDOW`` words in a row, and the logarithms
    of what is beyond ``LIKELY`` and ``SURE`` in distinct words and of the number of distinct words (0 without words)."""
    out: list[np.ndarray] = []
    for _, _, raw, at in slices(texts):
        h, _, first = words(raw, at, SYMBOLS)
        counts = np.diff(first)
        found = np.zeros((5, len(counts)))
        if len(h):
            value = values_of(h, first, m)
            heads = first[:-1][counts > 0]
            sums = np.concatenate([[0.0], np.cumsum(value)])
            found[0] = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(counts, 1)
            end = np.minimum(np.arange(len(h)) + WINDOW, first[1:][rows_of(first)])
            found[1, counts > 0] = np.maximum.reduceat((sums[end] - sums[:-1]) / WINDOW, heads)
            row = rows_of(first)
            order = np.lexsort((-value, h, row))  # of a repeated word the most suspicious place
            single = np.ones(len(h), dtype=bool)
            single[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
            place = order[single]
            found[2] = np.log1p(np.bincount(row[place], np.maximum(value[place] - LIKELY, 0), len(counts)))
            found[3] = np.log1p(np.bincount(row[place], np.maximum(value[place] - SURE, 0), len(counts)))
            found[4] = np.log1p(np.bincount(row[place], minlength=len(counts)))
        out.append(found)
    if not out:
        return tuple(np.zeros((5, 0)))
    return tuple(np.concatenate(out, axis=1))


def _statistic_columns(text: Column, model: Difference, spark) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def both(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(x) for x in statistics(texts, shared.value)], names=NAMES)

    return F.arrow_udf(both, ", ".join(f"{n} double" for n in NAMES))(F.lower(text))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", bound: int = 2500) -> Difference:
    """Models and calibration from labelled rows.

    ``bound`` is the documented size of the sample of each class, whatever that of the other; both models are
    distributions, and the calibration is weighted to the true shares. Two thirds of the sample (by key hash)
    teach the models, the rest the calibration. Repeated rows count once. Labels other than 0 and 1 are passed over; a key labelled
    twice counts once, as its larger label. Without rows of both classes every text gets the same low score.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("toxic"))
    marks = marks.filter(F.col("key").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("key").agg(F.max("toxic").alias("toxic"))
    share = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    picked = sampled(marks, "key", "toxic", bound)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col(text).isNotNull())
    sample = written(rows.join(F.broadcast(picked), "key").dropDuplicates(["key"]).dropDuplicates(["text"]), "toxicity-sample")
    part = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(3))
    counted = (
        sample.filter(part != 0).select("toxic", F.lower("text").alias("text")).mapInArrow(_counted, "toxic long, a long, b long, n long")
        .groupBy("toxic", "a", "b").agg(F.sum("n").alias("n"))
    ).toArrow()
    model = fitted({c: counted.column(c).to_numpy() for c in counted.column_names})
    found = sample.filter(part == 0).select("toxic", _statistic_columns(F.col("text"), model, spark).alias("s")).select("toxic", "s.*").collect()
    taken = {c: max(1, sum(r["toxic"] == c for r in found)) for c in (0, 1)}
    total = max(1, sum(share.values()))
    weights = [share[r["toxic"]] / total * len(found) / taken[r["toxic"]] for r in found]
    model.line = line_fit([([r[n] for n in NAMES], r["toxic"]) for r in found], weights)
    if len(model.line) != len(NAMES) + 1:
        model.line = [0.0] * len(NAMES) + [-3.0]
    return model


def toxicity(text: Column, model: Difference, spark) -> Column:
    """Probability that a text is toxic; NULL and empty texts count as texts without words."""
    found = _statistic_columns(text, model, spark)
    return sigmoid(sum((found[n] * w for n, w in zip(NAMES, model.line, strict=False)), F.lit(model.line[-1])))


def score_toxicity(docs: DataFrame, model: Difference, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All rows of ``docs`` with the column ``out``; one pass, no shuffle, extra columns stay."""
    return docs.withColumn(out, toxicity(F.col(text), model, docs.sparkSession))
