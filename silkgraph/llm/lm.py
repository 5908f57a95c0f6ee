"""LM scoring by a hashed maximum-entropy model with class-factored softmax.

Counts of all words of the training texts are gathered first, in a table that grows with the corpus. Words fall into
classes by their spelling: the closest of ``CLASSES`` centroids of letter pairs, found by k-means over that table. The
end of a text is a class of its own. A word's probability has three factors:

1. its class, a softmax over features of the words before it: the word before (n-gram), the word before that (skip),
   both (n-gram), and their classes, the one before them included. Words are hashed into the rows of one table of weights.
2. its slot in the class, a softmax over the word before and its class, each with the class. The most common words of a
   class have a slot of their own, the next ones share some, and all words outside the tasks' dictionary the last.
3. its smoothed share of the slot.

Both softmaxes start from the counts and are trained by gradient updates. A step sees one slice of the texts, and all
slices but one are seen once: tasks sum the gradient over their texts, blocks of rows are summed in a shuffle, and the driver
moves the weights by the sums, damped so that what was seen a few times stays near zero (``DAMPING`` is the penalty).
The last slice tells how far the weights of hashed words may be trusted: the best of ``TRUST`` scales them.
Scoring is one pass in numpy batches; only the counts of words outside the dictionary are joined afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import written, written_by
from .tokens import BLANKS, LOWER, looked_up, mixed, rows_of, slices, words

CLASSES = 24
SLOTS, OWN = 24, 14
#: Rows of hashed words; classes before have rows of their own behind them.
ROWS = 1 << 14
#: Kinds of letter pairs, rounds of the k-means, and the common words among which its centroids begin.
PAIRS, ROUNDS, SEEDS = 256, 3, 4096
DICTIONARY, LONGEST = 1 << 18, 64
STEPS, RATE, DAMPING = 12, 0.5, 60.0
TRUST = (0.5, 1.0)
#: Smoothing of word counts, the same as in the base score.
ADD = 0.1
END = np.uint64(0)
#: Stands before the first word.
START = np.uint64(1)
#: Tokens that are worked on together, and the rows of a block of sums.
BLOCK, SUM_ROWS = 1 << 15, 1 << 12
#: Sums travel as half floats, divided by this.
SCALE = 64.0


@dataclass
class Model:
    """Dictionary (sorted hashes with count, class and slot), spelling centroids, and weights. Class ``CLASSES`` is
    the end of a text, and as a context also its start."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    slots: np.ndarray
    tokens: int
    types: int
    end_count: int
    letters: np.ndarray
    mass: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    class_weights: np.ndarray
    slot_weights: np.ndarray


def hashed(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, where each word begins, and the first word of each row."""
    h, place, first = words(raw, at)
    h[h <= START] = np.uint64(2)
    return h, place, first


def spelled(raw: np.ndarray, at: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of the words that begin at ``place``, and their offsets."""
    ends = np.zeros(len(raw) + 1, dtype=bool)
    ends[: len(raw)] = BLANKS[raw]
    ends[at] = True
    bounds = np.flatnonzero(ends)
    size = bounds[np.searchsorted(bounds, place, side="right")] - place
    offsets = np.concatenate([[0], np.cumsum(size)])
    return LOWER[raw[np.arange(offsets[-1]) + np.repeat(place - offsets[:-1], size)]], offsets


def letter_pairs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds of all letter pairs of words, their blank ends included, and the word of each."""
    size = np.diff(offsets)
    word = np.repeat(np.arange(len(size)), size + 1)
    place = np.arange(len(word)) - np.repeat(offsets[:-1] + np.arange(len(size)), size + 1)
    at = np.repeat(offsets[:-1], size + 1) + place
    total = np.repeat(size, size + 1)
    padded = np.append(raw, np.uint8(32)).astype(np.int64)
    left = np.where(place == 0, 32, padded[np.maximum(at - 1, 0)])
    right = np.where(place == total, 32, padded[np.minimum(at, len(raw))])
    return (left * 181 + right * 59 + (left ^ right) // 8) % PAIRS, word


def spelling_class(raw: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The closest centroid of each word; words in slices of bounded bytes."""
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    low = 0
    while low < len(out):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + (1 << 17), side="right")) - 1)
        kind, word = letter_pairs(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[low:high] = np.add.reduceat(letters[kind], starts, axis=0).argmax(axis=1)
        low = high
    return out


def letter_vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of letter pairs, a row of length one for each word."""
    kind, word = letter_pairs(raw, offsets)
    out = np.bincount(word * PAIRS + kind, minlength=(len(offsets) - 1) * PAIRS).reshape(-1, PAIRS).astype(np.float32)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def _text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = column.cast(pa.binary())
    at = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if raw.buffers()[2] is not None and len(raw) else np.zeros(0, np.uint8)
    return data, at - at[0]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word, n) of all words, summed inside slices; h 0 counts the texts."""
    rows = 0
    names = ["h", "word", "n"]
    for batch in batches:
        rows += batch.num_rows
        for _, _, raw, at in slices(batch.column("text")):
            h, place, _ = hashed(raw, at)
            if len(h):
                every, one, n = np.unique(h, return_index=True, return_counts=True)
                data, offsets = spelled(raw, at, place[one])
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(every), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), text.cast(pa.large_string()).cast(pa.string()), pa.array(n)], names=names)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([""]), pa.array([rows])], names=names)


def _cluster(letters: np.ndarray):
    """Task function: (kind, pair, value) of the sums of the words nearest to each centroid, as letter pairs of length one
    together, weighted by the root of the word's count."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES * PAIRS)
        for batch in batches:
            for low in range(0, len(batch), 8192):
                part = batch.slice(low, 8192)
                raw, offsets = _text_buffers(part.column("word"))
                kind, word = letter_pairs(raw, offsets)  # words of at most LONGEST bytes
                nearest = np.add.reduceat(letters[kind], np.flatnonzero(np.diff(word, prepend=-1)), axis=0).argmax(axis=1)
                weight = np.sqrt(part.column("n").to_numpy() / (np.diff(offsets) + 1))
                out += np.bincount(nearest[word] * PAIRS + kind, weight[word], CLASSES * PAIRS)
        out = out.reshape(CLASSES, PAIRS)
        kind, pair = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(out[kind, pair])], names=["kind", "pair", "value"])

    return sums


def centroids(counts: DataFrame, common: pa.Array) -> np.ndarray:
    """Spelling classes as columns of letter-pair weights: k-means by cosine over all words of at most ``LONGEST``
    bytes, from the farthest among common ones. What comes back is a sum for each class and kind of pair."""
    vectors = letter_vectors(*_text_buffers(common))
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < CLASSES:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    out = vectors[chosen].T.copy()
    rows = counts.filter((F.col("h") != 0) & (F.octet_length("word") <= LONGEST)).select("word", "n")
    for _ in range(ROUNDS):
        total = np.zeros((CLASSES, PAIRS))
        sums = rows.mapInArrow(_cluster(out), "kind int, pair int, value double").groupBy("kind", "pair").agg(F.sum("value").alias("value")).toArrow()
        total[sums.column("kind").to_numpy(), sums.column("pair").to_numpy()] = sums.column("value").to_numpy()
        length = np.sqrt((total**2).sum(axis=1, keepdims=True))
        out = np.where(length > 0, total / np.maximum(length, 1e-12), out.T).T.astype(np.float32)
    return out


@dataclass
class Tokens:
    """All tokens with the end of each row put in: hash, class, slot, count (-1 outside the dictionary), row, the two
    hashes before, and the three classes before."""

    h: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    count: np.ndarray
    row: np.ndarray
    before: list[np.ndarray]
    kinds: list[np.ndarray]


def stream(raw: np.ndarray, at: np.ndarray, m: Model) -> Tokens:
    h, place, first = hashed(raw, at)
    where, known = looked_up(m.keys, h)
    kind, slot, count = np.zeros(len(h), np.int64), np.full(len(h), SLOTS - 1), np.full(len(h), -1)
    if len(m.keys):
        kind[known], slot[known], count[known] = m.classes[where[known]], m.slots[where[known]], m.counts[where[known]]
    away = np.flatnonzero(~known)
    if len(away):
        _, one, back = np.unique(h[away], return_index=True, return_inverse=True)
        kind[away] = spelling_class(*spelled(raw, at, place[away[one]]), m.letters)[back]
    rows = len(first) - 1
    total = len(h) + rows
    spot, last = np.arange(len(h)) + rows_of(first), first[1:] + np.arange(rows)
    begin = first[:-1] + np.arange(rows)
    row = np.repeat(np.arange(rows), np.diff(first) + 1)

    def whole(values: np.ndarray, end) -> np.ndarray:
        out = np.full(total, end, dtype=values.dtype)
        out[spot] = values
        return out

    def behind(values: np.ndarray, steps: int, start) -> np.ndarray:
        out = np.full(total, start, dtype=values.dtype)
        out[steps:] = values[: total - steps]
        for step in range(steps):
            early = begin + step
            early = early[early <= last]
            out[early] = start
        return out

    h, kind, slot, count = whole(h, END), whole(kind, CLASSES), whole(slot, 0), whole(count, m.end_count)
    return Tokens(h, kind, slot, count, row, [behind(h, k, START) for k in (1, 2)], [behind(kind, k, CLASSES) for k in (1, 2, 3)])


def class_rows(t: Tokens, own: slice) -> list[np.ndarray]:
    """Rows of the features of a class: hashed words first, then pairs of classes."""
    one, two = (b[own] for b in t.before)
    c1, c2, c3 = (k[own] for k in t.kinds)
    wide = CLASSES + 1
    both = mixed(two * np.uint64(0x9E3779B97F4A7C15) + one)
    hashes = [(mixed(x * np.uint64(3) + np.uint64(k)) & np.uint64(ROWS - 1)).astype(np.int64) for k, x in enumerate((one, two, both))]
    return [*hashes, ROWS + c1 * wide + c2, ROWS + wide**2 + c2 * wide + c3]


def slot_rows(t: Tokens, own: slice) -> list[np.ndarray]:
    """Rows of the features of a slot, which know the class."""
    kind = t.kind[own]
    word = (mixed(t.before[0][own] * np.uint64(CLASSES + 1) + kind.astype(np.uint64)) & np.uint64(ROWS - 1)).astype(np.int64)
    return [word, ROWS + t.kinds[0][own] * (CLASSES + 1) + kind]


#: Rows of the two tables.
CLASS_ROWS = ROWS + 2 * (CLASSES + 1) ** 2
SLOT_ROWS = ROWS + (CLASSES + 1) ** 2


def powers(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the bias and of rows of weights, a row for each token. The largest bias is 0 and weights are sums of a few
    steps, so their exponentials stay in range."""
    z = weights.take(rows[0], axis=0)
    for f in rows[1:]:
        z += weights.take(f, axis=0)
    z += bias
    return z


def factors(t: Tokens, own: slice, m: Model) -> list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For the class and for the slot of each token: the powers of all choices, the choice, and the rows."""
    first, second = class_rows(t, own), slot_rows(t, own)
    return [
        (powers(m.class_weights, m.class_bias, first), t.kind[own], first),
        (powers(m.slot_weights, m.slot_bias.take(t.kind[own], axis=0), second), t.slot[own], second),
    ]


def chosen_logs(z: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Log-probability of the choice of each row."""
    return z[np.arange(len(choice)), choice] - np.log(np.einsum("ij->i", np.exp(z)))


def blocks_of(t: Tokens) -> Iterator[slice]:
    for low in range(0, len(t.h), BLOCK):
        yield slice(low, min(low + BLOCK, len(t.h)))


def gradient(t: Tokens, m: Model, class_sums: np.ndarray, slot_sums: np.ndarray) -> None:
    """Add the gradient of the log-likelihood of tokens to the sums, which hold a line for each class or slot."""
    for own in blocks_of(t):
        for sums, (z, choice, rows) in zip((class_sums, slot_sums), factors(t, own, m), strict=True):
            np.exp(z, out=z)
            miss = np.empty(z.shape[::-1])
            np.divide(z.T, -np.einsum("ij->i", z), out=miss)
            miss[choice, np.arange(len(choice))] += 1
            for f in rows:
                low = int(f.min())
                f = f - low
                size = int(f.max()) + 1
                for k, line in enumerate(miss):
                    sums[k, low : low + size] += np.bincount(f, line, size)


def _gradients(shared):
    """Task function: the gradient over the texts of a part, by blocks of rows of the two tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sums = [np.zeros((CLASSES + 1, CLASS_ROWS)), np.zeros((SLOTS, SLOT_ROWS))]
        seen = False
        for batch in batches:
            for _, _, raw, at in slices(batch.column("text")):
                gradient(stream(raw, at, m), m, *sums)
                seen = True
        if seen:
            sums = [x.T for x in sums]
            places = [(k, low) for k, x in enumerate(sums) for low in range(0, len(x), SUM_ROWS)]
            blobs = [packed(sums[k][low : low + SUM_ROWS]) for k, low in places]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in places], pa.int32()), pa.array([low for _, low in places], pa.int32()), pa.array(blobs, pa.binary())], names=["side", "low", "sums"]
            )

    return run


def packed(x: np.ndarray) -> bytes:
    return (x / SCALE).astype("<f2").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<f2").astype(np.float32) * SCALE


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of blobs by block; all of a block are in this task."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for side, low, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            sums[side, low] = sums.get((side, low), 0) + unpacked(blob)
    for (side, low), x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([low], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["side", "low", "sums"])


SUMS = "side int, low int, sums binary"


def trusted(m: Model, scale: float) -> Model:
    """The model with the weights of hashed words taken times ``scale``."""
    out = Model(**m.__dict__)
    out.class_weights, out.slot_weights = m.class_weights.copy(), m.slot_weights.copy()
    out.class_weights[:ROWS] *= scale
    out.slot_weights[:ROWS] *= scale
    return out


def _likelihoods(shared):
    """Task function: the log-likelihood of a part's classes and slots for each scale of ``TRUST``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [trusted(shared.value, s) for s in TRUST]
        sums = [0.0] * len(models)
        for batch in batches:
            for _, _, raw, at in slices(batch.column("text")):
                t = stream(raw, at, models[0])
                for own in blocks_of(t):
                    for i, m in enumerate(models):
                        sums[i] += sum(float(chosen_logs(z, choice).sum()) for z, choice, _ in factors(t, own, m))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["scale", "value"])

    return run


def dictionary(counts: DataFrame, most: int) -> pa.Table:
    """The most common words, ``most`` at most: all above a limit on counts, found on a histogram."""
    level = F.floor(F.log("n") * 8).cast("int")
    levels = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, size in levels:
        if total + size > most:
            break
        total, least = total + size, at
    return counts.filter(level >= least if least is not None else F.lit(False)).toArrow()


def slots_of(classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Slot of each dictionary word in its class: one for each of the most common, equal shares for the others."""
    out = np.zeros(len(n), dtype=np.int64)
    shared = SLOTS - 1 - OWN
    for c in np.unique(classes):
        own = np.flatnonzero(classes == c)
        own = own[np.lexsort((own, -n[own]))]
        out[own[:OWN]] = np.arange(min(OWN, len(own)))
        rest = own[OWN:]
        if len(rest):
            out[rest] = OWN + np.minimum((np.cumsum(n[rest]) / n[rest].sum() * shared).astype(np.int64), shared - 1)
    return out


def _rest_mass(keys: np.ndarray, letters: np.ndarray):
    """Task function: by class, the counts and the number of the words outside the dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, types = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            _, known = looked_up(keys, batch.column("h").to_numpy().view(np.uint64))
            away = np.flatnonzero(~known)
            if len(away):
                kind = spelling_class(*_text_buffers(batch.column("word").take(pa.array(away))), letters)
                total += np.bincount(kind, batch.column("n").to_numpy()[away], CLASSES)
                types += np.bincount(kind, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(total), pa.array(types)], names=["kind", "total", "types"])

    return run


def learn(docs: DataFrame, text: str = "text", steps: int = STEPS) -> tuple[Model, DataFrame]:
    """Model and the table of word counts (h, word, n) from all rows of ``docs``.

    What is sent to the driver and to tasks at once is bounded: ``DICTIONARY`` words of ``LONGEST`` bytes and the rows
    of the two tables of weights. The table of words and what is summed for the gradients grow with the corpus. NULL
    and blank texts count as texts without words.
    """
    spark = docs.sparkSession
    # dealt in turn to the slices of the steps; the last slice is kept aside
    texts = docs.select(F.col(text).alias("text"), F.pmod(F.monotonically_increasing_id(), F.lit(steps + 1)).cast("int").alias("turn"))
    counts = texts.select("text").mapInArrow(_word_counts, "h long, word string, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "lm-words")
    whole = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    top = dictionary(counts.filter((F.col("h") != 0) & (F.octet_length("word") <= LONGEST)), DICTIONARY)
    keys, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    spelling = pa.concat_arrays([*top.column("word").chunks, pa.array([], pa.string())]).take(pa.array(order))
    end = counts.filter("h = 0").agg(F.sum("n")).first()[0] or 0
    best = np.lexsort((keys, -n))[:SEEDS]
    letters = centroids(counts, spelling.take(pa.array(best))) if len(keys) else np.zeros((PAIRS, CLASSES), np.float32)
    classes = spelling_class(*_text_buffers(spelling), letters) if len(keys) else np.zeros(0, np.int64)
    slots = slots_of(classes, n)
    mass = np.zeros((CLASSES + 1, SLOTS))
    np.add.at(mass, (classes, slots), n + ADD)
    rest = counts.filter("h <> 0").mapInArrow(_rest_mass(keys, letters), "kind int, total double, types double")
    for r in rest.groupBy("kind").agg(F.sum("total").alias("total"), F.sum("types").alias("types")).collect():
        mass[r["kind"], SLOTS - 1] += r["total"] + ADD * r["types"]
    mass[:CLASSES, SLOTS - 1] += ADD  # a word that was never seen
    mass[CLASSES, 0] = end + ADD
    with np.errstate(divide="ignore"):
        slot_bias = np.maximum(np.log(mass), -1e3)
    m = Model(
        keys, n, classes, slots, int(whole["tokens"] or 0), int(whole["types"]), int(end), letters, mass,
        *((x - x.max(axis=-1, keepdims=True)).astype(np.float32) for x in (np.log(mass.sum(axis=1)), slot_bias)),
        np.zeros((CLASS_ROWS, CLASSES + 1), np.float32), np.zeros((SLOT_ROWS, SLOTS), np.float32),
    )
    if not m.tokens:
        return m, counts
    sliced = written_by(texts, "lm-slices", "turn")
    squares = [np.zeros_like(m.class_weights), np.zeros_like(m.slot_weights)]
    for step in range(steps):
        shared = spark.sparkContext.broadcast(m)
        parts = sliced.filter(F.col("turn") == step).select("text").mapInArrow(_gradients(shared), SUMS)
        sums = [np.zeros_like(x) for x in squares]
        for r in parts.repartition("side", "low").mapInArrow(_summed, SUMS).collect():
            block = np.frombuffer(r["sums"], dtype="<f4").reshape(-1, sums[r["side"]].shape[1])
            sums[r["side"]][r["low"] : r["low"] + len(block)] += block
        shared.unpersist()
        for weights, square, change in zip((m.class_weights, m.slot_weights), squares, sums, strict=True):
            square += change**2
            weights += RATE * change / np.sqrt(square + DAMPING**2)
    shared = spark.sparkContext.broadcast(m)
    aside = sliced.filter(F.col("turn") == steps).select("text").mapInArrow(_likelihoods(shared), "scale int, value double")
    values = {r["scale"]: r["value"] for r in aside.groupBy("scale").agg(F.sum("value").alias("value")).collect()}
    shared.unpersist()
    if values:
        m = trusted(m, TRUST[max(values, key=lambda s: (values[s], s))])
    return m, counts


def scorer(shared):
    """Task function: a row of sums for each text, with the counts of its words outside the dictionary."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        whole = math.log10(m.tokens + ADD * (m.types + 1))
        with np.errstate(divide="ignore"):
            share = np.log10(m.mass)
        for batch in batches:
            for i, j, raw, at in slices(batch.column("text")):
                t = stream(raw, at, m)
                rows, value = j - i, np.zeros(len(t.h))
                for own in blocks_of(t):
                    value[own] = sum(chosen_logs(z, choice) for z, choice, _ in factors(t, own, m)) / math.log(10)
                counted = t.count >= 0
                log_c = np.where(counted, np.log10(np.maximum(t.count, 0) + ADD), 0.0)
                value += log_c - share[t.kind, t.slot]
                sums = [np.bincount(t.row, minlength=rows), np.bincount(t.row, counted & (t.count > 0), rows), np.bincount(t.row, log_c - whole, rows), np.bincount(t.row, value, rows)]
                away = np.flatnonzero(~counted)
                r, h = t.row[away], t.h[away]
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                heads = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(h.view(np.int64), prepend=0) != 0))
                n = np.diff(np.append(heads, len(r)))
                pairs = pa.StructArray.from_arrays([pa.array(h[heads].view(np.int64)), pa.array(n)], ["h", "n"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(r[heads], minlength=rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("own").slice(i, rows), batch.column("no").slice(i, rows), pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                        pa.array(sums[2]), pa.array(sums[3]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs),
                    ],
                    names=["own", "no", "n", "known", "base", "value", "rare"],
                )

    return score


def score_texts(docs: DataFrame, model: Model, counts: DataFrame, text: str = "text", out: str = "lm") -> DataFrame:
    """All rows of ``docs`` without ``text``, with the struct column ``out``: n_tokens, n_known, train_tokens,
    base_score (unigram with add-0.1 counts) and score (the model), both log10 of the whole text.

    Texts are read once. Rows, also repeated ones and those with NULL keys, are told apart by a row number
    given in that pass; only it goes with the words whose counts are joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (text, out)]
    own = F.struct(*(keep or [F.lit(0).alias("none")]))
    numbered = docs.select(own.alias("own"), F.monotonically_increasing_id().alias("no"), F.col(text).alias("text"))
    kind = numbered.schema["own"].dataType.simpleString()
    schema = f"own {kind}, no long, n long, known long, base double, value double, rare array<struct<h:long,n:long>>"
    found = written(numbered.mapInArrow(scorer(shared), schema), "lm-scores")
    rare = found.select("no", F.explode("rare").alias("x")).select("no", "x.h", "x.n")
    rare = rare.join(counts.select("h", F.col("n").alias("c")), "h", "left").select("no", "n", F.coalesce("c", F.lit(0)).alias("c"))
    rare = rare.groupBy("no").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known")
    )
    more: Column = F.coalesce("more", F.lit(0.0))
    return found.drop("rare").join(rare, "no", "left").select(
        *[F.col("own")[c].alias(c) for c in keep],
        F.struct(
            F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("value") + more).alias("score"),
        ).alias(out),
    )
