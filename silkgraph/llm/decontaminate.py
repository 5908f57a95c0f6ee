"""Benchmark decontamination: BM25 index of test items, queried with every passage by block-max WAND.

Test items are cut into segments of bounded length; segments are the documents of an inverted index whose
impacts are divided by the segment's score for itself, so that one threshold serves all. Every passage of
every text (windows of twice the longest segment, each overlapping half of the next) is a query.

For all passages of a batch at once the sum of block maxima bounds what any segment of a block can
score; blocks that cannot reach the threshold are passed over. The rest is walked by WAND: cursors over
postings, a pivot, a second look at block maxima, and full scores only where they can matter. Whatever
scores above the threshold is then verified on word n-grams: the question and the answer part of the
segment must both be found in the passage.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import SYMBOLS, looked_up, rows_of, shingles, slices, words

K1, B = 1.2, 0.75
BLOCK = 2
SEGMENT = 64
GRAM = 3


@dataclass
class Index:
    """Terms (sorted hashes) with postings in order of segments, block maxima, and the segments' n-grams."""

    terms: np.ndarray
    first: np.ndarray
    posts: np.ndarray
    impacts: np.ndarray
    block_max: np.ndarray
    items: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    width: int


def sentence_start(raw: bytes) -> int:
    """Byte where the last sentence begins; 0 if there is one sentence only."""
    text = raw.rstrip()
    return max(text[:-1].rfind(x) for x in (b". ", b"? ", b"! ", b"\n", b".\n")) + 1 if text else 0


def build(items: list[tuple[int, str]], least: int = 5) -> Index | None:
    """Index over (id, text). An item of fewer than ``least`` words cannot mark a passage and is left out."""
    kept: list[tuple[int, np.ndarray, int]] = []
    for item, text in items:
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        h, place, _ = words(raw, np.array([0, len(raw)]), SYMBOLS)
        if len(h) < least:
            continue
        parts = -(-len(h) // SEGMENT)
        edges = np.linspace(0, len(h), parts + 1).astype(int)
        answer = int(np.searchsorted(place, sentence_start(raw.tobytes())))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            cut = answer - a if a + GRAM <= answer <= b - GRAM else (3 * (b - a)) // 4
            kept.append((item, h[a:b], cut))
    if not kept:
        return None
    terms, spread = np.unique(np.concatenate([np.unique(h) for _, h, _ in kept]), return_counts=True)
    # neighbours share their most common terms, so that block maxima stay low
    kept.sort(key=lambda k: (sorted(zip(-spread[np.searchsorted(terms, np.unique(k[1]))], np.unique(k[1]), strict=True))[:4], k[0]))
    n, mean = len(kept), np.mean([len(h) for _, h, _ in kept])
    seg_of, term_of, tf = [], [], []
    for s, (_, h, _) in enumerate(kept):
        own, count = np.unique(h, return_counts=True)
        seg_of.append(np.full(len(own), s))
        term_of.append(np.searchsorted(terms, own))
        tf.append(count)
    seg, term, tf = np.concatenate(seg_of), np.concatenate(term_of), np.concatenate(tf).astype(float)
    length = np.array([len(h) for _, h, _ in kept])[seg]
    df = np.bincount(term, minlength=len(terms))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
    impact /= np.bincount(seg, impact, n)[seg]
    order = np.lexsort((seg, term))
    seg, term, impact = seg[order], term[order], impact[order]
    block_max = np.zeros((len(terms), -(-n // BLOCK)), dtype=np.float32)
    np.maximum.at(block_max, (term, seg // BLOCK), np.nextafter(impact.astype(np.float32), np.float32(2)))

    def grams(h: np.ndarray) -> np.ndarray:
        return np.unique(shingles(h, np.array([0, len(h)]), GRAM)[0])

    return Index(
        terms, np.searchsorted(term, np.arange(len(terms) + 1)), seg, impact, block_max, [k[0] for k in kept],
        [grams(h[: max(cut, GRAM)]) for _, h, cut in kept], [grams(h[min(cut, len(h) - GRAM) :]) for _, h, cut in kept],
        2 * max(len(h) for _, h, _ in kept),
    )


def wand(index: Index, query: np.ndarray, threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
    """All segments from block ``low`` up to ``high`` that score ``threshold`` or more for the distinct terms
    ``query``, by block-max WAND."""
    posts, impacts, terms = [], [], []
    for t in query.tolist():
        a, b = index.first[t], index.first[t + 1]
        own = index.posts[a:b]
        if high is not None:
            i, j = np.searchsorted(own, (low * BLOCK, high * BLOCK))
            own, a, b = own[i:j], a + i, a + j
        if len(own):
            posts.append(own.tolist())
            impacts.append(index.impacts[a:b].tolist())
            terms.append(t)
    tops = [max(x) for x in impacts]
    at = [0] * len(terms)
    found = []
    live = list(range(len(terms)))
    while live:
        live.sort(key=lambda k: posts[k][at[k]])
        bound, pivot = 0.0, None
        for place, k in enumerate(live):
            bound += tops[k]
            if bound >= threshold - 1e-9:
                pivot = place
                break
        if pivot is None:
            break
        segment = posts[live[pivot]][at[live[pivot]]]
        while pivot + 1 < len(live) and posts[live[pivot + 1]][at[live[pivot + 1]]] == segment:
            pivot += 1
        ahead = live[: pivot + 1]
        block = segment // BLOCK
        target = segment
        if sum(index.block_max[[terms[k] for k in ahead], block].tolist()) < threshold - 1e-6:
            # no segment before the block's end, or before the next cursor, can do it
            target = (block + 1) * BLOCK
            if pivot + 1 < len(live):
                target = min(target, posts[live[pivot + 1]][at[live[pivot + 1]]])
            target = max(target, segment + 1)
        elif posts[ahead[0]][at[ahead[0]]] == segment:
            score = sum(impacts[k][at[k]] for k in ahead)
            if score >= threshold:
                found.append((segment, score))
            target = segment + 1
        for k in ahead:
            at[k] = bisect_left(posts[k], target, at[k])
        live = [k for k in live if at[k] < len(posts[k])]
    return found


def share(part: np.ndarray, grams: np.ndarray) -> float:
    return float(np.isin(part, grams).mean()) if len(part) else 1.0


Hit = dict


def hits_of(texts: pa.Array, index: Index, threshold: float, overlap: float) -> list[list[Hit]]:
    """For each text the verified items, each with its best passage."""
    stride = index.width // 2
    out: list[list[Hit]] = []
    for _, _, raw, at in slices(texts, 1 << 20):
        h, _, first = words(raw, at, SYMBOLS)
        rows = len(at) - 1
        found: list[dict[int, Hit]] = [{} for _ in range(rows)]
        where, known = looked_up(index.terms, h)
        counts = np.diff(first)
        # half passages, and the distinct terms of each
        halves = -(-counts // stride)
        half_first = np.concatenate([[0], np.cumsum(halves)])
        row = rows_of(first)
        half = (half_first[row] + (np.arange(len(h)) - first[row]) // stride)[known]
        pair = np.unique(half * len(index.terms) + where[known])
        half, term = pair // len(index.terms), pair % len(index.terms)
        bounds = np.zeros((half_first[-1] + 1, index.block_max.shape[1]))
        heads = np.flatnonzero(np.diff(half, prepend=-1))
        if len(heads):
            bounds[half[heads]] = np.add.reduceat(index.block_max[term], heads, axis=0)
        edge = np.searchsorted(half, np.arange(half_first[-1] + 2))
        # a passage is a half with the next one of its text, if any
        row = np.repeat(np.arange(rows), halves)
        number = np.arange(len(row)) - half_first[row]
        last = number == halves[row] - 1
        bounds = bounds[:-1] + np.where(last[:, None], 0, bounds[1:])
        reach = bounds >= threshold - 1e-6
        for w in np.flatnonzero(reach.any(axis=1) & ~(last & (number > 0))):
            query = np.unique(term[edge[w] : edge[w + 1 if last[w] else w + 2]])
            begin = int(first[row[w]] + number[w] * stride)
            end = int(min(begin + index.width, first[row[w] + 1]))
            grams = None
            blocks = np.flatnonzero(reach[w])
            runs = np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1)
            for segment, score in (x for run in runs for x in wand(index, query, threshold, run[0], run[-1] + 1)):
                if grams is None:
                    part = h[begin:end]
                    grams = shingles(part, np.array([0, len(part)]), GRAM)[0]
                question, answer = share(index.questions[segment], grams), share(index.answers[segment], grams)
                if question < overlap or answer < overlap:
                    continue
                hit = dict(
                    item=index.items[segment], first_word=begin - int(first[row[w]]), words=end - begin,
                    score=score, question=question, answer=answer,
                )
                before = found[row[w]].get(hit["item"])
                if before is None or (score, question + answer) > (before["score"], before["question"] + before["answer"]):
                    found[row[w]][hit["item"]] = hit
        out += [[x[k] for k in sorted(x)] for x in found]
    return out


_hits = pa.list_(
    pa.struct(
        [("item", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())]
    )
)
HITS = "array<struct<item:long,first_word:long,words:long,score:double,question:double,answer:double>>"


def _looked(shared, threshold: float, overlap: float):
    def look(texts: pa.Array) -> pa.Array:
        return pa.array(hits_of(texts, shared.value, threshold, overlap), type=_hits)

    return F.arrow_udf(look, HITS)


def contamination(text: Column, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", threshold: float = 0.6, overlap: float = 0.6, most: int = 1000) -> Column:
    """Array of the test items found in a text: item, passage (first word and length), scores.

    The index goes to the tasks in shards of ``most`` items at most, so what is sent at once is bounded
    by items times the longest item; a larger benchmark makes more shards and more passes over a batch,
    not a larger broadcast. NULL and blank texts hold no item; NULL items and items under five words are left out;
    items with the same id count as one; an empty benchmark finds nothing.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.lower(item_text).alias("text")).filter("item is not null and text is not null")
    shards = -(-items.count() // most)
    found = []
    for shard in range(shards):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard).collect()
        index = build(sorted((r["item"], r["text"]) for r in own))
        if index is None:
            continue
        found.append(_looked(spark.sparkContext.broadcast(index), threshold, overlap)(F.lower(text)))
    if not found:
        return F.array().cast(HITS)
    return F.concat(*found) if len(found) > 1 else found[0]


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "contamination", **settings) -> DataFrame:
    """All rows of ``docs`` with the array column ``out``; one pass, no shuffle, extra columns stay."""
    return docs.withColumn(out, contamination(F.col(text), benchmark, **settings))
