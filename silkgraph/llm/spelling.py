"""Spelling variants by blocked Gram matrices of letter counts.

1. One pass counts the words of whole texts. Counts are summed inside tasks before they are shuffled.
2. One edit leaves the letters before it and behind it alone. A word of ``l`` letters, and one of ``l + 1``, is
   therefore dealt to a block for each third of its places: the block's key is what lies outside that third.
   A pair meets in the one block whose open places hold its first difference, and nowhere else.
3. A block of more than ``MOST`` words is halved at its open places until it is small. One open place leaves
   90 + 90 * 90 words at most, so this always ends below ``MOST``; nothing is cut.
4. Inside a block the words of length ``l`` stand against themselves and against those of length ``l + 1``:
   NumPy products of their letter counts give all squared distances, pairs of at most two are kept, and their
   edits are verified. A task returns a count and the best near word for each word, never pairs.
5. Forms are followed to their last word by doubling steps.

Defined results: NULL and empty texts have no words; a NULL key reads as an empty one; repeated rows count
each time; a table without words gives no rows; other columns of the table are not looked at, whatever their
names. Ties among near words of equal count go to the first in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import written

LETTERS = "a-zÀ-ÿ"
#: Dimensions of the letter counts: a-z, then U+00C0 to U+00FF.
KINDS = 26 + 64
#: Words of a block: what one open place can hold (KINDS + KINDS * KINDS), rounded up.
MOST = 8192
SIDE = 256
TILE = 1024
HELD = 200_000


def mutated(word: str, mark: int, every: int = 31) -> str:
    """The word, or the word without one of its letters if ``every`` divides its mark."""
    if mark % every:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1 :]


def counted_words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7) -> DataFrame:
    """(word, n) of all words of at least ``least`` letters, by whole texts."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(totals.keys(), pa.string()), pa.array(totals.values(), pa.int64())], ["word", "n"])
            totals.clear()
            return rows

        for batch in batches:
            for name, body in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
                if not body:
                    continue
                start = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(runs.findall(body.encode().lower().decode())).items():
                    word = mutated(run, zlib.crc32(run.encode(), start))
                    if len(word) >= least:
                        totals[word] += n
                if len(totals) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).filter("text is not null")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Block key ``h``: the letters outside the open places ``[s, e)`` of a word that pairs with words of ``l`` letters."""
    behind = F.greatest(F.lit(0), F.col("l") - F.col("e"))
    return rows.withColumn(
        "h", F.xxhash64("l", "s", "e", F.substring("word", F.lit(1), F.col("s")), F.substring("word", F.col("size") - behind + 1, behind))
    )


def blocks(words: DataFrame, least: int = 7, parts: int = 3, most: int = MOST) -> DataFrame:
    """(h, word, n, l, s, e): every word in each of its blocks; no block has more than ``most`` words."""
    places = (F.col("l") + 1).cast("double")
    rows = (
        words.withColumn("size", F.char_length("word"))
        .withColumn("l", F.explode(F.array("size", F.col("size") - 1)))
        .filter(F.col("l") >= least)
        .withColumn("i", F.explode(F.array(*[F.lit(float(i)) for i in range(parts)])))
        .withColumn("s", F.floor(places * F.col("i") / parts).cast("int"))
        .withColumn("e", F.floor(places * (F.col("i") + 1) / parts).cast("int"))
        .drop("i")
    )
    rows, done = _keyed(rows.filter("s < e")), []
    while True:
        hot = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > most).select("h"), "spelling-hot")
        if hot.isEmpty():
            break
        done.append(rows.join(hot, "h", "left_anti"))
        large = rows.join(hot, "h", "left_semi")
        done.append(large.filter("e - s < 2"))
        mid = F.floor((F.col("s") + F.col("e")) / 2).cast("int")
        halves = F.array(F.struct("s", mid.alias("e")), F.struct(mid.alias("s"), "e"))
        halved = large.filter("e - s >= 2").withColumn("half", F.explode(halves)).withColumns({"s": F.col("half.s"), "e": F.col("half.e")})
        rows = written(_keyed(halved.drop("half")), "spelling-halves")
    columns = ["h", "word", "n", "l", "s", "e"]
    out = rows.select(columns)
    for part in done:
        out = out.unionByName(part.select(columns))
    return out


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    kind = np.where(codes < 0xC0, codes - 97, codes - 0xC0 + 26)
    at = np.repeat(np.arange(len(words)), sizes) * KINDS + kind
    counts = np.bincount(at, minlength=len(words) * KINDS).reshape(-1, KINDS)
    return counts.astype(np.float32 if sizes.max(initial=0) < 2000 else np.float64)


def one_edit(short: str, long: str, first: int, end: int) -> bool:
    """Whether one inserted, deleted or replaced letter, first seen at a place in ``[first, end)``, is all that differs."""
    size = len(short)
    if short[:first] != long[:first]:
        return False
    for at in range(first, min(end, size)):
        if short[at] != long[at]:
            return short[at + (len(long) == size) :] == long[at + 1 :]
    return first <= size < end and len(long) == size + 1


def near_pairs(words: list[str], group: np.ndarray, l: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places of near words that stand in the same group; ``l``, ``s`` and ``e`` as in ``blocks``."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short, long = np.flatnonzero(sizes == l), np.flatnonzero(sizes == l + 1)
    counts = letter_counts(words)
    norms = (counts**2).sum(axis=1)
    tiles = [short[i : i + TILE] for i in range(0, len(short), TILE)]
    others = [long[i : i + TILE] for i in range(0, len(long), TILE)]
    for i, a in enumerate(tiles):
        for j, b in enumerate(tiles[i:] + others):
            apart = norms[a][:, None] + norms[b][None, :] - 2 * (counts[a] @ counts[b].T)
            kept = (apart < 2.5) & (group[a][:, None] == group[b][None, :])
            x, y = np.nonzero(np.triu(kept, 1) if j == 0 else kept)
            for u, v in zip(a[x].tolist(), b[y].tolist(), strict=True):
                if l[u] == l[v] and s[u] == s[v] and one_edit(words[u], words[v], s[u], e[u]):
                    yield u, v


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of blocks that follow each other: for each word its near words' count, and the best of them."""
    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h = rows["h"].to_numpy()
        if not len(h):
            return
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(fresh) - 1
        kept = np.flatnonzero(np.bincount(group)[group] > 1)
        rows, group = rows.take(kept), group[kept]
        words, n = rows["word"].to_pylist(), rows["n"].to_pylist()
        l, s, e = (rows[name].to_numpy() for name in ("l", "s", "e"))
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
        near: dict[str, tuple[int, int, str]] = {}
        at = 0
        while at < len(words):
            # whole groups, of SIDE rows together, or one larger group
            up = int(ends[max(np.searchsorted(ends, at + SIDE, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            part = words[at:up]
            for u, v in near_pairs(part, group[at:up], l[at:up], s[at:up], e[at:up]):
                for x, y in ((u, v), (v, u)):
                    count, best, form = near.get(part[x], (0, 0, ""))
                    if (-n[at + y], part[y]) < (-best, form) or not count:
                        best, form = n[at + y], part[y]
                    near[part[x]] = (count + 1, best, form)
            at = up
        if near:
            count, best, form = zip(*near.values(), strict=True)
            yield pa.record_batch(
                [pa.array(near.keys(), pa.string()), pa.array(count, pa.int64()), pa.array(best, pa.int64()), pa.array(form, pa.string())],
                ["word", "n_near", "near_n", "near"],
            )

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < 50_000:
            continue
        rows = pa.Table.from_batches(held)
        h = rows["h"].to_numpy()
        last = int(np.searchsorted(h, h[-1]))
        yield from found(rows.slice(0, last))
        held, size = rows.slice(last).combine_chunks().to_batches(), len(h) - last
    if held:
        yield from found(pa.Table.from_batches(held))


def near_words(words: DataFrame, least: int = 7, most: int = MOST) -> DataFrame:
    """(word, n_near, near_n, near) of every word that has near words; ``near`` is the most common of them."""
    dealt = blocks(words, least, most=most)
    dealt = dealt.repartition("h").sortWithinPartitions("h")
    found = dealt.mapInArrow(_match, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.order")).alias("near_n"), F.col("best.near").alias("near")
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form) without cycles: each step doubles the way that is known."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def spelling_variants(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 7, seen: int = 2, times: int = 10, most: int = MOST
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words with at least ``seen`` occurrences.

    ``form`` is the most common near word, if it is at least ``times`` as common as the word itself; ``root`` is the
    last word that forms lead to.
    """
    words = written(counted_words(docs, key, text, least).filter(F.col("n") >= seen), "spelling-words")
    near = near_words(words, least, most)
    given = F.col("near_n") >= times * F.col("n")
    rows = written(
        words.join(near, "word", "left").select(
            "word", F.when(given, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(given, F.col("near_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = last_forms(rows.filter("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
