"""Words of a batch of texts as 64-bit hashes, computed over the Arrow buffers without a loop over rows.

A word's hash is a polynomial over its bytes (A-Z lower-cased), read off a running sum over the batch.
Whole texts are read; a batch is taken in slices of bounded bytes, and a text longer than a slice in
pieces that end at separators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that end words, by kind: ASCII blanks, or everything in ASCII but digits and letters.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, *range(9, 14)]] = True
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

PIECE = 1 << 17
SLICE = 1 << 22
BASE = 0x9E3779B97F4A7C15
_letters = np.random.default_rng(5).integers(1, 1 << 63, size=256, dtype=np.uint64)
_letters = _letters[LOWER]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


# grown in the tasks, which get this module's functions by value
_up = _powers(BASE, 1)
_down = _powers(pow(BASE, -1, 1 << 64), 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread of 64-bit values, in place of a copy."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a NULL has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type) and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, places, data = texts.buffers()
    at = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes (one row at least), each with its bytes and row offsets."""
    raw, at = buffers(texts)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        last = min(last, rows)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, at: np.ndarray, apart: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, the byte where each starts, and for each row its first word.

    The third array has one entry more than there are rows, as offsets have.
    """
    global _up, _down
    total = len(raw)
    ends = np.zeros(total + 1, dtype=bool)
    ends[at] = True
    hashes, places = [], []
    pos = 0
    while pos < total:
        end = min(pos + PIECE, total)
        if end < total and not ends[end]:
            stops = np.flatnonzero(apart[raw[pos:end]] | ends[pos:end])
            stops = stops[stops > 0]
            if len(stops):
                end = pos + int(stops[-1])
            else:
                step = end
                while step < total:
                    stops = np.flatnonzero(apart[raw[step : step + PIECE]] | ends[step : min(step + PIECE, total)])
                    if len(stops):
                        step += int(stops[0])
                        break
                    step += PIECE
                end = min(step, total)
        piece = raw[pos:end]
        size = len(piece)
        if size > len(_up):
            _up, _down = _powers(BASE, max(size, PIECE)), _powers(pow(BASE, -1, 1 << 64), max(size, PIECE))
        gap = apart[piece]
        fresh = ends[pos:end].copy()
        fresh[0] = True
        fresh[1:] |= gap[:-1]
        start = np.flatnonzero(fresh & ~gap)
        if len(start):
            over = np.ones(size, dtype=bool)
            over[:-1] = gap[1:] | ends[pos + 1 : end]
            stop = np.flatnonzero(over & ~gap)
            sums = np.zeros(size + 1, dtype=np.uint64)
            np.cumsum(_letters[piece] * _up[:size], out=sums[1:])
            hashes.append(mixed((sums[stop + 1] - sums[start]) * _down[start]))
            places.append(start + pos)
        pos = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    place = np.concatenate(places)
    return np.concatenate(hashes), place, np.searchsorted(place, at)


def word_hash(word: str) -> int:
    """Hash of one word, as ``words`` gives it."""
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words(raw, np.array([0, len(raw)]), np.zeros(256, dtype=bool))[0][0])


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each word, from the first words of the rows."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(hashes: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside rows, and the row of each run.

    A row of fewer words, but at least one, has one shorter run.
    """
    n = len(hashes)
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), runs)
    before = np.concatenate([[0], np.cumsum(runs)])
    start = first[:-1][row] + np.arange(len(row)) - before[row]
    padded = np.concatenate([hashes, np.zeros(size, dtype=np.uint64)])
    out = np.zeros(len(row), dtype=np.uint64)
    end = first[1:][row]
    for k in range(size):
        part = padded[np.minimum(start + k, n)]
        if k:
            part = np.where(start + k < end, part, np.uint64(k))
        out = (out + part) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return mixed(out), row


def looked_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return at, keys[at] == values
