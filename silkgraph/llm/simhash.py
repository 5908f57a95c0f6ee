"""SimHash near-duplicates by a self-join of binary tries.

1. One pass signs whole texts: XXH64 of every word shingle, a bit for what over half of them have set. Equal
   fingerprints become one row with their smallest key; only these rows are joined.
2. Two fingerprints with at most three differing bits agree in one of four quarters of their bits. Each quarter
   takes its turn as the top of the trie, so that a fingerprint stands in four tries and a pair meets below the
   node of the quarter that it shares.
3. A node of more than ``MOST`` fingerprints is not handed to one task. Its pair with itself is opened by four bits at
   a time, in tables: pairs of children add their differing bits, those beyond the error budget are pruned, and what is
   small enough goes on. After 64 bits every node is a single fingerprint, so this ends and drops nothing.
4. A task walks its pairs of nodes together, one bit deeper each step: the children of a pair are pairs with as many or
   one more differing bit, and a pair is pruned as soon as its error budget is spent. Nodes are ranges of the sorted
   fingerprints. Links are merged on the spot; a task returns at most one edge for each of its fingerprints, never pairs.
5. Components of these edges give every document the smallest key that it reaches.

Defined results: a NULL or empty text, or one of blanks, has fingerprint zero, and links like any other; a text of
fewer words than a shingle has one shorter shingle; repeated rows come back as often as they stand there; a NULL key is
passed on and never is a component's id, unless all its keys are NULL; an empty table gives no rows; other columns of
the table are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .graph import components
from .shared import written

BITS = 64
QUARTER = 16
#: Differing bits of a link. Four quarters cannot all differ by three bits.
ERRORS = 3
SEED = 42
#: Fingerprints of a node that a task walks as a whole.
MOST = 8192
#: Bits that a large node is opened by in tables.
STEP = 4
SHINGLES = 1 << 18
PAIRS = 1 << 20
_lanes = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many hashes of each row have a bit set: rows by 64, the lowest bit first. ``first``: offsets of the rows."""
    # rows are cut into runs of at most 255 hashes, whose sums fit in the bytes of one number
    runs = np.concatenate([np.arange(a, b, 255) for a, b in zip(first[:-1], first[1:], strict=True)] or [np.zeros(0, np.int64)])
    out = np.zeros((len(first) - 1, BITS), dtype=np.int64)
    if not len(runs):
        return out
    row = np.searchsorted(first, runs, side="right") - 1
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & _lanes, runs)
        lanes = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
        out[row[starts], k::8] = np.add.reduceat(lanes, starts, axis=0, dtype=np.int64)
    return out


def fingerprints(texts: list[str | None], size: int = 3) -> np.ndarray:
    """SimHash of each text; shingles are hashed and counted in pieces of bounded size."""
    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), dtype=np.uint64)
    counts = np.zeros((len(texts), BITS), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held: list[int] = []
    row: list[int] = []
    stops: list[int] = [0]

    def fold() -> None:
        counts[row] += bit_counts(np.array(held, dtype=np.uint64), np.array(stops))
        held.clear(), row.clear()
        del stops[1:]

    for i, text in enumerate(texts):
        words = (text or "").encode().lower().split()
        if not words:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        whole = b" ".join(words)
        last = max(1, len(words) - size + 1)
        ends = ends[min(size, len(words)) - 1 :]
        total[i] = last
        for at in range(0, last, SHINGLES):
            held += [digest(whole[a:b], SEED) for a, b in zip(starts[at : min(at + SHINGLES, last)].tolist(), ends[at : at + SHINGLES].tolist(), strict=True)]
            row.append(i)
            stops.append(len(held))
            if len(held) >= SHINGLES:
                fold()
    if held:
        fold()
    for bit in range(BITS):
        out |= (2 * counts[:, bit] > total).astype(np.uint64) << np.uint64(bit)
    return out


def signed(docs: DataFrame, key: str, text: str, size: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of each row as a signed number."""
    kind = docs.schema[key].dataType

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                fp = fingerprints(part[1].to_pylist(), size).view(np.int64)
                yield pa.record_batch([part[0], pa.array(fp)], ["key", "fp"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, f"key {kind.simpleString()}, fp long")


def _roots(size: int, u: np.ndarray, v: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """``parent`` (of forests of depth one) after the links u to v."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    return parent


def walk(bits: np.ndarray, pairs: np.ndarray, depth: int, errors: int = ERRORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links below pairs of trie nodes, as pairs of places, in pieces.

    ``bits`` holds fingerprints, sorted inside each node. A column of ``pairs`` is a pair of nodes whose first ``depth``
    bits are done: two ranges of places and the number of bits that differ so far. Both ranges are equal, or apart.
    """
    todo = [(depth, pairs)]
    while todo:
        depth, pairs = todo.pop()
        while pairs.shape[1]:
            if pairs.shape[1] > PAIRS:
                half = pairs.shape[1] // 2
                todo.append((depth, pairs[:, half:]))
                pairs = pairs[:, :half]
            a, a_end, b, b_end, apart = pairs
            single = (a_end - a == 1) & (b_end - b == 1)
            if single.any():
                # two single paths are compressed: all their other bits at once
                u, v = a[single], b[single]
                near = (u != v) & (np.bitwise_count(bits[u] ^ bits[v]) <= errors)
                yield u[near], v[near]
                a, a_end, b, b_end, apart = pairs = pairs[:, ~single]
            if depth == BITS or not pairs.shape[1]:
                break
            ones = np.concatenate([[0], np.cumsum((bits >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
            a_mid, b_mid = a_end - (ones[a_end] - ones[a]), b_end - (ones[b_end] - ones[b])
            own = a == b
            pairs = np.concatenate(
                [
                    np.stack([a, a_mid, b, b_mid, apart]),
                    np.stack([a_mid, a_end, b_mid, b_end, apart]),
                    np.stack([a, a_mid, b_mid, b_end, apart + 1]),
                    np.stack([a_mid, a_end, b, b_mid, apart + 1])[:, ~own],
                ],
                axis=1,
            )
            pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & (pairs[4] <= errors)]
            depth += 1


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) of rows (task, depth, apart, side, quarter, bits), in order of task, side and bits."""
    def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        task = rows["task"].to_numpy()
        if not len(task):
            return
        depth, apart, side, quarter = (rows[name].to_numpy().astype(np.int64) for name in ("depth", "apart", "side", "quarter"))
        bits = rows["bits"].to_numpy() ^ np.int64(-1 << 63)
        bits = bits.view(np.uint64)
        fresh = np.concatenate([[True], task[1:] != task[:-1]])
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(task))
        mids = starts + np.add.reduceat((side == 0).astype(np.int64), starts)
        cross = mids < ends
        # a node against itself, or side 0 against side 1
        pairs = np.stack([starts, mids, np.where(cross, mids, starts), np.where(cross, ends, mids), apart[starts]])
        pairs = pairs[:, cross | (mids - starts > 1)]
        parent = np.arange(len(task))
        for d in np.unique(depth[pairs[0]]):
            for u, v in walk(bits, pairs[:, depth[pairs[0]] == d], int(d)):
                parent = _roots(len(task), u, v, parent)
        linked = np.flatnonzero(parent != np.arange(len(task)))
        if len(linked):
            turn = (quarter * QUARTER).astype(np.uint64)
            own = ((bits >> turn) | (bits << ((BITS - turn) % np.uint64(BITS)))).view(np.int64)
            yield pa.record_batch([pa.array(own[linked]), pa.array(own[parent[linked]])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < 100_000:
            continue
        rows = pa.Table.from_batches(held)
        last = int(np.searchsorted(rows["task"].to_numpy(), rows["task"][-1].as_py()))
        yield from edges(rows.slice(0, last))
        held, size = rows.slice(last).combine_chunks().to_batches(), len(rows) - last
    if held:
        yield from edges(pa.Table.from_batches(held))


def _prefix(bits: Column | str, depth: int) -> Column:
    """The first ``depth`` bits of sortable fingerprints (the sign bit flipped)."""
    return F.shiftright(bits, BITS - depth)


def node_pairs(prints: DataFrame, most: int = MOST, errors: int = ERRORS) -> DataFrame:
    """(task, depth, apart, side, quarter, bits): the fingerprints of every pair of trie nodes that a task walks.

    ``bits`` is the fingerprint with its quarter in front, and the first bit flipped so that signed order is the trie's.
    """
    def turned(quarter: int) -> Column:
        places = quarter * QUARTER
        whole = F.shiftleft("fp", places).bitwiseOR(F.shiftrightunsigned("fp", BITS - places)) if places else F.col("fp")
        return F.struct(F.lit(quarter).alias("quarter"), whole.bitwiseXOR(F.lit(-1 << 63)).alias("bits"))

    rows = prints.select(F.explode(F.array(*map(turned, range(BITS // QUARTER)))).alias("x")).select("x.quarter", "x.bits")

    def sized(rows: DataFrame, depth: int) -> DataFrame:
        return rows.groupBy("quarter", _prefix("bits", depth).alias("node")).agg(F.count(F.lit(1)).alias("rows"))

    def dealt(rows: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
        a, b = F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side"))
        sides = pairs.select("quarter", "apart", F.xxhash64(F.lit(depth), "quarter", "a", "b").alias("task"), F.explode(F.when(F.col("a") == F.col("b"), F.array(a)).otherwise(F.array(a, b))).alias("x"))
        sides = sides.select("quarter", "apart", "task", "x.node", "x.side")
        return rows.withColumn("node", _prefix("bits", depth)).join(sides, ["quarter", "node"]).select(
            "task", F.lit(depth).alias("depth"), "apart", "side", "quarter", "bits"
        )

    depth = QUARTER
    large = written(sized(rows, depth).filter(F.col("rows") > most).select("quarter", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("apart")), "trie-large")
    tops = rows.withColumn("a", _prefix("bits", depth))
    out = tops.join(large, ["quarter", "a"], "left_anti").select(
        F.xxhash64(F.lit(depth), "quarter", "a", "a").alias("task"), F.lit(depth).alias("depth"), F.lit(0).alias("apart"), F.lit(0).alias("side"), "quarter", "bits"
    )
    if large.isEmpty():
        return out
    rows = written(tops.join(large.select("quarter", "a"), ["quarter", "a"], "left_semi").select("quarter", "bits"), "trie-rows")
    while depth < BITS and not large.isEmpty():
        depth += STEP
        nodes = written(sized(rows, depth).withColumn("up", F.shiftright("node", STEP)), "trie-nodes")
        left = nodes.select("quarter", F.col("up").alias("a"), F.col("node").alias("x"), F.col("rows").alias("m"))
        right = nodes.select("quarter", F.col("up").alias("b"), F.col("node").alias("y"), F.col("rows").alias("n"))
        opened = large.join(left, ["quarter", "a"]).join(right, ["quarter", "b"]).filter((F.col("a") != F.col("b")) | (F.col("x") <= F.col("y")))
        opened = opened.withColumn("apart", F.col("apart") + F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << STEP) - 1))))
        same = F.col("x") == F.col("y")
        opened = written(
            opened.filter((F.col("apart") <= errors) & (~same | (F.col("m") > 1))).select(
                "quarter", F.col("x").alias("a"), F.col("y").alias("b"), "apart", (F.greatest("m", "n") > most).alias("large")
            ),
            "trie-pairs",
        )
        large = opened.filter("large")
        out = out.unionByName(dealt(rows, opened.filter("not large"), depth))
    return out


def similar_prints(prints: DataFrame, most: int = MOST, errors: int = ERRORS) -> DataFrame:
    """(node, root) of all fingerprints (fp: long, each once) that link to others; the root is the same for all of a component."""
    dealt = node_pairs(prints, most, errors).repartition("task").sortWithinPartitions("task", "side", "bits")
    return components(dealt.mapInArrow(_tasks, "u long, v long"), "simhash")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, most: int = MOST) -> DataFrame:
    """(key, fingerprint, component_id) of every row: its fingerprint in hex, and the smallest key of its component."""
    rows = written(signed(docs, key, text, size), "simhash")
    prints = written(rows.groupBy("fp").agg(F.min("key").alias("least")), "simhash-prints")
    roots = similar_prints(prints.select("fp"), most)
    linked = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = written(linked, "simhash-roots")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rows.join(linked.join(least, "root").select("fp", "component_id"), "fp")
    return found.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
