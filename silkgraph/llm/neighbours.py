"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Vectors are dealt into shards by key hash; a shard grows with the root of the table, so that neither the shards that a
query visits nor the rows of a shard grow with the table alone. A shard is indexed once, in one task: equal vectors
become one node, nodes of like length (within ``BAND``) a band, and each band a graph over their directions, grown by
batches: greedy searches from the medoid propose neighbours, pruning keeps an edge only if no kept neighbour is
nearer to its end by the factor ``ALPHA``, and back edges are pruned alike. The graphs are a table of nodes.

Every shard's nodes meet all queries in one place: the nodes come first, then the queries stream past them in batches.
A beam search by inner product walks the bands from the longest vectors down, for all queries of a batch at once, and leaves
out the bands whose longest vector cannot reach what a query has found. What was found is ranked by exact inner
products of the original vectors in double precision. The best of all shards are the answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import written

#: Rows of the first shard, and of the largest one.
SHARD_ROWS, MOST_ROWS = 8192, 1 << 18
#: Longest to shortest vector of a band.
BAND = 1.15
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
BATCH = 256


def distances(points: np.ndarray, lengths: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances, up to the query's own length, of each query to its row of nodes (-1: infinite)."""
    d = lengths[nodes] - 2 * np.einsum("qkd,qd->qk", points[nodes], queries, optimize=True)
    d[nodes < 0] = np.inf
    return d


def beam_search(points: np.ndarray, lengths: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes that a greedy walk meets, for all queries at once, nearest first."""
    q, n = len(queries), len(points)
    seen = np.zeros((q, n), dtype=bool)
    seen[:, entry] = True
    nodes = np.full((q, beam), -1, dtype=np.int64)
    far = np.full((q, beam), np.inf, dtype=points.dtype)
    nodes[:, 0] = entry
    far[:, 0] = distances(points, lengths, nodes[:, :1], queries)[:, 0]
    done = np.ones((q, beam), dtype=bool)
    done[:, 0] = False
    live = np.arange(q)
    while len(live):
        open_ = ~done[live]
        live = live[open_.any(axis=1)]
        if not len(live):
            break
        open_ = ~done[live]
        # the nearest nodes not yet expanded; the beam is sorted, so they come first
        rank = np.cumsum(open_, axis=1)
        chosen = open_ & (rank <= expand)
        who, place = np.nonzero(chosen)
        done[live[who], place] = True
        slot = rank[who, place] - 1
        near = np.full((len(live), expand, edges.shape[1]), -1, dtype=np.int64)
        near[who, slot] = edges[nodes[live[who], place]]
        near = near.reshape(len(live), -1)
        near[seen[live[:, None], near] & (near >= 0)] = -1
        # the same neighbour of two expanded nodes counts once
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        r, c = np.nonzero(near >= 0)
        seen[live[r], near[r, c]] = True
        d = distances(points, lengths, near, queries[live])
        both_n = np.concatenate([nodes[live], near], axis=1)
        both_d = np.concatenate([far[live], d], axis=1)
        both_x = np.concatenate([done[live], near < 0], axis=1)
        if both_d.shape[1] > beam:
            part = np.argpartition(both_d, beam - 1, axis=1)[:, :beam]
            both_n, both_d, both_x = (np.take_along_axis(x, part, axis=1) for x in (both_n, both_d, both_x))
        order = np.argsort(both_d, axis=1, kind="stable")
        nodes[live] = np.take_along_axis(both_n, order, axis=1)
        far[live] = np.take_along_axis(both_d, order, axis=1)
        done[live] = np.take_along_axis(both_x, order, axis=1) | ~np.isfinite(far[live])
    return nodes, far


def pruned(points: np.ndarray, lengths: np.ndarray, owners: np.ndarray, near: np.ndarray) -> np.ndarray:
    """At most ``DEGREE`` diverse edges for each owner from its row of candidates (-1: none)."""
    near = np.where(near == owners[:, None], -1, near)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    own = points[owners]
    d = distances(points, lengths, near, own) + lengths[owners][:, None]
    order = np.argsort(d, axis=1, kind="stable")
    near, d = np.take_along_axis(near, order, axis=1), np.take_along_axis(d, order, axis=1)
    width = int((near >= 0).sum(axis=1).max(initial=0))
    near, d = near[:, :width], np.maximum(d[:, :width], 0)
    x = points[near]
    between = lengths[near][:, :, None] + lengths[near][:, None, :] - 2 * np.einsum("oad,obd->oab", x, x, optimize=True)
    alive = near >= 0
    out = np.full((len(owners), DEGREE), -1, dtype=np.int64)
    rows = np.arange(len(owners))
    for k in range(min(DEGREE, width)):
        some = alive.any(axis=1)
        if not some.any():
            break
        first = alive.argmax(axis=1)
        out[some, k] = near[rows[some], first[some]]
        alive &= ALPHA**2 * between[rows, first] > d
        alive[rows, first] = False
    return out


def build(points: np.ndarray) -> tuple[np.ndarray, int]:
    """Out-edges (-1: none) of distinct points and the entry node; grown in batches."""
    n = len(points)
    lengths = (points**2).sum(axis=1)
    edges = np.full((n, DEGREE), -1, dtype=np.int64)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(17).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        batch = order[at : at + min(BATCH, max(1, at))]
        at += len(batch)
        near, _ = beam_search(points, lengths, edges, entry, points[batch], BUILD_BEAM)
        edges[batch] = pruned(points, lengths, batch, near)
        # back edges: free places are filled, full nodes are pruned again
        source = np.repeat(batch, DEGREE)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, heads, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), int(count.max(initial=0))), -1, dtype=np.int64)
        wide[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(heads, count)] = source
        merged = np.concatenate([edges[nodes], wide], axis=1)
        size = (merged >= 0).sum(axis=1)
        fits = size <= DEGREE
        if fits.any():
            left = -np.sort(-merged[fits], axis=1)[:, :DEGREE]
            edges[nodes[fits]] = np.pad(left, ((0, 0), (0, DEGREE - left.shape[1])), constant_values=-1)
        over = np.flatnonzero(~fits)
        for i in range(0, len(over), BATCH):
            part = over[i : i + BATCH]
            edges[nodes[part]] = pruned(points, lengths, nodes[part], merged[part])
    return edges, entry


def bands_of(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each vector, 0 the longest, and the lengths."""
    length = np.sqrt((vectors / np.abs(vectors).max()) ** 2 @ np.ones(vectors.shape[1])) * np.abs(vectors).max()
    step = np.floor(np.log(length.max() / length) / np.log(BAND) + 1e-9).astype(np.int64)
    return np.unique(step, return_inverse=True)[1], length


def stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.frombuffer(b.as_buffer(), dtype="<f8") for b in column.combine_chunks()])


NODES = "width int, shard long, node long, band int, entry boolean, vector binary, edges binary, members array<long>"


def indexer(rows: pa.Table) -> pa.Table:
    """Task function over one shard: its graphs as a row per distinct vector, longest bands first, with the keys
    that have it. Edges are places in the band."""
    keys = rows.column("key").to_numpy()
    distinct, node_of = np.unique(stacked(rows.column("vector")), axis=0, return_inverse=True)
    band, length = bands_of(distinct)
    by = np.argsort(band, kind="stable")
    place = np.empty(len(by), dtype=np.int64)
    place[by] = np.arange(len(by))
    distinct, band, length, node_of = distinct[by], band[by], length[by], place[node_of.ravel()]
    n = len(distinct)
    edges, entry = np.full((n, DEGREE), -1, dtype=np.int64), np.zeros(n, dtype=bool)
    for low, high in ranges(band):
        own, first = build((distinct[low:high] / length[low:high, None]).astype(np.float32))
        edges[low:high], entry[low + first] = own, True
    order = np.lexsort((keys, node_of))
    heads = np.searchsorted(node_of[order], np.arange(n + 1))
    return pa.table(
        {
            "width": pa.array(np.full(n, rows.column("width")[0].as_py(), dtype=np.int32)),
            "shard": pa.array(np.full(n, rows.column("shard")[0].as_py())), "node": pa.array(np.arange(n)),
            "band": pa.array(band.astype(np.int32)), "entry": pa.array(entry), "vector": pa.array([v.tobytes() for v in distinct], pa.binary()),
            "edges": pa.array([e.astype("<i4").tobytes() for e in edges], pa.binary()),
            "members": pa.ListArray.from_arrays(pa.array(heads.astype(np.int32)), pa.array(keys[order])),
        }
    )


def ranges(band: np.ndarray) -> list[tuple[int, int]]:
    """Where each band begins and ends."""
    heads = [*np.flatnonzero(np.diff(band, prepend=-1)).tolist(), len(band)]
    return list(zip(heads, heads[1:]))


class Index:
    """The graphs of a shard, from its rows in order."""

    def __init__(self, rows: pa.Table) -> None:
        self.vectors = stacked(rows.column("vector"))
        self.members = rows.column("members").combine_chunks()
        edges = np.stack([np.frombuffer(b.as_buffer(), dtype="<i4") for b in rows.column("edges").combine_chunks()]).astype(np.int64)
        entry = rows.column("entry").to_numpy()
        largest = np.abs(self.vectors).max()
        length = np.sqrt(((self.vectors / largest) ** 2).sum(axis=1)) * largest
        self.bands = []
        for low, high in ranges(rows.column("band").to_numpy()):
            longest = length[low:high].max()
            self.bands.append((low, high, longest, (self.vectors[low:high] / longest).astype(np.float32), edges[low:high], int(entry[low:high].argmax())))

    def near(self, queries: np.ndarray, top: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best nodes found for each query and their exact inner products, best first (-1: none)."""
        largest = np.abs(queries).max(axis=1)
        size = np.sqrt(((queries / largest[:, None]) ** 2).sum(axis=1)) * largest
        flat = (queries / size[:, None]).astype(np.float32)
        nodes, scores = np.full((len(queries), top + 1), -1, dtype=np.int64), np.full((len(queries), top + 1), -np.inf)
        for low, high, longest, points, edges, entry in self.bands:
            # what is at most as long as this band reaches no more than its length times the query's
            live = np.flatnonzero(scores[:, -1] < longest * size * (1 + 1e-9))
            step = max(16, (1 << 25) // (high - low))
            for i in range(0, len(live), step):
                own = live[i : i + step]
                found, _ = beam_search(points, np.zeros(len(points), np.float32), edges, entry, flat[own], min(beam, high - low))
                there = found >= 0
                exact = np.where(there, np.einsum("qkd,qd->qk", self.vectors[low + np.maximum(found, 0)], queries[own]), -np.inf)
                both_n = np.concatenate([nodes[own], np.where(there, found + low, -1)], axis=1)
                both_s = np.concatenate([scores[own], exact], axis=1)
                order = np.argsort(-both_s, axis=1, kind="stable")[:, : top + 1]
                nodes[own], scores[own] = np.take_along_axis(both_n, order, axis=1), np.take_along_axis(both_s, order, axis=1)
        return nodes, scores

    def answers(self, ids: np.ndarray, queries: np.ndarray, top: int, beam: int) -> pa.RecordBatch:
        """(query, key, score) of the nearest rows found."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        nodes, _ = self.near(queries, top, beam)
        for r, q in enumerate(queries):
            own = nodes[r][nodes[r] >= 0]
            score = (self.vectors[own] * q).sum(axis=1)
            keys, scores, had, last = [np.zeros(0, np.int64)], [np.zeros(0)], 0, np.inf
            for b in np.argsort(-score, kind="stable"):
                if had > top and score[b] < last:
                    break
                # of equal vectors no more than the first ``top`` and the query's own can be needed
                some = self.members[int(own[b])].values.to_numpy()[: top + 1]
                keys.append(some)
                scores.append(np.full(len(some), score[b]))
                had, last = had + len(some), score[b]
            k, s = np.concatenate(keys), np.concatenate(scores)
            k, s = k[k != ids[r]], s[k != ids[r]]
            order = np.lexsort((k, -s))[:top]
            found.append((np.full(len(order), ids[r]), k[order], s[order]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2])], names=["query", "key", "score"])


def searcher(top: int, beam: int):
    """Task function over shards one after the other, the nodes of each before its queries: (query, key, score)."""

    def search(batches):
        place, held, index = None, [], None
        for batch in batches:
            at = 0
            width, shard, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "shard", "asks"))
            fresh = np.flatnonzero((np.diff(width) != 0) | (np.diff(shard) != 0) | (np.diff(asks.astype(int)) != 0)) + 1
            for end in [*fresh.tolist(), len(batch)]:
                part = batch.slice(at, end - at)
                now = (int(width[at]), int(shard[at]))
                if now != place:
                    place, held, index = now, [], None
                if not asks[at]:
                    held.append(part)
                else:
                    if held:
                        index, held = Index(pa.Table.from_batches(held)), []
                    if index is not None:
                        ids = part.column("node").to_numpy()
                        queries = stacked(pa.chunked_array([part.column("vector")]))
                        for i in range(0, len(ids), BATCH):
                            yield index.answers(ids[i : i + BATCH], queries[i : i + BATCH], top, beam)
                at = end

    return search


def vector_bytes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector) with vectors as bytes of doubles; rows that take no part are gone.

    Left out are NULL keys, NULL, empty and zero vectors, and those holding a NULL or non-finite component.
    """
    usable = (
        F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(vector, lambda x: x != 0)
    )

    def packed(batches):
        for batch in batches:
            lists = batch.column("vector")
            out = [np.asarray(x.values, dtype="<f8").tobytes() for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.binary())], names=["key", "vector"])

    picked = rows.filter(usable).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return picked.mapInArrow(packed, "key long, vector binary")


def nearest(
    rows: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", top: int = 20, beam: int = 96, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``top`` nearest rows found for each query row: query_id, rank, key, score (exact inner product).

    All rows but the query's own are candidates; ties go to the smaller key. Vectors may have any lengths: long ones are found
    in bands of their own. Those of another number of components than the most common are compared in shards of
    their own. Rows that repeat a key are one candidate (with the nearest of its vectors) and one query; what
    ``vector_bytes`` leaves out takes no part.
    """
    every = vector_bytes(rows, key, vector)
    asked = vector_bytes(rows.filter(is_query), key, vector)
    size = every.withColumn("width", F.length("vector")).groupBy("width").agg(F.count(F.lit(1)).alias("n"))
    # shards of the root of ``shard_rows`` times the rows: as the table grows, both their number and their rows do
    held = F.least(F.lit(float(MOST_ROWS)), F.greatest(F.lit(float(shard_rows)), F.sqrt(F.col("n") * float(shard_rows))))
    plan = size.select("width", F.ceil(F.col("n") / held).cast("long").alias("shards"))
    plan = F.broadcast(written(plan, "neighbour-plan"))  # a row for each number of components
    dealt = every.withColumn("width", F.length("vector")).join(plan, "width").select(
        "width", F.pmod(F.xxhash64("key", F.lit(3)), F.col("shards")).alias("shard"), "key", "vector"
    )
    graphs = written(dealt.groupBy("width", "shard").applyInArrow(indexer, NODES), "neighbour-graphs")
    queries = asked.withColumn("width", F.length("vector")).join(plan, "width").select(
        "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.col("key").alias("node"), F.lit(None).cast("int").alias("band"),
        F.lit(None).cast("boolean").alias("entry"), "vector", F.lit(None).cast("binary").alias("edges"), F.lit(None).cast("array<long>").alias("members"), F.lit(True).alias("asks"),
    )
    met = graphs.withColumn("asks", F.lit(False)).unionByName(queries).repartition("width", "shard").sortWithinPartitions("width", "shard", "asks", "node")
    found = met.mapInArrow(searcher(top, beam), "query long, key long, score double")
    found = found.groupBy("query", "key").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "key")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("query").alias("query_id"), "rank", F.col("key").alias(key), "score")
