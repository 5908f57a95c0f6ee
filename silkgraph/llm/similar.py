"""N-gram Jaccard join by MinHash banding.

1. One pass signs every text: the fingerprint of its set of word n-grams and one hash per band. Bands and
   rows are chosen for the wanted recall at the wanted similarity.
2. Texts with the same set form a class; only its representative goes on.
3. Representatives are shuffled on band hashes; those that meet in a bucket are candidates. Buckets are
   joined to clusters of candidates, so that a pair is compared once, whatever the number of its buckets.
4. The members of a cluster are dealt into chunks of bounded rows and n-grams; one task compares two chunks
   on the full n-gram sets, by one product of sparse rows, and returns for each member its number of links
   and the smallest member that it is tied to. No pair is ever a row.

A cluster that has grown past ``whole`` members by chance links is compared bucket by bucket instead; a
pair then counts in the first bucket that both share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .shared import written
from .tokens import mixed, shingles, slices, words

CHUNK_ROWS = 256
CHUNK_GRAMS = 1_000_000
STEP = 1 << 15


def banding(similarity: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Number of bands and rows: as many rows as ``most`` hashes allow while a pair of just
    ``similarity`` still meets in a band with probability ``recall``."""
    for rows in range(16, 0, -1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding within that number of hashes")


def gram_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per slice: distinct n-gram hashes, sorted by row, and for each row its first (with the end last)."""
    for _, _, raw, at in slices(texts):
        h, _, first = words(raw, at)
        gram, row = shingles(h, first, size)
        order = np.lexsort((gram, row))
        gram, row = gram[order], row[order]
        fresh = np.ones(len(gram), dtype=bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
        gram, row = gram[fresh], row[fresh]
        yield gram, np.searchsorted(row, np.arange(len(at)))


def signer(size: int, bands: int, rows: int):
    """Task function: (key, text_hash, text) to (key, text_hash, grams, fp, bands)."""
    factors = np.random.default_rng(11).integers(1, 1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, prints, keys = [], [], []
            for gram, first in gram_sets(batch.column("text"), size):
                count = np.diff(first)
                some = np.flatnonzero(count)
                n = len(count)
                key = np.zeros((n, bands), dtype=np.uint64)
                total = np.zeros(n, dtype=np.uint64)
                if len(some):
                    heads = first[:-1][some]
                    total[some] = np.add.reduceat(mixed(gram), heads)
                    least = np.full((bands * rows, len(some)), np.uint64(0xFFFFFFFFFFFFFFFF))
                    # by steps that stay in the processor's cache; a row may reach over several steps
                    for low in range(0, len(gram), STEP):
                        high = min(low + STEP, len(gram))
                        a = int(np.searchsorted(heads, low, side="right")) - 1
                        b = int(np.searchsorted(heads, high, side="left"))
                        cut = np.maximum(heads[a:b], low) - low
                        part = gram[low:high]
                        for k in range(bands * rows):
                            np.minimum(least[k, a:b], np.minimum.reduceat(part * factors[k], cut), out=least[k, a:b])
                    for band in range(bands):
                        h = np.full(len(some), np.uint64(band + 1))
                        for k in range(band * rows, (band + 1) * rows):
                            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[k])
                        key[some, band] = h
                counts.append(count)
                prints.append(mixed(total + count.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
                keys.append(key)
            if not counts:
                continue
            flat = np.concatenate(keys).view(np.int64)
            places = pa.array(np.arange(0, flat.size + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("text_hash"), pa.array(np.concatenate(counts).astype(np.int32)),
                    pa.array(np.concatenate(prints).view(np.int64)), pa.ListArray.from_arrays(places, pa.array(flat.reshape(-1))),
                ],
                names=["key", "text_hash", "grams", "fp", "bands"],
            )

    return sign


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common n-grams of every two sets, by blocks of n-grams that occur more than once."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    fresh = np.ones(len(gram), dtype=bool)
    fresh[1:] = gram[1:] != gram[:-1]
    number = np.cumsum(fresh) - 1
    many = np.bincount(number) > 1
    kept = many[number]
    owner, number = owner[kept], (np.cumsum(many) - 1)[number[kept]]
    width = 4096
    for low in range(0, int(many.sum()), width):
        a, b = np.searchsorted(number, [low, low + width])
        block = np.zeros((n, width), dtype=np.float32)
        block[owner[a:b], number[a:b] - low] = 1
        out += block @ block.T
    return out


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component over few indexes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def comparer(similarity: float):
    """Task function over one pair of chunks: links of each member and its smallest tied member."""

    def compare(table: pa.Table) -> pa.Table:
        fp, keep = np.unique(table.column("fp").to_numpy(), return_index=True)
        chunk = table.column("chunk").to_numpy()[keep]
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        copies = table.column("copies").to_numpy()[keep].astype(np.float64)
        blobs = table.column("grams").combine_chunks()
        sets = [np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint64) for i in keep]
        n = len(sets)
        size = np.array([len(s) for s in sets], dtype=np.float64)
        if n == 2:
            common = np.zeros((2, 2))
            common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        else:
            common = overlaps(sets)
        linked = common >= similarity * (size[:, None] + size[None, :] - common) - 1e-9
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= chunk[:, None] != chunk[None, :]
        buckets = table.column("bands").combine_chunks()
        if buckets.null_count == 0:  # bucket by bucket: only in the first bucket that both share
            here = table.column("bucket")[0].as_py()
            own = np.stack([buckets[int(i)].values.to_numpy() for i in keep])
            for i, j in zip(*np.nonzero(linked), strict=True):
                first = own[i][(own[i] == own[j]).argmax()]
                linked[i, j] = first == here
        a, b = np.nonzero(linked)
        root = roots(n, a, b)
        some = np.flatnonzero(linked.any(axis=1))
        return pa.table(
            {
                "fp": pa.array(fp[some]), "tied": pa.array(fp[root[some]]),
                "texts": pa.array(linked[some].sum(axis=1).astype(np.int64)),
                "rows": pa.array((linked[some] @ copies).astype(np.int64)),
            }
        )

    return compare


def similarity_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8,
    recall: float = 0.9999, whole: int = 20_000,
) -> DataFrame:
    """One row per row of ``docs``: key, text_hash, class_id, copy_of, n_links, n_texts, fp.

    ``class_id`` is the smallest key of all documents tied by a chain of links (two n-gram sets of Jaccard
    similarity ``similarity`` or more); ``copy_of`` the smallest key with the same n-gram set; ``n_links`` the
    number of other rows linked directly, copies included; ``n_texts`` that of other n-gram sets linked.

    Words are what stands between ASCII blanks, A-Z lower-cased; a text of fewer words than ``size`` has
    one n-gram of all its words. NULL and blank texts have no n-grams: each is its own class without
    links. Rows that repeat a key and text are copies of each other. A NULL key takes part; it is the
    class id only if all keys of the class are NULL. Sets are known by 64-bit hashes of sets and n-grams.
    """
    bands, rows = banding(similarity, recall)
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    signed = written(
        source.mapInArrow(signer(size, bands, rows), f"key {kind}, text_hash long, grams int, fp long, bands array<long>"),
        "similar-signed",
    )
    classes = written(
        signed.filter("grams > 0").groupBy("fp").agg(
            F.min("key").alias("copy_of"), F.min(F.struct("key", "text_hash")).alias("at"),
            F.count(F.lit(1)).alias("copies"), F.first("grams").alias("size"), F.first("bands").alias("bands"),
        ),
        "similar-classes",
    )
    met = classes.select("fp", F.explode("bands").alias("bucket"))
    buckets = met.groupBy("bucket").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).filter("least < most")
    candidates = met.join(buckets.drop("most"), "bucket").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    clusters = written(
        components(candidates, "similar-candidates").join(classes.withColumnRenamed("fp", "node"), "node"), "similar-clusters"
    )
    extent = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("grams"))
    sized = clusters.join(extent, "root")
    by_cluster = sized.filter(F.col("members") <= whole).select(
        F.col("node").alias("fp"), "at", "copies", F.col("root").alias("bucket"), "members", F.col("grams").alias("total"),
        F.lit(None).cast("array<long>").alias("bands"),
    )
    loose = sized.filter(F.col("members") > whole).select(F.col("node").alias("fp"), "at", "copies", "size", "bands", F.explode("bands").alias("bucket"))
    full = loose.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total")).filter("members > 1")
    by_bucket = loose.join(full, "bucket").select("fp", "at", "copies", "bucket", "members", "total", "bands")
    groups = by_cluster.unionByName(by_bucket)
    groups = groups.withColumn(
        "chunks", F.ceil(F.greatest(F.col("members") / CHUNK_ROWS, F.col("total") / CHUNK_GRAMS)).cast("int")
    ).withColumn("chunk", F.pmod(F.xxhash64("fp", F.lit(9)), F.col("chunks")).cast("int"))
    homes = groups.groupBy("fp").agg(
        F.first("at").alias("at"), F.first("copies").alias("copies"),
        F.collect_list(F.struct("bucket", "chunk", "chunks", "bands")).alias("homes"),  # one, or one per band at most
    )
    texts = source.join(homes, (F.col("key").eqNullSafe(F.col("at.key"))) & (F.col("text_hash") == F.col("at.text_hash")))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [gram[first[i] : first[i + 1]].tobytes() for gram, first in gram_sets(batch.column("text"), size) for i in range(len(first) - 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("copies"), pa.array(sets, pa.binary()), batch.column("homes")],
                names=["fp", "copies", "grams", "homes"],
            )

    home = "array<struct<bucket:long,chunk:int,chunks:int,bands:array<long>>>"
    tiles = (
        texts.select("text", "fp", "copies", "homes")
        .mapInArrow(gather, f"fp long, copies long, grams binary, homes {home}")
        .select("fp", "copies", "grams", F.explode("homes").alias("h"))
        .select("fp", "copies", "grams", "h.*")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
        .select("bucket", "low", "high", "chunk", "fp", "copies", "grams", "bands")
    )
    links = written(
        tiles.groupBy("bucket", "low", "high").applyInArrow(comparer(similarity), "fp long, tied long, texts long, rows long"),
        "similar-links",
    )
    tied = components(links.select(F.col("fp").alias("u"), F.col("tied").alias("v")), "similar-components")
    counts = links.groupBy("fp").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    known = classes.select("fp", "copy_of", "copies").join(tied.withColumnRenamed("node", "fp"), "fp", "left").join(counts, "fp", "left")
    known = known.withColumn("root", F.coalesce("root", "fp"))
    least = known.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    known = known.join(least, "root").select(
        "fp", "class_id", "copy_of", (F.col("copies") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts")
    )
    return signed.select("key", "text_hash", "fp", "grams").join(known, "fp", "left").select(
        F.col("key").alias(key), "text_hash", F.when(F.col("grams") > 0, F.col("class_id")).otherwise(F.col("key")).alias("class_id"),
        F.when(F.col("grams") > 0, F.col("copy_of")).otherwise(F.col("key")).alias("copy_of"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.when(F.col("grams") > 0, F.col("fp")).alias("fp"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Rows of ``docs`` that stay when one row of each class of near duplicates is kept: that with the
    smallest key (the smallest text hash, if keys repeat). All blank texts and all rows without n-grams stay."""
    classes = written(similarity_classes(docs, key, text, **settings), "similar-rows")
    classes = classes.select(F.col(key).alias("key"), "text_hash", "class_id", "n_links")
    mark = F.struct("key", "text_hash")
    tied = classes.filter(F.col("n_links") > 0)
    first = tied.groupBy("class_id").agg(F.min(mark).alias("first")).withColumnRenamed("class_id", "id")
    keyed = tied.groupBy("class_id", "key", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
    keyed = keyed.join(first, keyed["class_id"].eqNullSafe(first["id"])).select(
        "key", "text_hash", "rows", (F.col("key").eqNullSafe(F.col("first.key")) & (F.col("text_hash") == F.col("first.text_hash"))).alias("stays")
    )
    # the row stands in a struct of its own, so that no column of it can clash with those used here
    out = docs.select(F.struct("*").alias("own")).withColumn("hash", F.xxhash64(F.coalesce(F.col("own")[text], F.lit(""))))
    same = F.col("own")[key].eqNullSafe(F.col("key")) & (F.col("hash") == F.col("text_hash"))
    kept = out.join(keyed.filter(~F.col("stays") | (F.col("rows") > 1)), same, "left_anti")
    # rows that repeat key and text: few, and only they are compared as a whole
    again = out.join(keyed.filter(F.col("stays") & (F.col("rows") > 1)), same, "left_semi")
    again = again.withColumn("key", F.col("own")[key]).dropDuplicates(["key", "hash"])
    return kept.select("own.*").unionByName(again.select("own.*"))
