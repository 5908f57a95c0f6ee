"""Operators over sets of rows: neighbours, similar texts, mixtures, and the pipeline."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from silkgraph.llm import mixing, neighbours, similar, stages
from silkgraph.llm.graph import components
from silkgraph.llm.queries import ORACLES, QUERIES
from silkgraph.llm.shared import table

from .conftest import SMALL


def brute_neighbours(rows, top):
    """rows: (key, vector or None). By definition, in double precision."""
    fine = [(k, np.array(v, dtype=float)) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for k, v in fine:
        if k % 20 == 0:
            near = sorted((-float((v * x).sum()), o) for o, x in fine if o != k)
            out[k] = [(o, -s) for s, o in near[:top]]
    return out


LENGTHS = {
    "as given": lambda rng, n: np.ones(n),
    "sigma 0.3": lambda rng, n: np.exp(0.3 * rng.standard_normal(n)),
    "sigma 0.7": lambda rng, n: np.exp(0.7 * rng.standard_normal(n)),
    "sigma 1.5": lambda rng, n: np.exp(1.5 * rng.standard_normal(n)),
    "one long": lambda rng, n: np.where(np.arange(n) == 77, 1e4, 1.0),
}


@pytest.mark.parametrize(("shard", "lengths"), [(8192, "as given"), (300, "as given"), (300, "sigma 0.3"), (8192, "sigma 0.7"), (8192, "sigma 1.5"), (300, "one long")])
def test_neighbours_reach_their_recall(spark, shard, lengths):
    given = table(spark, "/root/testdata/sf0.1", "embeddings").select("vec_id", "embedding").collect()
    scale = LENGTHS[lengths](np.random.default_rng(1), len(given))
    vectors = [(r["vec_id"], [x * s for x in r["embedding"]]) for r, s in zip(given, scale.tolist(), strict=True)]
    rows = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    want = brute_neighbours(vectors, 20)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(rows, F.col("vec_id") % 20 == 0, shard_rows=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert len(got[r["query_id"]]) == r["rank"]
    assert set(got) == set(want) and all(len(x) == 20 for x in got.values())
    recalls = [len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / 20 for q in want]
    assert np.mean(recalls) > 0.95 and min(recalls) >= 0.8
    for q in got:
        exact = dict(want[q])
        assert all(s == pytest.approx(exact[k], rel=1e-12, abs=1e-12) for k, s in got[q] if k in exact)


def test_neighbours_of_odd_vectors_and_copies(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(100, [0.5, 0.5]), (101, None), (102, [0.0, 0.0]), (103, [None, 1.0]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (106, []), (None, [1.0, 1.0]), (107, [3.0, -1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("key", F.lit("own"))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, shard_rows=16).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert dict(got) == brute_neighbours(rows, 20)
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.nearest(frame.filter("vec_id in (20, 100)"), F.col("vec_id") == 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(20, 1, 100)]


def brute_classes(rows, size=5, least=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        grams = {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()
        sets.append(grams)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    texts = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                if sets[i] != sets[j]:
                    texts[i].add(frozenset(sets[j]))
                    texts[j].add(frozenset(sets[i]))
                root[find(i)] = find(j)
    least_key = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least_key[find(i)] = min(key, least_key.get(find(i), key))
    return collections.Counter((rows[i][0], least_key.get(find(i)), links[i], len(texts[i])) for i in range(len(rows)))


def near_copies(n, seed=3):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 400, 90)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 90))] = f"new{int(rng.integers(0, 30))}"
        out.append((1000 + k, " ".join(words)))
    return out


@pytest.mark.parametrize("whole", [20_000, 1])
def test_similar_classes_equal_all_pairs(spark, odd, whole, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_ROWS", 16)  # several chunks for the large group
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()] + near_copies(70)
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if not r["text"] or len(r["text"]) < 1000]
    got = similar.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string"), whole=whole).collect()
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"], r["n_texts"]) for r in got) == brute_classes(rows)


def test_banding_reaches_its_recall():
    bands, rows = similar.banding(0.8, 0.9999)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999


def test_one_of_each_class_stays(spark, odd):
    docs = odd.unionByName(odd.limit(0)).unionByName(odd.filter("doc_id = 9"))
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    keys = collections.Counter(r["doc_id"] for r in kept.collect())
    assert keys[1] == 1 and keys[2] == 0 and keys[3] == 1 and keys[9] == 1 and keys[None] == 2 and keys[6] == 1 and keys[7] == 1
    assert similar.one_of_each(odd.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(-5, 200), (200, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, -5: -5, 200: -5}


def brute_mixture(rows, entropy_share, most, ratio, block_tokens):
    """rows: (key, source, tokens). Selection by its definition, with a plain bisection."""
    import hashlib
    import math

    def unit(*parts):
        text = ":".join("-" if p is None else str(p) for p in parts)
        return int(hashlib.md5(text.encode()).hexdigest()[:12], 16) / 2**48

    total = collections.Counter()
    for _, s, t in rows:
        total[s] += t
    corpus = sum(total.values())
    share = {s: t / corpus for s, t in total.items() if t}

    def weights(x):
        z = sum(p**x for p in share.values())
        return {s: p**x / z for s, p in share.items()}

    def entropy(x):
        return -sum(w * math.log(w) for w in weights(x).values())

    def passes(x):
        return max(w * ratio / share[s] for s, w in weights(x).items())

    def bisect(low, high, enough):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        return high

    x = bisect(1.0, 0.0, lambda v: entropy(v) >= entropy(1) + entropy_share * (entropy(0) - entropy(1)))
    if passes(x) > most:
        x = bisect(x, 1.0, lambda v: passes(v) <= most)
    out = collections.Counter()
    for s in total:
        own = [(k, t, unit(None if k is None else k)) for k, s2, t in rows if s2 == s]
        if s not in share:
            out.update((k, s, 0) for k, _, _ in own)
            continue
        quota = weights(x)[s] * ratio * corpus
        full = math.floor(quota / total[s] + 1e-9)
        rest = max(0.0, quota - full * total[s])
        blocks = max(1, math.ceil(total[s] / block_tokens))
        order = sorted({int(u * blocks) for _, _, u in own}, key=lambda b: (unit(s, full, b), b))
        done, taken = 0, []
        for b in order:
            for u in sorted({u for _, _, u in own if int(u * blocks) == b}):
                if done < rest:
                    taken.append(u)
                    done += sum(t for _, t, v in own if v == u)
        for k, _, u in own:
            out.update((k, s, e) for e in range(full + (u in taken)))
    return out


@pytest.mark.parametrize(("entropy_share", "most", "ratio"), [(0.5, 4.0, 1.0), (1.0, 1.5, 1.0), (0.8, 9.0, 0.4)])
def test_mixture_equals_its_definition(spark, entropy_share, most, ratio):
    rng = np.random.default_rng(4)
    rows = [(int(i), ["big", "mid", "small", None][min(3, int(rng.integers(0, 12)) // 4 if i % 3 else 0)], "w " * int(rng.integers(1, 40))) for i in range(400)]
    rows += [(900 + i, "rare", "w " * 9) for i in range(7)] + [(950, "void", ""), (951, "void", None), (None, "big", "w w"), (5, "big", "w w w")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_epoch", F.lit("own"))
    got = mixing.mixture(frame, entropy_share=entropy_share, most_passes=most, ratio=ratio, block_tokens=200)
    counted = [(k, s, len((t or "").split())) for k, s, t in rows]
    have = collections.Counter((r["doc_id"], r["source"], r["mix_epoch"]) for r in got.collect())
    assert have == brute_mixture(counted, entropy_share, most, ratio, 200)
    assert got.filter("mix_position < 0 or mix_position >= 1").count() == 0


def test_the_exponent_takes_few_jobs(spark):
    """The same as a plain bisection, by steps that are few: each plan and its tasks lie in the driver's memory."""
    sizes = [7**i + i for i in range(7)]
    sources = stages.written(spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, total long"), "test")
    sc = spark.sparkContext
    sc.setJobGroup("exponent", "exponent")
    try:
        power, norm = mixing.exponent(sources, "total", 0.5, 4.0, 1.0)
        jobs = len(sc.statusTracker().getJobIdsForGroup("exponent"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    share = np.array(sizes) / sum(sizes)

    def entropy(x):
        w = share**x / (share**x).sum()
        return -(w * np.log(w)).sum()

    def bisect(low, high, enough):
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (low, mid) if enough(mid) else (mid, high)
        return high

    even = bisect(1.0, 0.0, lambda x: entropy(x) >= (entropy(1) + entropy(0)) / 2)
    high = bisect(even, 1.0, lambda x: (share ** (x - 1)).max() <= 4 * (share**x).sum())
    assert power == pytest.approx(high, abs=2e-9) and norm == pytest.approx((share**power).sum(), rel=1e-9)
    assert jobs <= 30


def test_mixture_of_odd_tables(spark, odd):
    assert set(odd.columns) <= set(mixing.mixture(odd).columns)
    assert mixing.mixture(odd.limit(0)).count() == 0
    assert mixing.mixture(odd.filter("text is null")).count() == 2


def test_pipeline_stages(spark, odd):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near-duplicates", "decontamination", "mixing"]
    docs = table(spark, SMALL, "documents")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns
        docs = stages.written(after, "test")
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    wide = odd.withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert set(wide.columns) <= set(stage(spark, wide, SMALL).columns)
        assert stage(spark, wide.limit(0), SMALL).count() == 0


def test_pipeline_run_equals_its_stages_by_hand(spark):
    """All rows of the run: the classifiers' own stages, then classes, passages and the mixture by definition."""
    out = corpus_pipeline.run(spark, SMALL)
    docs = table(spark, SMALL, "documents")
    kept = stages.toxicity_stage(spark, stages.written(stages.quality_stage(spark, docs, SMALL), "hand"), SMALL)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in kept.collect()]
    root = {key: least for key, least, _, _ in brute_classes([(k, t) for k, t, _ in rows])}
    items = [" ".join(r["text"].lower().split()) for r in table(spark, SMALL, "benchmark").collect()]
    left = [(k, s, len(t.split())) for k, t, s in rows if root[k] == k and not any(i in " ".join(t.lower().split()) for i in items)]
    assert 0 < len(left) < len(rows) < docs.count()
    have = collections.Counter((r["doc_id"], r["source"], r["mix_epoch"]) for r in out.collect())
    assert have == brute_mixture(left, 0.5, 4.0, 1.0, 1 << 16)


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
