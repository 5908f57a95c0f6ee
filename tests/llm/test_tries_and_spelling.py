"""SimHash components, the prefix trie of conversations and spelling variants, against their definitions."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from silkgraph.llm import prefix_trie, simhash, spelling
from silkgraph.llm.queries import QUERIES
from silkgraph.llm.shared import fold, table

from .conftest import SMALL


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(key, brute_print(text)) for key, text in rows]
    distinct = sorted({p for _, p in prints})
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    least = {}
    for key, p in prints:
        if key is not None:
            least[find(p)] = min(key, least.get(find(p), key))
    return collections.Counter((key, f"{p:016x}", least.get(find(p))) for key, p in prints)


def found_components(docs, **how):
    return collections.Counter(tuple(r) for r in simhash.simhash_components(docs, **how).select("doc_id", "fingerprint", "component_id").collect())


@pytest.mark.parametrize("most", [8192, 2])
def test_simhash_components_equal_all_pairs(spark, odd, most):
    """With ``most`` = 2 nearly every node is opened in tables."""
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 500, 300)]
    for k in range(60):  # a group of near copies
        words = list(base)
        for at in rng.integers(0, 300, int(rng.integers(0, 3))):
            words[at] = f"x{k}"
        rows.append((5000 + k, " ".join(words)))
    rows += [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if not r["text"] or len(r["text"]) < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("own")).withColumn("least", F.lit(1))
    want = brute_components(rows)
    assert found_components(docs, most=most) == want
    assert max(collections.Counter(c for _, _, c in want).values()) > 20


def test_simhash_links_at_three_bits_and_not_at_four(spark):
    rng = np.random.default_rng(2)
    prints = [0, (1 << 64) - 1]
    for p in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        prints.append(p)
        for bits in (1, 2, 3, 4, 4):
            other = p
            for at in rng.choice(64, bits, replace=False).tolist():
                other ^= 1 << at
            prints.append(other)
    prints = sorted(set(prints))
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for p in prints:
        for q in prints:
            if p < q and (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    signed = np.array(prints, dtype=np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = collections.defaultdict(set)
    for p, s in zip(prints, signed, strict=True):
        want[find(p)].add(s)
    for most in (8192, 3):
        got = collections.defaultdict(set)
        for r in simhash.similar_prints(frame, most).collect():
            got[r["root"]].add(r["node"])
        assert {frozenset(x) for x in got.values()} == {frozenset(x) for x in want.values() if len(x) > 1}


def test_simhash_of_odd_tables(spark, odd):
    got = {(r["doc_id"], r["fingerprint"][:4]): r["component_id"] for r in simhash.simhash_components(odd).collect()}
    assert got[(3, "0000")] == got[(4, "0000")] == got[(5, "0000")] == got[(None, "0000")] == 3
    assert simhash.simhash_components(odd).count() == odd.count()
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    long = brute_print("word " * 150_000)
    assert {r["fingerprint"] for r in simhash.simhash_components(odd.filter("doc_id = 6")).collect()} == {f"{long:016x}"}


def test_bits_of_long_rows_are_counted_over_runs():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 254, 255, 256, 2000, 0, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    hashes = rng.integers(0, 1 << 63, int(first[-1]), dtype=np.uint64) * np.uint64(3)
    want = [[int((hashes[a:b] >> np.uint64(k) & np.uint64(1)).sum()) for k in range(64)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert simhash.bit_counts(hashes, first).tolist() == want


def brute_trie(rows, base=lambda c: c - c % 5, kept=lambda c: zlib.crc32(str(c).encode()) % 9):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            mark = hashlib.md5((str(len(role or "")) + ":" + (role or "") + (text or "")).encode()).digest()
            turns[conv].append((turn is not None, turn or 0, role or "", mark, text or ""))
    whole = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {c: ts if base(c) == c else whole.get(base(c), [])[: kept(c)] + ts[kept(c) :] for c, ts in whole.items()}
    members = collections.defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in members if p), {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        if p:
            leaves[p[:-1]] = leaves.get(p[:-1], 0) + leaves[p]
            saved[p[:-1]] = saved.get(p[:-1], 0) + saved[p]
    out = collections.Counter()
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(p))))
        above = min(members[p[:-1]]) if p else None
        out[(min(own), len(p), above, len(own), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(conversations, segment=256):
    turns = prefix_trie.written(prefix_trie.turn_rows(conversations), "test")
    conv = F.col("conv_id")
    nodes = prefix_trie.prefix_trie(*prefix_trie.forked(turns, conv - conv % 5, fold(conv, 9), 8), segment=segment)
    return collections.Counter(tuple(r) for r in nodes.select(COLUMNS).collect())


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_trie_of_copied_long_and_odd_conversations(spark, segment):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(60):  # few texts, so that many start alike
        rows += [(c, t, ["user", "bot"][t % 2], f"é{int(rng.integers(0, 2))}") for t in range(int(rng.integers(0, 12)))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(4)]
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(40)]
    rows += [(300, None, None, None), (300, None, None, None), (300, 1, "a", "b"), (300, 1, "a", "b"), (300, 1, "a", ""), (None, 0, "user", "x"), (301, 0, "", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("at", F.lit("own")).withColumn("id", F.lit(0))
    assert found_trie(frame, segment) == brute_trie(rows)


def test_trie_of_the_table_and_of_an_empty_one(spark):
    frame = table(spark, SMALL, "conversations")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in frame.collect()]
    got = collections.Counter(tuple(r) for r in QUERIES["op12_prefix_trie"](spark, SMALL).select(COLUMNS).collect())
    assert got == brute_trie(rows) and (rows and max(d for _, d, *_ in got) > 2)
    assert found_trie(frame.limit(0)) == collections.Counter()


def test_radix_nodes_grow_through_their_layouts():
    root = prefix_trie.Node()
    seen = set()
    for i in range(256):
        prefix_trie.insert(root, bytes([i * 7 % 256, 1, 2, 3]), i)
        seen.add(root.layout)
        if i % 50 == 0:
            assert root.child(i * 7 % 256).row == i and (i == 255 or root.child((i + 1) * 7 % 256) is None)
    assert seen == {4, 16, 48, 256}
    assert sorted((b, kid.row) for b, kid in root.children()) == sorted((i * 7 % 256, i) for i in range(256))
    prefix_trie.insert(root, bytes([0, 1, 9, 3]), 900)
    assert root.child(0).path == b"\x01" and root.child(0).child(9).row == 900 and root.child(0).child(2).row == 0


def brute_spelling(rows, least=7, seen=2, times=10):
    import re

    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= seen}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = set(), {}
    around = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and near(w, v)] for w in words}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


def found_spelling(docs, **how):
    rows = [tuple(r) for r in spelling.spelling_variants(docs, **how).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def variants():
    rng = np.random.default_rng(7)
    rows = []
    for i, word in enumerate(["aaaaaaaa", "Schönheit", "recommend", "occurrence", "ééééééé", "naïveté"]):
        rows.append((i, f"{word} " * 400))
        for k in range(30):
            at = int(rng.integers(0, len(word)))
            other = [word[:at] + word[at + 1 :], word[:at] + "xé"[k % 2] + word[at:], word[:at] + "q" + word[at + 1 :], word + "z"][k % 4]
            rows.append((100 + 30 * i + k, f"{other}, {other}! {other * 2}." * int(1 + rng.integers(0, 3) ** 3)))
    return rows


@pytest.mark.parametrize("most", [8192, 4])
def test_spelling_variants_equal_all_pairs(spark, odd, most):
    """With ``most`` = 4 the blocks are halved down to one open place."""
    rows = variants() + [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect() if not r["text"] or len(r["text"]) < 1000]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("own")).withColumn("n", F.lit(1))
    want = brute_spelling(rows)
    assert found_spelling(docs, most=most) == want
    assert sum(form is not None for _, form, *_ in want) > 20 and any(r not in (w, f) for w, f, r, *_ in want if f)


def test_spelling_blocks_hold_every_pair_once_and_stay_small(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}cdefgh", 2) for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"], "word string, n long")
    rows = spelling.blocks(words, most=100).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["h"]].append(r)
    assert max(map(len, groups.values())) <= 100
    pairs = collections.Counter()
    for own in groups.values():
        for a, b in spelling.near_pairs([r["word"] for r in own], np.zeros(len(own), int), *(np.array([r[c] for r in own]) for c in "lse")):
            pairs[frozenset((own[a]["word"], own[b]["word"]))] += 1
    assert set(pairs.values()) == {1} and len(pairs) == 256 * (7 + 7 + 3) // 2


def test_spelling_of_odd_tables(spark, odd):
    assert found_spelling(odd) == set() or all(n >= 2 for _, _, _, n, *_ in found_spelling(odd))
    assert found_spelling(odd.limit(0)) == set()
    assert found_spelling(odd.filter("text is null")) == set()
