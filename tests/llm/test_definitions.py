"""Classifiers against their definitions, in plain Python over plain numbers."""

import collections
import math

import numpy as np
import pytest

from silkgraph.llm import languages, quality, toxicity
from silkgraph.llm.shared import held_out, table
from silkgraph.llm.tokens import word_hash

from .conftest import SMALL


def plain_statistics(text):
    text = text or ""
    size = max(1, len(text))
    words = [w for w in text.translate({ord(c): " " for c in "\t\n\x0b\f\r"}).split(" ") if w]
    lines = [x for x in text.split("\n") if x]

    def share(letters):
        return sum(c in letters for c in text) / size

    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "word_length": size / max(1, len(words)),
        "distinct_words": len(set(words)) / max(1, len(words)), "distinct_lines": len(set(lines)) / max(1, len(lines)),
        "line_length": math.log1p(size / max(1, len(lines))), "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digits": share("0123456789"),
        "symbols": share("#$%&*+/<=>@[\\]^_{|}~"), "bangs": share("!?"), "stops": share(".,;:"), "blanks": share(" "),
    }


def test_quality_scores_by_definition(spark, odd):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rules = quality.learn(docs, table(spark, SMALL, "labels").filter(~held_out("doc_id", 5)))
    assert rules.weights
    for r in quality.score_quality(docs, rules).collect():
        stats = plain_statistics(r["text"])
        total = rules.constant
        for rule, weight in rules.weights:
            total += weight * all((stats[n] > v) if above else (stats[n] <= v) for n, above, v in rule)
        assert r["quality"] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)


def plain_grams(text):
    """Counts by kind of the 1- to 3-grams of a text's bytes; runs of other signs are one boundary, none at the start."""
    letters = []
    for c in text.encode().lower():
        other = c < 128 and not chr(c).isalpha()
        if not other:
            letters.append(c)
        elif letters and letters[-1] != 32:
            letters.append(32)
    mask, out = (1 << 32) - 1, collections.Counter()
    for i in range(len(letters)):
        h = letters[i] * 2654435761 & mask
        out[h >> 20] += 1
        for k in (1, 2):
            if i + k < len(letters):
                h = (h * 31 + letters[i + k] * 40503) * 2654435761 & mask
                out[h >> 20] += 1
    return out


def test_languages_by_definition(spark, odd):
    docs = table(spark, SMALL, "documents").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    model = languages.learn(docs.filter(~held_out("doc_id", 4, 2)), "text", "lang", "doc_id", bound=60)
    seen, checked = model.idf, 0
    for r in languages.identify_languages(docs, model).collect():
        if not r["text"] or len(r["text"]) > 5000 or not any(c.isalpha() for c in r["text"]):
            continue
        x = np.zeros(languages.BUCKETS)
        for kind, n in plain_grams(r["text"]).items():
            x[kind] = math.log1p(n) * seen[kind]
        near = model.vectors.astype(float) @ (x / np.linalg.norm(x))
        best = int(near.argmax())
        assert r["language"]["score"] == pytest.approx(near[best], abs=1e-5)
        assert r["language"]["lang"] == model.langs[best] or np.sort(near)[-1] - np.sort(near)[-2] < 1e-5
        checked += 1
    assert checked > 150


def plain_differences(toxic, clean):
    """What a word adds after another one: toxic minus ordinary log-probability, by the definition of the models."""
    sides = {1: toxic, 0: clean}
    pairs = {flag: collections.Counter(p for text in texts for p in {(a, b) for a, b in zip(["", *text], text)}) for flag, texts in sides.items()}
    vocabulary = sorted({w for c in pairs.values() for p in c for w in p})
    size = len(vocabulary)

    def off(counts):
        number = collections.Counter(counts)
        n1, n2, n3, n4 = (max(1.0, float(number[k])) for k in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        taken = [0, max(0, min(0.95, 1 - 2 * y * n2 / n1)), max(0, min(1.9, 2 - 3 * y * n3 / n2)), max(0, min(2.8, 3 - 4 * y * n4 / n3))]
        return [taken[min(int(c), 3)] for c in counts]

    def smoothed(counts, lower):
        discount, total = off(counts), max(sum(counts), 1.0)
        rest = max(sum(discount), 1e-6) / total
        return [(c - d) / total + rest * p for c, d, p in zip(counts, discount, lower)], rest

    follows = {f: collections.Counter(b for _, b in pairs[f]) for f in pairs}
    shared, shared_rest = smoothed([min(follows[1][w], follows[0][w]) for w in vocabulary], [1 / (size + 1)] * size)
    every = sorted(set(pairs[1]) | set(pairs[0]))
    context = {f: collections.Counter() for f in pairs}
    for f in pairs:
        for (a, _), n in pairs[f].items():
            context[f][a] += n
    used = [p for p in every if min(context[1][p[0]], context[0][p[0]]) >= toxicity.CUT and pairs[1][p] + pairs[0][p] >= toxicity.CUT]
    kinds = collections.Counter(a for a, _ in used)
    logs = {}
    for f in pairs:
        counts = collections.Counter()
        for (_, b), n in pairs[f].items():
            counts[b] += n
        word, rest = smoothed([counts[w] for w in vocabulary], shared)
        total = max(sum(counts.values()), 1.0)
        word = {w: (total * p + 0.5) / (total + 0.5 * (size + 1)) for w, p in zip(vocabulary, word)}
        unseen = (total * rest * shared_rest / (size + 1) + 0.5) / (total + 0.5 * (size + 1))
        discount = dict(zip(every, off([pairs[f][p] for p in every])))
        kept = collections.Counter()
        for p in used:
            kept[p[0]] += pairs[f][p] - discount[p]
        backoff = {a: max(1 - kept[a] / max(context[f][a], 1), 1e-4) for a in vocabulary}
        both = {}
        for a, b in used:
            n = max(context[f][a], 1)
            p = (pairs[f][a, b] - discount[a, b]) / n + backoff[a] * word[b]
            both[a, b] = (n * p + 0.5) / (n + 0.5 * kinds[a])
        for a in vocabulary:
            n = max(context[f][a], 1)
            backoff[a] *= n / (n + 0.5 * kinds[a])
        logs[f] = word, backoff, both, unseen

    def difference(a, b):
        if (a, b) in logs[1][2]:
            return math.log(logs[1][2][a, b] / logs[0][2][a, b])
        word = math.log(logs[1][0].get(b, logs[1][3]) / logs[0][0].get(b, logs[0][3]))
        return word + (math.log(logs[1][1][a] / logs[0][1][a]) if a in logs[1][1] else 0.0)

    return difference


def test_toxicity_models_take_little_of_the_driver():
    """Beside the counts, no more than two and a half times their bytes."""
    import tracemalloc

    r = np.random.default_rng(1)
    words = r.integers(-(2**63), 2**63 - 1, 10_000)
    a, b = (words[np.minimum(r.zipf(1.3, 100_000), len(words)) - 1] for _ in range(2))
    counts = {"toxic": r.integers(0, 2, len(a)), "a": a, "b": b, "n": r.integers(1, 9, len(a))}
    tracemalloc.start()
    try:
        toxicity.fitted(counts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2.5 * sum(x.nbytes for x in counts.values())


def test_toxicity_models_by_definition():
    """Bigrams, words and the shared backoff; texts of very unequal numbers on both sides."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(25)]
    toxic = [[words[i] for i in rng.integers(0, 18, 14)] + ["insult", "you"] for _ in range(40)]
    clean = [[words[i] for i in rng.integers(4, 25, 14)] + (["you", "insult"] if k % 9 == 0 else []) for k in range(150)]
    texts = pa.record_batch([pa.array([1] * len(toxic) + [0] * len(clean)), pa.array([" ".join(t) for t in toxic + clean])], ["toxic", "text"])
    counted = pa.Table.from_batches(list(toxicity._counted(iter([texts])))).group_by(["toxic", "a", "b"]).aggregate([("n", "sum")])
    model = toxicity.fitted({"toxic": counted["toxic"].to_numpy(), "a": counted["a"].to_numpy(), "b": counted["b"].to_numpy(), "n": counted["n_sum"].to_numpy()})
    difference = plain_differences(toxic, clean)
    assert len(model.pairs) > 10
    for text in (["w1", "insult", "you"], ["you", "insult", "never", "seen", "w20"], ["w5", "w6", "w7"], ["w24"]):
        h = np.array([word_hash(w) for w in text], dtype=np.uint64)
        got = toxicity.values_of(h, np.array([0, len(h)]), model)
        assert got.tolist() == pytest.approx([difference(a, b) for a, b in zip(["", *text], text)], abs=2e-4)
