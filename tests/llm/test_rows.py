"""Operators that judge single texts or URLs: brute force, held-out accuracy and odd rows."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from silkgraph.llm import decontaminate, languages, licenses, lm, quality, toxicity, url_filter
from silkgraph.llm.queries import QUERIES
from silkgraph.llm.shared import held_out, table
from silkgraph.llm.tokens import word_hash

from .conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def test_rules_fit_host_subdomains_and_path(spark):
    cases = [
        ("http://a.com/x", "a.com", "/x", "com/", "allow"), ("http://a.com", "a.com", "", None, None),
        ("https://WWW.Example.com/en/1?q", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/1#t", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"), ("x://net/es/", "net", "/es/", "net/es/", "block"),
        ("http://b.net/ES/", "b.net", "/ES/", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("http://a.com?u=://b.net/es/", "a.com", "", None, None), ("http://a.com/p://q/r", "a.com", "/p://q/r", "com/", "allow"),
        ("http://É.COM/\n/x", "É.com", "/\n/x", "com/", "allow"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    got = rows.select("page_id", host.alias("h"), path.alias("p"), url_filter.rule_of(host, path).alias("r")).collect()
    for r in got:
        assert (r["h"], r["p"], r["r"] and r["r"]["rule"], r["r"] and r["r"]["verdict"]) == cases[r["page_id"]][1:]


def markov(urls, order=url_filter.ORDER):
    """Witten-Bell by its definition."""
    counts = collections.defaultdict(collections.Counter)
    for url in urls:
        text = url_filter.START + url.lower() + url_filter.END
        for i in range(1, len(text)):
            for k in range(0, min(order, i) + 1):
                counts[text[i - k : i]][text[i]] += 1

    def chance(context, c):
        lower = chance(context[1:], c) if context else 1 / url_filter.ALPHABET
        own = counts.get(context)
        if not own:
            return lower
        return (own[c] + len(own) * lower) / (sum(own.values()) + len(own))

    def log(url):
        text = url_filter.START + url.lower() + url_filter.END
        return sum(math.log(chance(text[max(0, i - order) : i], text[i])) for i in range(1, len(text))) / (len(text) - 1)

    return log


def test_folded_weights_equal_the_markov_models(spark):
    yes, no = ["http://a.com/x", "http://b.com/xy", "http://a.com/z"], ["http://c.net/q", "https://c.net/qq"]
    rows = spark.createDataFrame([(u, True) for u in yes] + [(u, False) for u in no], "url string, accepted boolean")
    asked = ["http://a.com/x", "ftp://c.net", "", "zzz", "http://b.com/qq"]
    got = url_filter.ratios(spark.createDataFrame([(u,) for u in asked], "url string"), url_filter.weights(rows), "url", "ratio").collect()
    good, bad = markov(yes), markov(no)
    assert {r["url"] for r in got} == set(asked)
    for r in got:
        assert r["ratio"] == pytest.approx(good(r["url"]) - bad(r["url"]), abs=1e-9)


def test_url_filter_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y"), (3, "http://a.com/" + "p" * 5000, "z")], "page_id long, url string, _row string")
    out = url_filter.filter_urls(odd.withColumn("host", F.lit("own"))).collect()
    assert sorted((r["page_id"], r["host"], r["_row"], r["verdict"]) for r in out) == [(1, "", "x", "allow"), (1, "", "x", "allow"), (2, "", "y", "allow"), (3, "a.com", "z", "allow")]
    assert url_filter.filter_urls(odd.limit(0)).count() == 0


def test_url_models_agree_with_rules_and_query_is_native(spark):
    out = QUERIES["op1_url_filter"](spark, MIDDLE)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = out.collect()
    assert len(rows) == table(spark, MIDDLE, "pages").count()
    ruled = [r for r in rows if r["rule"]]
    assert np.mean([(r["chance"] >= 0.5) == (r["verdict"] == "allow") for r in ruled]) > 0.95


def accuracy(spark, rows, column, threshold):
    marks = {r["doc_id"]: r[column] for r in table(spark, MIDDLE, "labels").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    assert len(held) > 40
    return np.mean([(r["score"] >= threshold) == (marks[r["doc_id"]] == 1) for r in held])


def test_quality_on_held_out_labels(spark):
    rows = QUERIES["op3_quality"](spark, MIDDLE).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert accuracy(spark, rows, "quality", 0.3) > 0.95


def test_quality_rules_compile_to_what_they_say(spark, odd):
    rule = (("words", False, 1.0), ("upper", True, 0.1))
    rows = quality.with_statistics(spark.createDataFrame([("A",), ("b",), ("A A A A",), (None,)], "text string"), "text")
    assert [r[0] for r in rows.select(quality.condition(rule)).collect()] == [True, False, False, False]
    none = quality.learn(odd, table(spark, SMALL, "labels").limit(0))
    assert quality.score_quality(odd, none).filter("quality >= 0.3").count() == odd.count()
    rules = quality.Rules([(rule, 2.0)], -1.0)
    plan = quality.score_quality(odd, rules).filter("quality >= 0.3")._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("split(" in line for line in filters)  # statistics are not copied into the filter


def test_toxicity_on_held_out_labels(spark):
    rows = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in marks]
    clean, toxic = [r for r in held if marks[r["doc_id"]] == 0], [r for r in held if marks[r["doc_id"]] == 1]
    assert np.mean([r["predicted"] == 0 for r in clean]) > 0.99
    assert np.mean([r["predicted"] == 1 for r in toxic]) > 0.75


def test_toxicity_of_planted_words(spark):
    docs = [(i, f"number{i} you are a {'clown and a loser' if i % 2 else 'friend and a reader'} for page{i}") for i in range(120)]
    model = toxicity.learn(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, toxic int")
    )
    got = toxicity.score_toxicity(spark.createDataFrame([("what a clown",), ("what a friend",), ("",), (None,)], "text string"), model).collect()
    assert got[0]["toxicity"] > got[1]["toxicity"] and got[2]["toxicity"] == got[3]["toxicity"]


def test_languages_on_held_out_rows(spark):
    rows = QUERIES["op7_language_id"](spark, MIDDLE).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, MIDDLE, "documents").select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"]]) > 0.97


def test_odd_texts_keep_their_rows(spark, odd):
    n = odd.count()
    labels = table(spark, SMALL, "labels")
    docs = table(spark, SMALL, "documents")
    tox = toxicity.score_toxicity(odd, toxicity.learn(docs, labels)).collect()
    assert len(tox) == n and all(0 <= r["toxicity"] <= 1 for r in tox) and all(r["stats"] == "own stats" for r in tox)
    langs = languages.identify_languages(odd, languages.learn(docs, "text", "lang", "doc_id", bound=40)).collect()
    assert len(langs) == n
    for r in langs:
        assert (r["language"]["lang"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
        assert 0 <= r["language"]["score"] <= 1
    empty = languages.learn(docs.limit(0), "text", "lang", "doc_id")
    assert {r["language"]["lang"] for r in languages.identify_languages(odd, empty).collect()} == {"und"}
    found = decontaminate.find_contamination(odd, table(spark, SMALL, "benchmark")).collect()
    assert len(found) == n and all(r["contamination"] == [] for r in found)
    assert licenses.scan_licenses(odd).count() == n
    for operator in (lambda d: toxicity.score_toxicity(d, toxicity.learn(docs, labels.limit(0))), licenses.scan_licenses):
        assert operator(odd.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "order"),
    [
        ("MIT", ["mit"]), ("mit OR apache-2.0 and isc", ["mit", "apache-2.0", "isc", "and", "or"]),
        ("(MIT or GPL-2.0 WITH classpath) AND isc -->", ["mit", "gpl-2.0", "classpath", "with", "or", "isc", "and"]),
        ("and", None), ("(mit", None), ("mit or", None), ("mit)", None), ("", None), ("a and b and c", ["a", "b", "and", "c", "and"]),
    ],
)
def test_postfix_order(text, order):
    assert licenses.postfix(text) == order


def test_licence_expressions_are_evaluated():
    found = licenses.scan(b"// SPDX-License-Identifier: (GPL-3.0 OR mit) AND Apache-2.0 */\nx")
    assert found["labels"] == "apache-2.0,gpl-3.0,mit" and found["permitted"] is True
    assert licenses.scan(b"SPDX-License-Identifier: gpl-3.0 and mit")["permitted"] is False
    assert licenses.scan(b"SPDX-License-Identifier: mit and")["expressions"] == []


def test_licence_bases_equal_a_word_by_word_search(spark):
    texts = [r["text"] for r in table(spark, MIDDLE, "documents").select("text").collect()]
    texts += ["mit license MIT-License general public license", "license mit", "", "the mit  license2", "émit license", "MIT license" * 3]
    for text in texts:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode()))
        places, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            parts = phrase.encode().split()
            for i in range(len(words)):
                if words[i : i + len(parts)] == parts:
                    places.append(i)
                    labels.add(label)
        got = licenses.scan(text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (
            len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
        )


def test_wand_finds_what_an_exhaustive_search_finds(spark):
    items = [(r["item_id"], r["text"].lower()) for r in table(spark, "/root/testdata/sf0.1", "benchmark").collect()]
    index = decontaminate.build(sorted(items))
    exact = np.zeros((len(index.terms), len(index.items)))
    for t in range(len(index.terms)):
        exact[t, index.posts[index.first[t] : index.first[t + 1]]] = index.impacts[index.first[t] : index.first[t + 1]]
    rng = np.random.default_rng(1)
    for _ in range(60):
        query = np.unique(rng.choice(len(index.terms), size=60, p=(w := (exact > 0).sum(axis=1) + 0.0) / w.sum()))
        scores = exact[query].sum(axis=0)
        for threshold in (0.1, 0.2, 0.4):
            found = dict(decontaminate.wand(index, query, threshold))
            assert set(found) == set(np.flatnonzero(scores >= threshold))
            assert all(found[s] == pytest.approx(scores[s]) for s in found)


def test_planted_passages_are_found_and_clean_texts_left(spark):
    items = table(spark, SMALL, "benchmark").collect()
    filler = " ".join(f"filler{i % 97} words{i % 31}" for i in range(300))
    docs = [(r["item_id"], f"{filler} {r['text'].upper()}\n{filler}") for r in items] + [(-1, filler), (-2, items[0]["text"][: len(items[0]["text"]) // 3])]
    rows = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), table(spark, SMALL, "benchmark")).collect()
    for r in rows:
        hits = [h["item"] for h in r["contamination"]]
        assert (r["doc_id"] in hits) if r["doc_id"] >= 0 else not hits
    few = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), table(spark, SMALL, "benchmark"), most=7).collect()
    assert [sorted(h["item"] for h in r["contamination"]) for r in few] == [[h["item"] for h in r["contamination"]] for r in rows]


def test_lm_base_is_exact_and_model_is_a_distribution(spark, odd):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    model, counts = lm.learn(docs.filter(~held_out("doc_id", 10)), steps=4)
    got = lm.score_texts(docs, model, counts).select("*", held_out("doc_id", 10).alias("held")).collect()
    rows = docs.select("doc_id", "text", held_out("doc_id", 10).alias("held")).collect()
    assert len(got) == len(rows)
    known = collections.Counter()
    for r in rows:
        if not r["held"]:
            known.update((r["text"] or "").encode().lower().split())
            known[b""] += 1
    n, v = sum(known.values()), len(known)
    want = collections.defaultdict(list)
    for r in rows:
        tokens = [*(r["text"] or "").encode().lower().split(), b""]
        want[r["doc_id"]].append((len(tokens), sum(known[t] > 0 for t in tokens), n, sum(math.log10((known[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    have = collections.defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(tuple(r["lm"][c] for c in ("n_tokens", "n_known", "train_tokens", "base_score")))
        assert r["lm"]["score"] < 0
    for key, values in want.items():
        for a, b in zip(sorted(values), sorted(have[key]), strict=True):
            assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    # the words of a slot, and one unseen word in each class
    mass = np.zeros_like(model.mass)
    for r in counts.filter("h <> 0").collect():
        kind, slot = lm_place(r["word"].encode(), model)[:2]
        mass[kind, slot] += r["n"] + lm.ADD
    mass[: lm.CLASSES, -1] += lm.ADD
    mass[lm.CLASSES, 0] = model.end_count + lm.ADD
    assert mass == pytest.approx(model.mass)
    # scores by definition
    plain = collections.defaultdict(list)
    for r in rows:
        if r["text"] is None or len(r["text"]) < 3000:
            plain[r["doc_id"]].append(plain_score(r["text"] or "", model, known))
    for key, values in plain.items():
        scores = sorted(r["lm"]["score"] for r in got if r["doc_id"] == key)
        assert len(scores) != len(values) or sorted(values) == pytest.approx(scores, rel=1e-5)
    assert len(plain) > 150


def lm_hash(word):
    h = word_hash(word.decode())
    return 2 if h <= 1 else h


def lm_place(word, m):
    """Class, slot and whether the word is in the dictionary."""
    at = int(np.searchsorted(m.keys, np.uint64(lm_hash(word))))
    if at < len(m.keys) and int(m.keys[at]) == lm_hash(word):
        return int(m.classes[at]), int(m.slots[at]), True
    padded = b" " + word + b" "
    total = np.zeros(lm.CLASSES)
    for left, right in zip(padded, padded[1:]):
        total += m.letters[(left * 181 + right * 59 + (left ^ right) // 8) % lm.PAIRS]
    return int(total.argmax()), lm.SLOTS - 1, False


def scalar_mix(h):
    mask = (1 << 64) - 1
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & mask
    return h ^ (h >> 32)


def plain_score(text, m, known):
    """Log10 probability of a text, token by token."""
    mask, wide, end = (1 << 64) - 1, lm.CLASSES + 1, lm.CLASSES
    hashes, kinds, total = [1, 1], [end, end, end], 0.0
    for word in [*text.encode().lower().split(), b""]:
        kind, slot = lm_place(word, m)[:2] if word else (end, 0)
        two, one = hashes[-2:]
        c3, c2, c1 = kinds[-3:]
        both = (scalar_mix(two * 0x9E3779B97F4A7C15 + one & mask))
        rows = [scalar_mix(x * 3 + k & mask) % lm.ROWS for k, x in enumerate((one, two, both))]
        rows += [lm.ROWS + c1 * wide + c2, lm.ROWS + wide**2 + c2 * wide + c3]
        z = m.class_bias + sum(m.class_weights[r].astype(float) for r in rows)
        total += z[kind] - math.log(np.exp(z).sum())
        rows = [scalar_mix(one * wide + kind & mask) % lm.ROWS, lm.ROWS + c1 * wide + kind]
        z = m.slot_bias[kind] + sum(m.slot_weights[r].astype(float) for r in rows)
        total += z[slot] - math.log(np.exp(z).sum())
        total += math.log((known[word] + lm.ADD) / m.mass[kind, slot])
        hashes.append(lm_hash(word) if word else 0)
        kinds.append(kind)
    return total / math.log(10)


def test_lm_beats_its_base_on_held_out_texts(spark):
    """At least nine of ten held-out texts above the base; unseen texts gain nearly as much as learned ones."""
    rows = QUERIES["op5_lm_score"](spark, MIDDLE).collect()
    gain = {held: [(r["score"] - r["base_score"]) / r["n_tokens"] for r in rows if r["held_out"] == held] for held in (True, False)}
    assert np.mean(np.array(gain[True]) > 0) >= 0.9 and np.mean(gain[True]) > 0.15
    assert np.mean(gain[False]) - np.mean(gain[True]) < 0.1
    token = {held: sum(r["score"] for r in rows if r["held_out"] == held) / sum(r["n_tokens"] for r in rows if r["held_out"] == held) for held in (True, False)}
    assert token[False] - token[True] < 0.3


def test_lm_without_training_rows(spark, odd):
    model, counts = lm.learn(odd.limit(0))
    assert lm.score_texts(odd, model, counts).count() == odd.count()
    model, counts = lm.learn(odd, steps=1)
    assert lm.score_texts(odd.limit(0), model, counts).count() == 0
