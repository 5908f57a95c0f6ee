"""What the language model learns, and how its sums are taken."""

import numpy as np
import pytest

from silkgraph.llm import lm


def test_lm_learns_what_follows_a_rare_word(spark):
    """Rare words of like spelling, told apart only by the hashed word before."""
    rng = np.random.default_rng(2)
    docs = []
    for k in range(600):
        words = [f"the{i}" for i in rng.integers(0, 8, 20)]
        words[7:9] = ["amber", "zyzzyva"] if k % 2 else ["ambre", "qwopqwop"]
        docs.append((k, " ".join(words)))
    model, counts = lm.learn(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame([(0, "the0 amber zyzzyva"), (1, "the0 ambre zyzzyva")], "doc_id long, text string")
    got = {r["doc_id"]: r["lm"] for r in lm.score_texts(asked, model, counts).collect()}
    assert got[0]["base_score"] == pytest.approx(got[1]["base_score"])
    assert got[0]["score"] > got[1]["score"] + 0.3


def test_lm_word_table_grows_with_the_corpus(spark):
    def words(n):
        frame = spark.createDataFrame([(k, " ".join(f"w{k * 31 + i} v{i}" for i in range(30))) for k in range(n)], "doc_id long, text string")
        return lm.learn(frame, steps=1)[1].count()

    assert words(2000) > 15 * words(100)


def test_lm_gradient_of_many_parts_equals_that_of_one(spark):
    frame = spark.createDataFrame([(k, f"one{k % 7} two{k % 5} three{k}") for k in range(90)], "doc_id long, text string")
    texts = [r["text"] for r in frame.collect()]
    model, _ = lm.learn(frame.coalesce(1), steps=1)

    def sums(parts):
        total = [np.zeros_like(model.class_weights.T, float), np.zeros_like(model.slot_weights.T, float)]
        for part in parts:
            raw = np.frombuffer("".join(part).encode(), dtype=np.uint8)
            at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in part])])
            lm.gradient(lm.stream(raw, at, model), model, *total)
        return total

    for one, many in zip(sums([texts]), sums([texts[:20], texts[20:21], texts[21:]]), strict=True):
        assert np.abs(one).max() > 0 and many == pytest.approx(one, abs=1e-4)


def test_lm_gradient_is_the_slope_of_its_likelihood(spark):
    frame = spark.createDataFrame([(k, f"one{k % 7} two{k % 5} three{k}") for k in range(60)], "doc_id long, text string")
    model, _ = lm.learn(frame, steps=2)
    text = "one1 two2 three7 one2"
    raw, at = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)])
    t = lm.stream(raw, at, model)
    own = slice(0, len(t.h))
    model.class_weights, model.slot_weights = model.class_weights.astype(float), model.slot_weights.astype(float)
    sums = [np.zeros_like(model.class_weights.T), np.zeros_like(model.slot_weights.T)]
    lm.gradient(t, model, *sums)

    def value():
        return sum(lm.chosen_logs(z, choice).sum() for z, choice, _ in lm.factors(t, own, model))

    for weights, change in zip((model.class_weights, model.slot_weights), (x.T for x in sums), strict=True):
        row = int(np.abs(change).sum(axis=1).argmax())
        for column in np.abs(change[row]).argsort()[-3:]:
            before = float(weights[row, column])
            weights[row, column] = before + 0.01
            up = value()
            weights[row, column] = before - 0.01
            down = value()
            weights[row, column] = before
            assert (up - down) / 0.02 == pytest.approx(float(change[row, column]), abs=0.02)
