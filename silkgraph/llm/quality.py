"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to Column expressions.

A forest over statistics of labelled rows gives candidate rules (each path from a root is a conjunction of
limits); a logistic regression with a lasso penalty over the rules' outcomes keeps few of them. What
remains is a sum of weighted conditions, evaluated by Spark's own expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from .shared import sampled, sigmoid, written

#: One condition: statistic, whether it must lie above the limit, and the limit.
Condition = tuple[str, bool, float]


@dataclass
class Rules:
    weights: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)
    constant: float = 1.0


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text by built-in functions; NULL counts as an empty text."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda w: w != "")

    def share(letters: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, letters, ""))) / size

    return {
        "chars": F.log1p(F.length(text).cast("double")),
        "words": F.log1p(F.size(words).cast("double")),
        "word_length": size / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "line_length": F.log1p(size / F.greatest(F.size(lines), F.lit(1))),
        "upper": share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "digits": share("0123456789"),
        "symbols": share("#$%&*+/<=>@[\\]^_{|}~"),
        "bangs": share("!?"),
        "stops": share(".,;:"),
        "blanks": share(" "),
    }


def with_statistics(docs: DataFrame, text: str, out: str = "stats") -> DataFrame:
    """``docs`` with one struct column of all statistics."""
    return docs.withColumn(out, F.struct(*[v.cast("double").alias(k) for k, v in statistics(F.col(text)).items()]))


def paths(tree, names: list[str]) -> set[tuple[Condition, ...]]:
    """All paths of a fitted tree as conjunctions, inner nodes included; limits of one statistic are merged."""
    found: set[tuple[Condition, ...]] = set()

    def walk(node, limits: dict[tuple[str, bool], float]) -> None:
        if limits:
            found.add(tuple(sorted((n, above, v) for (n, above), v in limits.items())))
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, limit = names[split.featureIndex()], float(split.threshold())
        low, high = dict(limits), dict(limits)
        low[name, False] = min(limit, low.get((name, False), limit))
        high[name, True] = max(limit, high.get((name, True), limit))
        walk(node.leftChild(), low)
        walk(node.rightChild(), high)

    walk(tree._call_java("rootNode"), {})
    return found


def condition(rule: tuple[Condition, ...], stats: str = "stats") -> Column:
    """A conjunctive rule as a Column."""
    met = F.lit(True)
    for name, above, limit in rule:
        value = F.col(stats)[name]
        met = met & ((value > limit) if above else (value <= limit))
    return met


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    bound: int = 20000, trees: int = 12, depth: int = 3, penalty: float = 0.002,
) -> Rules:
    """Rules from labelled rows of ``docs``.

    ``bound`` is the documented size of the labelled sample of each class; it bounds the keys that are
    broadcast, and statistics are taken of these rows only. Labels other than 0 and 1 are
    passed over; a key labelled twice counts once, as its smaller label. Without rows of both classes
    there are no rules and every text is accepted.
    """
    marks = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    marks = marks.filter(F.col("key").isNotNull() & F.col("label").isin(0, 1)).groupBy("key").agg(F.min("label").alias("label"))
    picked = sampled(marks, "key", "label", bound)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    sample = written(with_statistics(rows, "text").drop("text").dropDuplicates(["key"]), "quality-sample")
    names = sample.schema["stats"].dataType.names
    counts = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Rules()
    vectors = sample.select(
        F.col("label").cast("double").alias("label"), "stats",
        array_to_vector(F.array(*[F.col("stats")[n] for n in names])).alias("features"),
    )
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=3, subsamplingRate=0.8, maxBins=64).fit(vectors)
    rules = sorted(set().union(*(paths(t, names) for t in forest.trees)))
    if not rules:
        return Rules(constant=3.0 if counts.get(1, 0) >= counts.get(0, 0) else -3.0)
    outcomes = vectors.select("label", array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, standardization=False).fit(outcomes)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return Rules(kept, float(lasso.intercept))


def score(rules: Rules, stats: str = "stats") -> Column:
    """Probability of good quality as one expression over the struct of statistics."""
    total = F.lit(rules.constant)
    for rule, weight in rules.weights:
        total = total + F.when(condition(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
    return sigmoid(total)


def score_quality(docs: DataFrame, rules: Rules, text: str = "text", out: str = "quality") -> DataFrame:
    """All rows of ``docs`` with the column ``out``; no shuffle, extra columns stay.

    The statistics of a text are taken once: their struct also holds a row number, and the optimizer
    does not copy an expression with such a number into a filter or into each rule above it.
    """
    own = docs.drop(out).select(F.struct("*").alias("own"), F.col(text).alias("text"))
    values = [v.cast("double").alias(k) for k, v in statistics(F.col("text")).items()]
    taken = own.select("own", F.struct(F.monotonically_increasing_id().alias("row"), *values).alias("stats"))
    return taken.select("own.*", score(rules).alias(out))
