"""URL filter: explicit rules, and for the rest a ratio of two character language models.

Both models, of accepted and of rejected URLs, are Markov models of variable order: every character is
predicted from the longest known context of up to ``ORDER`` characters, smoothed by Witten-Bell towards
shorter contexts. In backoff form the log-likelihood of a URL is a sum over all its substrings of up to
``ORDER`` + 1 characters: what a substring adds as an event beyond its own suffix, and its backoff weight as
a context. Both models fold into one weight per substring, so scoring is one explode, one look-up join and
one sum per URL, all in Spark's own operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import sampled, sigmoid, written

ORDER = 4
ALPHABET = 128
START, END = "\u0002", "\u0003"
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules of the registered query, fixed by its contract: (verdict, host and path).
RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or NULL.

    A rule fits its host and all subdomains, if the path starts with the rule's. Rules are configuration:
    a short list that goes into the plan.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def framed(url: Column) -> Column:
    return F.concat(F.lit(START), F.lower(F.coalesce(url, F.lit(""))), F.lit(END))


def pieces(text: Column, most: int) -> Column:
    """All substrings of up to ``most`` characters."""
    ends = F.sequence(F.lit(1), F.length(text))
    return F.flatten(F.transform(ends, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), i)), lambda k: F.substring(text, i - k + 1, k))))


def weights(urls: DataFrame) -> DataFrame:
    """(piece, weight) from labelled URLs (url, accepted): accepted minus rejected, in natural logarithms.

    The empty piece holds what every predicted character adds.
    """
    grams = urls.select("accepted", F.explode(pieces(framed(F.col("url")), ORDER + 1)).alias("gram"))
    grams = grams.filter(F.col("gram") != START).groupBy("accepted", "gram").agg(F.count(F.lit(1)).alias("n"))
    grams = written(grams.withColumn("size", F.length("gram")), "url-grams")
    last = F.expr("left(gram, size - 1)")
    contexts = grams.groupBy("accepted", last.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    joined = grams.withColumn("context", last).withColumn("suffix", F.expr("substring(gram, 2)")).join(contexts, ["accepted", "context"])
    joined = written(joined, "url-contexts")
    share = F.col("kinds") / (F.col("total") + F.col("kinds"))
    levels = []
    before = None
    for size in range(1, ORDER + 2):
        level = joined.filter(F.col("size") == size)
        if before is None:
            level = level.withColumn("lower", F.lit(1.0 / ALPHABET))
        else:
            level = level.join(before.select("accepted", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["accepted", "suffix"])
        level = level.withColumn("p", (F.col("n") + F.col("kinds") * F.col("lower")) / (F.col("total") + F.col("kinds")))
        before = level
        levels.append(level.select("accepted", F.col("gram").alias("piece"), (F.log("p") - F.log(share) - F.log("lower")).alias("w")))
    parts = contexts.select("accepted", F.col("context").alias("piece"), F.log(share).alias("w"))
    for level in levels:
        parts = parts.unionByName(level)
    return parts.groupBy("piece").agg(F.sum(F.when(F.col("accepted"), F.col("w")).otherwise(-F.col("w"))).alias("weight"))


def ratios(rows: DataFrame, model: DataFrame, url: str, out: str, most: int = 1_000_000) -> DataFrame:
    """``rows`` (``url`` and any other columns) with the length-normalised difference of log-likelihoods.

    The weights are broadcast only if they are counted to be ``most`` at most; else they are joined by the piece. Only distinct URLs are taken apart; the rows meet their sums again by the URL, so
    other columns are not copied for the pieces, and a URL of very many rows is taken apart once.
    """
    base = model.filter("piece = ''").select("weight").first()
    constant = float(base["weight"]) if base else 0.0
    pieces_of = model.filter("piece <> ''")
    if pieces_of.count() <= most:
        pieces_of = F.broadcast(pieces_of)
    texts = rows.select(framed(F.col(url)).alias("text")).distinct()
    cut = texts.select("text", F.explode(pieces(F.col("text"), ORDER + 1)).alias("piece"))
    summed = cut.join(pieces_of, "piece", "left").groupBy("text").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    whole = rows.select(F.struct("*").alias("whole"), framed(F.col(url)).alias("text"))
    return whole.join(summed, "text").select("whole.*", (F.col("w") / (F.length("text") - 1) + constant).alias(out))


def filter_urls(
    pages: DataFrame, url: str = "url", rules: list[tuple[str, str]] = RULES, bound: int | None = None, prefix: str = "",
) -> DataFrame:
    """All rows of ``pages`` with host, path, rule, verdict, ratio and chance (each with ``prefix``).

    All distinct URLs that a rule judges teach the models (a sample of about ``bound`` of each verdict if that is
    given), two thirds the models, one third the calibration, which turns the
    ratio into a chance by the means and the common variance of both verdicts. A URL without a rule is
    allowed if its chance is one half or more. A NULL or malformed URL has an empty host and path and is
    judged as its text (NULL as the empty text). Without rules of both verdicts all else is allowed.
    Columns of the names made here are replaced.
    """
    names = {n: prefix + n for n in ("host", "path", "rule", "verdict", "ratio", "chance")}
    # the row stands in a struct of its own, so that no column of it can clash with those used here
    rows = pages.drop(*names.values()).select(F.struct("*").alias("own"), F.col(url).alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    labelled = rows.filter(F.col("rule").isNotNull()).select("url", (F.col("rule.verdict") == "allow").alias("accepted"))
    taught = written(labelled.distinct() if bound is None else sampled(labelled.distinct(), "url", "accepted", bound), "url-taught")
    part = F.pmod(F.xxhash64("url", F.lit(5)), F.lit(3))
    model = written(weights(taught.filter(part != 0)), "url-weights")
    fit = ratios(taught.filter(part == 0), model, "url", "ratio").groupBy("accepted").agg(
        F.avg("ratio").alias("mean"), F.coalesce(F.var_pop("ratio"), F.lit(0.0)).alias("spread"), F.count(F.lit(1)).alias("n")
    )
    found = {r["accepted"]: r for r in fit.collect()}
    scored = ratios(rows, model, "url", "ratio")
    if len(found) == 2:
        yes, no = found[True], found[False]
        spread = max((yes["spread"] * yes["n"] + no["spread"] * no["n"]) / (yes["n"] + no["n"]), 1e-9)
        middle, slope = (yes["mean"] + no["mean"]) / 2, (yes["mean"] - no["mean"]) / spread
        chance = sigmoid((F.col("ratio") - middle) * slope)
    else:
        chance = F.lit(1.0)
    scored = scored.withColumn("chance", chance)
    verdict = F.coalesce("rule.verdict", F.when(F.col("chance") >= 0.5, "allow").otherwise("block"))
    made = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("rule.rule"), "verdict": verdict, "ratio": F.col("ratio"), "chance": F.col("chance")}
    return scored.select("own.*", *[c.alias(names[n]) for n, c in made.items()])
