import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with NULLs in every column, blank and very long texts, repeated rows, and columns whose
    names the operators use inside."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
        (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "en", "a"),
        (3, None, "en", "b"), (4, "", None, "b"), (5, " \n\t ", "en", None), (6, "word " * 150_000, "en", "b"),
        (7, "x" * 400_000, "de", "b"), (8, "two words", "de", "c"), (None, "no key here at all", "en", "c"), (None, None, None, None),
        (9, "Ünïcode ÇA été 漢字 \U0001f600 z", "fr", "c"),
    ]
    names = ["key", "text_hash", "fp", "stats", "toxic", "row", "rid", "h", "n", "mix_epoch", "_plan", "toxicity", "hits", "license"]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in names:
        from pyspark.sql import functions as F

        out = out.withColumn(name, F.lit("own " + name))
    return out
