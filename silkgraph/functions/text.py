"""Text helpers shared by the extractors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The Unicode characters that count as blank in page text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every Unicode blank on both sides (set based, no regex)."""
    return F.trim(text, F.lit(BLANKS))


def joined_text(pieces: Column) -> Column:
    """Text of an element: its pieces glued, then stripped."""
    return strip(F.array_join(pieces, ""))


def stripped_pieces(pieces: Column) -> Column:
    """Text of an element with every piece stripped before glueing."""
    return F.array_join(F.transform(pieces, strip), "")


def json_string(text: Column) -> Column:
    """A JSON string literal."""
    boxed = F.to_json(F.array(text))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def directives(text: Column) -> Column:
    """Robots directive list: split at commas, stripped, lower case; empty for blank or NULL."""
    return F.when(
        strip(text) != "", F.transform(F.split(strip(text), ","), lambda d: F.lower(strip(d)))
    ).otherwise(F.array().cast("array<string>"))
