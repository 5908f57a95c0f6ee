"""Licence scan: Aho-Corasick over words for notices and tags, shunting-yard for tagged expressions.

A text is brought to its words (runs of ASCII digits, letters with A-Z lower-cased, and any byte beyond
ASCII) joined by one blank; one automaton finds all notice phrases and the tag in that form. Where the
tag occurs, the expression behind it is read from the text itself, turned to postfix order and evaluated
against a set of permitted licences.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .tokens import LOWER, SYMBOLS, slices

#: Fixed by the contract of the query: phrase and base label.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Further notices and the labels that the method gives them (fixed values).
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache license 2 0": "apache-2.0",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "general public license v2": "gpl-2.0",
    "general public license v3": "gpl-3.0",
    "bsd license": "bsd",
    "2 clause bsd license": "bsd-2-clause",
    "3 clause bsd license": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0": "cc0-1.0",
    "the unlicense": "unlicense",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
PERMITTED = frozenset(
    "mit apache apache-2.0 bsd bsd-2-clause bsd-3-clause isc bsl-1.0 cc-by-4.0 cc0-1.0 unlicense 0bsd zlib".split()
)

_bytes = bytes(32 if SYMBOLS[LOWER[b]] else int(LOWER[b]) for b in range(256))
_tag = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE)
_piece = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+_-]*")
RANK = {"or": 1, "and": 2, "with": 3}


def postfix(text: str) -> list[str] | None:
    """Postfix order of a licence expression; None if it is not well formed.

    ``with`` binds before ``and``, that before ``or``; names are compared in lower case. A comment end
    or other text behind the expression ends it.
    """
    out: list[str] = []
    stack: list[str] = []
    wants_name = True
    place = 0
    text = text.lower()
    while True:
        while place < len(text) and text[place] in " \t":
            place += 1
        found = _piece.match(text, place)
        if not found:
            break
        token = found[0]
        if token in RANK or token == ")":
            if wants_name:
                return None
            limit = RANK.get(token, 0)
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= max(limit, 1):
                out.append(stack.pop())
            if token == ")":
                if not stack:
                    return None
                stack.pop()
            else:
                stack.append(token)
                wants_name = True
        elif token == "(":
            if not wants_name:
                break
            stack.append(token)
        else:
            if not wants_name:
                break
            out.append(token.rstrip(".-"))
            wants_name = False
        place = found.end()
    if wants_name or "(" in stack:
        return None
    return out + stack[::-1]


def permits(order: list[str], permitted: frozenset[str] = PERMITTED) -> tuple[bool, list[str]]:
    """Whether a postfix expression can be met by permitted licences, and the licences it names."""
    stack: list[tuple[bool, str]] = []
    names: list[str] = []
    for token in order:
        if token not in RANK:
            stack.append((token in permitted or token.rstrip("+") in permitted, token))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":  # the right side is an exception, which only adds rights
            stack.append((left[0], ""))
            names.append(left[1])
        else:
            names += [x[1] for x in (left, right) if x[1]]
            both = left[0] and right[0]
            stack.append((both if token == "and" else left[0] or right[0], ""))
    if stack[0][1]:
        names.append(stack[0][1])
    return stack[0][0], names


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """All phrases between blanks; the value says what was found."""
    found = ahocorasick.Automaton()
    base = dict(BASE_PHRASES)
    for phrase in {**base, **NOTICES, TAG: None}:
        found.add_word(f" {phrase} ", (phrase, base.get(phrase), NOTICES.get(phrase)))
    found.make_automaton()
    return found


FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "permitted boolean, expressions array<string>, spans array<struct<label:string,first:long,words:long>>"
)
_span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64())])
_out = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("permitted", pa.bool_()),
        ("expressions", pa.list_(pa.string())), ("spans", pa.list_(_span)),
    ]
)


def scan(text: bytes) -> dict:
    """All licence findings of one text."""
    parts = text.translate(_bytes).split()
    if not parts:
        return dict(n_words=0, n_base=0, first_word=None, last_word=None, base_labels="", labels="", permitted=None, expressions=[], spans=[])
    line = (b" " + b" ".join(parts) + b" ").decode("latin-1")
    base, labels, starts, spans, expressions, verdicts = set(), set(), [], [], [], []
    word = at = 0
    tagged = False
    for end, (phrase, base_label, label) in automaton().iter(line):
        first = end - len(phrase) - 1
        if first >= at:
            word += line.count(" ", at, first)
            at = first
            start = word
        else:
            start = word - line.count(" ", first, at)
        if base_label:
            base.add(base_label)
            starts.append(start)
        if base_label or label:
            labels.add(base_label or label)
            spans.append({"label": base_label or label, "first": start, "words": phrase.count(" ") + 1})
            verdicts.append((base_label or label) in PERMITTED)
        else:
            tagged = True
    if tagged:
        for found in _tag.finditer(text):
            order = postfix(found[1].decode("latin-1"))
            if order is not None:
                verdict, names = permits(order)
                labels.update(names)
                verdicts.append(verdict)
                expressions.append(" ".join(order))
    return dict(
        n_words=len(parts), n_base=len(starts), first_word=min(starts, default=None), last_word=max(starts, default=None),
        base_labels=",".join(sorted(base)), labels=",".join(sorted(base | labels)),
        permitted=all(verdicts) if verdicts else None, expressions=expressions, spans=spans,
    )


def _scanned(texts: pa.Array) -> pa.Array:
    rows = []
    for _, _, raw, at in slices(texts):
        whole = raw.tobytes()
        rows += [scan(whole[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    return pa.array(rows, type=_out)


def license_findings(text: Column) -> Column:
    """Struct of findings for each text. NULL and blank texts have no words and no findings.

    ``spans`` has every notice with its label and words; ``expressions`` the well-formed tagged
    expressions in postfix order; ``permitted`` whether all that was found is permitted (NULL if
    nothing was found). A malformed expression is passed over.
    """
    return F.arrow_udf(_scanned, FIELDS)(text)


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """All rows of ``docs`` with the findings as one struct column ``out`` (which replaces one of that name).

    One pass without a shuffle; repeated rows give repeated findings, an empty table none.
    """
    return docs.withColumn(out, license_findings(F.col(text)))
