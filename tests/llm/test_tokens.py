import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from silkgraph.llm import tokens as tk

texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("abAB .,\n\té漢\U0001f600")), max_size=60)), max_size=8)


def split(text):
    return (text or "").encode().lower().split()


def all_words(values, apart=tk.BLANKS, limit=tk.SLICE):
    out = []
    for _, _, raw, at in tk.slices(pa.array(values, pa.string()), limit):
        h, place, first = tk.words(raw, at, apart)
        out += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_are_those_between_blanks(values):
    assert all_words(values) == [[tk.word_hash(w.decode()) for w in split(v)] for v in values]


def test_pieces_and_slices_do_not_change_words(monkeypatch):
    values = ["one two three four five", None, "six " * 40, "sevenseven" * 9, "", "eight"]
    whole = all_words(values)
    monkeypatch.setattr(tk, "PIECE", 16)
    assert all_words(values) == whole
    assert all_words(values, limit=10) == whole


def test_symbols_end_words_and_letters_beyond_ascii_do_not():
    (found,) = all_words(["Don't STOP_here2 été!"], tk.SYMBOLS)
    assert found == [tk.word_hash(w) for w in ("don", "t", "stop", "here2", "été")]


def test_shingles_stay_in_rows():
    ((_, _, raw, at),) = tk.slices(pa.array(["a b c d e f", "a b", "", "a b c d e"]))
    h, _, first = tk.words(raw, at)
    gram, row = tk.shingles(h, first)
    assert row.tolist() == [0, 0, 1, 3]
    assert gram[0] == gram[3] and len(np.unique(gram)) == 3


def test_sliced_and_large_arrays():
    values = pa.array(["zero", "one two", None, "three"])
    for array in (values.slice(1, 3), values.cast(pa.large_string()).slice(1, 3)):
        ((_, _, raw, at),) = tk.slices(array)
        assert np.diff(tk.words(raw, at)[2]).tolist() == [2, 0, 1]
