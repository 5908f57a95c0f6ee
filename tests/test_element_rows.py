"""Any text gives records of the standard parser: consistent elements, or none if it gives up."""

import pyarrow.parquet as pq
from hypothesis import given, settings, strategies as st

from silkgraph.functions import element_rows as e
from silkgraph.operators.dom import EVERYTHING

WANT = {**EVERYTHING, "tags": None}


def check(html):
    nodes, words, parsed = e.page_record(html, WANT)
    assert words >= 0 and (parsed or not nodes)
    for at, (me, parent, end, tag, attrs, texts, path, scopes, raw, parts) in enumerate(nodes):
        assert me == at and parent < me <= end < len(nodes)
        assert path.startswith("/[document]/") and (parent < 0 or nodes[parent][2] >= end)
        assert parts is None or tag == "script"
        assert raw is None or (raw in html and raw.startswith("<"))


def test_given_pages():
    for html in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        check(html)


PIECES = st.sampled_from(
    ["<p>", "</p>", "<div class=a id='b' x=\"c&amp;d&e=1\" y>", "</div>", "<br/>", "</br>", "<a href=/a/>", "</a>", "text ", "&amp;", "&copy", "&#150;", "& ", "< ",
     "<!-- c -->", "<!-->", "<!DOCTYPE html>", "<?php x ?>", "<![CDATA[x]]>", "<script>", "</script>", "<script type='application/ld+json'>{}</script>", "<style>p{}</style>",
     "<title>", "</title>", "<textarea> ", "<template>", "<pre> ", "<div itemscope itemtype=x>", "<i itemprop=y>", "</i>", "<x-y:z>", "<b a=1 a=2 B>", "<p =x>", "<p a='b'c>"]
)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14))
def test_mixed_markup(pieces):
    check("".join(pieces))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-&;#abPp=\"' \n\t", max_size=40))
def test_any_text(html):
    check(html)
