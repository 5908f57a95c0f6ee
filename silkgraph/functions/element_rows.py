"""Task-side helper of the HTML scan: one pass of the standard HTML parser over a page.

It only turns markup into element records; everything that is looked up in them is a Column
expression or a DataFrame operator. The functions travel to the executors by value, so the workers need no copy
of this package.
"""

from __future__ import annotations

import sys
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle

from silkgraph.functions.json_items import script_parts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Elements without content, and elements whose text is not page text.
VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
SIDE_TEXT = frozenset(["script", "style", "template", "rt", "rp"])
KEEP_SPACE = frozenset(["pre", "textarea"])
SPACES = " \n\t\f\r"

# The objects of a JSON-LD script: place in its list, text, error.
PART = pa.struct([("at", pa.int32()), ("data", pa.string()), ("error", pa.string())])
NODE = pa.struct(
    [
        ("ord", pa.int32()),
        ("parent_ord", pa.int32()),
        ("subtree_end", pa.int32()),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text_pieces", pa.list_(pa.string())),
        ("xpath", pa.string()),
        ("spans", pa.list_(pa.int32())),
        ("raw", pa.string()),
        ("parts", pa.list_(PART)),
    ]
)
DOM = [("nodes", pa.list_(NODE)), ("word_count", pa.int32()), ("parsed", pa.bool_())]
FLUSH_CHARS = 1 << 20


class Tree(HTMLParser):
    """Records of the elements of one page, in document order."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        # One list per element: tag, parent, subtree end, attributes, number among its like
        # siblings, first and last text. (Lists, because this is the inner loop of the scan.)
        self.nodes, self.siblings, self.texts, self.side = [], {}, [], {}
        self.starts, self.stops, self.html, self.at = {}, {}, "", 0
        self.stack, self.open, self.side_stack, self.space_depth = [], {}, [], 0
        self.pending = []

    def flush(self):
        if not self.pending:
            return
        text = "".join(self.pending)
        self.pending = []
        if not self.space_depth and not text.strip(SPACES):
            text = "\n" if "\n" in text else " "
        if self.side_stack:
            self.side.setdefault(self.side_stack[-1], []).append(text)
        else:
            self.texts.append(text)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";", "&" + name))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self.flush()

    def updatepos(self, i, j):
        """The parser has read on from ``i`` to ``j``: only the offset of the token being handled is kept, no line."""
        if i < j:
            self.at += j - i
        return j

    def handle_starttag(self, tag, attrs):
        self.begin(tag, {k: v or "" for k, v in attrs} if attrs else {})

    def begin(self, tag, attrs):
        if self.pending:
            self.flush()
        nodes, stack = self.nodes, self.stack
        me, parent = len(nodes), stack[-1] if stack else -1
        like = (parent, tag)
        nth = self.siblings[like] = self.siblings.get(like, 0) + 1
        texts = len(self.texts)
        nodes.append([tag, parent, me, attrs, nth, texts, texts])
        if attrs and (is_item(attrs) or is_json_ld(tag, attrs)):
            self.starts[me] = self.at
        if tag in VOID:
            return
        stack.append(me)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in SIDE_TEXT:
            self.side_stack.append(me)
        elif tag in KEEP_SPACE:
            self.space_depth += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.pending:
            self.flush()
        if self.open.get(tag):
            while self.pop(tag) != tag:
                pass

    def pop(self, closing=None):
        me = self.stack.pop()
        node = self.nodes[me]
        tag = node[0]
        self.open[tag] -= 1
        node[2] = len(self.nodes) - 1
        node[6] = len(self.texts)
        if tag in SIDE_TEXT:
            self.side_stack.pop()
        elif tag in KEEP_SPACE:
            self.space_depth -= 1
        if me in self.starts:
            self.stops[me] = (self.at, tag == closing)
        return tag

    def read(self, html):
        self.html = html
        self.feed(html)
        self.close()
        return self.finish()

    def finish(self):
        self.flush()
        while self.stack:
            self.pop()
        return self

    def pieces(self, me):
        node = self.nodes[me]
        return self.side.get(me, []) if node[0] in SIDE_TEXT else self.texts[node[5] : node[6]]

    def xpaths(self):
        """Path of every element; a step is numbered when the parent has more of that tag."""
        out = []
        for tag, parent, _, _, nth, _, _ in self.nodes:
            step = f"{tag}[{nth}]" if self.siblings[parent, tag] > 1 else tag
            out.append(f"{out[parent] if parent >= 0 else '/[document]'}/{step}")
        return out

    def spans(self):
        """For an item, the part of the page's properties that lies inside it: its first microdata
        property and their number, and the same for RDFa. Properties are in document order, so those
        inside an element stand together."""
        before, itemprops, properties = ([0], [0]), 0, 0
        for node in self.nodes:
            if attrs := node[3]:
                itemprops += bool(attrs.get("itemprop"))
                properties += bool(attrs.get("property"))
            before[0].append(itemprops)
            before[1].append(properties)

        def of(me):
            end = self.nodes[me][2] + 1
            return [x for counts in before for x in (counts[me + 1], counts[end] - counts[me + 1])]

        return of

    def source(self, me):
        """Source slice of an item, end tag included when it closed the element."""
        begin = self.starts[me]
        if me not in self.stops:
            return self.html[begin : self.html.find(">", begin) + 1]
        end, own = self.stops[me]
        return self.html[begin : self.html.find(">", end) + 1 if own and self.html[end : end + 1] == "<" else end]


def is_item(attrs):
    return "itemscope" in attrs or "typeof" in attrs


def is_property(attrs):
    return "itemprop" in attrs or "property" in attrs


def is_json_ld(tag, attrs):
    return tag == "script" and attrs.get("type") == "application/ld+json"


def page_record(html, want, base=""):
    """(node dicts, word count, parsed) of one page at ``base``; no nodes if the parser gives up."""
    html = html or ""
    try:
        tree = Tree().read(html)
    except AssertionError:
        return [], 0, False
    words = len("".join(tree.texts).split())
    paths = tree.xpaths() if want["xpath"] else None
    spans = tree.spans() if want["raw"] else None
    nodes, any_tag, tags, names = [], want["tags"] is None, want["tags"] or (), frozenset(want["attrs"])
    every_text = want["text_tags"] is None
    for me, (tag, parent, end, attrs, _, _, _) in enumerate(tree.nodes):
        block = bool(attrs) and is_json_ld(tag, attrs)
        if not (
            any_tag
            or tag in tags
            or (attrs and not names.isdisjoint(attrs))
            or (block and want["json_ld"])
        ):
            continue
        prop = attrs and is_property(attrs)
        texts = tree.pieces(me) if every_text or tag in want["text_tags"] or prop or block else None
        raw = tree.source(me) if want["raw"] and me in tree.starts else None
        script = "".join(texts).strip() if block and want["json_ld"] else ""
        nodes.append(
            (
                me, parent, end, tag, list(attrs.items()), texts,
                paths[me] if paths else None, spans(me) if spans and attrs and is_item(attrs) else None, raw,
                script_parts(script, base) if script else None,
            )
        )
    return nodes, words, True


def to_arrays(records):
    """Arrow columns of the page records."""
    offsets, flat = [0], []
    for nodes, _, _ in records:
        flat.extend(nodes)
        offsets.append(len(flat))
    fields = list(zip(*flat)) if flat else [[] for _ in NODE]
    struct = pa.StructArray.from_arrays(
        [pa.array(list(values), field.type) for values, field in zip(fields, NODE)],
        fields=list(NODE),
    )
    return [
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct),
        pa.array([r[1] for r in records], pa.int32()),
        pa.array([r[2] for r in records], pa.bool_()),
    ]


def scan_batches(batches, want):
    """Arrow batches (kept columns..., html) -> (kept columns..., nodes, word_count, parsed). Relative values of
    JSON-LD are taken against the column ``url``."""
    for batch in batches:
        html = batch.column(batch.num_columns - 1)
        bases = batch.column("url") if want["json_ld"] else None
        start, records, size = 0, [], 0
        for row in range(batch.num_rows):
            text = html[row].as_py()
            records.append(page_record(text, want, (bases[row].as_py() or "") if bases else ""))
            size += len(text or "")
            if size >= FLUSH_CHARS or row == batch.num_rows - 1:
                kept = batch.slice(start, row + 1 - start).columns[:-1]
                names = batch.schema.names[:-1] + [n for n, _ in DOM]
                yield pa.RecordBatch.from_arrays([*kept, *to_arrays(records)], names=names)
                start, records, size = row + 1, [], 0


class HtmlNodes:
    """Table function of one page: a row for every element, in document order."""

    WANT = {"tags": None, "attrs": (), "text_tags": None, "xpath": True, "json_ld": False, "raw": False}

    def eval(self, html: str):
        for me, parent, end, tag, attrs, texts, path, *_ in page_record(html, self.WANT)[0]:
            yield me, parent, end, tag, dict(attrs), "".join(texts).strip(), path
