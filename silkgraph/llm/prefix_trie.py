"""Prefix trie of conversations by adaptive radix trees.

1. A turn gets an id of fixed width: the 16 bytes of a hash of its role and text, compared from the first byte on. A
   conversation is a key of such ids. Keys longer than ``SEGMENT`` turns are cut into segments; a segment carries the
   id of the node that it hangs from, so a conversation of any length is never one row or one task.
2. Equal segments become one row with their number of conversations and the smallest of them, so that a conversation
   that everybody copies is one key.
3. Keys are range partitioned. Each task builds an adaptive radix tree of its keys: nodes grow through layouts of 4,
   16, 48 and 256 children, and bytes without a branch are one compressed path. Only byte depths that end a turn give
   nodes of the trie, also inside a compressed path.
4. Nodes off the first and last key of a task belong to that task alone and are complete. The others ("open") are
   merged by id, and their subtree sums are taken by doubling steps over that small rest.
5. The members that end at a node are joined to one text in order, its pieces made by many tasks, and hashed.

Defined results: a NULL role or text reads as empty; rows without a conversation id belong to none and are left out;
turns with equal numbers are ordered by role, then by id, and repeated rows are repeated turns; NULL turn numbers come
first; a conversation without turns ends at the root; an empty table has no nodes; other columns of the table are not
looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from silkgraph.operators.scale import row_ranks

from .shared import written

WIDTH = 16
SEGMENT = 256
ROOT = bytes(WIDTH)
PIECE = 8192


class Node:
    """Node of an adaptive radix tree: a compressed path, then children by their first byte."""

    __slots__ = ("path", "layout", "bytes", "kids", "row", "found")

    def __init__(self, path: bytes = b"") -> None:
        self.path = path
        self.layout = 4
        self.bytes = bytearray()
        self.kids: list[Node | None] = []
        self.row: int | None = None
        self.found: Found | None = None

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Add a child or replace the one of that byte; a full node takes the next layout."""
        if self.layout <= 16:
            at = self.bytes.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.layout:
                self.bytes.append(byte)
                self.kids.append(kid)
                return
            if self.layout == 4:
                self.layout = 16
            else:
                slots = bytearray(256)
                for at, old in enumerate(self.bytes):
                    slots[old] = at + 1
                self.layout, self.bytes = 48, slots
            self.put(byte, kid)
        elif self.layout == 48:
            at = self.bytes[byte]
            if at:
                self.kids[at - 1] = kid
            elif len(self.kids) < 48:
                self.kids.append(kid)
                self.bytes[byte] = len(self.kids)
            else:
                self.kids = [self.kids[at - 1] if at else None for at in self.bytes]
                self.layout, self.bytes = 256, bytearray()
                self.kids[byte] = kid
        else:
            self.kids[byte] = kid

    def children(self) -> Iterator[tuple[int, Node]]:
        if self.layout <= 16:
            yield from zip(self.bytes, self.kids, strict=True)
        elif self.layout == 48:
            yield from ((byte, self.kids[at - 1]) for byte, at in enumerate(self.bytes) if at)
        else:
            yield from ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)


def insert(root: Node, key: bytes, row: int) -> None:
    """Add a key, which no other row has, to the tree. The root has no path."""
    above, node, at = None, root, 0
    while True:
        path = node.path
        same = 0
        if path and key[at : at + len(path)] == path:
            same = len(path)
        else:
            for a, b in zip(path, key[at : at + len(path)], strict=False):
                if a != b:
                    break
                same += 1
        if same < len(path):
            split = Node(path[:same])
            split.put(path[same], node)
            node.path = path[same + 1 :]
            above.put(key[at - 1], split)
            node = split
        at += same
        if at == len(key):
            node.row = row
            return
        kid = node.child(key[at])
        if kid is None:
            kid = Node(key[at + 1 :])
            kid.row = row
            node.put(key[at], kid)
            return
        above, node, at = node, kid, at + 1


class Found:
    """What a part of a tree hands to the node of the trie above it."""

    __slots__ = ("closed", "opened", "n", "least", "leaves", "saved", "waiting", "row")

    def __init__(self) -> None:
        self.closed = self.opened = self.n = self.leaves = self.saved = 0
        self.least: int | None = None
        self.waiting: list[int] = []
        self.row = -1

    def add(self, other: Found) -> None:
        self.closed += other.closed
        self.opened += other.opened
        self.n += other.n
        self.leaves += other.leaves
        self.saved += other.saved
        if self.least is None or (other.least is not None and other.least < self.least):
            self.least = other.least
        self.waiting += other.waiting
        self.row = other.row


NODES = "open boolean, id binary, parent binary, depth long, n long, least long, size long, children long, leaves long, saved long, parent_conv_id long"


def trie_nodes(group: tuple[bytes, int], rows: list[dict], segment: int) -> list[list]:
    """Rows of ``NODES`` for the keys of one group, in order; sums of an open node cover its complete children only."""
    place, number = group
    root = Node()
    for i, row in enumerate(rows):
        insert(root, row["key"], i)
    order, stack = [], [(root, None, 0, 0)]
    while stack:
        node, above, start, end = stack.pop()
        order.append((node, above, start, end))
        node.found = Found()
        for _, kid in node.children():
            stack.append((kid, node, end, end + 1 + len(kid.path)))
    out: list[list] = []
    for node, above, start, end in reversed(order):
        found, own_open = node.found, False
        if node.row is not None:
            own = Found()
            own.n, own.least, own.row = rows[node.row]["n"], rows[node.row]["least"], node.row
            found.add(own)
            own_open = node.row in (0, len(rows) - 1)
        key, sizes = rows[found.row]["key"], rows[found.row]["sizes"]
        first = 0 if above is None else start // WIDTH + 1
        for depth in range(end // WIDTH, first - 1, -1):
            top = depth == 0
            n, least = (0, None) if top and number else (found.n, found.least)
            size = 0 if top else sizes[depth - 1]
            opened = top or found.opened > 0 or depth == segment or (own_open and depth * WIDTH == end)
            name = place if top else rows[found.row]["end"] if depth == segment else hashlib.md5(place + key[: depth * WIDTH]).digest()
            if not opened:
                found.leaves = found.leaves if found.closed else 1
                found.saved += (n - 1) * size
            for child in found.waiting:
                out[child][2 if opened else 10] = name if opened else least
            found.waiting = [len(out)]
            out.append([opened, name, None, number * segment + depth, n, least, size, found.closed, found.leaves, found.saved, None])
            found.closed, found.opened = (0, 1) if opened else (1, 0)
            if opened:
                found.leaves = found.saved = 0
        if above is not None:
            above.found.add(found)
        node.found = None
    return out


def turn_rows(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, at, id, size): every turn with its place in its conversation, its id and the bytes of its text."""
    said = F.coalesce(F.col(text), F.lit(""))
    by = F.coalesce(F.col(role), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), by.alias("role"),
        F.unhex(F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))).alias("id"),
        F.octet_length(said).cast("long").alias("size"),
    )
    ranked = row_ranks(rows, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("id")], ["conv_id"], "at")
    return ranked.select("conv_id", "at", "id", "size")


def forked(turns: DataFrame, base: Column, kept: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that start like another: the first ``kept`` turns (at most ``most``) of the conversation ``base``,
    then their own turns after as many. Both are expressions of ``conv_id``; a conversation that is its own base stays.

    Returns (conv_id, at, id, size) and (conv_id, turns); conversations without turns are only in the second.
    """
    heads = turns.filter(F.col("at") < most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select("conv_id", "own", base.alias("base"), kept.cast("long").alias("kept"))
    convs = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")
    taken = F.least("kept", F.coalesce(F.size("head"), F.lit(0)).cast("long"))
    same = F.col("base") == F.col("conv_id")
    convs = convs.withColumns({
        "head": F.when(same, None).otherwise(F.slice("head", 1, F.greatest(taken, F.lit(0)).cast("int"))),
        "taken": F.when(same, F.lit(0).cast("long")).otherwise(taken),
        "kept": F.when(same, F.lit(0).cast("long")).otherwise(F.col("kept")),
    })
    convs = written(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("kept"), F.lit(0))), "trie-forks")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.at", "t.id", "t.size")
    rest = turns.join(convs.select("conv_id", "kept", "taken"), "conv_id").filter(F.col("at") >= F.col("kept"))
    rest = rest.select("conv_id", (F.col("at") - F.col("kept") + F.col("taken")).alias("at"), "id", "size")
    return first.unionByName(rest), convs.select("conv_id", "turns")


def _segments(turns: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """(conv_id, seg, key, sizes, place, end, last): the segments of all conversations, the empty ones included.

    ``place`` is the id of the node that a segment hangs from, ``end`` that of the node where it ends.
    """
    rows = turns.groupBy("conv_id", F.floor(F.col("at") / segment).cast("int").alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("at", "id", "size"))).alias("t")
    )
    joined = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["id"])), ""))
    rows = rows.select("conv_id", "seg", joined.alias("key"), F.col("t.size").alias("sizes"))
    void = convs.filter("turns = 0").select("conv_id", F.lit(0).alias("seg"), F.lit(b"").alias("key"), F.array().cast("array<bigint>").alias("sizes"))
    rows = written(rows.unionByName(void), "trie-segments")
    # a node after whole segments is named by the hashes of these segments together
    marks = [F.xxhash64("key", "seg"), F.xxhash64("seg", "key")]
    long = rows.filter("seg > 0").select("conv_id").distinct()
    before = rows.join(long, "conv_id").select("conv_id", "seg", *[m.alias(f"m{i}") for i, m in enumerate(marks)])
    over = "over (partition by conv_id order by seg rows between unbounded preceding and 1 preceding)"
    before = before.selectExpr("conv_id", "seg", f"bit_xor(m0) {over} as x0", f"bit_xor(m1) {over} as x1").filter("seg > 0")
    rows = rows.join(before, ["conv_id", "seg"], "left")
    xs = [F.coalesce(F.col(f"x{i}"), F.lit(0).cast("long")) for i in range(2)]

    def name(parts: list[Column]) -> Column:
        return F.unhex(F.concat(*[F.lpad(F.hex(p), 16, "0") for p in parts]))

    place = name(xs)
    end = (
        F.when(F.length("key") == 0, place)
        .when(F.length("key") == segment * WIDTH, name([x.bitwiseXOR(m) for x, m in zip(xs, marks, strict=True)]))
        .otherwise(F.unhex(F.md5(F.concat(place, F.col("key")))))
    )
    last = F.col("seg") == F.floor((F.greatest(F.col("turns"), F.lit(1)) - 1) / segment)
    return rows.join(convs, "conv_id").select("conv_id", "seg", "key", "sizes", place.alias("place"), end.alias("end"), last.alias("last"))


def _nodes(keys: DataFrame, segment: int) -> DataFrame:
    """Rows of ``NODES``, of all tasks: keys (place, seg, key, sizes, end, n, least), each once."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("open", pa.bool_()), ("id", pa.binary()), ("parent", pa.binary()),
            *[(name, pa.int64()) for name in ("depth", "n", "least", "size", "children", "leaves", "saved", "parent_conv_id")],
        ])

        def out(group: tuple[bytes, int], rows: list[dict]) -> Iterator[pa.RecordBatch]:
            nodes = trie_nodes(group, rows, segment)
            for at in range(0, len(nodes), 20_000):
                columns = list(zip(*nodes[at : at + 20_000], strict=True))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        group, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                now = (row["place"], row["seg"])
                if now != group and held:
                    yield from out(group, held)
                    held = []
                group = now
                held.append(row)
        if held:
            yield from out(group, held)

    order = ["seg", "place", "key"]
    return keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(build, NODES)


def _merged(rows: DataFrame) -> DataFrame:
    """Open nodes by id, complete: (id, parent, depth, n, least, children, leaves, saved)."""
    nodes = rows.groupBy("id").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.max("size").alias("size"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
    )
    nodes = written(nodes, "trie-open")
    kids = nodes.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("open_children"))
    nodes = nodes.join(kids, "id", "left").withColumn("children", F.col("children") + F.coalesce("open_children", F.lit(0)))
    nodes = written(
        nodes.select(
            "id", "parent", "depth", "n", "least", "children", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).alias("leaves"),
            (F.col("saved") + (F.col("n") - 1) * F.col("size")).alias("saved"),
        ),
        "trie-open",
    )
    sums = nodes.select("id", F.col("parent").alias("up"), "leaves", "saved")
    while not sums.filter("up is not null").isEmpty():
        more = sums.filter("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        ahead = sums.select(F.col("id").alias("up"), F.col("up").alias("next"))
        sums = written(
            sums.join(more, "id", "left").join(ahead, "up", "left").select(
                "id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
                (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
            ),
            "trie-sums",
        )
    return nodes.drop("leaves", "saved").join(sums.drop("up"), "id")


def _digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of rows (id, conv_id): SHA-256 of the decimal numbers in order, joined by commas."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
            names, first, texts = zip(*rows, strict=True)
            return pa.record_batch([pa.array(names, pa.binary()), pa.array(first, pa.int64()), pa.array(texts)], ["id", "first", "piece"])

        name, held, rows = None, [], []
        for batch in batches:
            for now, conv in zip(batch["id"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
                if held and (now != name or len(held) == PIECE):
                    rows.append((name, held[0], ",".join(map(str, held))))
                    held = []
                name = now
                held.append(conv)
            if len(rows) > 1000:
                yield out(rows)
                rows = []
        if held:
            rows.append((name, held[0], ",".join(map(str, held))))
        if rows:
            yield out(rows)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
            names, found = zip(*rows, strict=True)
            return pa.record_batch([pa.array(names, pa.binary()), pa.array(found)], ["id", "ends_sha256"])

        name, digest, rows = None, None, []
        for batch in batches:
            for now, piece in zip(batch["id"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                if now == name:
                    digest.update(b"," + piece.encode())
                    continue
                if name is not None:
                    rows.append((name, digest.hexdigest()))
                name, digest = now, hashlib.sha256(piece.encode())
            if len(rows) > 1000:
                yield out(rows)
                rows = []
        if name is not None:
            rows.append((name, digest.hexdigest()))
        if rows:
            yield out(rows)

    parts = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id binary, first long, piece string")
    return parts.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashes, "id binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Nodes of the trie of conversations: turns (conv_id, at, id, size) and convs (conv_id, turns), as ``forked`` gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and id.
    """
    rows = written(_segments(turns, convs, segment), "trie-keys")
    keys = rows.groupBy("place", "seg", "key").agg(
        F.first("sizes").alias("sizes"), F.first("end").alias("end"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")
    )
    nodes = written(_nodes(keys, segment), "trie-nodes")
    columns = ["id", F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")]
    merged = written(_merged(nodes.filter("open")), "trie-open")
    above = merged.select(F.col("id").alias("parent"), F.col("least").alias("parent_conv_id"))
    whole = nodes.filter("not open")
    out = whole.filter("parent is null").select(columns)
    out = out.unionByName(whole.filter("parent is not null").drop("parent_conv_id").join(above, "parent").select(columns))
    out = out.unionByName(merged.join(above, "parent", "left").select(columns))
    digests = _digests(rows.filter("last").select(F.col("end").alias("id"), "conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.join(digests, "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
