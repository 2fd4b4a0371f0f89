"""The trie of conversation prefixes, built from adaptive radix trees over slices of the sorted conversations.

A turn's id is the first 16 bytes of a digest of its role and text, so a conversation is a byte string of big-endian
ids of fixed width. Conversations are dealt out in key order (equal ones by ``conv_id``), so neither a common first
turn nor a conversation that a third of all rows repeat fills a slice. Each slice is one adaptive radix tree.

A trie node is a stretch of neighbouring keys. Nodes inside one slice are finished there. Others are prefixes of the
key before or after their slice; each slice gets these two keys, which tell which of its nodes began earlier or go on
later, so that every figure is a sum (or minimum) of parts that count each node once. Only the parts of such nodes,
at most two keys' prefixes a slice, are shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructType

from applause.session import cut_lineage

from .packing import give_back

WIDTH = 16  # bytes of a turn's id
SLICE_BYTES = 8 << 20  # of keys that one tree holds
WORD = r"[^\x20\x09-\x0D]+"
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Node:
    """An inner node or a leaf: the bytes above it, the conversations that end here and its children.

    The layout of the children grows with their number: up to 4 and up to 16 byte keys kept sorted beside their
    children, up to 48 children behind an index of 256 places, and 256 places of their own.
    """

    __slots__ = ("prefix", "ends", "layout", "keys", "children")

    def __init__(self, prefix: bytes):
        self.prefix, self.ends = prefix, []
        self.layout, self.keys, self.children = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.layout == 48:
            at = self.keys[byte]
            return self.children[at - 1] if at else None
        return self.children[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child or replace the one of this byte."""
        if self.layout <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.children[at] = node
                return
            if len(self.keys) < self.layout:
                self.keys.insert(at, byte)
                self.children.insert(at, node)
                return
        elif self.layout == 48:
            at = self.keys[byte]
            if at:
                self.children[at - 1] = node
                return
            if len(self.children) < 48:
                self.children.append(node)
                self.keys[byte] = len(self.children)
                return
        else:
            self.children[byte] = node
            return
        self.grow()
        self.put(byte, node)

    def grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for at, byte in enumerate(self.keys):
                index[byte] = at + 1
            self.layout, self.keys = 48, index
        else:
            places: list[Node | None] = [None] * 256
            for byte in range(256):
                if self.keys[byte]:
                    places[byte] = self.children[self.keys[byte] - 1]
            self.layout, self.keys, self.children = 256, bytearray(), places

    def nodes(self) -> list[Node]:
        """Children in key order."""
        if self.layout == 48:
            return [self.children[at - 1] for at in self.keys if at]
        return [c for c in self.children if c is not None]


class RadixTree:
    """Keys with the value of each of their occurrences."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.ends.append(value)
                return
            below = node.child(key[at])
            if below is None:
                leaf = Node(key[at:])
                leaf.ends.append(value)
                node.put(key[at], leaf)
                return
            own = below.prefix
            if key.startswith(own, at):
                node, at = below, at + len(own)
                continue
            same = shared(own, key[at : at + len(own)])
            upper = Node(own[:same])
            below.prefix = own[same:]
            upper.put(own[same], below)
            node.put(key[at], upper)
            node, at = upper, at + same


def shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:  # bytes compare in one call, so halve instead of walking
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def trie_nodes(rows: list[tuple[bytes, int, list[int]]], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Trie nodes of a slice: ``(path, parent path, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, words, ends)``.

    ``rows`` are ``(key, conv_id, words of each turn)``; ``before`` and ``after`` are the keys next to the slice. Paths are
    given where the node (or its parent) is also part of another slice; the figures of such a node are its parts.
    """
    tree = RadixTree()
    for key, conv, words in rows:
        tree.insert(key, (conv, words))
    earlier = -1 if before is None else shared(before, rows[0][0])  # prefixes up to this length began before the slice
    later = -1 if after is None else shared(after, rows[-1][0])  # and up to this length go on after it
    first, last = rows[0][0], rows[-1][0]

    # key order; a node comes before its children, and its figures are summed when they are done
    todo: list[tuple[Node, bytes, bool]] = [(tree.root, b"", False)]
    sums: dict[int, tuple] = {}
    while todo:
        node, above, done = todo.pop()
        if not done:
            todo.append((node, above, True))
            whole = above + node.prefix
            todo.extend((c, whole, False) for c in node.nodes())
            continue
        key = above + node.prefix
        below = [sums.pop(id(c)) for c in node.nodes()]
        n = len(node.ends) + sum(b[0] for b in below)
        least = min([c for c, _ in node.ends] + [b[1] for b in below])
        words = node.ends[0][1] if node.ends else below[0][2]  # of any member: the turns down to here are the same
        # children whose parent lies at this byte depth, all parents known by now
        children, leaves, saved = 0, 0, 0
        waiting: list[list] = []
        for b in below:
            children, leaves, saved = children + b[3], leaves + b[4], saved + b[5]
            waiting.extend(b[6])
        depths = [d for d in range(len(key) // WIDTH, -1, -1) if d * WIDTH > len(above) or (d == 0 and not above and node is tree.root)]
        for d in depths:
            prefix = key[: d * WIDTH]
            began, goes_on = earlier >= len(prefix) and first.startswith(prefix), later >= len(prefix) and last.startswith(prefix)
            ends = sorted(c for c, _ in node.ends) if len(prefix) == len(key) else []
            own_words = words[d - 1] if d else 0
            if not waiting and not goes_on:
                leaves += 1
            saved += (n - (not began)) * own_words
            path = path_of(prefix) if began or goes_on else None
            for record in waiting:
                record[1], record[4] = (path, None) if path else (None, least)
                yield tuple(record)
            record = [path, None, least, d, None, n, children, leaves, saved, own_words, ends]
            waiting = [record]
            children = 0 if began else 1
        sums[id(node)] = (n, least, words, children, leaves, saved, waiting)
    for record in sums[id(tree.root)][6]:
        yield tuple(record)


def path_of(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


def turn_id(role: Column, text: Column) -> Column:
    """32 hex digits that tell turns apart."""
    return F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), F.lit(2 * WIDTH))


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns``: the ids and word counts of each conversation's turns in order, the texts left behind.

    Turns are ordered by ``turn``, null first, equal ones by id. Null roles and texts are empty; rows without a
    conversation are left out. Repeated rows are turns of their own.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("bigint").alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("known"), F.coalesce(F.col(turn).cast("bigint"), F.lit(0)).alias("turn"),
            turn_id(who, said).alias("id"), F.regexp_count(said, F.lit(WORD)).alias("words"),
        ).alias("said"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("said")).alias("said")).select(
        "conv_id", F.transform("said", lambda x: F.struct(x["id"].alias("id"), x["words"].alias("words"))).alias("turns")
    )


def build(sequences: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The nodes of the trie of ``sequences`` (``conv_id, turns``, ids of ``turn_id``, one row a conversation).

    One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. No
    conversations give no rows. A conversation and the ids of all that end at one node are values of one row.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), ""))
    keyed = cut_lineage(sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda x: x["words"]).alias("words")))
    size = keyed.agg(F.sum(F.length("key") + 64)).first()[0] or 0
    n = max(keyed.sparkSession.sparkContext.defaultParallelism, size // slice_bytes + 1)
    sliced = cut_lineage(keyed.repartitionByRange(n, "key", "conv_id").withColumn("slice", F.spark_partition_id()))
    edges = sliced.groupBy("slice").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    order = Window.orderBy("slice")  # one row a slice
    edges = edges.select("slice", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("after"))

    schema = (
        StructType().add("path", BinaryType()).add("parent", BinaryType()).add("conv_id", LongType()).add("depth", IntegerType())
        .add("parent_conv_id", LongType()).add("n_convs", LongType()).add("n_children", LongType()).add("n_leaves", LongType())
        .add("saved_tokens", LongType()).add("words", LongType()).add("slice", IntegerType()).add("ends", StringType())
        .add("ends_sha256", StringType())
    )
    columns = {"path": pa.binary(), "parent": pa.binary(), "depth": pa.int32(), "slice": pa.int32(), "ends": pa.string(), "ends_sha256": pa.string()}
    kinds = [columns.get(name, pa.int64()) for name in schema.names]

    def work(given: pa.Table, beside: pa.Table) -> pa.Table:
        rows = sorted(zip(*(given.column(c).to_pylist() for c in ("key", "conv_id", "words"))))
        if not rows:
            return pa.table([pa.array([], k) for k in kinds], schema.names)
        number = given.column("slice")[0].as_py()
        out = []
        for path, parent, conv, depth, parent_conv, convs, children, leaves, saved, words, ends in trie_nodes(
            rows, beside.column("before")[0].as_py(), beside.column("after")[0].as_py()
        ):
            spelt = ",".join(map(str, ends))
            digest = (hashlib.sha256(spelt.encode()).hexdigest() if ends else NO_ENDS) if path is None else None
            out.append((path, parent, conv, depth, parent_conv, convs, children, leaves, saved, words, number,
                        spelt if path is not None and ends else None, digest))
        del rows
        give_back()
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], schema.names)

    found = cut_lineage(sliced.groupBy("slice").cogroup(edges.groupBy("slice")).applyInArrow(work, schema))
    pieces = F.array_sort(F.collect_list(F.when(F.col("ends").isNotNull(), F.struct("slice", "ends"))))
    parts = found.filter("path is not null")
    whole = parts.groupBy("path").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), pieces.alias("pieces"),
    )
    digest = F.sha2(F.array_join(F.transform("pieces", lambda x: x["ends"]), ",").cast("binary"), 256)
    figures = ["conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = cut_lineage(whole.withColumn("ends_sha256", digest).drop("pieces"))
    tops = whole.select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    mine = ["parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    open_ones = whole.select(mine).unionByName(found.filter("path is null and parent is not null").select(mine))
    named = open_ones.join(tops, "parent", "left")  # the root has no parent
    return found.filter("path is null and parent is null").select(figures).unionByName(named.select(figures))
