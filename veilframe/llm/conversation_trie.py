"""Prefix trie of conversations by a splitter skeleton.

Every conversation is a path of turns. Paths are dealt out in ranges of (path, conversation), so all members of a trie node lie in
neighbouring ranges, and only a node that holds both the last path of a range and the first path of the next one is split. These split
nodes are the skeleton: the prefixes that every two neighbouring ranges share, one cut path a range. The skeleton's trie is broadcast; every
range, sorted, finishes all its other nodes in one pass with a stack as deep as the path, and gives partial aggregates of the skeleton nodes
it touches. These are added up by reduction, subtrees of the skeleton by running sums over its nodes in preorder. A path that very many
conversations share is cut by conversation, so its copies lie in several ranges too.

A turn is a fingerprint of 128 bits of role and text, so texts are read once and never moved: a turn is 44 bytes in the first shuffle
and 20 bytes after it. The digest of the conversations that end in a node is a chain by its definition: ranges send the ids of split nodes as
blocks of text, and one task a node runs through them in order, in bounded memory.

Sizes: a conversation is a row of 20 bytes a turn and must fit a task; the broadcast holds one path a range at most, cut where the ranges part; a
task keeps the closed children (80 bytes each) of the nodes on its stack.

Defined cases: null role or text is empty; null turns come first; rows of one turn number go by role, then by fingerprint, and repeated rows
stay; rows without conv_id belong to no conversation; no conversations give no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veilframe.storage import materialize

WIDTH = 16  #: bytes of a turn in a path
BLOB = 1 << 16  #: bytes of ids sent at a time
ROWS_AT_ONCE = 20_000

NODE, SPLIT, IDS = 0, 1, 2  # kinds of rows that a range gives
PARTS = (
    "kind int, conv_id long, depth long, parent_conv_id long, parent_node long, node long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, size long, digest binary, part int, nr int, ids binary"
)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _TYPES[kind]) for name, kind in (x.split() for x in PARTS.split(", "))])


def paths(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turns, sizes): every conversation's turn fingerprints (hex) and the UTF-8 bytes of their texts, in order."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    print_ = F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 2 * WIDTH)
    each = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), r.alias("role"), print_.alias("p"), F.octet_length(t).alias("s"))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), each.alias("x"))
    lists = rows.groupBy("c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return lists.select("c", F.col("x.p").alias("turns"), F.col("x.s").alias("sizes"))


def branch(own: DataFrame, base: Column, kept: Column, most: int) -> DataFrame:
    """``paths`` rebuilt: the first ``kept`` (at most ``most``) turns of conversation ``base``, then the own ones after as many."""
    heads = own.select(F.col("c").alias("b"), F.slice("turns", 1, most).alias("bt"), F.slice("sizes", 1, most).alias("bs"))
    rows = own.withColumns({"_b": base, "_k": kept.cast("int")}).join(heads, F.col("_b") == F.col("b"), "left")

    def rebuilt(head: str, mine: str) -> Column:
        rest = F.slice(mine, F.col("_k") + 1, F.greatest(F.size(mine), F.lit(1)))
        return F.when(F.col("b").isNull(), rest).otherwise(F.concat(F.slice(head, F.lit(1), F.col("_k")), rest))

    return rows.select("c", rebuilt("bt", "turns").alias("turns"), rebuilt("bs", "sizes").alias("sizes"))


def shared_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    if a[: high * WIDTH] == b[: high * WIDTH]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * WIDTH : middle * WIDTH] == b[low * WIDTH : middle * WIDTH]:
            low = middle
        else:
            high = middle
    return low


class Skeleton:
    """Trie of the cut splitter paths: nodes numbered in preorder, 0 the root."""

    def __init__(self, cuts: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in cuts:
            at = 0
            for i in range(0, len(path), WIDTH):
                turn = path[i : i + WIDTH]
                if (at, turn) not in self.child:
                    self.child[at, turn] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[at, turn]

    def rows(self) -> list[tuple[int, int, int, int]]:
        """(node, parent, last node of its subtree, children in the skeleton)."""
        last, children = list(range(len(self.parent))), [0] * len(self.parent)
        for node in range(len(self.parent) - 1, 0, -1):
            last[self.parent[node]] = max(last[self.parent[node]], last[node])
            children[self.parent[node]] += 1
        return [(n, self.parent[n], last[n], children[n]) for n in range(len(self.parent))]


class _Open:
    """A node on the stack. ``waiting``: its closed children, whose rows need this node's smallest member."""

    __slots__ = ("node", "n", "least", "children", "leaves", "saved", "size", "hash", "ids", "bytes", "nr", "waiting", "digests")

    def __init__(self, node: int, size: int):
        self.node, self.size = node, size
        self.n = self.children = self.leaves = self.saved = self.bytes = self.nr = 0
        self.least = self.hash = None
        self.ids, self.waiting, self.digests = [], array("q"), bytearray()


_EMPTY = hashlib.sha256(b"").digest()


class _Shard:
    def __init__(self, skeleton: Skeleton, part: int):
        self.child, self.part, self.out, self.path = skeleton.child, part, [], None
        self.stack = [_Open(0, 0)]

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        if self.path is not None:
            self.close(shared_turns(self.path, path))
        self.path, stack, child = path, self.stack, self.child
        for d in range(len(stack) - 1, len(sizes)):
            above = stack[-1].node
            node = child.get((above, path[d * WIDTH : (d + 1) * WIDTH]), -1) if above >= 0 else -1
            stack.append(_Open(node, sizes[d]))
        top = stack[-1]
        top.n += 1
        top.least = conv if top.least is None else min(top.least, conv)
        text = str(conv).encode()
        if top.node < 0:
            if top.hash is None:
                top.hash = hashlib.sha256(text)
            else:
                top.hash.update(b"," + text)
            return
        top.ids.append(text)
        top.bytes += len(text) + 1
        if top.bytes > BLOB:
            self.send_ids(top)

    def send_ids(self, top: _Open) -> None:
        if top.ids:
            self.out.append({"kind": IDS, "node": top.node, "part": self.part, "nr": top.nr, "ids": b",".join(top.ids)})
            top.ids, top.bytes, top.nr = [], 0, top.nr + 1

    def close(self, depth: int) -> None:
        """Close all nodes deeper than ``depth``."""
        while len(self.stack) - 1 > depth:
            x, d = self.stack.pop(), len(self.stack)
            up = self.stack[-1] if self.stack else None
            if up is not None:
                up.n += x.n
                up.least = x.least if up.least is None else min(up.least, x.least)
            if x.node >= 0:
                self.send_ids(x)
                self.out.append({"kind": SPLIT, "node": x.node, "conv_id": x.least, "depth": d, "n_convs": x.n, "n_children": x.children, "n_leaves": x.leaves, "saved_tokens": x.saved, "size": x.size})
                continue
            leaves, saved = max(1, x.leaves), x.saved + (x.n - 1) * x.size
            digest = x.hash.digest() if x.hash else _EMPTY
            up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
            self.rows(x, d)
            if up.node >= 0:
                self.out.append({"kind": NODE, "conv_id": x.least, "depth": d, "parent_node": up.node, "n_convs": x.n, "n_children": x.children, "n_leaves": leaves, "saved_tokens": saved, "digest": digest})
            else:
                up.waiting.extend((x.least, x.n, x.children, leaves, saved))
                up.digests += digest

    def rows(self, x: _Open, depth: int) -> None:
        """The rows of the closed children of ``x``."""
        w = x.waiting
        for i in range(len(w) // 5):
            conv, n, children, leaves, saved = w[i * 5 : i * 5 + 5]
            self.out.append({"kind": NODE, "conv_id": conv, "depth": depth + 1, "parent_conv_id": x.least, "n_convs": n, "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "digest": bytes(x.digests[i * 32 : i * 32 + 32])})

    def taken(self) -> Iterator[pa.RecordBatch]:
        out, self.out = self.out, []
        for i in range(0, len(out), ROWS_AT_ONCE):
            yield pa.RecordBatch.from_pylist(out[i : i + ROWS_AT_ONCE], schema=_SCHEMA)


def _finish(batches: Iterator[pa.RecordBatch], skeleton: Skeleton) -> Iterator[pa.RecordBatch]:
    """Rows (c, path, sizes) of one range, sorted, to the rows of its nodes."""
    shard = _Shard(skeleton, TaskContext.get().partitionId())
    for batch in batches:
        for conv, path, sizes in zip(*(column.to_pylist() for column in batch.columns)):
            shard.add(conv, path, sizes)
            if len(shard.out) >= ROWS_AT_ONCE:
                yield from shard.taken()
    if shard.path is not None:
        shard.close(-1)
    yield from shard.taken()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, ids) sorted by node, part and number to one digest a node."""
    node, hash_, nodes, digests = None, None, [], []
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n == node:
                hash_.update(b",")
                hash_.update(ids)
                continue
            if node is not None:
                nodes.append(node)
                digests.append(hash_.digest())
            node, hash_ = n, hashlib.sha256(ids)
    if node is not None:
        nodes.append(node)
        digests.append(hash_.digest())
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(digests, pa.binary())], ["node", "digest"])


def trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every node of the trie of ``conversations`` (c, turns, sizes), as ``paths`` gives them.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens (bytes that members
    share with an earlier one, summed over the subtree), ends_sha256 (of the members that end here). ``ranges``: tasks, the shuffle partitions
    unless given.
    """
    spark = conversations.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = conversations.select("c", F.coalesce(F.unhex(F.array_join("turns", "")), F.lit(b"")).alias("path"), "sizes")
    ranged = materialize(rows.repartitionByRange(n, "path", "c").withColumn("part", F.spark_partition_id()), "paths")
    ends = ranged.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("part").collect()  # a row a range
    cuts = [bytes(b.first)[: shared_turns(bytes(a.last), bytes(b.first)) * WIDTH] for a, b in zip(ends, ends[1:])]
    skeleton = Skeleton(cuts)
    held = spark.sparkContext.broadcast(skeleton)
    dealt = ranged.repartitionById(n, "part").sortWithinPartitions("path", "c").select("c", "path", "sizes")
    parts = materialize(dealt.mapInArrow(lambda it: _finish(it, held.value), PARTS), "trie")
    # the skeleton: one row a node from here on
    split = parts.where(F.col("kind") == SPLIT).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("own_children"),
        F.sum("n_leaves").alias("own_leaves"), F.sum("saved_tokens").alias("own_saved"), F.max("size").alias("size"),
    )
    ids = parts.where(F.col("kind") == IDS).select("node", "part", "nr", "ids").repartition(n, "node").sortWithinPartitions("node", "part", "nr")
    ended = ids.select("node", "ids").mapInArrow(_digest, "node long, digest binary")
    shape = spark.createDataFrame(skeleton.rows(), "node long, parent long, last long, inner long")
    so_far = W.orderBy("node").rowsBetween(W.unboundedPreceding, 0)  # over the skeleton
    children = F.col("own_children") + F.col("inner")
    sums = split.join(shape, "node").join(ended, "node", "left").select(
        "node", "parent", "last", "conv_id", "depth", "n_convs", children.alias("n_children"), "digest",
        (F.col("own_leaves") + (children == 0).cast("long")).alias("leaves"), (F.col("own_saved") + (F.col("n_convs") - 1) * F.col("size")).alias("saved"),
    )
    running = materialize(sums.withColumns({"all_leaves": F.sum("leaves").over(so_far), "all_saved": F.sum("saved").over(so_far)}), "skeleton")
    end = running.select(F.col("node").alias("last"), F.col("all_leaves").alias("to_leaves"), F.col("all_saved").alias("to_saved"))
    above = running.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    whole = running.withColumnRenamed("parent", "parent_node").join(end, "last").join(above, "parent_node", "left").select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("to_leaves") - F.col("all_leaves") + F.col("leaves")).alias("n_leaves"), (F.col("to_saved") - F.col("all_saved") + F.col("saved")).alias("saved_tokens"), "digest",
    )
    local = parts.where(F.col("kind") == NODE).join(above, "parent_node", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "digest"
    )
    digest = F.lower(F.hex(F.coalesce("digest", F.unhex(F.lit(_EMPTY.hex())))))
    return local.unionByName(whole).withColumn("ends_sha256", digest).drop("digest")


def branched_trie(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """``trie`` of the branched conversations: conversation c starts with the first crc32(c) % 9 turns of conversation c - c % 5."""
    own = materialize(paths(turns), "own-paths")
    c = F.col("c")
    return trie(branch(own, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8), ranges)
