"""Conversation prefix trie: adaptive radix trees over turn ids.

A turn is a fixed-width id: 16 bytes of a SHA-256 of its role and text and the
text's length in 4 big-endian bytes.  A conversation's key is the ids of its
turns, one after the other.  Adaptive radix trees hold the keys: inner nodes
have room for 4, 16, 48 or 256 children and grow as they fill, and bytes
without a branch are kept as one path.  Only byte depths that end a turn are
nodes of the trie; a path of many turns gives one node for each of them.

Scale: keys are sorted and cut into ranges of about ``TURNS_AT_ONCE`` turns by
(key, conversation), so copies of one conversation are cut as well, and each
range has a tree of its own.  A trie node that lies in one range is complete
there.  The prefixes that a range shares with its neighbours are known from
the ends of the ranges; only these few nodes are added up afterwards, by the
hash of their key.  Every sum over a subtree is a sum over ranges, because a
node counts as new in its first range and as childless in its last one.
"""

from __future__ import annotations

import hashlib
import math
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.sources.sinks import materialize

#: Bytes of a turn id, and those of its hash.
WIDTH, HASH = 20, 16
#: Turns of one tree, on average.
TURNS_AT_ONCE = 200_000
#: Rows that a task hands on at once.
ROWS_AT_ONCE = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

ROWS = ("kind int, node binary, parent binary, conv_id bigint, depth bigint, parent_conv_id bigint, "
        "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
#: Kinds of rows: a complete node, a part of a shared node, an end at a shared node.
WHOLE, PART, END = 0, 1, 2


# ------------------------------------------------------------------ the tree
class Art:
    """A node of an adaptive radix tree: path, ends and children."""

    __slots__ = ("path", "ends", "room", "index", "kids")

    def __init__(self, path: bytes, ends=None):
        self.path, self.ends = path, ends
        self.room, self.index, self.kids = 4, bytearray(), []

    def find(self, byte: int) -> Art | None:
        if self.room <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.room == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, kid: Art) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room <= 16:
            self.index.append(byte)
            self.kids.append(kid)
        elif self.room == 48:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)
        else:
            self.kids[byte] = kid

    def _grow(self) -> None:
        held = list(self.children())
        self.room = {4: 16, 16: 48, 48: 256}[self.room]
        if self.room == 48:
            self.index = bytearray(256)
            for at, (byte, _) in enumerate(held):
                self.index[byte] = at + 1
            self.kids = [kid for _, kid in held]
        elif self.room == 256:
            self.index, self.kids = bytearray(), [None] * 256
            for byte, kid in held:
                self.kids[byte] = kid

    def children(self):
        """(byte, child) pairs, in no order."""
        if self.room <= 16:
            return zip(self.index, self.kids)
        if self.room == 48:
            return ((byte, self.kids[at - 1]) for byte, at in enumerate(self.index) if at)
        return ((byte, kid) for byte, kid in enumerate(self.kids) if kid is not None)

    def split(self, at: int) -> None:
        """Cuts the path before ``at``: the rest goes to a child."""
        low = Art(self.path[at + 1:], self.ends)
        low.room, low.index, low.kids = self.room, self.index, self.kids
        byte, self.path = self.path[at], self.path[:at]
        self.ends, self.room, self.index, self.kids = None, 4, bytearray(), []
        self.add(byte, low)


def _same(path: bytes, key: bytes, at: int) -> int:
    """Bytes of the path that the key has from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    low, high = 0, min(len(path), len(key) - at)
    while low < high:  # the longest common start, by halving
        mid = (low + high + 1) // 2
        if key.startswith(path[:mid], at):
            low = mid
        else:
            high = mid - 1
    return low


def insert(root: Art | None, key: bytes, ends) -> Art:
    """Adds a key that the tree does not have; returns the root."""
    if root is None:
        return Art(key, ends)
    node, at = root, 0
    while True:
        same = _same(node.path, key, at)
        if same < len(node.path):
            node.split(same)
        at += same
        if at == len(key):
            node.ends = ends
            return root
        kid = node.find(key[at])
        if kid is None:
            node.add(key[at], Art(key[at + 1:], ends))
            return root
        node, at = kid, at + 1


def post_order(root: Art):
    """(node, byte depth above it, key length up to its end) children first;
    without recursion, as a path may be very deep."""
    stack = [(root, -1, len(root.path), False)]
    while stack:
        node, above, end, done = stack.pop()
        if done or not node.kids:
            yield node, above, end
            continue
        stack.append((node, above, end, True))
        for _, kid in node.children():
            stack.append((kid, end, end + 1 + len(kid.path), False))


class Below:
    """What the subtrees below a byte depth add up to."""

    __slots__ = ("n", "least", "kids", "fresh", "leaves", "bytes", "tops", "first", "last", "key")

    def __init__(self):
        self.n, self.least = 0, None
        self.kids = 0  # trie nodes next below, in this range
        self.fresh = 0  # of these, those that no earlier range has
        self.leaves = self.bytes = 0
        self.tops = []  # rows of the trie nodes next below, which lack their parent
        self.first = self.last = False
        self.key = None  # one of the keys below

    def add(self, other: Below) -> None:
        self.n += other.n
        if self.least is None or (other.least is not None and other.least < self.least):
            self.least = other.least
        self.kids += other.kids
        self.fresh += other.fresh
        self.leaves += other.leaves
        self.bytes += other.bytes
        if len(other.tops) > len(self.tops):
            self.tops, other.tops = other.tops, self.tops
        self.tops += other.tops
        self.first |= other.first
        self.last |= other.last
        self.key = self.key or other.key


def range_nodes(groups: list[tuple[bytes, array]], with_prev: int, with_next: int):
    """Rows (as ``ROWS``) of one range of distinct keys in order.

    ``with_prev`` and ``with_next``: turns that the first and last key share
    with the neighbouring range, -1 where there is none.
    """
    root = None
    for key, convs in groups:
        root = insert(root, key, (key, convs))
    first, last = groups[0][0], groups[-1][0]
    done: dict[int, Below] = {}
    for node, above, end in post_order(root):
        sums = Below()
        for _, kid in node.children():
            sums.add(done.pop(id(kid)))
        convs = ()
        if node.ends is not None:
            sums.key, convs = node.ends
            sums.n += len(convs)
            sums.least = convs[0] if sums.least is None else min(sums.least, convs[0])
            sums.first |= sums.key == first
            sums.last |= sums.key == last
        for at in range(end - end % WIDTH, above, -WIDTH):  # turn-aligned depths, deepest first
            depth = at // WIDTH
            ends = convs if at == end else ()
            old = sums.first and depth <= with_prev
            more = sums.last and depth <= with_next
            name = hashlib.sha256(sums.key[:at]).digest()[:HASH] if old or more else None
            size = int.from_bytes(sums.key[max(at - WIDTH + HASH, 0):at], "big")
            sums.bytes += size * (sums.n - (not old))
            sums.leaves += not sums.kids and not more
            row = [PART if name else WHOLE, name, None, sums.least, depth, None, sums.n, sums.fresh,
                   sums.leaves, sums.bytes, None]
            for kid in sums.tops:
                kid[2], kid[5] = name, None if name else sums.least
                yield kid
            if name:
                yield from ([END, name, None, c, *[None] * 7] for c in ends)
            else:
                row[10] = ends_digest(ends)
            sums.tops, sums.kids, sums.fresh = [row], 1, int(not old)
        done[id(node)] = sums
    yield from done.popitem()[1].tops


def ends_digest(convs) -> str:
    return hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest() if len(convs) else NO_ENDS


# ----------------------------------------------------------------- the tables
def conversation_keys(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, key) of every conversation that has an id.

    Turns go in ascending order, null first; equal turn numbers by the hash of
    role and text.  A null role or text is an empty one.  Only turn ids are
    shuffled, 20 bytes a turn.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.substring(F.sha2(F.concat_ws(":", F.octet_length(role), role, text).cast("binary"), 256),
                       1, 2 * HASH)
    size = F.lpad(F.hex(F.octet_length(text)), 2 * (WIDTH - HASH), "0")
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.struct(F.col(turn_col).cast("long").alias("turn"), F.concat(name, size).alias("id")).alias("t"))
    ids = F.transform(F.sort_array(F.collect_list("t")), lambda t: t["id"])
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(ids, "")).alias("key"))


def graft_keys(keys: DataFrame, every: int = 5, spread: int = 9) -> DataFrame:
    """Conversations that begin like another one: the first h turns are those
    of conversation c - c % every, then its own after the first h; h is the
    CRC-32 of the decimal c, modulo ``spread``."""
    c, h = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread
    head = keys.select(F.col("conv_id").alias("_base"),
                       F.substring("key", 1, (spread - 1) * WIDTH).alias("_head")).where(
        F.col("_base") % every == 0)
    own = F.substring(F.col("key"), (h * WIDTH + 1).cast("int"), F.length("key"))
    of_base = F.coalesce(F.substring(F.col("_head"), F.lit(1), (h * WIDTH).cast("int")), F.lit(b""))
    return (keys.join(head, c - c % every == F.col("_base"), "left")
            .select("conv_id", F.concat(of_base, own).alias("key")))


def _shared_turns(a: bytes, b: bytes) -> int:
    return _same(a, b, 0) // WIDTH


def _neighbours(ranges: DataFrame) -> dict[int, tuple[int, int]]:
    """Turns that each range shares with the one before and the one after; one
    row of numbers per range comes to the driver."""
    ends = ranges.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    in_order = Window.orderBy("part")  # one row per range
    pairs = materialize(ends.withColumn("before", F.lag("last").over(in_order)), "trie-range-ends")

    def share(batches):
        for batch in batches:
            got = [-1 if b is None else _shared_turns(b, f) for b, f in
                   zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())],
                                             names=["part", "shared"])

    found = sorted(map(tuple, pairs.select("part", "before", "first")
                       .mapInArrow(share, "part int, shared bigint").collect()))
    after = [s for _, s in found[1:]] + [-1]
    return {part: (shared, nxt) for (part, shared), nxt in zip(found, after)}


def _build(batches, shared):
    """One tree after the other: the rows come by range and key."""
    part, groups, out = None, [], []

    def flush():
        for at in range(0, len(out), ROWS_AT_ONCE):
            columns = zip(*out[at:at + ROWS_AT_ONCE])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)
        out.clear()

    def finish():
        if groups:
            for row in range_nodes(groups, *shared[part]):
                out.append(row)
                if len(out) >= ROWS_AT_ONCE:
                    yield from flush()
            groups.clear()

    for batch in batches:
        for p, key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                yield from finish()
                part = p
            if not groups or groups[-1][0] != key:
                groups.append((key, array("q")))
            groups[-1][1].append(conv)
    yield from finish()
    yield from flush()


_NAMES = [f.split()[0] for f in ROWS.split(", ")]
_TYPES = [{"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}[f.split()[1]]
          for f in ROWS.split(", ")]


def _digests(ends: DataFrame) -> DataFrame:
    """(node, digest) of the ascending ids that end at each shared node; the
    ids of a node are streamed through the hash, which is one sequence."""

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            names, got = [], []
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == node:
                    sha.update(b",%d" % conv)
                    continue
                if node is not None:
                    names.append(node)
                    got.append(sha.hexdigest())
                node, sha = name, hashlib.sha256(b"%d" % conv)
            yield _digest_rows(names, got)
        if node is not None:
            yield _digest_rows([node], [sha.hexdigest()])

    return (ends.select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
            .mapInArrow(digest, "node binary, digest string"))


def _digest_rows(names, got):
    return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(got, pa.string())],
                                      names=["node", "digest"])


def prefix_trie(keys: DataFrame) -> DataFrame:
    """One row per trie node of the keys (conv_id, key), a key a conversation.

    conv_id: the smallest member; depth; parent_conv_id, the parent's (root:
    null); n_convs, n_children, n_leaves (childless nodes below, itself
    included); saved_tokens: text bytes that members beyond the first would
    repeat, over the subtree; ends_sha256 of the ids that end here.  An empty
    key is a member of the root alone; no keys give no nodes.
    """
    keys = materialize(keys, "trie-keys")
    rows, turns = keys.agg(F.count(F.lit(1)), F.sum(F.length("key")) / WIDTH).first()
    ranges = max(1, math.ceil((rows + (turns or 0)) / TURNS_AT_ONCE))
    cut = materialize(
        keys.repartitionByRange(ranges, "key", "conv_id")
        .withColumn("part", F.spark_partition_id()), "trie-ranges")
    shared = _neighbours(cut)
    held = materialize(
        cut.select("part", "key", "conv_id").repartition(ranges, "part")
        .sortWithinPartitions("part", "key", "conv_id")
        .mapInArrow(lambda batches: _build(batches, shared), ROWS), "trie-nodes")
    parts = held.where(F.col("kind") == PART).groupBy("node").agg(
        F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"),
        F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    parts = parts.join(_digests(held.where(F.col("kind") == END)), "node", "left").withColumn(
        "ends_sha256", F.coalesce("digest", F.lit(NO_ENDS))).drop("digest")
    parts = materialize(parts, "trie-shared")
    named = parts.select(F.col("node").alias("parent"), F.col("conv_id").alias("_of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               "ends_sha256"]
    whole = held.where(F.col("kind") == WHOLE)
    hanging = (whole.where(F.col("parent").isNotNull()).drop("node", "kind", "parent_conv_id")
               .unionByName(parts.drop("node"))
               .join(named, "parent", "left").withColumnRenamed("_of", "parent_conv_id"))
    return whole.where(F.col("parent").isNull()).select(columns).unionByName(hanging.select(columns))


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                      role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of a table of turns; see :func:`prefix_trie`.

    Rows without a conversation id belong to no conversation.  Rows that
    repeat a turn are turns of their own.  A conversation is a key of 20 bytes
    a turn, whatever its texts; one of over 100 million turns does not fit.
    """
    return prefix_trie(conversation_keys(turns, conv_col, turn_col, role_col, text_col))
