"""N-gram Jaccard join by size-banded tiles with hashed bitmap signatures.

1. Every document becomes its sorted array of 64-bit shingle hashes.  Equal
   sets are one class, which is compared once.
2. Keys: shingles are ordered by how many documents' sets fall into their
   hash bucket; linked sets share one of their rarest members (prefixes).  A
   key holds the size band, as linked sets lie in one band or in two that are
   next to each other.  Classes that share a key meet.
3. Signatures: the parity bitmap of a set (each shingle flips one bit) gives a
   lower bound of the difference of two sets, that is an upper bound of their
   overlap.  Of the classes that meet, only those that it cannot exclude are
   joined into blocks; no linked pair is outside a block, and sets that merely
   share a passage do not widen one.
4. Tiles: a block is cut into bands of set sizes and a band by a hash into
   parts of bounded content; a tile compares two parts of one band or of two
   neighbouring ones.  Pairs that the bitmaps do not exclude are intersected
   exactly over the sorted arrays of their members.
5. Links of all tiles are joined into components of classes, and classes hand
   them to their documents.

Scale: the text is read three times and never grouped; full sets are written
for members of blocks alone.  Keys travel as packed arrays.  A key that more
than ``MEETING`` documents can hold goes another way, where its classes are
cut into parts and meet tile by tile.  Tiles and meetings have bounded content,
and pairs are never rows: they return one row per class.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import discard, type_of, with_row_key
from pulsepanel.llm.components import connected_components
from pulsepanel.sources.sinks import materialize

#: Shingles in a part of a block (a set counts for 128 at least); a tile holds
#: two parts.
PART_SHINGLES = 1 << 19
#: Classes that meet at one key at once; a key of more is cut into parts.
MEETING = 4096
#: Keys that are matched in one group, on average.
KEYS_AT_ONCE = 1 << 20
#: Rows of a side that is broadcast at most (40 bytes each).
BROADCAST_ROWS = 200_000
CACHE_WORDS = 150_000
#: Buckets of the document counts that order the shingles (a power of two), and
#: the blocks that they are sent in.
BUCKETS, COUNT_BLOCKS = 1 << 20, 64
#: Texts that a task turns into sets at once.
TEXTS_AT_ONCE = 1000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ALL = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place on a copy)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: bytes, size: int, words: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a UTF-8 text; a
    text of fewer words is one shingle, one without words has none."""
    parts = text.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = max(1, len(parts) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(parts))):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[i:i + n]
    if len(parts) < size:
        out += np.uint64(len(parts))
    return np.unique(_mix(out))


@dataclass(frozen=True)
class Link:
    """Two sets link when ``den * intersection >= num * union``."""

    num: int
    den: int

    def band(self, size: int) -> int:
        """Band of a set size; a partner lies in the same band or the next."""
        return math.floor(math.log(size) / (2 * math.log(self.den / self.num)) + 1e-9)


def prefix_keys(shingles: np.ndarray, counts: np.ndarray, link: Link) -> np.ndarray:
    """The rarest shingles of a set, as many as a partner must not all miss.

    A partner holds at least ``num / den`` of the set, so of two linked sets
    the first ``n - ceil(n * num / den) + 1`` members in one common order have
    a member in common.  The order is by bucket count, then by hash.  A key is
    a shingle with a size band: the set's own, and the next one if a partner
    can be there."""
    return _prefix(shingles, counts, link)[0]


def _prefix(shingles: np.ndarray, counts: np.ndarray, link: Link) -> tuple[np.ndarray, np.ndarray]:
    """:func:`prefix_keys` with the bucket count of each key's shingle."""
    n = len(shingles)
    keep = n - -(-n * link.num // link.den) + 1
    rank = counts[shingles & np.uint64(len(counts) - 1)]
    order = np.argsort(rank, kind="stable")[:keep]
    rare = shingles[order]
    bands = range(link.band(n), link.band(n * link.den // link.num) + 1)
    keys = [_mix(rare + np.uint64(b * int(_M1) & _ALL)) for b in bands]
    return np.concatenate(keys), np.tile(rank[order], len(bands))


def shingle_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents' sets fall into each of ``BUCKETS`` hash buckets: the
    order of the prefixes, of a fixed size.  Frequent shingles (lines and
    passages that many documents share) come late in it."""
    width = BUCKETS // COUNT_BLOCKS

    def count(batches):
        words, total, held, waiting = WordHash(), np.zeros(BUCKETS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                held.append(shingle_set(text.as_py() or b"", size, words) & np.uint64(BUCKETS - 1))
                waiting += len(held[-1])
                if waiting >= BUCKETS:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
                    held, waiting = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COUNT_BLOCKS), pa.int64()),
             pa.array([b.tobytes() for b in total.reshape(COUNT_BLOCKS, width)], pa.binary())],
            names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, np.int64)
        for part in table.column("counts"):
            total += np.frombuffer(part.as_py(), np.int64)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    sums = (rows.select("text").mapInArrow(count, "block bigint, counts binary")
            .groupBy("block").applyInArrow(add, "block bigint, counts binary").collect())
    counts = np.zeros((COUNT_BLOCKS, width), np.int64)
    for r in sums:
        counts[r.block] = np.frombuffer(r.counts, np.int64)
    return counts.reshape(-1)


def signature(shingles: np.ndarray) -> bytes:
    """Parity bitmap of a set, of two bits a member at least (a power of two)."""
    bits = 64
    while bits < 2 * len(shingles):
        bits *= 2
    return parity_bitmaps([shingles], bits)[0].tobytes()


def _fold(marks: np.ndarray, words: int) -> np.ndarray:
    """A parity bitmap as one of fewer bits."""
    while len(marks) > words:
        marks = marks[:len(marks) // 2] ^ marks[len(marks) // 2:]
    return marks


def _documents(rows: DataFrame, size: int, link: Link, common) -> DataFrame:
    """(id, _row, n_shingles, digest, sign, keys, often) of each document.
    ``common`` is the broadcast order of the shingles; ``often`` are the keys
    that more than ``MEETING`` documents can hold."""
    meeting = MEETING

    def make(batches):
        words, counts = WordHash(), common.value
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_AT_ONCE):
                batch = whole.slice(at, TEXTS_AT_ONCE)
                out = [[], [], [], [], []]
                for text in batch.column(2).cast(pa.binary()):
                    s = shingle_set(text.as_py() or b"", size, words)
                    row = [len(s), None, None, [], []]
                    if len(s):
                        keys, held = _prefix(s, counts, link)
                        keys = keys.view(np.int64)
                        row[1:] = (hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s),
                                   keys[held <= meeting], keys[held > meeting])
                    for column, value in zip(out, row):
                        column.append(value)
                types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(out, types)]],
                    names=["id", "_row", "n_shingles", "digest", "sign", "keys", "often"])

    return rows.mapInArrow(make, f"id {type_of(rows, 'id')}, _row bigint, n_shingles bigint, digest binary, "
                                 "sign binary, keys array<bigint>, often array<bigint>")


# A class is named by 8 bytes of its digest in the meetings; two classes of one
# name are looked up together there and told apart by their digests later.
_NAME = "node"


def _node() -> F.Column:
    return F.xxhash64("digest").alias(_NAME)


def _light_groups(docs: DataFrame) -> DataFrame:
    """(meeting, node): classes that share a key of few documents.  Keys of one
    set of classes make one meeting."""
    total = docs.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    buckets = 16
    while buckets * KEYS_AT_ONCE < total:
        buckets *= 2

    def pack(batches):
        for batch in batches:
            lists = batch.column(1)
            keys = lists.flatten().to_numpy()
            nodes = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
            bucket = _mix(keys.view(np.uint64)) & np.uint64(buckets - 1)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(at))
            cut = lambda x: [x[order[at[b]:at[b + 1]]].tobytes() for b in full]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int64)), pa.array(cut(keys), pa.binary()),
                 pa.array(cut(nodes), pa.binary())], names=["bucket", "keys", "nodes"])

    def match(table: pa.Table) -> pa.Table:
        keys, nodes = (np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table.column(c)])
                       for c in ("keys", "nodes"))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])  # copies name one class
        keys, nodes = keys[new], nodes[new]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(starts, len(keys)))
        names = _mix(np.add.reduceat(_mix(nodes.view(np.uint64)), starts) + sizes.astype(np.uint64))
        _, firsts = np.unique(names, return_index=True)
        kept = np.zeros(len(starts), bool)
        kept[firsts] = True
        several = np.repeat(kept & (sizes > 1), sizes)
        return pa.table({"meeting": np.repeat(names, sizes)[several].view(np.int64), "node": nodes[several]})

    return (docs.where(F.size("keys") > 0).select(_node(), "keys")
            .mapInArrow(pack, "bucket bigint, keys binary, nodes binary")
            .groupBy("bucket").applyInArrow(match, "meeting bigint, node bigint").distinct()
            .select("meeting", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"),
                    F.lit(0).alias("side"), "node"))


def _heavy_groups(docs: DataFrame) -> DataFrame:
    """(meeting, i, j, side, node): the classes of each key that many documents
    hold, in parts of about ``MEETING``; a tile compares parts i and j."""
    held = materialize(docs.select(_node(), F.explode("often").alias("meeting")).distinct(), "heavy-keys")
    parts = held.groupBy("meeting").agg(F.ceil(F.count(F.lit(1)) / MEETING).alias("k"), F.count(F.lit(1)).alias("m"))
    cut = (held.join(materialize(parts.where("m > 1"), "heavy-parts"), "meeting")
           .withColumn("p", F.pmod(F.xxhash64("node"), F.col("k"))))
    p = F.col("p")
    tiles = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda q: F.when(
        q >= p, F.struct(p.alias("i"), q.alias("j"), F.lit(0).alias("side")))
        .otherwise(F.struct(q.alias("i"), p.alias("j"), F.lit(1).alias("side"))))
    return (cut.withColumn("t", F.explode(tiles))
            .select("meeting", F.col("t.i").cast("long").alias("i"), F.col("t.j").cast("long").alias("j"),
                    F.col("t.side").alias("side"), "node"))


def meeting_roots(n: np.ndarray, signs: list[bytes], link: Link) -> np.ndarray:
    """For each set of a meeting the first one that it is joined with, over pairs
    that size and bitmap do not exclude."""
    words = min(map(len, signs)) // 8
    marks = np.stack([_fold(np.frombuffer(s, np.uint64), words) for s in signs])
    root = np.full(len(n), -1)
    left = np.arange(len(n))
    while len(left):
        first, left = left[0], left[1:]
        root[first] = first
        front = [first]
        while front and len(left):
            x = front.pop()
            small, big = np.minimum(n[x], n[left]), np.maximum(n[x], n[left])
            most = (n[x] + n[left]) * (link.den - link.num) // (link.den + link.num)
            hit = (link.den * small >= link.num * big) & (
                np.bitwise_count(marks[left] ^ marks[x]).sum(axis=1, dtype=np.int64) <= most)
            root[left[hit]] = first
            front += left[hit].tolist()
            left = left[~hit]
    return root


def _meet(groups: DataFrame, classes: DataFrame, link: Link) -> DataFrame:
    """Edges (a, b) between classes that meet and that their bitmaps do not
    keep apart, as a forest per meeting."""
    seated = groups.join(classes.select(_node(), "rep", "n", "sign"), "node")

    def roots(rows):
        """Edges of whole meetings, given as (rep, n, sign) columns and bounds."""
        reps, n, signs, bounds = rows
        a, b = [], []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if high - low > 1:
                found = meeting_roots(n[low:high], signs[low:high], link)
                other = np.flatnonzero(found != np.arange(high - low))
                a.append(reps[low + other])
                b.append(reps[low + found[other]])
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(a)), pa.array(join(b))], names=["a", "b"])

    def compare(batches):
        held = None  # the last meeting of a batch may go on in the next
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            tile = np.stack([table.column(c).to_numpy() for c in ("meeting", "i", "j")])
            starts = np.flatnonzero(np.append(True, (tile[:, 1:] != tile[:, :-1]).any(axis=0)))
            last = int(starts[-1])
            done = table.slice(0, last)
            held = table.slice(last)
            if last:
                yield roots((done.column("rep").to_numpy(), done.column("n").to_numpy(),
                             done.column("sign").to_pylist(), starts))
        if held is not None:
            yield roots((held.column("rep").to_numpy(), held.column("n").to_numpy(),
                         held.column("sign").to_pylist(), np.array([0, held.num_rows])))

    return (seated.select("meeting", "i", "j", "rep", "n", "sign").repartition("meeting", "i", "j")
            .sortWithinPartitions("meeting", "i", "j").mapInArrow(compare, "a bigint, b bigint").distinct())


def _tiles(members: DataFrame, link: Link) -> DataFrame:
    """Members (block, rep, n, size, set) once for each tile they take part in.

    A band of a block has ``k = ceil(content / PART_SHINGLES)`` parts by hash;
    a tile is a pair of parts of one band or of two neighbouring ones.
    """
    # Bands by the logarithm of the size, so partners are at most one apart.
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit((link.den / link.num) ** 2)) + 1e-9)
    inside = members.withColumn("band", band.cast("long"))
    parts = materialize(
        inside.groupBy("block", "band").agg(
            F.ceil(F.sum(F.greatest("n", F.lit(128))) / PART_SHINGLES).alias("k")), "block-parts")
    near = lambda shift, name: parts.select(
        "block", (F.col("band") + shift).alias("band"), F.col("k").alias(name))
    inside = (inside.join(parts, ["block", "band"]).join(near(-1, "k_up"), ["block", "band"], "left")
              .join(near(1, "k_down"), ["block", "band"], "left")
              .withColumn("p", F.pmod(F.xxhash64("rep"), F.col("k"))))

    def place(b, i, j, side, cross):
        return F.struct(b.cast("long").alias("band"), i.cast("long").alias("i"),
                        j.cast("long").alias("j"), F.lit(side).alias("side"),
                        F.lit(cross).alias("cross"))

    p, b = F.col("p"), F.col("band")
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda q: F.when(
        q >= p, place(b, p, q, 0, False)).otherwise(place(b, q, p, 1, False)))
    upto = lambda k: F.sequence(F.lit(0).cast("long"), F.col(k) - 1)
    up = F.when(F.col("k_up").isNotNull(),
                F.transform(upto("k_up"), lambda q: place(b, p, q, 0, True)))
    down = F.when(F.col("k_down").isNotNull(),
                  F.transform(upto("k_down"), lambda q: place(b - 1, q, p, 1, True)))
    none = F.array().cast("array<struct<band:bigint,i:bigint,j:bigint,side:int,cross:boolean>>")
    tiles = F.concat(own, F.coalesce(up, none), F.coalesce(down, none))
    return inside.withColumn("t", F.explode(tiles)).select(
        *members.columns, "t.band", "t.i", "t.j", "t.side", "t.cross")


def parity_bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """One bitmap per set; each member flips the bit that it hashes to."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets):
        flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        row[:] = np.packbits(flips.astype(bool))
    return out.view(np.uint64)


class SortedSets:
    """Sets of a tile as one array of the ranks of their members, for exact
    intersections of one set with many; its size is that of the tile."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        values, self.ranks = np.unique(flat, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        self.mine = np.zeros(len(values), bool)

    def common(self, i: int, others: np.ndarray) -> np.ndarray:
        """Members that set ``i`` has in common with each of ``others``."""
        at, ranks = self.at, self.ranks
        own = ranks[at[i]:at[i + 1]]
        self.mine[own] = True
        low, high = at[others], at[others + 1]
        size = high - low
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        spot = np.arange(size.sum()) + np.repeat(low - starts, size)
        out = np.add.reduceat(self.mine[ranks[spot]], starts, dtype=np.int64)
        self.mine[own] = False
        return out


def compare_tile(rep: np.ndarray, weight: np.ndarray, side: np.ndarray, sets: list[np.ndarray],
                 two: bool, link: Link) -> tuple[np.ndarray, np.ndarray]:
    """(root, links) of each set of a tile: all pairs of one part, or, with
    ``two``, the pairs across two parts.  ``links`` counts linked sets by
    their class's documents."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    n = np.array([len(sets[i]) for i in order], np.int64)
    sets = [sets[i] for i in order]
    side, w, ids = side[order], weight[order], rep[order]
    bits = 64
    while bits < 2 * int(n.max()):
        bits *= 2
    marks, exact = parity_bitmaps(sets, bits), SortedSets(sets)
    label = np.arange(len(sets))
    links = np.zeros(len(sets), np.int64)
    for i in range(len(sets) - 1):
        # den * a >= num * b is needed for sizes a <= b
        last = int(np.searchsorted(n, n[i] * link.den // link.num, side="right"))
        j = np.arange(i + 1, last)
        if two:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        most = (n[i] + n[j]) * (link.den - link.num) // (link.den + link.num)
        differ = np.bitwise_count(marks[j] ^ marks[i]).sum(axis=1, dtype=np.int64)
        j = j[differ <= most]
        if not len(j):
            continue
        common = exact.common(i, j)
        j = j[link.den * common >= link.num * (n[i] + n[j] - common)]
        if not len(j):
            continue
        links[i] += w[j].sum()
        links[j] += w[i]
        label[np.isin(label, label[np.append(j, i)])] = label[np.append(j, i)].min()
    roots = np.empty(len(sets), np.int64)
    for value in np.unique(label):
        roots[label == value] = ids[label == value].min()
    back = np.argsort(order, kind="stable")
    return roots[back], links[back]


def _linked(tiles: DataFrame, link: Link) -> DataFrame:
    """(rep, root, links) of every member of every tile."""
    def tile(table: pa.Table) -> pa.Table:
        rep = table.column("rep").to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table.column("set").to_pylist()]
        roots, links = compare_tile(rep, table.column("size").to_numpy(),
                                    table.column("side").to_numpy(), sets,
                                    table.column("cross")[0].as_py()
                                    or table.column("i")[0] != table.column("j")[0], link)
        return pa.table({"rep": pa.array(rep), "root": pa.array(roots), "links": pa.array(links)})

    return tiles.groupBy("block", "band", "i", "j", "cross").applyInArrow(
        tile, "rep bigint, root bigint, links bigint")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
               num: int = 90, den: int = 100, row_col: str | None = None) -> DataFrame:
    """One row per document: id, ``_row`` (key of the physical row; that of
    ``row_col`` where the caller has one),
    ``n_shingles``, ``class_size`` (documents with the same set), ``n_links``,
    ``component_id`` (smallest id that links reach) and ``first`` (whether the
    row is the one of its component that a dedup keeps: smallest id, nulls
    last, then smallest row).

    Two documents link when ``den * intersection >= num * union`` of their
    distinct ``size``-word shingles.  A text of fewer words is one shingle; a
    null or empty text, or one of white space, links with nothing and is its
    own component.  Null ids count as largest; a component of null ids only
    has a null id.  Rows that repeat are documents that link.  An empty table
    gives no rows.  Shingles are compared as 64-bit hashes.
    """
    link = Link(num, den)
    named = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if row_col is None:
        rows = with_row_key(docs.select(*named)).select("id", "_row", "text")
    else:
        rows = docs.select(named[0], F.col(row_col).alias("_row"), named[1])
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(rows, size))
    made = materialize(_documents(rows, size, link, counts).withColumn("rid", F.monotonically_increasing_id()),
                       "shingle-keys")
    counts.unpersist()
    sets = materialize(made.drop("sign", "keys", "often"), "shingle-sets")
    classes = materialize(
        made.where("digest is not null").groupBy("digest")
        .agg(F.min("rid").alias("rep"), F.min("id").alias("low"), F.count(F.lit(1)).alias("size"),
             F.first("n_shingles").alias("n"), F.first("sign").alias("sign"),
             F.min_by(F.struct("id", "_row"), "rid").alias("at")), "shingle-classes")

    # Blocks hold every linked pair; only their members are read again.
    groups = materialize(_light_groups(made).unionByName(_heavy_groups(made)), "meetings")
    edges = materialize(_meet(groups, classes, link), "meeting-edges")
    discard(made, groups)
    blocks = materialize(connected_components(edges), "blocks")
    members = materialize(
        classes.join(blocks, F.col("rep") == F.col("node"))
        .select(F.col("root").alias("block"), "rep", "n", "size", F.col("at.id").alias("mid"),
                F.col("at._row").alias("mrow")), "block-members")
    small = members.count() <= BROADCAST_ROWS
    keyed = F.broadcast(members) if small else members
    texts = rows.join(keyed, (F.col("_row") == F.col("mrow")) & F.col("id").eqNullSafe(F.col("mid")))

    def attach(batches):
        words = WordHash()
        for batch in batches:
            sets = [shingle_set(t.as_py(), size, words).tobytes()
                    for t in batch.column(4).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(sets, pa.binary())],
                names=["block", "rep", "n", "size", "set"])

    sets_of = (texts.select("block", "rep", "n", "size", "text")
               .mapInArrow(attach, "block bigint, rep bigint, n bigint, size bigint, set binary"))
    sets_of = materialize(sets_of, "member-sets")
    found = materialize(_linked(_tiles(sets_of, link), link), "tile-links")
    discard(sets_of)

    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = (classes.select("digest", "rep", "low", "size")
              .join(roots, F.col("rep") == F.col("node"), "left")
              .join(links, "rep", "left")
              .withColumn("root", F.coalesce("root", "rep")))
    groups = materialize(groups.select("digest", "rep", "root", "low", "size", "links"), "class-groups")
    lowest = (groups.where("rep <> root or links > 0").groupBy("root")
              .agg(F.min("low").alias("reach")))
    named = materialize(
        groups.join(lowest, "root", "left")
        .select("digest", "root", "size", F.coalesce("reach", "low").alias("reach"),
                (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")), "class-names")
    out = sets.join(named, "digest", "left")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"),
                     F.col("rid").alias("rid"))
    keepers = materialize(
        out.where("root is not null and (size > 1 or links > 0)").groupBy("root")
        .agg(F.min(first).alias("_f")).select(F.col("root").alias("_root"),
                                              F.col("_f.rid").alias("_keeper")), "keepers")
    out = out.join(keepers, F.col("root") == F.col("_root"), "left")
    return out.select(
        F.col("id").alias(id_col), "_row", "n_shingles", F.coalesce("size", F.lit(1)).alias("class_size"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("reach")).alias("component_id"),
        F.coalesce(F.col("_keeper") == F.col("rid"), F.lit(True)).alias("first"))
