"""Trie nodes against a plain grouping of prefixes; node layouts of the tree."""

import hashlib
import random
import zlib
from array import array
from collections import defaultdict

import pytest
from pulsepanel.llm import prefix_trie as pt
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    # names that the operator uses itself or returns
    T.StructField("key", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("depth", T.StringType()), T.StructField("t", T.StringType())])


def make(spark, rows):
    return spark.createDataFrame([(*r, "k", "p", "d", "t") for r in rows], SCHEMA)


def plain_keys(rows):
    """Conversation -> list of (role, text) in order."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}


def plain_graft(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain_nodes(convs):
    """The rows by their definition."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in cs if len(convs[c]) == len(node))
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids),
                 len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def columns(df):
    return df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                     "saved_tokens", "ends_sha256")


def check(df, convs):
    got = [tuple(r) for r in columns(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_nodes(convs)


ODD = [
    (0, 0, "user", "hello"), (0, 1, "assistant", "hi"), (0, 2, "user", "bye"),
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"),
    (2, 0, "user", "hello"), (2, 1, "assistant", "hi"), (2, 2, "user", "bye"),
    (3, None, None, None), (3, 0, "user", ""), (3, 0, "user", ""), (3, 0, "", "user"),
    (4, 5, "user", "é" * 1000), (4, 5, "assistant", "naïve"), (4, -3, "system", "x"),
    (None, 0, "user", "lost"), (None, None, None, None),
    (-7, 0, "user", "hello"), (-5, 0, "user", "hello"), (-5, 1, "user", "more"),
    (11, 0, "user:", "a"), (12, 0, "user", ":a"), (13, 0, "user", "x" * 70_000),
    (10**15, 0, "user", "hello"), (10**15 + 1, 3, "user", "only its fourth"),
    *[(20, i, "user", "again") for i in range(40)], *[(25, i, "user", "again") for i in range(37)],
]


@pytest.mark.parametrize("at_once", [200_000, 3])
def test_odd_rows(spark, monkeypatch, at_once):
    monkeypatch.setattr(pt, "TURNS_AT_ONCE", at_once)
    df = make(spark, ODD)
    check(pt.conversation_trie(df), plain_keys(ODD))
    check(pt.prefix_trie(pt.graft_keys(pt.conversation_keys(df))), plain_graft(plain_keys(ODD)))


@pytest.mark.parametrize("at_once", [200_000, 40, 7])
def test_ranges_do_not_change_the_nodes(spark, monkeypatch, at_once):
    """Hot first turns, large groups of copies, and copies that one range cuts."""
    monkeypatch.setattr(pt, "TURNS_AT_ONCE", at_once)
    rng = random.Random(5)
    rows = []
    for c in range(160):
        if c % 3 == 0:
            turns = ["hot", "same", "copy"][:rng.choice([3, 3, 3, 2])]
        else:
            turns = ["hot"] * (c % 2) + [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    check(pt.conversation_trie(make(spark, rows)), plain_keys(rows))


def test_empty_keys_end_at_the_root(spark):
    keys = spark.createDataFrame([(3, b""), (1, b""), (2, b"a" * 16 + b"\0\0\0\5")], "conv_id long, key binary")
    got = {(r.conv_id, r.depth): r for r in pt.prefix_trie(keys).collect()}
    root = got[1, 0]
    assert (root.n_convs, root.n_children, root.n_leaves, root.saved_tokens) == (3, 1, 1, 0)
    assert root.ends_sha256 == hashlib.sha256(b"1,3").hexdigest() and (2, 1) in got and len(got) == 2


def test_no_rows(spark):
    assert pt.conversation_trie(make(spark, [])).count() == 0


def test_layouts_grow_and_paths_are_split():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=pt.WIDTH * rng.randrange(0, 4))) for _ in range(500)}
    keys |= {bytes([7] * 39 + [b]) for b in range(256)}  # one full node below a long path
    keys |= {bytes([9] * 19 + [b]) for b in range(40)}
    root = None
    for key in rng.sample(sorted(keys), len(keys)):
        root = pt.insert(root, key, (key, array("q", [1])))
    seen, rooms = set(), set()
    stack = [(root, b"")]
    while stack:
        node, before = stack.pop()
        at = before + node.path
        if node.ends is not None:
            assert node.ends[0] == at
            seen.add(at)
        kids = list(node.children())
        assert len(kids) == len(node.kids) - node.kids.count(None) <= node.room
        assert node.ends is not None or len(kids) > 1 or not at  # paths are compressed
        rooms.add(node.room)
        stack += [(kid, at + bytes([b])) for b, kid in kids]
        assert all(node.find(b) is kid for b, kid in kids)
    assert seen == keys and rooms == {4, 16, 48, 256}


def test_a_very_deep_path_needs_no_recursion():
    key = b"".join(hashlib.sha256(b"%d" % i).digest()[:16] + b"\0\0\0\1" for i in range(5000))
    rows = list(pt.range_nodes([(key[:2000 * 20], array("q", [1])), (key, array("q", [0]))], -1, -1))
    assert len(rows) == 5001 and max(r[4] for r in rows) == 5000
    assert next(r for r in rows if r[4] == 0)[9] == 2000
