"""Closed syncmers against a plain version of their definition."""

import hashlib
import re
import struct

import pytest
import xxhash
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm import fingerprint as fp
from pyspark.sql import functions as F


def xx(*parts):
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<q", p), h)
    return h - (1 << 64) if h >> 63 else h


UNSPACED = ("\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF"
            "\U00020000-\U0003FFFF")


def units(text):
    return re.findall(f"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,8}}", text)


def anchors(text, k=fp.K, s=fp.S):
    words = units(text)
    inner = [xx(*words[i:i + s]) for i in range(len(words) - s + 1)]
    out = []
    for i in range(len(words) - k + 1):
        part = inner[i:i + k - s + 1]
        if min(part) in (part[0], part[-1]):
            out.append((xx(*part), i))
    return out or ([(xx(" ".join(words)), 0)] if words else [])


def shown(found):
    return " ".join(f"{h & (1 << 64) - 1:016x}@{i}" for h, i in found)


def like(a, b):
    last = max([i for _, i in a[-1:] + b[-1:]], default=0)
    a, b = ({h: i for h, i in reversed(x)} for x in (a, b))
    offsets = sorted(b[h] - a[h] for h in a.keys() & b.keys())
    slack = max(0.25 * (last + fp.K), 4)
    near = sum(abs(o - offsets[len(offsets) // 2]) <= slack for o in offsets)
    return 2 * near / (len(a) + len(b)) if a or b else 1.0


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xx(r[1])))
    out = []
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), shown(anchors(text)),
                    shown(anchors(edited)), like(anchors(text), anchors(edited)),
                    like(anchors(text), anchors(after))))
    return sorted(out, key=str)


def check(docs):
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    assert sorted((tuple(r) for r in fp.fingerprints(docs).collect()), key=str) == expected(rows)


def texts(n):
    return [(i * 31 % 10_007 - 500, " ".join(f"w{(i * j * j + j) % 91}" for j in range(i * 7 % 60)), "a")
            for i in range(n)]


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("rows", [1, 2, 7])
def test_many_small_ranges(make_docs, monkeypatch, rows):
    monkeypatch.setattr(fp, "BUCKET_ROWS", rows)
    monkeypatch.setattr(fp, "QUANTILES", 8)
    check(make_docs(*texts(120)))


def test_one_document_follows_itself(make_docs):
    check(make_docs((5, "ab cd é\U0001f600f")))


def test_ids_far_apart(make_docs):
    check(make_docs((-(1 << 62), "a b"), (1 << 62, "c d"), (0, "e"), (1, "f g h"), (None, "i")))


def test_anchors_do_not_depend_on_their_surroundings(spark):
    part = " ".join(f"t{i * i % 53}" for i in range(40))
    df = spark.createDataFrame([(part,), ("x y z " + part + " q",)], "t string")
    one, two = (r.a for r in fp.with_anchors(df, "t", "a").orderBy(F.length("t")).collect())
    assert {(a["hash"], a["at"] + 3) for a in one} <= {(a["hash"], a["at"]) for a in two}


def test_short_texts_keep_anchors_of_their_unchanged_half(make_docs):
    docs = make_docs(*[(i, " ".join(f"{i:02d}{j:02d}" for j in range(10 + i % 8)), "a") for i in range(40)])
    assert all(r.near_edited > 0 for r in fp.fingerprints(docs).collect())


def test_texts_without_white_space_keep_anchors(make_docs):
    han = "".join(chr(0x4E00 + i * i % 997) for i in range(400))
    run = "".join(chr(97 + i * i * i % 9973 % 23) for i in range(500))
    docs = make_docs((1, han), (2, run), (3, "alpha beta gamma"), (4, "x" * 30 + han[:60]))
    check(docs)
    near = {r.doc_id: r.near_edited for r in fp.fingerprints(docs).collect()}
    assert 0.3 < near[1] < 0.7 and 0.3 < near[2] < 0.7


def test_positions_count(make_docs):
    words = [f"v{i * i % 9973}" for i in range(200)]
    moved, longer = words[100:] + words[:100], words[:90] + ["more"] * 20 + words[90:]
    docs = make_docs(*[(i, " ".join(w)) for i, w in enumerate((words, moved, words, longer, words))])
    check(docs)
    near = {r.doc_id: r.near_next for r in fp.fingerprints(docs).collect()}
    assert near[0] < 0.6 and near[1] < 0.6 and near[2] > 0.9 and near[4] == 1


def test_likeness_of_repeated_passages(make_docs):
    part = " ".join(f"p{i}" for i in range(12))
    check(make_docs(*[(i, " ".join([part, f"q{i}"] * (i % 4 + 1))) for i in range(12)]))


def test_empty(no_docs):
    assert fp.fingerprints(no_docs).count() == 0
