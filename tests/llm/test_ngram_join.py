"""Links and components against all pairs of small tables."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm import ngram_join as nj
from pulsepanel.llm.components import connected_components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def expected(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((d, len(sets[i]), sum(s == sets[i] and bool(s) for s in sets) or 1, links[i],
                    min(ids, default=None)))
    return sorted(out, key=str)


def check(docs, size=3, num=90, den=100):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = nj.ngram_join(docs, size=size, num=num, den=den).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.class_size, r.n_links, r.component_id) for r in found),
                 key=str)
    assert got == expected(rows, size, num, den)
    return found


def near_texts(seed, groups=12, members=8):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 12, 40, 150, 600]))]
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                at = rng.randrange(len(words))
                words[at:at + 1] = rng.choice([[], [f"n{rng.randrange(99)}"], [words[at], "more"]])
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100)])
def test_near_copies(make_docs, size, num, den):
    check(make_docs(*near_texts(size)), size, num, den)


def test_odd_rows(odd_docs):
    found = check(odd_docs)
    keep = [r for r in found if r.first]
    assert len([r for r in keep if r.component_id == 8]) <= 1


def test_large_blocks_are_cut_into_tiles(make_docs, monkeypatch):
    monkeypatch.setattr(nj, "PART_SHINGLES", 300)
    check(make_docs(*near_texts(77, groups=5, members=14)))


@pytest.mark.parametrize("meeting", [1, 3])
def test_keys_of_many_documents_meet_in_parts(make_docs, monkeypatch, meeting):
    monkeypatch.setattr(nj, "MEETING", meeting)
    check(make_docs(*near_texts(5, groups=4, members=10)))


def test_classes_of_one_name_are_told_apart(make_docs, monkeypatch):
    """Meetings name a class by 8 bytes; all classes under one name still work."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(nj, "_node", lambda: (F.xxhash64("digest") % 3).alias("node"))
    check(make_docs(*near_texts(6, groups=4, members=4)))


def test_blocks_hold_what_links_and_little_else(make_docs, monkeypatch):
    """Texts that share passages, but are no near copies, are not fetched again."""
    rng = random.Random(4)
    passages = [" ".join(f"p{rng.randrange(10**6)}" for _ in range(60)) for _ in range(6)]
    texts = [" ".join([rng.choice(passages), *(f"w{rng.randrange(10**6)}" for _ in range(90)),
                       rng.choice(passages)]) for _ in range(150)]
    texts += [t + " tail" for t in texts[:10]]
    seen = []
    tiles = nj._tiles
    monkeypatch.setattr(nj, "_tiles", lambda members, link: seen.append(members.count()) or tiles(members, link))
    check(make_docs(*enumerate(texts)))
    assert 20 <= seen[0] <= 30


@pytest.mark.parametrize("seed", range(60))
def test_meetings_join_all_that_link(seed):
    rng = random.Random(seed)
    m, link = rng.randint(2, 40), nj.Link(90, 100)
    base = [rng.getrandbits(64) for _ in range(rng.randrange(3, 300))]
    sets = []
    for _ in range(m):
        if rng.random() < 0.3:
            base = [rng.getrandbits(64) for _ in range(rng.randrange(3, 300))]
        own = [x for x in base if rng.random() > 0.03] + [rng.getrandbits(64) for _ in range(rng.randrange(4))]
        sets.append(np.unique(np.array(own or base, np.uint64)))
    n = np.array([len(s) for s in sets])
    roots = nj.meeting_roots(n, [nj.signature(s) for s in sets], link)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            assert roots[i] == roots[j] or 100 * both < 90 * (len(a) + len(b) - both)


def test_intersections_over_sorted_arrays():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 400, k).astype(np.uint64)) for k in rng.integers(1, 300, 30)]
    held = nj.SortedSets(sets)
    for i in range(30):
        others = np.array([j for j in range(30) if j != i and rng.random() < 0.6])
        if len(others):
            assert held.common(i, others).tolist() == [len(np.intersect1d(sets[i], sets[j])) for j in others]


def test_first_keeps_one_row_of_each_component(make_docs):
    same = "one two three four five six"
    found = nj.ngram_join(make_docs((4, same), (2, same), (2, same), (None, same), (9, "other words here"))
                          ).collect()
    assert sorted((str(r.doc_id), r.first) for r in found) == [
        ("2", False), ("2", True), ("4", False), ("9", True), ("None", False)]


def test_empty(no_docs):
    assert nj.ngram_join(no_docs).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.randoms(use_true_random=False))
def test_linked_sets_share_a_key(n, out, new, rng):
    for num, den in ((90, 100), (80, 100)):
        link = nj.Link(num, den)
        base = [rng.getrandbits(64) for _ in range(n + new)]
        a = np.unique(np.array(base[:n], np.uint64))
        b = np.unique(np.array(base[min(out, n - 1):], np.uint64))
        common = len(np.intersect1d(a, b))
        if den * common >= num * (len(a) + len(b) - common) and not np.array_equal(a, b):
            counts = np.random.default_rng(n).integers(0, 9, 64)
            assert len(np.intersect1d(nj.prefix_keys(a, counts, link), nj.prefix_keys(b, counts, link)))


def test_prefixes_hold_the_rarest_members():
    counts = np.arange(64)[::-1].copy()
    s = np.arange(50, dtype=np.uint64)
    link = nj.Link(90, 100)
    bands = range(link.band(50), link.band(55) + 1)
    want = {int(nj._mix(np.array([x], np.uint64) + np.uint64(b * int(nj._M1) % 2**64))[0])
            for x in range(44, 50) for b in bands}
    assert set(nj.prefix_keys(s, counts, link).tolist()) == want


def test_partners_are_at_most_one_band_apart():
    for num, den in ((90, 100), (80, 100), (1, 2)):
        link = nj.Link(num, den)
        for n in [*range(1, 400), 10**6, 10**9]:
            assert link.band(n) <= link.band(n * den // num) <= link.band(n) + 1


def test_parity_bound_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, 300).astype(np.uint64)) for _ in range(20)]
    marks = nj.parity_bitmaps(sets, 256)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(marks[i] ^ marks[j]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (5, 5), (21, 22), (2, 1)] + [(100, i) for i in range(101, 150)] + [
        (i, i + 1) for i in range(300, 340)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 150)} | {
        i: 300 for i in range(300, 341)}
    assert got == want
