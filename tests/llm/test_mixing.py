"""Targets, probabilities and the sampled copy of the mix."""

from collections import defaultdict

import pytest
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm.mixing import mix_sources
from pyspark.sql import functions as F


def water(sizes, weights, total, cap):
    """Targets by repeated resharing."""
    left, fixed = total, {}
    while True:
        open_ = {s: w for s, w in weights.items() if s not in fixed}
        if not open_:
            return fixed
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        full = [s for s in open_ if share[s] > cap * sizes[s]]
        if not full:
            return fixed | share
        for s in full:
            fixed[s] = cap * sizes[s]
            left -= fixed[s]


def test_targets_match_resharing_and_taken_comes_near(spark, make_docs):
    rows = [(i, "w " * (i * 37 % 300 + 1), f"s{i % 7}" if i % 5 else "s0") for i in range(900)]
    got = mix_sources(make_docs(*rows)).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    sizes = defaultdict(int)
    for i, t, s in rows:
        sizes[s] += len(t.split())
    names = sorted(sizes)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    source = {i: s for i, _, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r["size"] == len(rows[r.doc_id][1].split())
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert int(r.target // r.source_size) <= r.copies
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 5


def test_reruns_and_other_partitionings_agree(spark, make_docs):
    rows = [(i, "w " * (i % 90), f"s{i % 3}") for i in range(300)]
    once = sorted(map(tuple, mix_sources(make_docs(*rows)).collect()))
    again = sorted(map(tuple, mix_sources(make_docs(*rows[::-1]).repartition(5)).collect()))
    assert once == again


def test_long_documents_are_likelier(make_docs):
    rows = [(i, "w " * (10 if i % 2 else 400), "s0") for i in range(400)] + [(900, "w " * 99000, "s1")]
    got = [r for r in mix_sources(make_docs(*rows), weights=(1, 9)).collect() if r.doc_id != 900]
    whole = min(r.copies for r in got)
    picked = {n: sum(r.copies - whole for r in got if r["size"] == n) for n in (10, 400)}
    assert picked[400] > 2 * picked[10] > 0


def test_odd_rows(odd_docs):
    got = mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sum(r["size"] == 0 and r.taken == 0 for r in got) == 4
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_empty_and_wordless(no_docs, make_docs):
    assert mix_sources(no_docs).count() == 0
    rows = mix_sources(make_docs((1, None), (2, " "))).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_carried_columns(make_docs):
    docs = make_docs((1, "a b"), (2, "c")).withColumn("mark", F.col("doc_id") * 2)
    assert all(r.mark == 2 * r.doc_id for r in mix_sources(docs, carry=("mark",)).collect())
