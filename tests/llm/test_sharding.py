"""Row law, slots and mixture of the shards."""

import zlib
from collections import Counter, defaultdict

from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm.sharding import interleave_shards


def check(docs, shards):
    rows = docs.collect()
    got = interleave_shards(docs, shards).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                   for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    return got


def test_odd_rows(odd_docs):
    check(odd_docs, 4)


def test_more_shards_than_rows(make_docs):
    check(make_docs((1, "a"), (2, "b")), 5)


def test_every_shard_has_the_mixture(make_docs):
    source = {i: "hot" if i % 3 else f"s{i % 12}" for i in range(1200)}
    got = check(make_docs(*[(i, str(i), s) for i, s in source.items()]), 8)
    whole = Counter(source.values())
    for shard in range(8):
        part = Counter(source[r.doc_id] for r in got if r.shard == shard)
        assert all(abs(part[s] - n / 8) <= 1.5 for s, n in whole.items())


def test_rank_buckets_do_not_change_the_order(make_docs, monkeypatch):
    from pulsepanel.llm import sharding
    docs = make_docs(*[(i, str(i % 7), f"s{i % 5}") for i in range(500)])
    few = sorted(map(tuple, interleave_shards(docs, 6).collect()))
    monkeypatch.setattr(sharding, "bucket_count", lambda rows: 997)
    assert sorted(map(tuple, interleave_shards(docs, 6).collect())) == few


def test_empty(no_docs):
    assert interleave_shards(no_docs).count() == 0
