"""Radix dedup against grouping by the normalised text itself."""

import hashlib
import re
from collections import defaultdict

import pytest
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm.exact_dedup import exact_dedup


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for text, ids in groups.items():
        order = sorted(ids, key=lambda i: (i is None, i or 0))
        for n, i in enumerate(order):
            out.append((i, order[0], len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in exact_dedup(docs, **options).collect()), key=str)
    assert got == expected(rows)


def test_odd_rows(odd_docs):
    check(odd_docs)


@pytest.mark.parametrize("width", [1, 3])
def test_narrow_digits(make_docs, width):
    check(make_docs((1, "ab"), (2, "ab "), (3, "abc"), (4, "abc"), (5, "abd"), (6, "a"), (7, "a"),
                    (8, "é"), (9, "è"), (10, "é"), (11, "ab" * 400), (12, "ab" * 400 + "c"),
                    (13, "ab" * 400)), first_width=width)


def test_text_that_ends_at_a_digit(make_docs):
    check(make_docs((1, "x" * 64), (2, "x" * 64), (3, "x" * 512), (4, "x" * 512), (5, "x" * 513)))


def test_one_group_holds_most_rows(make_docs):
    check(make_docs(*[(i, "same text " * 20) for i in range(300)], (400, "other")))


def test_empty(no_docs):
    out = exact_dedup(no_docs)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert out.count() == 0
