"""Pieces against the tokenizer itself, sequences against their law."""

import weakref
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm.common import free_worker
from pulsepanel.llm.packing import WordIds, pack_documents, plan_windows, word_ids
from pulsepanel.llm.queries import tokenizer_path

ODD = ["", " ", "a<|endoftext|>b", "<|startoftext|> x", "été ́a", "A B\x1cC\x85D E",
       "don't we'll I'd 's", "x" * 300, "\U0001f600\U0001f600 tab\there\r\nline\n\n end ", "Ünïcödé ΣΑΣ Σ",
       "İ. İ.. É, éx; ßß!! a.b. a'. x*. q<. Ab%%% 1. 1,a. _. ́. aͅ.", "A<|ENDOFTEXT|>B C",
       "１２ ① ﬁ", "日本語のテキスト 中文", "a\ńb", "ﬁ Å Ω"]


@pytest.fixture(scope="module")
def words():
    return WordIds(tokenizer_path())


def direct(words, text):
    return words.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids_of_odd_texts(words, text):
    assert np.frombuffer(words.encode(text), "<u4").tolist() == direct(words, text)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aBİéßσΣΚ.,!*'<| \n1́ͅ", max_size=30)))
def test_ids_of_any_text(text):
    words = word_ids(tokenizer_path())
    assert np.frombuffer(words.encode(text), "<u4").tolist() == direct(words, text)


def test_a_full_cache_keeps_working(words):
    small = WordIds(tokenizer_path(), limit=5)
    text = " ".join(f"w{i % 23}. the," for i in range(200))
    assert small.encode(text) == words.encode(text) and len(small) + len(small.older) <= 10


def check(docs, words, window):
    rows = docs.collect()
    got = pack_documents(docs, tokenizer_path(), window).collect()
    texts, pieces, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = direct(words, r.text or "") + [2]
        for start in range(0, len(ids), window):
            part = ids[start:start + window]
            texts[r.doc_id].append((start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)))
    for r in got:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in texts.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return got


def test_odd_rows(odd_docs, words):
    check(odd_docs, words, 128)


def test_little_padding(make_docs, words):
    docs = make_docs(*[(i, "word " * (i * 7919 % 900 + 1)) for i in range(600)])
    got = check(docs, words, 1024)
    used = sum(r.length for r in got)
    assert used / (1024 * len({r.sequence_id for r in got})) > 0.98


def test_empty(no_docs):
    assert pack_documents(no_docs, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_places_every_piece_once(counts):
    plan = plan_windows(counts, 64)
    seen, fill = defaultdict(list), defaultdict(int)
    ends = {}
    for i in range(len(plan.length)):
        a, first = int(plan.length[i]), int(plan.first[i])
        later = [int(f) for x, f in zip(plan.length, plan.first) if x == a and f > first]
        stop = min(later, default=counts[a])
        for j in range(first, stop):
            s = int(plan.sequence[i]) + j - first
            seen[a].append(j)
            fill[s] += a
            ends.setdefault(s, []).append((int(plan.offset[i]), a))
    assert {a: sorted(js) for a, js in seen.items()} == {a: list(range(n)) for a, n in counts.items()}
    assert all(v <= 64 for v in fill.values()) and set(fill) == set(range(plan.sequences))
    for parts in ends.values():
        at = 0
        for offset, a in sorted(parts):
            assert offset == at
            at += a


def test_least_squares_uses_exact_fills():
    plan = plan_windows({40: 100, 24: 130, 8: 90}, 64)
    # 100 x (40 + 24), then 24 + 24 + 8 + 8 and 8 x 8
    assert plan.sequences <= 100 + 16 + 8


def test_other_operators_free_the_words():
    words = word_ids(tokenizer_path())
    assert word_ids(tokenizer_path()) is words  # kept from task to task
    gone = weakref.ref(words)
    del words
    free_worker()
    assert gone() is None
