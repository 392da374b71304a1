"""Likelihoods against sums over all state paths, counts against Python."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm import hmm


def small_model(classes=5, states=3):
    rng = np.random.default_rng(3)
    emit = rng.random((classes, states)) + 0.05
    move = rng.random((states, states)) + 0.05
    start, share = rng.random(states) + 0.1, rng.random(states) + 0.1
    return hmm.Model(start / start.sum(), share / share.sum(), move / move.sum(axis=1, keepdims=True),
                     emit / emit.sum(axis=0))


def path_sum(seq, start, model):
    """(likelihood, expected counts) by enumeration of all state paths."""
    states, total = len(start), 0.0
    emit, move, first = np.zeros_like(model.emit), np.zeros_like(model.move), np.zeros(states)
    for path in itertools.product(range(states), repeat=len(seq)):
        p = start[path[0]] * model.emit[seq[0], path[0]]
        for t in range(1, len(seq)):
            p *= model.move[path[t - 1], path[t]] * model.emit[seq[t], path[t]]
        total += p
        first[path[0]] += p
        for t, s in enumerate(path):
            emit[seq[t], s] += p
            if t:
                move[path[t - 1], s] += p
    return total, first / total, move / total, emit / total


DOCS = [np.array(d, np.uint32) for d in ([1], [0, 2, 1], [3, 3, 0, 4, 2, 1], [2, 1, 4, 4, 0])]


@pytest.mark.parametrize("length", [1, 2, 4, 128])
def test_likelihood_is_exact_for_any_segment_length(length):
    model = small_model()
    got = hmm.log_likelihoods(DOCS, model, length)
    want = [math.log10(path_sum(d.tolist(), model.start, model)[0]) for d in DOCS]
    assert got == pytest.approx(want)


def test_long_texts_do_not_underflow(monkeypatch):
    model = small_model()
    doc = np.random.default_rng(1).integers(0, 5, 50_000).astype(np.uint32)
    whole = hmm.log_likelihoods([doc], model)[0]
    a, total = model.start * model.emit[doc[0]], 0.0
    for t in range(1, len(doc)):
        total += math.log10(a.sum())
        a = (a / a.sum()) @ model.move * model.emit[doc[t]]
    assert whole == pytest.approx(total + math.log10(a.sum()))
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 10)
    assert hmm.log_likelihoods([*DOCS, doc], model)[-1] == pytest.approx(whole)


def test_expected_counts():
    model = small_model()
    start, move, emit, total = hmm.expected_counts(DOCS, model)
    parts = [path_sum(d.tolist(), model.start, model) for d in DOCS]
    assert total == pytest.approx(sum(math.log10(p[0]) for p in parts))
    for got, i in ((start, 1), (move, 2), (emit, 3)):
        assert got == pytest.approx(sum(p[i] for p in parts))


def test_segments_start_from_the_shares():
    model = small_model()
    _, move, emit, total = hmm.expected_counts([DOCS[2]], model, 4)
    parts = [path_sum(DOCS[2][:4].tolist(), model.start, model),
             path_sum(DOCS[2][4:].tolist(), model.share, model)]
    assert emit == pytest.approx(parts[0][3] + parts[1][3])
    assert move == pytest.approx(parts[0][2] + parts[1][2])


def expected_base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: (t or "").encode().lower().split() + [b" "]
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words(t))) for i, t in rows]


def check(docs, monkeypatch, head):
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm, "OWN_RATE", 2)
    monkeypatch.setattr(hmm, "PASSES", 2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(hmm.score_documents(docs).collect(), key=lambda r: str((r.doc_id, r.base_score)))
    want = sorted(expected_base(rows), key=lambda r: str((r[0], r[5])))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (str(r.doc_id), r.n_tokens)),
                    sorted(want, key=lambda r: (str(r[0]), r[2]))):
        assert tuple(g)[:5] == w[:5]
        assert g.base_score == pytest.approx(w[5]) and g.score <= 0
    return got


@pytest.mark.parametrize("head", [1, 40, 1000])
def test_base_scores(spark, odd_docs, monkeypatch, head):
    check(odd_docs, monkeypatch, head)


def test_rare_words_outside_the_head_score_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    scores = [{r.doc_id: r.score for r in check(docs, monkeypatch, head)} for head in (2_000, 100_000)]
    assert scores[0] == pytest.approx(scores[1], rel=1e-6)


def test_class_probabilities_add_up_to_one():
    known = hmm.Vocabulary(100, 12, 5, [b"a", b"b"], np.array([30, 20]), 2, np.array([40, 0, 5]),
                           np.array([8, 0, 1]))
    unigram = known.unigram()
    assert unigram == pytest.approx(np.array([6, 41, 1, 6, 31, 21]) / 106)
    emit = hmm.first_model(unigram).emit
    assert emit.sum(axis=0) == pytest.approx(1)


def test_vocabulary_against_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(hmm, "OWN_RATE", 2)
    words = (b"x y xing zing a" + "ß née 語 ".encode() * 3 + b" x x y walked talked").split()
    docs = spark.createDataFrame([(b" ".join(words).decode(),), ("",), (None,)], "text string")
    known = hmm.read_vocabulary(hmm.word_counts(docs))
    counts = Counter(words)
    assert (known.tokens, known.distinct, known.ends) == (len(words) + 3, len(counts) + 1, 3)
    assert dict(zip(known.words, known.counts)) == counts
    own = known.words[:known.own]
    assert known.rare == math.ceil(4 * math.sqrt(known.distinct)) and len(own) == 7
    tokens, kinds = np.zeros(known.rare), np.zeros(known.rare)
    for w in counts:
        if w not in own:
            tokens[zlib.crc32(w[-3:]) % known.rare] += counts[w]
            kinds[zlib.crc32(w[-3:]) % known.rare] += 1
    assert known.rare_tokens.tolist() == tokens.tolist() and known.rare_words.tolist() == kinds.tolist()


def test_classes_follow_the_vocabulary():
    sizes = [10 ** n for n in range(1, 11)]
    own, rare = [hmm.own_words(10 ** 9, v) for v in sizes], [hmm.rare_classes(v) for v in sizes]
    assert own == sorted(set(own)) and rare == sorted(set(rare))
    assert (own[-1] + rare[-1]) * hmm.STATES * 8 < 260e6


@pytest.mark.parametrize("head", [5, 1000])
def test_scores_against_sums_over_paths(spark, monkeypatch, head):
    """The registered score, from the text to the word's share of its class."""
    monkeypatch.setattr(hmm, "HEAD", head)
    monkeypatch.setattr(hmm, "OWN_RATE", 1)
    monkeypatch.setattr(hmm, "STATES", 2)
    kept = {}
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda *a: kept.setdefault("m", train(a[0], a[1], 2, 3)))
    rows = [(i, t) for i, t in enumerate(["a b a walked", "a b c talked", "", "b a c", "new a seen"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in hmm.score_documents(docs).collect()}
    used = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in used for w in t.encode().split())
    order = sorted(counts, key=lambda w: (-counts[w], w))
    least = min((c for c in counts.values() if sum(x >= c for x in counts.values()) <= head), default=None)
    held = [w for w in order if least is not None and counts[w] >= least]
    own = held[:math.ceil(math.sqrt(len(counts) + 1))]
    rare = hmm.rare_classes(len(counts) + 1)
    group = lambda w: zlib.crc32(w[-3:]) % rare
    for i, t in rows:
        seq, share = [], 0.0
        for w in t.encode().split():
            if w in own:
                seq.append(1 + rare + own.index(w))
                continue
            seq.append(1 + group(w))
            mates = [x for x in counts if x not in own and group(x) == group(w)]
            share += math.log10((counts[w] + 1) / (sum(counts[x] for x in mates) + len(mates) + 1))
        want = share + math.log10(path_sum([*seq, 0], kept["m"].start, kept["m"])[0])
        assert got[i] == pytest.approx(want)


def test_a_long_text_is_handled_in_pieces(monkeypatch):
    model = small_model()
    doc = np.random.default_rng(2).integers(0, 5, 1_000).astype(np.uint32)
    docs = [*DOCS, doc, *DOCS, doc[:700]]
    whole = hmm.expected_counts(docs, model, 8), hmm.log_likelihoods(docs, model, 8)
    monkeypatch.setattr(hmm, "TOKENS_AT_ONCE", 50)
    assert max(sum(len(d) for _, _, d in g) for g in hmm._pieces(docs, 8)) < 2 * 50
    for a, b in zip(whole[0], hmm.expected_counts(docs, model, 8)):
        assert b == pytest.approx(a)
    assert hmm.log_likelihoods(docs, model, 8) == pytest.approx(whole[1])


def test_training_raises_the_likelihood(spark, monkeypatch):
    monkeypatch.setattr(hmm, "OWN_RATE", 4)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")

    def total(passes):
        monkeypatch.setattr(hmm, "PASSES", passes)
        return sum(r.score for r in hmm.score_documents(docs).collect() if not r.held_out)
    assert total(0) < total(2) < total(5)


def test_empty(no_docs):
    assert hmm.score_documents(no_docs).count() == 0
