"""Held-out accuracy, folds and odd rows of the classifier."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm import quality
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    return docs, labels, quality.classify(docs, labels).collect()


def test_held_out_rows(scored):
    docs, labels, got = scored
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([s >= 0.7 for s in good]) > 0.9 and np.mean([s < 0.7 for s in bad]) > 0.9
    loss = -np.mean([np.log(max(s if y else 1 - s, 1e-9)) for s, y in held])
    rate = np.mean([y for _, y in held])
    assert loss < -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate)) / 2


def test_labels_of_the_held_out_fold_are_not_used(scored):
    docs, labels, got = scored
    turned = labels.withColumn("quality", F.when(quality.fold(F.col("doc_id"), 4, 2),
                                                 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, turned).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in got)


def test_context_counts_match_a_plain_count(make_docs):
    docs = make_docs((1, "a b c a!!"), (2, None), (3, ""), (4, "b 12 B"))
    rows = {r["cls"]: r for r in quality.context_counts(docs).collect()}
    places, signs = quality.index_vectors()
    want, seen = {}, {}
    for text in ("a b c a!!", "b 12 B"):
        ids = quality.token_classes(text, quality.TokenClass()).tolist()
        for i, c in enumerate(ids):
            seen[c] = seen.get(c, 0) + 1
            v = want.setdefault(c, np.zeros(quality.DIM))
            for j in range(max(0, i - quality.REACH), min(len(ids), i + quality.REACH + 1)):
                if j != i:
                    np.add.at(v, places[ids[j]], signs[ids[j]])
    assert {c: r["n"] for c, r in rows.items()} == seen
    for c, v in want.items():
        assert [rows[c][f"c{i}"] for i in range(quality.DIM)] == v.tolist()


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(None, 1), (3, None)],
                                   "doc_id long, quality int")
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    empty = {r.score for r in got if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)


def test_without_labels_or_documents(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd_docs, none).collect()} == {0.5}
    assert quality.classify(no_docs, none).count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = quality.fit_network(x, y, None, None)
    p = model.score(x)
    for low in (0.1, 0.3, 0.5, 0.7):
        part = (p >= low) & (p < low + 0.2)
        assert abs(p[part].mean() - y[part].mean()) < 0.1


def test_a_worker_keeps_few_tokens():
    """Rare words pass without piling up in the worker's memory."""
    import sys

    classes = quality.TokenClass()
    quality.token_classes(" ".join("".join(chr(97 + int(c)) for c in str(i)) for i in range(200_000)), classes)
    assert len(classes) <= 50_000 and sys.getsizeof(classes) < 4 << 20


def test_inputs_of_arrow_texts_are_those_of_a_list():
    texts = ["one Two THREE", None, "", "a a a b"]
    vectors = np.random.default_rng(0).random((quality.CLASSES, quality.DIM))
    weights = np.ones(quality.CLASSES)
    of_list = quality.document_inputs(texts, vectors, weights, quality.TokenClass())
    assert np.array_equal(of_list, quality.document_inputs(pa.array(texts), vectors, weights, quality.TokenClass()))


def test_scoring_sends_a_text_once(make_docs):
    model = quality.fit_network(np.zeros((0, quality.INPUTS)), np.zeros(0), np.zeros((quality.CLASSES, quality.DIM)),
                                np.ones(quality.CLASSES))
    docs = make_docs((1, "a b c"), (2, None))
    scored = quality.score_quality(docs, model)
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert "AS text#" not in plan.split("MapInArrow")[1]
    assert [(r.row.doc_id, r.row.text) for r in scored.orderBy("row.doc_id").collect()] == [(1, "a b c"), (2, None)]
    other = quality.score_quality(docs, model, "TEXT")  # not the column's own name: sent beside the row
    assert sorted((r.row.doc_id, r.score) for r in other.collect()) == \
        sorted((r.row.doc_id, r.score) for r in scored.collect())
