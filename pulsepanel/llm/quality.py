"""Quality classifier: random-indexing word vectors and a small network.

Random indexing gives every token class a sparse random index vector; a
class's context vector is the sum of the index vectors around its
occurrences, counted over all documents.  A document's input is the weighted
mean of its tokens' vectors and of its distinct tokens' vectors, with its
length and its share of distinct tokens.  A two-layer network is fitted with
numpy on a bounded sample of labelled rows; a temperature fitted on rows that
the network has not seen calibrates its probabilities.

Scale: token classes are a fixed number of hash buckets by shape (lower,
title, upper, other), so the vectors have a fixed size.  Each task adds up
context counts and sends one row per class that it has seen; the sums are
grouped by class.  Only the class table, the labelled sample (bounded by
``TRAIN_ROWS``) and the network pass the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepanel.llm.common import free_worker

#: Hash buckets of each token shape, and shapes.
BUCKETS, SHAPES = 2048, 4
CLASSES = BUCKETS * SHAPES
#: Length of the vectors, non-zeros of an index vector, words to each side.
DIM, NONZERO, REACH = 64, 4, 2
#: Network inputs: two pooled vectors, share of distinct tokens, length, empty.
INPUTS = 2 * DIM + 3
#: Labelled rows that the network sees at most, chosen by a hash of their id.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 2e-3, 1e-4
#: Share of the sample that the temperature is fitted on.
CALIBRATE = 0.2
THRESHOLD = 0.7
SEED = 4
#: Tokens of which a task counts contexts at once, and whose classes it keeps:
#: a worker lives as long as its executor, beside others.
TOKENS_AT_ONCE, TOKENS_KEPT = 250_000, 50_000

_TOKEN = regex.compile(r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+")


class TokenClass(dict):
    """Class of a token: a bucket among those of its shape."""

    def __missing__(self, token: str) -> int:
        if not token[0].isalpha():
            shape = 3
        elif token.isupper() and len(token) > 1:
            shape = 2
        else:
            shape = 1 if token[0].isupper() else 0
        value = shape * BUCKETS + zlib.crc32(token.encode()) % BUCKETS
        if len(token) <= 32:
            if len(self) >= TOKENS_KEPT:
                self.clear()
            self[token] = value
        return value


def token_classes(text: str, classes: TokenClass) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(classes.__getitem__, tokens), np.int64, len(tokens))


def index_vectors(seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zeros of each class's index vector; a last
    class stands for the gap between documents and has no sign."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((CLASSES + 1, DIM)), axis=1)[:, :NONZERO]
    signs = rng.choice([-1.0, 1.0], (CLASSES + 1, NONZERO))
    signs[CLASSES] = 0
    return places, signs


def context_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per token class: ``cls``, ``n`` and the context sums ``v``
    (as columns ``c0 ..``) over all documents."""
    fields = ", ".join(f"c{i} bigint" for i in range(DIM))

    def count(batches):
        free_worker()
        places, signs = index_vectors()
        classes = TokenClass()
        sums, seen = np.zeros(CLASSES * DIM), np.zeros(CLASSES, np.int64)
        gap = np.full(REACH, CLASSES)

        def add(parts):
            ids = np.concatenate([gap, *parts])
            seen.__iadd__(np.bincount(ids, minlength=CLASSES + 1)[:CLASSES])
            for step in range(1, REACH + 1):
                for a, b in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
                    real = a < CLASSES
                    a, b = a[real] * DIM, b[real]
                    for z in range(NONZERO):
                        sums.__iadd__(np.bincount(a + places[b, z], signs[b, z], CLASSES * DIM))

        parts, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                ids = token_classes(text.as_py() or "", classes)
                parts += [ids, gap]
                held += len(ids)
                if held >= TOKENS_AT_ONCE:
                    add(parts)
                    parts, held = [], 0
        if parts:
            add(parts)
        at = np.flatnonzero(seen)
        table = sums.reshape(CLASSES, DIM)[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(seen[at]), *[pa.array(np.ascontiguousarray(c)) for c in table.T]],
            names=["cls", "n", *[f"c{i}" for i in range(DIM)]])

    parts = docs.select(text_col).mapInArrow(count, f"cls bigint, n bigint, {fields}")
    return parts.groupBy("cls").agg(F.sum("n").alias("n"),
                                    *[F.sum(f"c{i}").alias(f"c{i}") for i in range(DIM)])


def word_vectors(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, weights) of all classes; at most ``CLASSES`` rows are read.

    A vector is the unit context vector and the class's own index vector; a
    frequent class weighs less."""
    places, signs = index_vectors()
    own = np.zeros((CLASSES, DIM))
    np.put_along_axis(own, places[:CLASSES], signs[:CLASSES], axis=1)
    table = counts.toArrow()
    at = table.column("cls").to_numpy()
    n = np.zeros(CLASSES)
    n[at] = table.column("n").to_numpy()
    context = np.zeros((CLASSES, DIM))
    context[at] = np.stack([table.column(f"c{i}").to_numpy() for i in range(DIM)], axis=1)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    vectors = context / np.maximum(norm, 1) + own / np.sqrt(NONZERO)
    weights = 1e-3 / (1e-3 + n / max(n.sum(), 1))
    return vectors.astype(np.float32), weights.astype(np.float32)


def document_inputs(texts, vectors: np.ndarray, weights: np.ndarray, classes: TokenClass):
    """One row of network inputs per text (a list, or Arrow strings, which are
    taken out one by one)."""
    out = np.zeros((len(texts), INPUTS), np.float32)
    for row, text in zip(out, texts):
        ids = token_classes((text.as_py() if isinstance(text, pa.Scalar) else text) or "", classes)
        if len(ids):
            kinds, n = np.unique(ids, return_counts=True)
            v, w = vectors[kinds], weights[kinds]
            row[:DIM] = (w * n) @ v / (w @ n)
            row[DIM:2 * DIM] = w @ v / w.sum()
            row[2 * DIM] = len(kinds) / len(ids)
        row[2 * DIM + 1] = np.log1p(len(ids)) / 10
        row[2 * DIM + 2] = not len(ids)
    return out


@dataclass
class Model:
    """The class vectors and the fitted network; a few MB at any input size."""

    vectors: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list
    temperature: float
    prior: float
    seen: int = 0  #: labelled rows that it was fitted on

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_network(x: np.ndarray, y: np.ndarray, vectors, weights, seed: int = SEED) -> Model:
    """Two layers by Adam on the log loss, then the temperature by search on
    held-back rows.  With one class or without rows the score is constant."""
    prior = float(y.mean()) if len(y) else 0.5
    model = Model(vectors, weights, np.zeros(1), np.ones(1), [], 1.0, prior, len(y))
    if prior in (0.0, 1.0) or len(y) < 10:
        return model
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    cut = max(1, int(CALIBRATE * len(y)))
    held, use = order[:cut], order[cut:]
    model.mean, model.scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    z = (x[use] - model.mean) / model.scale
    t = y[use]
    d = z.shape[1]
    layers = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(())]
    first, second, step = [0.0] * 4, [0.0] * 4, 0
    for _ in range(EPOCHS):
        mixed = rng.permutation(len(t))
        for at in range(0, len(t), BATCH):
            rows = mixed[at:at + BATCH]
            w1, b1, w2, b2 = layers
            h = np.tanh(z[rows] @ w1 + b1)
            e = (_sigmoid(h @ w2 + b2) - t[rows]) / len(rows)
            back = np.outer(e, w2) * (1 - h * h)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), h.T @ e + DECAY * w2, e.sum()]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
    model.layers = layers
    logits, t = model.logits(x[held]), y[held]

    def loss(temperature):
        p = np.clip(_sigmoid(logits / temperature), 1e-7, 1 - 1e-7)
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).mean()

    model.temperature = min(np.geomspace(0.25, 8, 141), key=loss)
    return model


def fold(id_col, folds: int, held: int) -> F.Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id
    does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", label_col: str = "quality",
                  train_rows: int = TRAIN_ROWS, folds: int = 4, held: int = 2) -> Model:
    """Fits the classifier.  Labels of held-out ids, and null labels, are not
    looked at; of the others ``train_rows`` are used at most, by id hash."""
    vectors, weights = word_vectors(context_counts(docs, text_col))
    key = F.col(id_col)
    sample = (labels.where(key.isNotNull() & F.col(label_col).isNotNull() & ~fold(key, folds, held))
              .select(key.alias("_lid"), (F.col(label_col) > 0).cast("double").alias("_y"))
              .orderBy(F.xxhash64("_lid", F.lit(SEED)), "_lid", "_y").limit(train_rows))
    rows = docs.select(key.alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(sample), F.col("_id") == F.col("_lid")).select("_y", "_text")

    def inputs(batches):
        free_worker()
        classes = TokenClass()
        for batch in batches:
            x = document_inputs(batch.column(1), vectors, weights, classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    # Rows that repeat an id could make more; the driver takes no more.
    table = rows.mapInArrow(inputs, "y double, x binary").limit(train_rows).toArrow()
    y = table.column("y").to_numpy()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.float32).reshape(len(y), INPUTS)
    order = np.lexsort((y, *x.T[:4])) if len(y) else np.zeros(0, int)  # arrival order is not fixed
    return fit_network(x[order].astype(np.float64), y[order], vectors, weights)


def score_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows as a struct ``row`` with ``score``: higher, label 1 likelier.
    Null and empty texts get the score of an empty text."""
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)),
                           T.StructField("score", T.DoubleType())])
    sent = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")]
    at = docs.columns.index(text_col) if text_col in docs.columns else None
    if at is None:  # not a column as it stands; else the row's own text is read, not a copy
        sent.append(F.col(text_col).alias("text"))

    def score(batches):
        free_worker()
        classes = TokenClass()
        for batch in batches:
            rows = batch.column(0)
            texts = batch.column(1) if at is None else rows.field(at)
            scores = model.score(document_inputs(texts, model.vectors, model.weights, classes))
            yield pa.RecordBatch.from_arrays([rows, pa.array(scores, pa.float64())], names=["row", "score"])
            del batch, rows, texts  # not beside the next batch

    return docs.select(*sent).mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, ``held_out``, ``score``, ``predicted``."""
    model = train_quality(docs, labels, id_col, text_col)
    scored = score_quality(docs.select(id_col, text_col), model, text_col)
    key = F.col(f"row.{id_col}")
    return scored.select(key.alias(id_col), fold(key, 4, 2).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
