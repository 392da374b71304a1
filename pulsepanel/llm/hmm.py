"""Language-model scoring with a hidden Markov model.

Latent states emit token classes: the most frequent training words are classes
of their own, every other word belongs to a class of words with its ending,
and the end of a text is a class.  Both numbers of classes follow the root of
the number of distinct training words, so the model learns more words and
finer endings from a larger corpus.  Baum-Welch trains the states: every pass
adds up expected counts in each partition and groups them by class.  A text's
likelihood is exact: the scaled forward recursion runs over the whole text, in
segments whose transfer matrices are multiplied in order, and a rare word adds
the probability of the word within its class, from its training count.

Scale: word counts are shuffled by word and kept in a table that is as large
as the vocabulary.  Tasks hold only its head (``HEAD`` words at most, with
their counts); other words are joined with the table.  The emission table
grows as the root of the vocabulary: 31 MB at 10 billion distinct words.
Training cuts texts into segments that start from the states' shares; scoring
cuts for memory alone, and a text of any length is handled in pieces.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import type_of
from pulsepanel.sources.sinks import materialize

STATES = 6
#: Words with a class of their own, and classes of rare words, for each unit of
#: the root of the number of distinct training words.
OWN_RATE, RARE_RATE = 48, 4
#: Bytes of a rare word's ending; a hash of them chooses its class.
ENDING = 3
#: The class of the end; those of rare words follow, then the words' own.
END = 0
#: Words whose counts every task holds at most, and their longest length.
HEAD, HEAD_BYTES = 1 << 18, 64
PASSES = 6
#: States start out likely to stay: languages and styles run over many words.
STAY = 10.0
#: Tokens of a segment and tokens handled at once.
SEGMENT = 128
TOKENS_AT_ONCE = 400_000
#: Weight of the unigram shares in the emission estimates.
SMOOTH = 20.0
SEED = 2
#: The key of the end token; no word holds a space.
END_KEY = b" "
#: Distinct words that a task counts before it hands them on.
COUNT_WORDS = 300_000


def fold(id_col, folds: int, held: int) -> F.Column:
    """Whether crc32 of the id as text falls in the held-out fold; a null id
    does not."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == held, F.lit(False))


def _words(column):
    """Words of one text after the other, so a batch is never held as words."""
    # Bytes: lower() changes A-Z only, split() splits at ASCII white space only.
    for text in column.cast(pa.binary()):
        yield (text.as_py() or b"").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all rows of a one-column frame; the end is a word."""
    def count(batches):
        def rows(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                names=["word", "c"])

        counts, ends = Counter(), 0
        for batch in batches:
            for words in _words(batch.column(0)):
                counts.update(words)
            ends += batch.num_rows
            if len(counts) > COUNT_WORDS:
                yield rows(counts)
                counts = Counter()
        if ends:
            counts[END_KEY] = ends
        yield rows(counts)

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def rare_classes(distinct: int) -> int:
    """Classes of rare words, for a number of distinct training words."""
    return max(1, math.ceil(RARE_RATE * math.sqrt(distinct)))


def rare_class(word: bytes, classes: int) -> int:
    """Class of a rare word, 0 to ``classes`` - 1, by its ending."""
    return zlib.crc32(word[-ENDING:]) % classes


@dataclass
class Vocabulary:
    """Totals and the head of the counts; ``words[i]`` has count ``counts[i]``.

    The first ``own`` words are classes of their own.  ``rare_tokens`` and
    ``rare_words`` count the training tokens and the distinct words of each
    class of rare words."""

    tokens: int
    distinct: int
    ends: int
    words: list
    counts: np.ndarray
    own: int
    rare_tokens: np.ndarray
    rare_words: np.ndarray

    @property
    def rare(self) -> int:
        return len(self.rare_tokens)

    def unigram(self) -> np.ndarray:
        """Share of each class, none of them zero."""
        n = np.concatenate([[self.ends], self.rare_tokens, self.counts[:self.own]]) + 1.0
        return n / n.sum()

    def rare_norm(self) -> np.ndarray:
        """log10 of each rare class's total, with one for words not seen."""
        return np.log10(self.rare_tokens + self.rare_words + 1.0)


def own_words(head: int, distinct: int) -> int:
    """Words with a class of their own, of a head of the vocabulary."""
    return min(head, math.ceil(OWN_RATE * math.sqrt(distinct)))


def read_vocabulary(counts: DataFrame) -> Vocabulary:
    """The head holds all words above the smallest count for which there are
    no more than ``HEAD``.  The window runs over the distinct counts, of which
    n tokens have no more than the root of 2 n.  Totals by ending are one row
    for each class of rare words."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1)),
                       F.sum(F.when(F.col("word") == F.lit(END_KEY), F.col("c")))).first()
    words = counts.where((F.col("word") != F.lit(END_KEY)) & (F.length("word") <= HEAD_BYTES))
    upto = F.sum("count").over(Window.orderBy(F.desc("c")))
    least = (words.groupBy("c").count().withColumn("upto", upto).where(F.col("upto") <= HEAD)
             .agg(F.min("c")).first()[0])
    word, c = [], np.zeros(0, np.int64)
    if least is not None:
        head = words.where(F.col("c") >= least).toArrow()
        word, c = head.column("word").to_pylist(), head.column("c").to_numpy()
    order = sorted(range(len(word)), key=lambda i: (-c[i], word[i]))
    word, c = [word[i] for i in order], c[order]
    distinct = total[1]
    rare = rare_classes(distinct)
    ending = F.crc32(F.substring("word", -ENDING, ENDING)) % rare
    sums = (counts.where(F.col("word") != F.lit(END_KEY)).groupBy(ending.alias("cls"))
            .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).toArrow())
    tokens, kinds = np.zeros(rare, np.int64), np.zeros(rare, np.int64)
    tokens[sums.column("cls").to_numpy()] = sums.column("n").to_numpy()
    kinds[sums.column("cls").to_numpy()] = sums.column("v").to_numpy()
    own = own_words(len(word), distinct)
    for i in range(own):
        at = rare_class(word[i], rare)
        tokens[at] -= c[i]
        kinds[at] -= 1
    return Vocabulary(total[0] or 0, distinct, total[2] or 0, word, c, own, tokens, kinds)


class _Index(dict):
    """Place of a head word; -1 for other words."""

    def __missing__(self, word):
        return -1


def encode(rows: DataFrame, vocabulary) -> DataFrame:
    """Adds to rows (id, held_out, text): n_tokens, head_known, head_log (sum
    of log10(c + 1) of head words and ends), rare_log (that sum over the rare
    words of the head, less the log10 totals of the classes of all rare
    words), ``classes`` (32 bits each) and ``tail`` (words outside the head)."""
    def make(batches):
        known = vocabulary.value
        own, rare, norm = known.own, known.rare, known.rare_norm()
        index = _Index(zip(known.words, range(len(known.words))))
        logs = np.log10(np.append(known.counts, 0) + 1.0)  # -1 takes the last, 0
        end_log = math.log10(known.ends + 1.0)
        place = np.arange(len(known.words) + 1, dtype=np.uint32) + 1 + rare
        place[own:-1] = [1 + rare_class(w, rare) for w in known.words[own:]]
        for batch in batches:
            out = [[] for _ in range(6)]
            for tokens in _words(batch.column(2)):
                at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                tail = np.flatnonzero(at < 0)
                others = [tokens[i] for i in tail]
                cls = np.append(place[at], np.uint32(END))
                cls[tail] = [1 + rare_class(w, rare) for w in others]
                seldom = at[at >= own]
                lost = norm[cls[(cls > END) & (cls <= rare)] - 1].sum()
                for part, value in zip(out, (
                        len(tokens) + 1, len(tokens) - len(tail) + (known.ends > 0),
                        float(logs[at].sum()) + end_log, float(logs[seldom].sum() - lost),
                        cls.tobytes(), others)):
                    part.append(value)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(p, t) for p, t in zip(out, types)]],
                names=["id", "held_out", "n_tokens", "head_known", "head_log", "rare_log", "classes", "tail"])

    return rows.mapInArrow(make, f"id {type_of(rows, 'id')}, held_out boolean, n_tokens bigint, "
                                 "head_known bigint, head_log double, rare_log double, "
                                 "classes binary, tail array<binary>")


# ----------------------------------------------------------------- the model
@dataclass
class Model:
    """start (S), share (S), move (S x S), emit (classes x S)."""

    start: np.ndarray
    share: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def first_model(unigram: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * rng.gamma(2.0, 0.5, (len(unigram), states))
    move = rng.random((states, states)) + 0.2 + STAY * np.eye(states)
    even = np.full(states, 1 / states)
    return Model(even, even, move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def _pieces(docs: list[np.ndarray], length: int):
    """Groups of about ``TOKENS_AT_ONCE`` tokens as lists of (document, its
    segments before this piece, tokens).  A longer document is cut at segment
    borders; its next piece is the first of the next group."""
    limit = max(1, TOKENS_AT_ONCE // length) * length
    held, size = [], 0
    for i, d in enumerate(docs):
        for at in range(0, len(d), limit):
            piece = d[at:at + limit]
            held.append((i, at // length, piece))
            size += len(piece)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _segments(group, length: int):
    """(padded classes, lengths, piece, place in its piece, whether it is the
    first of its document) of segments, longest first, so the first rows of a
    step are the ones still running."""
    flat = np.concatenate([d for _, _, d in group])
    sizes = np.array([len(d) for _, _, d in group])
    per = -(-sizes // length)
    piece = np.repeat(np.arange(len(group)), per)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(per) - per, per)
    opens = (nth == 0) & (np.array([before for _, before, _ in group]) == 0)[piece]
    starts = np.repeat(np.cumsum(sizes) - sizes, per) + nth * length
    lengths = np.minimum(length, np.repeat(sizes, per) - nth * length)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    at = np.minimum(starts[:, None] + np.arange(length), len(flat) - 1)
    return flat[at].astype(np.int64), lengths, piece[order], nth[order], opens[order]


def expected_counts(docs: list[np.ndarray], model: Model, length: int = SEGMENT):
    """Baum-Welch counts of texts: (start, move, emit, log10 likelihood)."""
    states, classes = len(model.start), len(model.emit)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    total = 0.0
    for group in _pieces(docs, length):
        ids, lengths, _, _, opens = _segments(group, length)
        steps = int(lengths.max())
        running = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
        seen = model.emit[ids]
        ahead, scales = [], []
        a = np.where(opens[:, None], model.start, model.share)
        for t in range(steps):
            n = running[t]
            a = (a if t == 0 else a[:n] @ model.move) * seen[:n, t]
            scale = a.sum(axis=1, keepdims=True)
            a = a / scale
            ahead.append(a)
            scales.append(scale)
            total += np.log10(scale).sum()
        back, weights = np.ones((running[-1], states)), []
        for t in range(steps - 1, -1, -1):
            n = running[t]
            if len(back) < n:  # segments that end here
                back = np.concatenate([back, np.ones((n - len(back), states))])
            weight = ahead[t] * back
            weights.append(weight)
            if t == 0:
                start += weight[opens[:n]].sum(axis=0)
            else:
                later = seen[:n, t] * back / scales[t]
                move += model.move * (ahead[t - 1][:n].T @ later)
                back = later @ model.move.T
        weights = np.concatenate(weights)
        at = np.concatenate([ids[:running[t], t] for t in range(steps - 1, -1, -1)])
        for s in range(states):
            emit[:, s] += np.bincount(at, weights[:, s], classes)
    return start, move, emit, total


def log_likelihoods(docs: list[np.ndarray], model: Model, length: int = SEGMENT) -> np.ndarray:
    """Exact log10 likelihood of each whole text by the scaled forward
    recursion; a segment's steps make one matrix, rescaled as it grows."""
    states = len(model.start)
    out, end = np.zeros(len(docs)), model.start
    for group in _pieces(docs, length):
        ids, lengths, piece, nth, opens = _segments(group, length)
        steps = int(lengths.max())
        carry = np.broadcast_to(np.eye(states), (len(ids), states, states)).copy()
        logs = np.zeros(len(ids))
        for t in range(steps):
            n = int(np.searchsorted(-lengths, -t, side="left"))
            # The first token of a text has no move before it.
            moved = (carry[:n].reshape(-1, states) @ model.move).reshape(n, states, states)
            if t == 0:
                moved[opens[:n]] = np.eye(states)
            moved *= model.emit[ids[:n, t]][:, None, :]
            scale = moved.sum(axis=(1, 2))
            carry[:n] = moved / scale[:, None, None]
            logs[:n] += np.log10(scale)
        # Multiply each piece's segments in order, all pieces at once.
        order = np.lexsort((piece, nth))
        piece, nth, carry, logs = piece[order], nth[order], carry[order], logs[order]
        state = np.stack([end if before else model.start for _, before, _ in group])
        likelihood = np.zeros(len(group))
        ends = np.searchsorted(nth, np.arange(nth.max() + 2))
        for lo, hi in zip(ends[:-1], ends[1:]):
            d = piece[lo:hi]
            state[d] = np.einsum("ds,dsk->dk", state[d], carry[lo:hi])
            scale = state[d].sum(axis=1)
            state[d] /= scale[:, None]
            likelihood[d] += np.log10(scale) + logs[lo:hi]
        np.add.at(out, [i for i, _, _ in group], likelihood)
        end = state[-1]
    return out


def next_model(counts: np.ndarray, start: np.ndarray, move: np.ndarray, unigram: np.ndarray) -> Model:
    """Maximisation: shares of the expected counts, emissions smoothed by the
    unigram shares so that every class keeps a probability in every state."""
    share = counts.sum(axis=0) + 1.0
    emit = counts + SMOOTH * unigram[:, None]
    start, move = start + 1.0, move + 1.0
    return Model(start / start.sum(), share / share.sum(), move / move.sum(axis=1, keepdims=True),
                 emit / emit.sum(axis=0))


def train(encoded: DataFrame, unigram: np.ndarray, states: int = STATES,
          passes: int = PASSES) -> Model:
    """Baum-Welch over all training rows; each pass reads them once."""
    spark = encoded.sparkSession
    model = first_model(unigram, states)
    columns = [f"s{i}" for i in range(states)]
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(model)

        def count(batches, sent=sent):
            model = sent.value
            size = len(model.emit)
            totals = np.zeros((size + 1 + states, states))
            for batch in batches:
                docs = [np.frombuffer(b, np.uint32) for b in batch.column(0).to_pylist()]
                start, move, emit, _ = expected_counts(docs, model)
                totals[:size] += emit
                totals[size] += start
                totals[size + 1:] += move
            at = np.flatnonzero(totals.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), *[pa.array(totals[at, s]) for s in range(states)]],
                names=["row", *columns])

        sums = (encoded.where("not held_out").select("classes")
                .mapInArrow(count, "row bigint, " + ", ".join(f"{c} double" for c in columns))
                .groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow())
        size = len(unigram)
        totals = np.zeros((size + 1 + states, states))
        totals[sums.column("row").to_numpy()] = np.stack(
            [sums.column(c).to_numpy() for c in columns], axis=1) if sums.num_rows else 0
        model = next_model(totals[:size], totals[size], totals[size + 1:], unigram)
        sent.unpersist()
    return model


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``.

    A null or empty text is its end token alone.  A null id is not held out.
    Rows that repeat count and score as documents of their own.  Without
    training rows the base score is 0 and the states are those of the start.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), fold(F.col(id_col), folds, held).alias("held_out"),
                       F.col(text_col).alias("text"))
    counts = materialize(word_counts(rows.where("not held_out").select("text")), "word-counts")
    vocabulary = read_vocabulary(counts)
    head = spark.sparkContext.broadcast(vocabulary)
    encoded = materialize(encode(rows, head)
                          .withColumn("rid", F.monotonically_increasing_id()), "encoded")
    head.unpersist()
    model = train(encoded, vocabulary.unigram(), STATES, PASSES)

    sent = spark.sparkContext.broadcast(model)

    def likelihood(batches):
        for batch in batches:
            docs = [np.frombuffer(b, np.uint32) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(log_likelihoods(docs, sent.value))],
                names=[*batch.schema.names[1:], "path"])

    narrow = ["id", "held_out", "n_tokens", "head_known", "head_log", "rare_log", "rid"]
    fields = ", ".join(f"{c} {type_of(encoded, c)}" for c in narrow)
    scored = encoded.select("classes", *narrow).mapInArrow(likelihood, f"{fields}, path double")

    tail = (encoded.select("rid", F.explode("tail").alias("word")).join(counts, "word")
            .groupBy("rid").agg(F.count(F.lit(1)).alias("t_known"),
                                F.sum(F.log10(F.col("c") + 1)).alias("t_log")))
    joined = scored.join(tail, "rid", "left")
    n, v = vocabulary.tokens, vocabulary.distinct
    t_log = F.coalesce("t_log", F.lit(0.0))
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("t_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_log") + t_log - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"),
        (F.col("path") + F.col("rare_log") + t_log).alias("score"))
