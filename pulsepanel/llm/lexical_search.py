"""Ranked lexical search: accumulator-limited term at a time.

Every item asks for its best documents.  Documents are split into blocks; in
a block an item's terms are taken from the rarest to the most frequent.  While
a document without an accumulator could still enter the best ``k``, a term
opens accumulators; once the largest scores that the remaining terms can add
are below the k-th best partial score, none is opened, and the remaining terms
only update the survivors, exactly.  The results are those of scoring every
document for every item.

Scale: a document is tokenised once for each block of items and kept as its
length and the counts of the items' terms (a table in the shared folder).
Totals and document frequencies come from that table; a task then searches
its own documents and returns ``k`` rows an item at most.  What a task holds
follows the batch size and the items of one block, not the corpus.  Items go
in blocks of about ``ITEMS_AT_ONCE``, so their terms stay small.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.sources.sinks import materialize

TOP = 20
#: Items whose terms a task holds at once, about.
ITEMS_AT_ONCE = 512
#: Documents that are searched as one block at most.
DOCS_AT_ONCE = 20_000

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Stands for a null id inside numpy; sorts before every other id.
_NO_ID = np.iinfo(np.int64).min

HITS = "item int, doc_id bigint, score bigint"
TERMS = "doc_id bigint, n bigint, terms array<int>, counts array<int>"


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").translate(_LOWER))


def weight(documents: int, frequency: int) -> int:
    """Weight of a term that ``frequency`` of ``documents`` hold."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def count_terms(docs: DataFrame, vocabulary: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: all its terms with repeats, and the counts of
    those in the vocabulary."""

    def count(batches):
        known = vocabulary.get
        for batch in batches:
            ids, lengths, terms, counts, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms_of(text.as_py())
                if not words:
                    continue
                found = [t for t in map(known, words) if t is not None]
                at, times = np.unique(np.array(found, np.int32), return_counts=True)
                ids.append(doc_id)
                lengths.append(len(words))
                terms.append(at)
                counts.append(times.astype(np.int32))
                ends.append(ends[-1] + len(at))
            off = pa.array(ends, pa.int32())
            flat = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int32), pa.int32())
                    for p in (terms, counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 *[pa.ListArray.from_arrays(off, p) for p in flat]],
                names=["doc_id", "n", "terms", "counts"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, TERMS)


class Block:
    """Postings of a block of documents, by term, with their term scores."""

    def __init__(self, batch: pa.RecordBatch, documents: int, words: int, size: int):
        ids, n, terms, counts = batch.columns
        self.ids = ids.fill_null(int(_NO_ID)).to_numpy(zero_copy_only=False)
        m = 75 + 25 * n.to_numpy(zero_copy_only=False) * documents // max(words, 1)
        lengths = np.diff(terms.offsets.to_numpy())
        rows = np.repeat(np.arange(len(self.ids)), lengths)
        terms, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        order = np.argsort(terms, kind="stable")
        self.rows, tf = rows[order], tf[order]
        self.gains = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.rows])
        self.starts = np.searchsorted(terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        full = np.flatnonzero(np.diff(self.starts))
        if len(full):
            self.most[full] = np.maximum.reduceat(self.gains, self.starts[full])

    def search(self, item: list[tuple[int, int]], k: int, least: int):
        """(rows, scores) of the documents that can be among the best ``k``.

        ``item``: (term, weight times repeats), rarest first; ``least`` is a
        score that a document has to reach (k documents elsewhere have it)."""
        bound = np.array([w * self.most[t] for t, w in item], np.int64)
        left = bound.sum() - np.cumsum(bound)  # what the terms after this one can add
        score = np.zeros(len(self.ids), np.int64)
        opened, at = 0, 0
        limit = least
        while at < len(item) and (at == 0 or left[at - 1] >= limit):  # new documents can get in
            t, w = item[at]
            low, high = self.starts[t], self.starts[t + 1]
            if w and high > low:
                score[self.rows[low:high]] += w * self.gains[low:high]
                opened += high - low
                if opened >= k and left[at] < score.max():
                    limit = max(least, _kth(score, k))
            at += 1
        alive = np.flatnonzero(score)
        for t, w in item[at:]:
            low, high = self.starts[t], self.starts[t + 1]
            if w and high > low and len(alive):
                rows = self.rows[low:high]
                spot = np.minimum(np.searchsorted(rows, alive), len(rows) - 1)
                hit = rows[spot] == alive
                score[alive[hit]] += w * self.gains[low:high][spot[hit]]
        alive = alive[score[alive] >= max(least, 1)]
        return alive, score[alive]


def _kth(score: np.ndarray, k: int) -> int:
    """The k-th best score, 0 where fewer documents have one."""
    return int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0


def _best(ids: np.ndarray, scores: np.ndarray, k: int):
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search_task(batches, queries: list[list[tuple[int, int]]], documents: int, words: int,
                size: int, k: int):
    """The best ``k`` documents of a task for every item, block by block."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in queries]
    for batch in batches:
        for at in range(0, batch.num_rows, DOCS_AT_ONCE):
            block = Block(batch.slice(at, DOCS_AT_ONCE), documents, words, size)
            for i, item in enumerate(queries):
                ids, scores = best[i]
                least = int(scores[-1]) if len(scores) == k else 0
                rows, found = block.search(item, k, least)
                if len(rows):
                    best[i] = _best(np.concatenate([ids, block.ids[rows]]),
                                    np.concatenate([scores, found]), k)
    for at in range(0, len(best), 256):
        part = best[at:at + 256]
        ids = np.concatenate([b[0] for b in part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(at, at + len(part), dtype=np.int32), [len(b[0]) for b in part])),
             pa.array(ids, mask=ids == _NO_ID), pa.array(np.concatenate([b[1] for b in part]))],
            names=["item", "doc_id", "score"])


def _search_block(docs, items, k, id_col, text_col):
    """The best documents of a bounded list of (item_id, text)."""
    words_of = [terms_of(text) for _, text in items]
    vocabulary = {t: i for i, t in enumerate(sorted({t for ws in words_of for t in ws}))}
    counted = materialize(count_terms(docs, vocabulary, id_col, text_col), "search-terms")
    documents, words = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = [weight(documents, held.get(t, 0)) for t in range(len(vocabulary))]
    queries = []
    for ws in words_of:
        times: dict[int, int] = {}
        for t in ws:
            times[vocabulary[t]] = times.get(vocabulary[t], 0) + 1
        rare_first = sorted(times, key=lambda t: (held.get(t, 0), t))
        queries.append([(t, weights[t] * times[t]) for t in rare_first if t in held])
    size = len(vocabulary)
    hits = counted.mapInArrow(
        lambda batches: search_task(batches, queries, documents, words, size, k), HITS)
    rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    names = docs.sparkSession.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(items)], "item int, item_id long")
    return (hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score.

    Null and empty texts have no term: such a document is never found and does
    not count, such an item finds nothing.  Equal scores go by ascending id,
    null first; documents that repeat an id are rows of their own.  Items are
    distinct (id, text) rows: two texts under one id are ranked apart.  Only
    documents with a score above 0 are returned.  No documents or no items:
    no rows.
    """
    asked = materialize(items.select(F.col(item_col).cast("long").alias("item_id"),
                                     F.col(item_text).alias("item_text")).distinct(), "search-items")
    blocks = max(1, -(-asked.count() // ITEMS_AT_ONCE))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)))
    found = []
    for block in range(blocks):
        part = sorted(map(tuple, asked.where(F.col("block") == block).drop("block").collect()),
                      key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        found.append(_search_block(docs, part, k, id_col, text_col))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
