"""Packing documents into token sequences by non-negative least squares.

Every document is tokenised once and cut into full windows and a remainder.
The histogram of piece lengths has at most ``window`` entries, whatever the
number of documents.  Shallow combinations of lengths that fill a window
exactly are enumerated; non-negative least squares solves how often each is
repeated so that together they use up the histogram; the counts are rounded
down; what is left is packed greedily, largest length first.  The plan says,
for the j-th piece of a length, its sequence and offset.

Scale: the driver sees only the histogram.  Pieces are numbered within their
length in buckets, so a length that a third of all pieces share is not
numbered by one task, and each task then looks its pieces up in the plan,
whose size is bounded by the window, not by the data.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import bucket_count, group_rank, type_of, worker_cache
from pulsepanel.sources.sinks import materialize

WINDOW = 4096
#: Id that ends a document.
END_ID = 2
#: A combination has one length up to so many times and at most one filler.
DEPTH = 12
ITERATIONS = 400
#: Words kept with their ids in a process, twice (those in use and older ones).
CACHE_WORDS = 400_000
CACHE_WORD_CHARS = 64
#: Characters that may follow a word; none of them is part of a special token.
PUNCTUATION = ".,;:!?*%$&#"


class WordIds(dict):
    """Ids of a word as little-endian 32-bit bytes, made on first use.

    The vocabulary's splitting rule never crosses a space or a line feed, nor
    the border between a letter and the punctuation in ``PUNCTUATION``, and it
    reads A-Z as a-z; so a text's ids are those of its lower-cased parts, one
    after the other, and only new words without their punctuation are encoded.
    Texts that hold the start of a special token keep their case.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.older = limit, {}

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self._encode(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self) >= self.limit:  # words in use come back from ``older``
                self.older = self.copy()
                self.clear()
            self[word] = packed
        return packed

    def _encode(self, word: str) -> bytes:
        core = word.rstrip(PUNCTUATION)
        # A letter whose lower case ends in a mark (I with dot) joins what follows.
        if core and len(core) < len(word) and core[-1].isalpha() and core[-1].lower()[-1].isalpha():
            return self[core] + self[word[len(core):]]
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            text = text.encode().lower().decode()  # A-Z only
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def word_ids(path: str) -> WordIds:
    """The cache of this worker process, which serves many tasks."""
    return worker_cache((WordIds, path), lambda: WordIds(path))


def cut_pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``window`` ids: id, start, length, ids_crc32, doc_tokens."""
    kind = type_of(docs, id_col)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        words = word_ids(tokenizer_path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for i in range(batch.num_rows):
                packed = words.encode(texts[i].as_py() or "") + end
                total = len(packed) // 4
                for start in range(0, total, window):
                    part = packed[4 * start:4 * (start + window)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in
                                                        (starts, lengths, crcs, totals)]],
                names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


# ------------------------------------------------------------------ the plan
@dataclass
class Plan:
    """Runs of pieces: pieces ``first`` .. of ``length`` go to consecutive
    sequences from ``sequence`` on, at ``offset``.  Sorted by (length, first)."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def combinations(lengths: np.ndarray, window: int, depth: int) -> list[dict[int, int]]:
    """Exact fills of the window: q times one length and at most one other."""
    have = set(lengths.tolist())
    out = []
    for a in lengths.tolist():
        for q in range(1, min(depth, window // a) + 1):
            rest = window - q * a
            if rest == 0:
                out.append({a: q})
            elif rest in have and (rest != a) and (q > 1 or a >= rest):
                out.append({a: q, rest: 1})
    return out


def solve(counts: dict[int, int], combos: list[dict[int, int]], iterations: int) -> np.ndarray:
    """min |A x - h| over x >= 0 by accelerated projected gradient."""
    lengths = sorted(counts)
    place = {a: i for i, a in enumerate(lengths)}
    h = np.array([counts[a] for a in lengths], dtype=float)
    if not combos:
        return np.zeros(0)
    rows = np.array([place[a] for c in combos for a in c])
    cols = np.array([j for j, c in enumerate(combos) for _ in c])
    vals = np.array([q for c in combos for q in c.values()], dtype=float)
    # Columns scaled to unit length: combinations of many pieces else stall.
    norm = np.sqrt(np.bincount(cols, vals * vals, len(combos)))
    vals = vals / norm[cols]
    forward = lambda x: np.bincount(rows, vals * x[cols], len(lengths))
    back = lambda r: np.bincount(cols, vals * r[rows], len(combos))
    v = np.ones(len(combos))
    for _ in range(30):
        v = back(forward(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(forward(v))))
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0, y - step * back(forward(y) - h))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / norm


def plan_windows(counts: dict[int, int], window: int = WINDOW, depth: int = DEPTH,
                 iterations: int = ITERATIONS) -> Plan:
    """Sequences for a histogram {piece length: count}; every piece is used."""
    left = {a: n for a, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    sequences = 0

    def apply(pattern: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for a, q in sorted(pattern.items(), reverse=True):
            for _ in range(q):
                runs.append((a, used[a], sequences, offset))
                used[a] += times
                offset += a
            left[a] -= q * times
        sequences += times

    if left.get(window):
        apply({window: 1}, left[window])
    lengths = np.array(sorted(a for a, n in left.items() if n and a < window), dtype=int)
    combos = combinations(lengths, window, depth)
    if combos:
        x = solve({int(a): left[int(a)] for a in lengths}, combos, iterations)
        for j in np.argsort(-x, kind="stable"):
            times = min([int(x[j] + 1e-6)] + [left[a] // q for a, q in combos[j].items()])
            if times > 0:
                apply(combos[j], times)
    # Greedy: fill from the largest length down, as often as the counts allow.
    some = sorted(a for a, n in left.items() if n > 0)
    while some:
        room, pattern, at = window, {}, len(some) - 1
        while at >= 0:
            a = some[at]
            q = min(left[a], room // a)
            if q:
                pattern[a] = q
                room -= q * a
            at = min(at - 1, bisect.bisect_right(some, room) - 1)
        apply(pattern, min(left[a] // q for a, q in pattern.items()))
        some = [a for a in some if left[a] > 0]
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 4).T
    return Plan(*columns, sequences)


def place_pieces(ranked: DataFrame, plan: Plan) -> DataFrame:
    """Adds sequence_id and offset to pieces with ``length`` and ``nth``."""
    schema = ranked.schema
    length, first, sequence, offset = plan.length, plan.first, plan.sequence, plan.offset
    span = int(first.max(initial=0)) + 1

    def place(batches):
        keys = length * span + first
        for batch in batches:
            n = batch.schema.get_field_index("length")
            k = batch.schema.get_field_index("nth")
            a, j = batch.column(n).to_numpy(), batch.column(k).to_numpy()
            at = np.searchsorted(keys, a * span + np.minimum(j, span - 1), side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sequence[at] + j - first[at]), pa.array(offset[at])],
                names=[*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW,
                   end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A null or empty text is a document of the end id alone.  Documents longer
    than the window are cut into full windows and one remainder.  Rows that
    repeat are separate documents.  Offsets in a sequence leave no gap.  An
    empty table gives no rows.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, window, end_id, id_col, text_col)
                         .withColumn("_u", F.rand(10)), "pack-pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_windows(counts, window)
    ranked = group_rank(pieces, "length", "_u", ["id", "start", "ids_crc32"],
                        bucket_count(sum(counts.values())), "nth")
    return (place_pieces(ranked, plan)
            .select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                    "sequence_id", "offset"))
