"""Document fingerprints from closed syncmers.

The units of a text are its words, cut after every eighth character; a
character of a script that is written without spaces is a unit of its own.
They form k-mers of ``K`` units.  Each holds ``K - S + 1`` inner runs of ``S``
units; a k-mer is a closed syncmer when the smallest hash among its inner runs
is the first or the last one.  The choice looks at nothing but the k-mer
itself, so a passage has the same anchors wherever it stands.  The fingerprint
is the text's anchors in order, each with its unit position.  Likeness matches
anchors by position: of the anchors that two texts share, those on consistent
offsets count.

Scale: DataFrame functions only.  A document meets its successor in one
shuffle of the texts: ids fall into ranges of about ``BUCKET_ROWS`` rows, and
the first row of each range also goes to the range before it.  No window spans the
table and no group holds more than a range.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.sources.sinks import materialize

#: Characters of scripts without spaces between words (Thai, Lao,
#: Myanmar, Khmer; East Asian radicals, kana, ideographs).
UNSPACED = (r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u9FFF\uF900-\uFAFF"
            r"\x{20000}-\x{3FFFF}")
#: Characters of a unit at most.
UNIT_CHARS = 8
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,{UNIT_CHARS}}}"
#: Units of a k-mer and of its inner runs: of two neighbouring k-mers one is an
#: anchor, so five units that two texts share in a row always give one.
K, S = 4, 2
#: Shared anchors count when their offset is near the median one: within this
#: share of the longer text's units, SLACK_UNITS at least.
SLACK, SLACK_UNITS = 0.25, 4
#: Rows of an id range, and quantiles of the ids that are cut into ranges.
BUCKET_ROWS = 2000
QUANTILES = 128


def _shifts(name: str, count: int) -> F.Column:
    """Array of structs ``v0 .. v{count-1}``: each element with its successors
    (null beyond the end)."""
    size = F.greatest(F.size(name), F.lit(1))
    return F.arrays_zip(*[F.slice(name, i + 1, size).alias(f"v{i}") for i in range(count)])


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Adds ``out``: array of (hash, position) of the closed syncmers of a text
    column, in order.  A text with units but no syncmer has one anchor, the
    hash of all its units; a text without any has none."""
    inner = k - s + 1
    names = [f"_{out}_{x}" for x in ("w", "z", "h", "y")]
    w, z, h, y = names
    df = df.withColumn(w, F.regexp_extract_all(F.col(text), F.lit(f"({UNIT})"), F.lit(1)))
    df = df.withColumn(z, _shifts(w, s))
    df = df.withColumn(h, F.transform(F.slice(F.col(z), 1, F.greatest(F.size(w) - s + 1, F.lit(0))),
                                      lambda x: F.xxhash64(*[x[f"v{i}"] for i in range(s)])))
    df = df.withColumn(y, F.slice(_shifts(h, inner), 1,
                                  F.greatest(F.size(h) - inner + 1, F.lit(0))))

    def anchor(x, i):
        hashes = [x[f"v{j}"] for j in range(inner)]
        low = F.least(*hashes)
        chosen = (low == hashes[0]) | (low == hashes[-1])
        return F.when(chosen, F.struct(F.xxhash64(*hashes).alias("hash"), i.alias("at")))

    found = F.filter(F.transform(F.col(y), anchor), lambda a: a.isNotNull())
    df = df.withColumn(out, found)
    whole = F.array(F.struct(F.xxhash64(F.array_join(w, " ")).alias("hash"), F.lit(0).alias("at")))
    return (df.withColumn(out, F.when((F.size(out) == 0) & (F.size(w) > 0), whole)
                          .otherwise(F.col(out))).drop(*names))


def fingerprint_text(anchors) -> F.Column:
    """Anchors as text: 16 hexadecimal digits and the unit position each."""
    return F.array_join(F.transform(anchors, lambda a: F.concat(
        F.lpad(F.lower(F.hex(a["hash"])), 16, "0"), F.lit("@"), a["at"].cast("string"))), " ")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Adds ``out``: the Dice share of the distinct anchors of two columns that
    match by position; 1 for two texts without any.

    An anchor stands where it occurs first.  Its offset is the difference of
    its two positions; it matches when that is within ``SLACK`` of the median
    offset.  So an insertion or a removal shifts what follows it without loss,
    while passages that changed places match on one side only."""
    e, n, o = (f"_{out}_{x}" for x in "eno")
    # (hash, side, position): the first text's last, its positions negative, so
    # that in sorted order its first occurrence stands next to the second's.
    both = F.sort_array(F.concat(
        F.transform(a, lambda v: F.struct(v["hash"].alias("h"), F.lit(0).alias("s"), (-v["at"]).alias("p"))),
        F.transform(b, lambda v: F.struct(v["hash"].alias("h"), F.lit(1).alias("s"), v["at"].alias("p")))))
    pair = F.transform(_shifts(e, 2), lambda x: F.when(
        (x["v0"]["h"] == x["v1"]["h"]) & (x["v0"]["s"] < x["v1"]["s"]), x["v0"]["p"] + x["v1"]["p"]))
    sizes = [F.size(F.array_distinct(F.transform(x, lambda v: v["hash"]))) for x in (a, b)]
    df = df.withColumn(e, both).withColumn(n, sizes[0] + sizes[1])
    df = df.withColumn(o, F.sort_array(F.filter(pair, lambda v: v.isNotNull())))
    last = F.greatest(*[F.coalesce(F.element_at(x, -1)["at"], F.lit(0)) for x in (
        F.when(F.size(c) > 0, F.col(c)) for c in (a, b))])
    slack = F.greatest(F.lit(SLACK) * (last + K), F.lit(float(SLACK_UNITS)))
    middle = F.get(F.col(o), F.floor(F.size(o) / 2).cast("int"))
    near = F.size(F.filter(o, lambda v: F.abs(v - middle) <= slack))
    share = F.when(F.col(n) == 0, F.lit(1.0)).otherwise(2.0 * near / F.greatest(F.col(n), F.lit(1)))
    return df.withColumn(out, share).drop(e, n, o)


def with_range(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Adds ``_b``, a number that rises with ``_k`` (non-null): quantiles of
    the ids, each cut evenly into ranges of about ``BUCKET_ROWS`` rows."""
    points = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = ids.agg(F.percentile_approx("_k", points, 10 * QUANTILES).alias("q"),
                  F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return rows.withColumn("_b", F.lit(0).cast("long"))
    cut = math.ceil(row["n"] / QUANTILES / BUCKET_ROWS)
    bounds = F.array(*[F.lit(q).cast("long") for q in row["q"]])
    rows = rows.withColumn("_p", F.greatest(
        F.size(F.filter(bounds, lambda q: q <= F.col("_k"))) - 1, F.lit(0)))
    low = F.get(bounds, F.col("_p")).cast("double")
    width = F.coalesce(F.get(bounds, F.col("_p") + 1).cast("double") - low, F.lit(1.0))
    inside = F.floor((F.col("_k").cast("double") - low) / F.greatest(width, F.lit(1.0)) * cut)
    inside = F.greatest(F.least(inside, F.lit(cut - 1)), F.lit(0))
    return rows.withColumn("_b", F.col("_p").cast("long") * cut + inside).drop("_p")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``_id``, ``_text`` of id ranges ``_b``, with the first row of the
    next range as a guest at the end of each (of the first for the last).
    Null ids come first; rows of one id follow in the order of a text hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    least = docs.agg(F.min(key)).first()[0]
    least = max(-(1 << 63), (least or 0) - 1)
    key = F.coalesce(key, F.lit(least).cast("long")).alias("_k")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), key)
    rows = with_range(rows, docs.select(key))
    # One row per range; the window over them gives each the range before.
    firsts = rows.groupBy("_b").agg(F.min("_k").alias("_first"))
    order = Window.orderBy("_b")
    firsts = materialize(
        firsts.withColumn("_to", F.lag("_b").over(order))
        .withColumn("_last", F.max("_b").over(Window.partitionBy(F.lit(0))))
        .select("_first", F.coalesce("_to", "_last").alias("_to")), "fingerprint-ranges")
    guests = (rows.join(firsts, F.col("_k") == F.col("_first"))
              .select("_id", "_text", "_k", F.col("_to").alias("_b"), F.lit(True).alias("_guest")))
    both = rows.withColumn("_guest", F.lit(False)).unionByName(guests)
    return both.withColumn("_tie", F.xxhash64("_text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                 s: int = S) -> DataFrame:
    """One row per document: id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by
    the first as many (or all) of the next document.  Ids are whole numbers;
    a null id comes first, a null text is empty, and a single document is its
    own successor.  Rows that repeat follow each other.  An empty table gives
    no rows.
    """
    rows = with_next(docs, id_col, text_col)
    order = Window.partitionBy("_b").orderBy("_guest", "_k", "_tie")
    rows = rows.withColumn("_next", F.lead("_text").over(order))
    rows = with_anchors(rows, "_text", "_a", k, s)
    rows = rows.withColumn("_na", F.lead("_a").over(order)).where("not _guest")
    n = F.length("_text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn(
        "_edited", F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - half),
                            F.substring(F.col("_next"), F.lit(1), half)))
    rows = with_anchors(rows, "_edited", "_ea", k, s)
    rows = with_likeness(with_likeness(rows, "_a", "_ea", "near_edited"), "_a", "_na", "near_next")
    return rows.select(
        F.col("_id").alias(id_col), "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("_a")).alias("fingerprint"),
        fingerprint_text(F.col("_ea")).alias("edited_fingerprint"),
        "near_edited", "near_next")
