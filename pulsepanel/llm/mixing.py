"""Mixing sources to target weights by Pareto order sampling.

Each source gets a word target: its weight's share of the mix, at most
``max_repeat`` times its words, the excess reshared by weight (a water level
over the sources).  A source's target holds a number of whole copies of all
its documents, which are allocated first; the rest is an unequal-probability
sample.  A document's inclusion probability is ``min(1, a * preference)``
with ``a`` solved so that the expected words equal the rest.  Documents are
ranked by ``odds(u) / odds(inclusion probability)``, ``u`` a seeded uniform
number of the document, and taken in that order while they fit the rest; one
document whose size is closest to the words still missing completes it.

Scale: the text is read once, into a written table of ids and sizes.  The cut
comes from sums per (source, bucket of the rank), and only the rows of one
bucket per source are numbered, so a source with a third of all documents is
never in one task.  Buckets follow the row count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.llm.common import WORD, bucket_count, hash52, source_key
from pulsepanel.sources.sinks import materialize

#: Weights by position of the source in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this many hundredths of all words.
TOTAL_PERCENT = 150
MAX_REPEAT = 2
#: Preference of a document for the sampled copy: 1 for the shortest, 8 from
#: 448 words on; very short documents gain least from being repeated.
PREFERENCE_WORDS = 64
PREFERENCE_MAX = 8
SEED = 1


def source_targets(sizes: DataFrame, weights=WEIGHTS, total_percent: int = TOTAL_PERCENT,
                   max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Per source (``_src``): words, weight and target.

    The unpartitioned windows run over one row per source.
    """
    per = sizes.groupBy("_src").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy("_src")) - 1
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int")).cast("long"))
    ratio = F.col("source_size") / F.col("weight")
    level = Window.orderBy(ratio, "_src")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    cap = F.col("source_size") * max_repeat
    per = (per
           .withColumn("_left", F.sum("source_size").over(everything) * total_percent
                       - 100 * F.coalesce(F.sum(cap).over(before), F.lit(0)))
           .withColumn("_weights", F.sum("weight").over(rest)))
    # A source is full when its cap is at most its share of what is left.
    full = 100 * cap * F.col("_weights") <= F.col("weight") * F.col("_left")
    per = per.withColumn("_share", F.when(~full, F.col("_left") / (100 * F.col("_weights"))))
    # All sources that are not full share the level of the first of them.
    first = F.first("_share", ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (per.withColumn("target", F.when(full, cap.cast("double"))
                           .otherwise(F.col("weight") * first))
            .select("_src", "source_size", "weight", "target"))


def inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per (source, preference): inclusion probability of the sampled copy.

    From the highest preference down, classes are certain until the remaining
    words spread over the remaining classes give a probability of at most 1.
    """
    classes = (sizes.where("size > 0").groupBy("_src", "_pref")
               .agg(F.sum("size").alias("_words")).join(targets, "_src"))
    down = Window.partitionBy("_src").orderBy(F.desc("_pref"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    below = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (classes
            .withColumn("_open", F.col("_rest") - F.coalesce(F.sum("_words").over(above), F.lit(0)))
            .withColumn("_mass", F.sum(F.col("_words") * F.col("_pref")).over(below))
            .withColumn("_try", F.greatest(F.col("_open") / F.col("_mass"), F.lit(0.0)))
            .withColumn("_a", F.first(F.when(F.col("_try") * F.col("_pref") <= 1, F.col("_try")),
                                      ignorenulls=True)
                        .over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .select("_src", "_pref",
                    F.least(F.lit(1.0), F.coalesce(F.col("_a") * F.col("_pref"), F.lit(1.0)))
                    .alias("_prob")))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", carry: tuple[str, ...] = (), weights=WEIGHTS,
                total_percent: int = TOTAL_PERCENT, max_repeat: int = MAX_REPEAT,
                seed: int = SEED) -> DataFrame:
    """One row per document: id, carried columns, ``size``, ``source_size``,
    ``target`` of its source, ``copies`` and ``taken`` (copies times size).

    A null text has size 0; documents without words are never sampled, and
    get their source's whole copies.  A null source is one source, the last.
    Ties in the ranking go to the smaller id, null first.  Rows that repeat
    in full are separate documents.  An empty table gives no rows; a table
    without words gives targets of 0.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = materialize(
        docs.select(F.col(id_col).alias("_id"),
                    *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                    source_key(F.col(source_col)).alias("_src"), words.alias("size"),
                    hash52(F.lit(seed), F.col(id_col)).alias("_h"),
                    F.monotonically_increasing_id().alias("_rid"))
        .withColumn("_pref", F.least(F.lit(PREFERENCE_MAX),
                                     1 + F.floor(F.col("size") / PREFERENCE_WORDS)).cast("long")),
        "mix-sizes")
    targets = source_targets(sizes, weights, total_percent, max_repeat)
    whole = F.when(F.col("source_size") > 0,
                   F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    whole = F.least(F.coalesce(whole, F.lit(0)), F.lit(max_repeat)).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn(
        "_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")

    u = (F.col("_h") + 0.5) / float(1 << 52)
    p = F.col("_prob")
    drawn = (sizes.join(materialize(inclusion(sizes, targets), "mix-odds"), ["_src", "_pref"], "left")
             .join(targets, "_src")
             .withColumn("_q", F.when((p >= 1) & (F.col("size") > 0), F.lit(0.0))
                         .when((p > 0) & (F.col("size") > 0), u / (1 - u) / (p / (1 - p)))))
    buckets = bucket_count(sizes.count())
    spot = F.col("_q") / (1 + F.col("_q"))
    drawn = drawn.withColumn(
        "_b", F.least(F.floor(spot * buckets), F.lit(buckets - 1)).cast("long"))

    # The bucket in which each source's rest runs out, and what fits into it.
    # A source without any sampled words has no such bucket.
    run = Window.partitionBy("_src").orderBy("_b")
    sums = (drawn.where("_q is not null").groupBy("_src", "_b")
            .agg(F.sum("size").alias("_w"), F.first("_rest").alias("_rest"))
            .withColumn("_upto", F.sum("_w").over(run)))
    edge = (sums.where("_upto > _rest").groupBy("_src")
            .agg(F.min(F.struct("_b", (F.col("_rest") - F.col("_upto") + F.col("_w")).alias("room")))
                 .alias("_e"))
            .select("_src", F.col("_e._b").alias("_eb"), F.col("_e.room").alias("_room")))
    drawn = materialize(drawn.join(edge, "_src", "left"), "mix-drawn")
    inside = Window.partitionBy("_src").orderBy("_q", "_id", "_rid")
    at_edge = (drawn.where("_q is not null and _b = _eb").withColumn("_sum", F.sum("size").over(inside))
               .withColumn("_in", F.col("_sum") <= F.col("_room")).drop("_sum"))
    others = drawn.where("_q is null or _eb is null or _b <> _eb").withColumn(
        "_in", F.col("_q").isNotNull() & F.coalesce(F.col("_b") < F.col("_eb"), F.lit(True)))
    chosen = materialize(at_edge.unionByName(others), "mix-chosen")

    # One more document per source where it brings the words closer.
    gap = (chosen.groupBy("_src")
           .agg((F.first("_rest") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(0)))
                .alias("_gap")))
    near = F.abs(F.col("_gap") - F.col("size"))
    extra = (chosen.where("not _in and _q is not null").join(gap, "_src")
             .where(near < F.col("_gap")).groupBy("_src")
             .agg(F.min(F.struct(near.alias("d"), F.col("size").alias("s"),
                                 F.col("_id").alias("i"), F.col("_rid").alias("r"))).alias("_x"))
             .select("_src", F.col("_x.r").alias("_extra")))
    copies = (F.col("_whole") + F.col("_in").cast("long")
              + F.coalesce(F.col("_rid") == F.col("_extra"), F.lit(False)).cast("long"))
    return (chosen.join(extra, "_src", "left").withColumn("copies", copies)
            .select(F.col("_id").alias(id_col),
                    *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                    "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))
