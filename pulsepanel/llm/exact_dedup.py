"""Exact dedup by distributed MSD radix partitioning.

Texts are split by successive bytes, most significant first.  A digit is a
run of bytes whose width grows eightfold from round to round, so a text of
``n`` bytes needs about ``log8(n)`` rounds.  After each round a row leaves
when its group is a singleton or when its text has ended; only the rest of
the bytes of the remaining rows is written on.  Two rows are equal when
every digit is equal: no digest takes part in the decision.

Scale: a round is one partial aggregation over (group, digit) and one join of
rows with the groups of more than one row.  The groups are read from a written
table, so both join inputs are plain shuffles that adaptive execution can
split: a group of copies with a third of all rows is spread over tasks.  The
join is a merge join at every size: the groups grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import SPACE
from pulsepanel.sources.sinks import materialize

FIRST_WIDTH = 64
GROWTH = 8


def normalised(text) -> F.Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: tuple[str, ...] = (), first_width: int = FIRST_WIDTH) -> DataFrame:
    """One row per input row: id, carried columns, ``keep_id``, ``group_size``,
    ``kept`` and ``text_sha256`` (of the normalised text; a column of the
    result, not of the comparison).

    Of equal texts the row with the smallest id stays; null ids come last, and
    of rows with the same id exactly one stays.  Null and empty texts are
    equal.  An empty table gives an empty result.  Columns that are neither
    named nor carried are not read.
    """
    text = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"),
                       *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                       F.sha2(text, 256).alias("_sha"), F.encode(text, "UTF-8").alias("_rest"))
    carried = [f"_c{i}" for i in range(len(carry))]

    # Round 0 only tells which first digits occur more than once.  Rows get
    # their row number when they are first written.
    digit = F.substring("_rest", 1, first_width)
    often = materialize(rows.groupBy(digit.alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
                        .where("_n > 1"), "radix-groups")
    joined = rows.withColumn("_d", digit).join(often.hint("merge"), "_d", "left")
    state = materialize(
        joined.select("_id", *carried, "_sha", F.monotonically_increasing_id().alias("_rid"),
                      F.lit(0).cast("long").alias("_gid"), F.col("_id").alias("_keep"),
                      F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"),
                      F.col("_n").isNotNull().alias("_active"),
                      F.when(F.col("_n").isNotNull(), F.col("_rest")).alias("_rest")),
        "radix-rows")
    done = [state.where("not _active")]
    active = state.where("_active")
    width = first_width * GROWTH
    while not active.isEmpty():
        state = _round(active, carried, width)
        done.append(state.where("not _active"))
        active = state.where("_active")
        width *= GROWTH

    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(F.col("_id").alias(id_col),
                      *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                      F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
                      F.col("_kept").alias("kept"), F.col("_sha").alias("text_sha256"))


def _round(active: DataFrame, carried: list[str], width: int) -> DataFrame:
    """Split every group by its next ``width`` bytes and write the rows back."""
    rows = active.withColumn("_d", F.substring("_rest", 1, width))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
                           F.col("_rid").alias("rid")))
    groups = materialize(
        rows.groupBy("_gid", "_d")
        .agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"), F.min("_rid").alias("_next"))
        .where("_n > 1"), "radix-groups")
    joined = rows.drop("_keep", "_size", "_kept").join(
        groups.hint("merge"), ["_gid", "_d"], "left")
    several = F.col("_n").isNotNull()
    ended = F.length("_d") < width
    going = several & ~ended
    return materialize(
        joined.select(
            "_id", *carried, "_sha", "_rid",
            F.coalesce("_next", "_gid").alias("_gid"),
            F.when(several, F.col("_first.id")).otherwise(F.col("_id")).alias("_keep"),
            F.coalesce("_n", F.lit(1)).cast("long").alias("_size"),
            F.coalesce(F.col("_first.rid") == F.col("_rid"), F.lit(True)).alias("_kept"),
            going.alias("_active"),
            F.when(going, F.expr(f"substring(_rest, {width + 1})")).alias("_rest")),
        "radix-rows")
