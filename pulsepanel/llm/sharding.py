"""Sharding by proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's
fractional rank is ``(rank + 1/2) / rows of the source``.  All rows sorted by
fractional rank interleave the sources in proportion, so cutting that order
into runs of equal length gives every shard the mixture of the whole.

Scale: the text is read once, into a written table of ids, sizes and
checksums.  Both rankings number rows inside (group, bucket) and add bucket
offsets, so neither a hot source nor the global order meets in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import bucket_count, group_rank, hash52, source_key
from pulsepanel.sources.sinks import materialize

SHARDS = 40
#: Bytes that a row costs beside its text.
ROW_BYTES = 16
SEED = 9


def interleave_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                      text_col: str = "text", source_col: str = "source", seed: int = SEED,
                      carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, carried columns, ``size``, ``text_crc32``,
    ``shard``, ``slot`` (position in the shard) and ``fraction``.

    Row counts of shards differ by at most one.  A null text has no bytes and
    the checksum of the empty text.  A null source is one source.  Rows that
    repeat in full get slots of their own.  An empty table gives no rows; with
    fewer rows than shards some shards stay empty.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = materialize(
        docs.select(F.col(id_col).alias("_id"),
                    *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
                    source_key(F.col(source_col)).alias("_src"),
                    (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
                    F.crc32(body).alias("text_crc32"),
                    (hash52(F.lit(seed), F.col(id_col)) / float(1 << 52)).alias("_u")),
        "shard-rows")
    total = base.count()
    buckets = bucket_count(total)
    counts = base.groupBy(F.col("_src").alias("_ns")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = group_rank(base, "_src", "_u", ["_id", "text_crc32"], buckets, "_rank")
    ranked = materialize(
        ranked.join(counts, F.col("_src") == F.col("_ns"))
        .withColumn("fraction", (F.col("_rank") + 0.5) / F.col("_n"))
        .withColumn("_all", F.lit(0)).drop("_ns", "_n", "_rank", "_u"), "shard-ranks")
    placed = group_rank(ranked, "_all", "fraction", ["_src", "_id", "text_crc32"], buckets, "_pos")
    # In whole numbers: shard s starts at ceil(s * total / shards).
    shard = F.expr(f"cast((_pos * {shards}) div {max(total, 1)} as int)")
    start = F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("_pos") - start)
            .select(F.col("_id").alias(id_col),
                    *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                    "size", "text_crc32", "shard", "slot", "fraction"))
