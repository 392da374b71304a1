"""Exact, deterministic sampling.

``sampleBy``/``sample`` are Bernoulli: the size is only expected.  These
operators take an exact number of rows chosen by a seeded hash order
(the first 60 bits of ``md5("seed|key1|key2...")``, ties broken by the
keys).  The cut-off hash is found from the hashes alone, and the input is
then filtered by it: wide rows are neither shuffled nor written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.operators.rank import default_buckets, ordered_positions, value_prefix


def _hash(keys, seed: int) -> F.Column:
    """Seeded 60-bit hash: the first 15 hex digits of md5 over the seed and
    the keys' string forms joined by '|' (NULL keys skipped).  Any engine with
    ``md5`` computes the same order (for integer / string keys), so samples
    are reproducible outside Spark."""
    text = F.concat_ws("|", F.lit(str(int(seed))), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def uniform_sample(df: DataFrame, n: int, keys, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, the n smallest by seeded hash, ties by keys."""
    return _smallest(df.withColumn("_h", _hash(list(keys), seed)), n, list(keys)).drop("_h")


def _smallest(x: DataFrame, n: int, keys) -> DataFrame:
    """The n rows with the smallest ``_h``, ties by keys."""
    if n <= 0:
        return x.limit(0)
    pre = value_prefix(x.select("_h"), "_h", positions=lambda rows: {min(n, rows) - 1} if rows else set())
    if pre.total["n"] <= n:
        return x
    at = pre.df.where((F.col("cum_n") >= n) & (F.col("cum_n") - F.col("n") < n)).first()
    cut, need = at["_h"], n - (at["cum_n"] - at["n"])
    if need == at["n"]:
        return x.where(F.col("_h") <= cut)
    # Only repeated keys share a hash; the rows at the cut are numbered.
    ties = ordered_positions(x.where(F.col("_h") == cut), list(keys), pos="_p")
    return x.where(F.col("_h") < cut).unionByName(ties.where(F.col("_p") <= need).drop("_p"))


def _stratum_key(col) -> F.Column:
    """The stratum as a string that is not NULL."""
    return F.when(col.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), col.cast("string")))


def sample_sizes(counts: DataFrame, max_rows: int, total: int) -> DataFrame:
    """Adds ``n_sample`` = min(rows, max(1, round_half_even(rows * frac))), frac =
    max_rows / total in double arithmetic."""
    part = F.rint(F.col("count") * F.lit(max_rows / total if total else 1.0))
    return counts.withColumn("n_sample", F.least(
        F.col("count"), F.greatest(F.lit(1), part.cast("long"))))


def stratified_sample(df: DataFrame, max_rows: int, stratum: str = "safra", keys=("msno",),
                      seed: int = 42) -> DataFrame:
    """At most ``max_rows`` rows, proportional per stratum, exact sizes.

    Up to ``max_rows`` rows the input is returned whole.  Otherwise each
    stratum, that of NULL included, keeps its ``n_sample`` smallest-hash rows;
    if rounding pushes the total over ``max_rows`` a global hash trim follows.
    Counts and cut-offs per stratum stay DataFrames.
    """
    from pulsepanel.sources.sinks import materialize

    keys = list(keys)
    x = (df.withColumn("_h", _hash(keys + [stratum], seed))
         .withColumn("_s", _stratum_key(F.col(stratum))))
    narrow = materialize(x.select("_s", "_h", *keys), "sample_hashes")
    total = narrow.count()
    if total <= max_rows:
        return df
    sizes = materialize(sample_sizes(narrow.groupBy("_s").count(), max_rows, total), "sample_sizes")
    cuts = materialize(_cuts(narrow, sizes), "sample_cuts")
    cuts = cuts.withColumnRenamed("_s", "_cs")
    inside = x.join(cuts, F.col("_s") == F.col("_cs"))
    plain = inside.where((F.col("_h") < F.col("_cut")) | ((F.col("_h") == F.col("_cut"))
                                                          & (F.col("_need") >= F.col("_tied"))))
    at = inside.where((F.col("_h") == F.col("_cut")) & (F.col("_need") < F.col("_tied")))
    at = ordered_positions(at, keys, pos="_p", group="_s").where(F.col("_p") <= F.col("_need"))
    extra = ["_cs", "_cut", "_need", "_tied"]
    picked = plain.drop(*extra).unionByName(at.drop(*extra, "_p"))
    if sizes.agg(F.sum("n_sample")).first()[0] > max_rows:
        picked = _smallest(picked, max_rows, [*keys, "_s"])
    return picked.drop("_h", "_s")


def _cuts(narrow: DataFrame, sizes: DataFrame) -> DataFrame:
    """(_s, _cut, _need, _tied): hash of each stratum's last row, rows needed
    at that hash and rows that have it.

    Hashes are uniform, so equal ranges of them are even buckets: buckets are
    counted, and only those in which a stratum's sample ends are sorted.
    """
    width = math.ceil((1 << 60) / max(256, default_buckets(narrow.sparkSession)))
    x = narrow.select("_s", "_h", F.floor(F.col("_h") / F.lit(width)).cast("long").alias("_b"))
    run = Window.partitionBy("_s").orderBy("_b")
    ends = (x.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_upto", F.sum("_c").over(run)).join(sizes.drop("count"), "_s")
            .where((F.col("_upto") >= F.col("n_sample"))
                   & (F.col("_upto") - F.col("_c") < F.col("n_sample")))
            .select(F.col("_s").alias("_es"), F.col("_b").alias("_eb"),
                    (F.col("n_sample") - F.col("_upto") + F.col("_c")).alias("_room")))
    inner = Window.partitionBy("_s", "_b").orderBy("_h")
    h = (x.join(ends, (F.col("_s") == F.col("_es")) & (F.col("_b") == F.col("_eb")))
         .groupBy("_s", "_b", "_h", "_room").agg(F.count(F.lit(1)).alias("_tied"))
         .withColumn("_upto", F.sum("_tied").over(inner)))
    return (h.where((F.col("_upto") >= F.col("_room")) & (F.col("_upto") - F.col("_tied") < F.col("_room")))
            .select("_s", F.col("_h").alias("_cut"),
                    (F.col("_room") - F.col("_upto") + F.col("_tied")).alias("_need"), "_tied"))
