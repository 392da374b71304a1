"""Connected components of an edge table, by alternating stars.

Each round hangs the larger neighbours of every node below its smallest
neighbour (large star), then the node and its smaller neighbours below the
smallest of them (small star).  Both keep the components; after a few rounds
every component is a star around its smallest node.  Minima are partial
aggregates written to a table and joined back, so both join sides are plain
shuffles and a node with very many neighbours can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.llm.common import discard
from pulsepanel.sources.sinks import materialize


def _stars(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every (u, v) with the smallest of u and its neighbours as ``m``, and the
    table of the minima."""
    least = materialize(pairs.groupBy("u").agg(F.min("v").alias("m")), "star-minima")
    return pairs.join(least, "u").withColumn("m", F.least("u", "m")), least


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge, its root the smallest node that
    it reaches.  Loops, repeated and null edges do no harm."""
    now = materialize(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "star-edges")
    before = None
    while (state := _state(now)) != before:
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars, least = _stars(both)
        large = materialize(stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where("u <> v").distinct(), "star-edges")
        small, lesser = _stars(large)
        after = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct(), "star-edges")
        discard(now, least, large, lesser)  # a round needs only the one before
        now = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame):
    """Count and checksum that tell whether a round has changed the edges."""
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
