"""Tables stored by customer: joins and windows on the customer without a shuffle.

A table that is bucketed and sorted by the customer keeps its rows where the
panel's join, its lags and its forward status want them.  Storing it costs one
shuffle; every later stage reads bucket by bucket.  All tables of one panel
need the same number of buckets.

The rows are unique per (customer, period), so a customer has at most as many
rows as there are periods, and a bucket as many customers as any other.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def write_bucketed(df: DataFrame, table: str, key: str, order=(), buckets: int = 200,
                   path: str | None = None) -> DataFrame:
    """Stores ``df`` as catalog table ``table``: ``buckets`` buckets by ``key``,
    each one file sorted by key and ``order``.  Replaces an older table; its
    files lie at ``path`` or in the warehouse.

    The frame asks for merge joins: sorted files are a small part of their rows
    in memory, so Spark would take millions of rows for small enough to send
    them through the driver to every executor."""
    rows = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    writer = rows.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key, *order)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table).hint("merge")


@contextmanager
def by_bucket(spark: SparkSession):
    """Inside, a join on (customer, period) of tables that lie by customer stays
    where they lie: Spark otherwise wants both columns in the partitioning.
    Actions of the joined frame belong inside as well."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)
