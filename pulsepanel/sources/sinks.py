"""Sinks: idempotent (partitioned) Parquet, CSV/JSON reports, model saves.

Rerunning a job must not duplicate rows, so every write is an overwrite:
``mode="overwrite"`` replaces the whole table, or, with ``dynamic=True``,
only the partitions present in the new data (Spark's dynamic partition
overwrite; the session default is static).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.session import checkpoint_dir


def write_parquet(df: DataFrame, path: str, partition_by=None, dynamic: bool = False) -> None:
    """Overwrite a table, or with ``dynamic`` the partitions of the new data.

    Before a partitioned write the rows are rebalanced by the partition
    columns: adaptive execution splits a heavy period over several tasks and
    merges small ones, so neither one task nor every task writes a period.
    """
    if not partition_by:
        df.write.mode("overwrite").parquet(path)
        return
    cols = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    w = df.hint("rebalance", *[F.col(c) for c in cols]).write.mode("overwrite").partitionBy(*cols)
    if dynamic:
        w = w.option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def write_report_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header.  ``single_file`` is for bounded reports (months, bins,
    segments): all rows then pass one task, behind a shuffle of their own."""
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read.option("header", True)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def write_json_summary(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines; ``single_file`` as for :func:`write_report_csv`."""
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").json(path)


def remove_scratch(spark: SparkSession) -> None:
    """Removes the tables that :func:`materialize` wrote in this session.

    For the end of a job: results that still read them must be written first.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/tables")
    path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` under the shared checkpoint folder.

    Uses the folder named by ``spark.checkpoint.dir`` (never a machine-local
    one on a cluster), so a lost executor does not recompute the upstream
    plan.  Returns a DataFrame reading the written table.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tables/{name or 'tbl'}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
