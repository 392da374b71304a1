"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.session import checkpoint_dir
from pulsepanel.sources.sinks import materialize

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Rows that one task numbers at most, on average, in :func:`group_rank`.
ROWS_PER_BUCKET = 50_000


#: What this worker process keeps from task to task; see :func:`worker_cache`.
_KEPT: dict = {}


def worker_cache(key, make):
    """The object that this worker process keeps under ``key``, made on first use.

    A worker serves the stages of a whole session, so it keeps one object at a
    time: another key drops it, and so does :func:`free_worker`."""
    if key not in _KEPT:
        free_worker()
        _KEPT[key] = make()
    return _KEPT[key]


def free_worker() -> None:
    """For the start of a task: drops what earlier tasks of other operators left
    in this worker process, and returns the memory that Arrow holds unused."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def lower_ascii(col) -> F.Column:
    """Lower-case A-Z and leave every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def hash52(*parts) -> F.Column:
    """52 bits of an md5 over the parts (null reads as ``~``): the same number
    on every run, engine and partitioning."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets follow the data, so the rows that one task numbers do not."""
    return max(16, math.ceil(rows / per_bucket))


def group_rank(df: DataFrame, group: str, position: str, order: list[str], buckets: int,
               out: str) -> DataFrame:
    """0-based rank inside ``group`` without one task per group.

    ``position`` is a double in [0, 1) that never falls as the order rises
    (a hash or a fraction).  Rows are numbered inside (group, bucket of the
    position); counts of (group, bucket) give each bucket its offset.  A
    group with a third of all rows is spread over all its buckets.
    """
    cut = df.withColumn("_b", F.floor(F.col(position) * buckets).cast("long"))
    totals = cut.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(group).alias("_og"), F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(group, "_b").orderBy(position, *order)
    numbered = cut.withColumn("_rn", F.row_number().over(inside) - 1)
    joined = numbered.join(offsets, (F.col(group) == F.col("_og")) & (F.col("_b") == F.col("_ob")))
    return (joined.withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
            .drop("_b", "_rn", "_og", "_ob", "_off"))


def with_row_key(docs: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a key of the physical row: a hash of file and position in the file.

    It is the same in every scan of the files.  A frame that is not a plain
    file scan is written to the shared folder first.
    """
    def keyed(df):
        hidden = df.metadataColumn("_metadata")  # whatever a user column is named
        return df.select("*", F.xxhash64(hidden["file_path"], hidden["row_index"]).alias(name))

    try:
        return keyed(docs)
    except AnalysisException:  # no file behind it
        return keyed(materialize(docs, "rows"))


def discard(*written: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more (frames returned by
    ``materialize``); other frames are left alone."""
    for df in written:
        spark = df.sparkSession
        home = f"{checkpoint_dir(spark).rstrip('/')}/tables/"
        folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for folder in folders:
            if home.split(":", 1)[-1].lstrip("/") in folder:
                at = spark._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def source_key(col) -> F.Column:
    """A source as a non-null string that sorts by code point, null last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
