"""One table from files of several schemas.

Exports of different months differ: a column is missing, an integer became a
double, a number came as text.  ``read.parquet`` of such a folder takes one
file's schema, drops columns or fails.  Here files are grouped so that each
group's footers merge, every group is aligned to the common columns and types,
and the groups are united.

Grouping takes one distributed footer job for a folder whose files merge.  On
a conflict the sorted file list is halved until the halves merge, so the jobs
follow the number of schema changes along the list, not the number of files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsepanel.functions.scalar import coerce_numeric

#: Numeric types from narrow to wide; two of them meet in the wider one.
NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()]


def _merged(spark: SparkSession, base: str | None, files: list[str]) -> DataFrame | None:
    reader = spark.read.option("mergeSchema", True)
    if base is not None:
        reader = reader.option("basePath", base)
    try:
        return reader.parquet(*files)
    except Exception as error:
        if "MERGE" not in str(error).upper():
            raise
        return None


def mergeable_groups(spark: SparkSession, files: list[str], base: str | None = None) -> list[DataFrame]:
    """The files as frames of files whose schemas merge, in the order of files."""
    whole = _merged(spark, base, files)
    if whole is not None:
        return [whole]
    if len(files) == 1:
        raise ValueError(f"the schema of {files[0]} cannot be read")
    half = len(files) // 2
    return mergeable_groups(spark, files[:half], base) + mergeable_groups(spark, files[half:], base)


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider number, a timestamp over a date, text
    over everything else."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        known = [NUMBERS.index(t) if t in NUMBERS else len(NUMBERS) - 1 for t in (a, b)]
        return NUMBERS[max(known)]
    dates = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, dates) and isinstance(b, dates):
        return a if isinstance(b, T.DateType) else b
    return T.StringType()


def common_schema(schemas, numeric=()) -> T.StructType:
    """Columns of all schemas in order of appearance, each with a type that
    holds all of its types.  Columns of ``numeric`` that mix numbers and text
    become doubles."""
    types: dict[str, T.DataType] = {}
    seen: dict[str, set] = {}
    for schema in schemas:
        for f in schema.fields:
            types[f.name] = common_type(types.get(f.name, T.NullType()), f.dataType)
            seen.setdefault(f.name, set()).add(f.dataType)
    for name in numeric:
        if name in types and len(seen[name]) > 1 and isinstance(types[name], T.StringType):
            types[name] = T.DoubleType()
    return T.StructType([T.StructField(n, T.StringType() if isinstance(t, T.NullType) else t)
                         for n, t in types.items()])


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of ``schema``: null where it lacks a
    column; text that is no number becomes null in a numeric column."""
    out = []
    for f in schema.fields:
        if f.name not in df.columns:
            col = F.lit(None).cast(f.dataType)
        else:
            col, held = F.col(f"`{f.name}`"), df.schema[f.name].dataType
            if isinstance(held, T.StringType) and isinstance(f.dataType, T.NumericType):
                col = coerce_numeric(col).cast(f.dataType)
            elif held != f.dataType:
                col = col.cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(*out)


def read_mixed(spark: SparkSession, path: str, numeric=(), columns=None) -> DataFrame:
    """All rows of a folder of Parquet files with differing schemas.

    The result has every column of every file (or those of ``columns`` that
    exist), see :func:`common_schema` and :func:`align`.  Projections and
    filters reach the scan of each group; a filter on a column whose type was
    widened is applied after its cast.
    """
    files = sorted(spark.read.parquet(path).inputFiles())
    if not files:
        return spark.read.parquet(path)
    groups: list[DataFrame] = []
    for g in mergeable_groups(spark, files, path):
        groups.append(g)
    schema = common_schema([g.schema for g in groups], numeric)
    if columns is not None:
        schema = T.StructType([f for c in columns for f in schema.fields if f.name == c])
    return reduce(DataFrame.unionByName, [align(g, schema) for g in groups])
