"""Bucketed storage, folders of mixed schemas, checks in flight."""

import pytest
from conftest import SF_SMALL
from pulsepanel.functions.periods import period_index
from pulsepanel.operators import labels, panel
from pulsepanel.plans import catalog
from pulsepanel.sources import checked, mixed
from pulsepanel.sources.bucketed import by_bucket, write_bucketed
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ------------------------------------------------------------------ bucketed
def test_join_lag_and_status_without_an_exchange(spark, tmp_path):
    months = [201601 + i for i in range(5)]
    usage = spark.createDataFrame([(c, m, float(c + m)) for c in range(30) for m in months],
                                  "msno long, safra int, secs double")
    paid = usage.select("msno", "safra", (F.col("secs") * 2).alias("paid")).where("msno % 3 = 0")
    active = usage.select("msno", "safra", (F.col("msno") % 2).cast("int").alias("is_ativo"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = [write_bucketed(df, f"t_bucketed_{i}", "msno", ["safra"], 4, str(tmp_path / f"b{i}"))
                 for i, df in enumerate((usage, paid, active))]

        def windowed(tables):
            x = panel.feature_join(tables[0], tables[1:], paid_col="paid", usage_col="secs")
            x = x.withColumn("_i", period_index("safra"))
            return labels.forward_status(panel.lag_diff(x, ["secs", "paid"], idx="_i"), idx="_i")

        with by_bucket(spark):
            stored = windowed(parts)
            text = plan(stored)
            assert "SortMergeJoin" in text and "Window" in text and "Exchange" not in text
            got = sorted(map(tuple, stored.collect()))
        plain = windowed([usage, paid, active])
        assert "Exchange" in plan(plain)
        assert got == sorted(map(tuple, plain.collect()))
        again = write_bucketed(usage.where("msno = 1"), "t_bucketed_0", "msno", ["safra"], 4, str(tmp_path / "b0"))
        assert again.count() == len(months)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for i in range(3):
            spark.sql(f"drop table if exists t_bucketed_{i}")


def test_stored_tables_are_not_broadcast(spark, tmp_path):
    """Small files at Spark's usual threshold: the join still stays where they lie."""
    usage = spark.range(400).select((F.col("id") % 40).alias("msno"), (F.col("id") / 40).cast("int").alias("safra"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    try:
        parts = [write_bucketed(usage.withColumn(f"v{i}", F.col("msno") + i), f"t_merged_{i}", "msno", ["safra"], 4,
                                str(tmp_path / f"m{i}")) for i in range(3)]
        with by_bucket(spark):
            joined = panel.feature_join(parts[0], [parts[1], parts[2].select("msno", "safra", "v2")],
                                        paid_col="v1", usage_col="v0")
            assert joined.count() == 400
            text = plan(joined)
        assert text.count("SortMergeJoin") == 2 and "Broadcast" not in text and "Exchange" not in text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for i in range(3):
            spark.sql(f"drop table if exists t_merged_{i}")


def test_by_bucket_puts_the_setting_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), by_bucket(spark):
        raise KeyError
    assert spark.conf.get(name) == before


# --------------------------------------------------------------------- mixed
def test_three_schemas(spark, tmp_path):
    path = str(tmp_path / "t")
    parts = {
        "a": spark.createDataFrame([(1, 1.5, "x"), (2, None, None)], "id long, v double, name string"),
        "b": spark.createDataFrame([(3, 7), (4, None)], "id int, v int"),
        "c": spark.createDataFrame([(5, "2.25", True), (6, "n/a", None), (7, "", False)],
                                   "id long, v string, flag boolean"),
    }
    for name, df in parts.items():
        df.coalesce(1).write.parquet(f"{path}/month={name}")
    got = mixed.read_mixed(spark, path, numeric=["v"])
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {
        "id": "bigint", "v": "double", "name": "string", "flag": "boolean", "month": "string"}
    want = {(1, 1.5, "x", None, "a"), (2, None, None, None, "a"), (3, 7.0, None, None, "b"),
            (4, None, None, None, "b"), (5, 2.25, None, True, "c"), (6, None, None, None, "c"),
            (7, None, None, False, "c")}
    assert set(map(tuple, got.select("id", "v", "name", "flag", "month").collect())) == want
    text = mixed.read_mixed(spark, path)
    assert text.schema["v"].dataType == T.StringType() and text.count() == 7
    few = mixed.read_mixed(spark, path, numeric=["v"], columns=["v", "id", "nowhere"])
    assert few.columns == ["v", "id"]
    assert "month" not in plan(few.where("id > 3")).split("ReadSchema")[1].split("\n")[0]


def test_files_that_merge_take_one_group(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(5):
        spark.range(3).withColumn(f"c{i % 2}", F.lit(i)).coalesce(1).write.parquet(f"{path}/m={i}")
    files = sorted(spark.read.parquet(path).inputFiles())
    assert len(mixed.mergeable_groups(spark, files, path)) == 1
    assert mixed.read_mixed(spark, path).where("c0 is not null").count() == 9
    spark.range(2).withColumn("c0", F.lit("text")).coalesce(1).write.parquet(f"{path}/m=2b")
    files = sorted(mixed.read_mixed(spark, path).inputFiles())
    assert 2 <= len(mixed.mergeable_groups(spark, files, path)) <= 4
    assert mixed.read_mixed(spark, path).count() == 17


def test_common_types():
    s, d = T.StringType(), T.DoubleType()
    assert mixed.common_type(T.IntegerType(), T.LongType()) == T.LongType()
    assert mixed.common_type(T.FloatType(), T.IntegerType()) == d
    assert mixed.common_type(T.DecimalType(10, 2), d) == d
    assert mixed.common_type(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert mixed.common_type(T.BooleanType(), T.LongType()) == s
    assert mixed.common_type(T.NullType(), d) == d


# ------------------------------------------------------------------- checked
def test_rules_are_counted_by_the_write(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "k long, y int")
    rules = {**checked.has_rows(), **checked.no_nulls(["k"]), **checked.two_classes("y"),
             **checked.total("positives", F.col("y"), 2)}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "checked")
    try:
        table, found = checked.materialize_checked(df, "t", rules)
        with_rules = len(tracker.getJobIdsForGroup("checked"))
        spark.sparkContext.setJobGroup("plain", "plain")
        checked.materialize(df, "t")
        assert with_rules == len(tracker.getJobIdsForGroup("plain"))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert found["rows"] == 3 and found["positives"] == 2 and table.count() == 3


@pytest.mark.parametrize("rows, rules, said", [
    ([], lambda: checked.has_rows("panel"), "panel has no rows"),
    ([], lambda: checked.two_classes("y"), "single class"),
    ([(None, 1)], lambda: checked.no_nulls(["k"]), "null values in k"),
    ([(1, 1), (2, 1)], lambda: checked.two_classes("y"), "single class"),
    ([(1, 1), (2, 0)], lambda: checked.two_classes("y", F.col("k") == 1), "single class"),
    ([(1, 1)], lambda: checked.total("n", F.col("y"), 5), "n is not 5"),
])
def test_broken_rules(spark, rows, rules, said):
    with pytest.raises(checked.CheckFailed, match=said):
        checked.materialize_checked(spark.createDataFrame(rows, "k long, y int"), "t", rules())


def test_rows_that_the_optimizer_drops(spark):
    df = spark.createDataFrame([(1, 1)], "k long, y int").where("k = 2")
    _, found = checked.materialize_checked(df.join(df.distinct(), "k").drop("y"), "t", checked.no_nulls(["k"]))
    assert found["null_k"] == 0
    with pytest.raises(checked.CheckFailed):
        checked.materialize_checked(df.where("false"), "t", checked.has_rows())


def test_catalog_queries_use_them():
    assert {"bucketed_model_table", "mixed_schema_scan", "refresh_model_table"} <= set(catalog.queries())
