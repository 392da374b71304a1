"""Physical-plan properties that matter at scale."""

from pulsepanel.functions.periods import period_index
from pulsepanel.operators import clean, joins, labels, panel, rank
from pulsepanel.plans import catalog, fixtures as fx

from conftest import SF_SMALL
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lag_and_forward_share_one_exchange_and_sort(spark):
    p = fx.censored_panel(spark, SF_SMALL).withColumn("_i", period_index("safra"))
    x = labels.forward_status(panel.lag_diff(p, ["n_lines", "qty"], idx="_i"), idx="_i")
    s = plan(x)
    assert s.count("Exchange hashpartitioning(msno") == 1
    assert s.count("Sort [msno") == 1
    assert "RangeFrame, -1, -1" in s and "RangeFrame, 3, 3" in s


def test_period_filter_pushed_to_parquet(spark):
    s = plan(catalog.QUERIES["scan_month_filter"](spark, SF_SMALL))
    assert "PushedFilters: [Or(Or(And(GreaterThanOrEqual(l_shipdate" in s


def test_projection_pruned_at_scan(spark):
    s = plan(catalog.QUERIES["scan_projected"](spark, SF_SMALL))
    assert ("ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_linenumber:int,"
            "l_quantity:double,l_returnflag:string>") in s


def test_document_frame_shuffles_no_text(spark):
    """Words are counted below the join's exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(fx.doc_frame(spark, SF_SMALL)).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchange = min(i for i, x in enumerate(lines) if "Exchange hashpartitioning(doc_id" in x)
    assert all(i > exchange for i, x in enumerate(lines) if "split(" in x)


def test_dedup_is_partial_aggregate(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    s = plan(clean.dedup(li, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"]))
    assert "partial_max_by" in s
    assert "Window" not in s
    # only the named columns are scanned and shuffled
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    try:
        s = plan(catalog.QUERIES["dedup_keep_last"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
    assert ("ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_suppkey:bigint,"
            "l_linenumber:int,l_quantity:double,l_extendedprice:double,"
            "l_shipdate:timestamp_ntz>") in s


def test_panel_aggregation_is_two_phase(spark):
    s = plan(panel.usage_monthly(fx.usage_logs(spark, SF_SMALL)))
    assert "partial_sum" in s and s.count("Exchange hashpartitioning") == 1


def test_feature_join_adds_no_exchange(spark):
    """Three tables aggregated by (key, period) are joined where they are."""
    usage = panel.usage_monthly(fx.usage_logs(spark, SF_SMALL))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pay = panel.payments_monthly(fx.order_txn(spark, SF_SMALL))
        alone = plan(usage).count("Exchange") + plan(pay).count("Exchange")
        joined = plan(panel.feature_join(usage, [pay]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in joined and joined.count("Exchange") <= alone


def test_ranking_never_gathers_rows_in_one_partition(spark):
    scores = fx.score_frame(spark, SF_SMALL).select("msno", "safra", "p_churn", "churn_3m")
    for df in (rank.topk_flags(scores, "p_churn", [0.05], ["msno", "safra"]),
               rank.ordered_positions(scores, ["msno", "safra"]),
               rank.value_prefix(scores, "p_churn", ("churn_3m",), True).df):
        lines = plan(df).splitlines()
        for i, line in enumerate(lines):  # only totals per bucket, never rows
            assert "SinglePartition" not in line or "HashAggregate(keys=[_bucket" in lines[i + 1]


def test_one_to_one_join_reads_each_side_once(spark):
    a = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_custkey")
    b = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice")
    assert plan(joins.join_one_to_one(a, b, ["o_orderkey"])).count("FileScan") == 2


def test_quantiles_sort_only_the_buckets_that_hold_them(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).cast("double").alias("v"))
    pre = rank.value_prefix(df, "v", n_buckets=50, positions=rank.quantile_positions([0.5]))
    assert 0 < pre.df.count() < 10_000 / 50 * 3
    assert rank.quantiles_from_prefix(pre, [0.5]) == {
        0.5: df.selectExpr("percentile(v, 0.5)").first()[0]}


def test_group_buckets_use_no_lambda(spark):
    """Every row is placed among its group's boundaries by compiled expressions."""
    rows = [("f", v) for v in (1.0, 2.0, 2.0, 3.0, float("-inf"), float("inf"))] + [("g", 5.0)]
    cuts = {"f": [1.0, 2.0, 3.0], "g": []}
    x = spark.createDataFrame(rows, "k string, v double")
    bounds = spark.createDataFrame(list(cuts.items()), "_bg string, _b array<double>")
    for nb in (4, 200):
        for descending in (False, True):
            out = rank._group_bucket(x, bounds, "k", "v", nb, descending)
            s = plan(out)
            assert "lambda" not in s and "BatchEvalPython" not in s
            for r in out.collect():
                under = sum(b <= r.v if descending else b < r.v for b in cuts[r.k])
                assert r._bucket == (len(cuts[r.k]) - under if descending else under)


def test_group_buckets_of_any_number_of_bounds(spark):
    for n in (1, 2, 3, 7, 8, 50):
        bounds = spark.range(1).select(F.lit("f").alias("_bg"), F.array(*[F.lit(2.0 * i) for i in range(n)])
                                       .alias("_b"))
        x = spark.range(-1, 2 * n + 2).select(F.lit("f").alias("k"), F.col("id").alias("v"))
        got = rank._group_bucket(x, bounds, "k", "v", n).collect()
        assert [r._bucket for r in sorted(got, key=lambda r: r.v)] == [
            sum(2 * i < v for i in range(n)) for v in range(-1, 2 * n + 2)], n
