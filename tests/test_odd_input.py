"""Inputs that earlier versions got wrong: float periods, NULL strata, NaN and
NULL scores, one-sided bounds, local timestamps, long shared prefixes; and the
guards at stage borders."""

import datetime as dt

import pytest
from pulsepanel.functions import scalar as S
from pulsepanel.operators import binning, clean, joins, profile, rank, sample, scenario, segment
from pulsepanel.operators.train import fit_churn_model
from pulsepanel.sources import sinks, tables
from pyspark.sql import functions as F


def test_float_periods_are_periods(spark):
    df = spark.createDataFrame([("a", 201601.0), ("b", None), ("c", 201602.5), ("d", float("nan"))],
                               "msno string, safra double")
    good, bad = clean.normalize_keys(df)
    assert [(r.msno, r.safra) for r in good.collect()] == [("a", 201601)]
    assert sorted(r.msno for r in bad.collect()) == ["b", "c", "d"]


def test_null_stratum_keeps_its_share(spark):
    data = [(i, None if i % 4 == 0 else 201600 + i % 4) for i in range(400)]
    df = spark.createDataFrame(data, "msno int, safra int")
    got = {r.safra: r["count"] for r in
           sample.stratified_sample(df, 100, "safra", ["msno"]).groupBy("safra").count().collect()}
    assert got == {None: 25, 201601: 25, 201602: 25, 201603: 25}


def test_sample_plan_moves_no_payload(spark):
    df = spark.range(5000).select("id", F.lit("x" * 50).alias("payload"))
    plan = sample.uniform_sample(df, 10, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_samples_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, 5)] * 9 + [(2, 5)] * 9, "msno int, safra int")
    assert sample.uniform_sample(df, 7, ["msno"]).count() == 7
    assert sample.stratified_sample(df, 7, "safra", ["msno"]).count() == 7


def test_one_sided_histogram_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "v double")
    count = lambda **b: sum(r.n for r in binning.equal_width_histogram(df, "v", 10, **b).collect())
    assert count(lo=50) == 50 and count(hi=9) == 10 and count(lo=10, hi=19) == 10


def test_local_timestamps_in_a_dst_gap_keep_their_order(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        start = dt.datetime(2024, 3, 10, 1, 0)
        rows = [(i, start + dt.timedelta(minutes=5 * i)) for i in range(30)]
        df = spark.createDataFrame(rows, "i int, t timestamp_ntz")
        got = {r.i: r._pos for r in rank.ordered_positions(df, ["t"], n_buckets=6).collect()}
        assert [got[i] for i in range(30)] == list(range(1, 31))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_nan_is_missing_in_quantiles_and_cuts(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, float("nan"), None, 4.0])],
                               "msno int, v double")
    assert rank.exact_quantiles(df, "v", [0.5]) == {0.5: 2.0}
    long = df.select(F.lit("f").alias("g"), "v")
    assert rank.grouped_quantiles(long, "g", "v", [0.5])[0] == {"f": {0.5: 2.0}}
    assert profile.numeric_profile(df, ["v"]).first()["count"] == 3


def test_rows_without_score_keep_flag_zero(spark):
    rows = [(i, None if i % 10 == 0 else float("nan") if i % 10 == 1 else i / 100) for i in range(100)]
    df = spark.createDataFrame(rows, "msno int, p double")
    got = rank.topk_flags(df, "p", [0.1, 1.0], ["msno"]).collect()
    assert len(got) == 100 and sum(r.top_10 for r in got) == 8 and sum(r.top_100 for r in got) == 80
    assert not any(r.top_10 or r.top_100 for r in got if r.msno % 10 < 2)


def test_ids_with_a_long_common_prefix_spread_over_buckets(spark):
    n = 100_000
    df = spark.range(n).select(F.format_string("customer-number-0000%08d", F.col("id")).alias("k"),
                               F.col("id").alias("v"))
    bounds = rank._sampled_bounds(df, "k", 32)
    per = df.groupBy(rank._rank_in(F.array(*[F.lit(b) for b in bounds]), len(bounds),
                                   lambda b: b <= F.col("k")).alias("b")).count().collect()
    assert len(per) == 32 and max(r["count"] for r in per) < 4 * n / 32
    wrong = rank.ordered_positions(df, ["k"], n_buckets=32).where(F.col("_pos") != F.col("v") + 1)
    assert wrong.count() == 0


def test_rank_in_any_array_size(spark):
    for n in (1, 2, 3, 7, 16, 50):
        arr = F.array(*[F.lit(2 * i) for i in range(n)])
        got = spark.range(-1, 2 * n + 2).select("id", rank._rank_in(
            arr, n, lambda b: b <= F.col("id")).alias("r")).collect()
        assert [r.r for r in got] == [sum(2 * i <= r.id for i in range(n)) for r in got], n


def test_names_with_spaces(spark):
    df = spark.createDataFrame([("1.5",)], "`a b` string")
    assert df.select(S.coerce_numeric("a b").alias("v")).first().v == 1.5


def test_one_to_one_join_raises_on_either_side(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (1, "d")], "k int, y string")
    same = spark.createDataFrame([(1, "c"), (3, None)], "k int, y string")
    assert [tuple(r) for r in joins.join_one_to_one(one, same, ["k"]).collect()] == [(1, "a", "c")]
    for a, b in ((one, two), (two, one)):
        with pytest.raises(Exception, match="duplicated keys"):
            joins.join_one_to_one(a, b, ["k"]).collect()


def test_guards(spark):
    df = spark.createDataFrame([(1, 0.0)], "msno int, paid_sum double")
    with pytest.raises(ValueError, match="missing columns"):
        scenario.arpu(df.drop("paid_sum"))
    with pytest.raises(ValueError, match="missing columns"):
        fit_churn_model(df, "churn_3m")
    with pytest.raises(ValueError, match="no rows"):
        tables.require_rows(df.where("msno = 2"), "join")
    curve = spark.createDataFrame([(0.1, 1, 1, 0)], "top_frac double, k int, TP int, FP int")
    none = scenario.arpu(df).first()["ARPU_NTD"]
    with pytest.raises(ValueError, match="no paying customer"):
        scenario.scenario_grid(curve, none, 0.1)


def test_segment_drivers_equal_their_definition(spark):
    rows = [(i % 3, float(i * i % 17), None if i % 5 == 0 else float(i % 7)) for i in range(90)]
    df = spark.createDataFrame(rows, "cluster int, a double, b double")
    got = {r.feature: r.separation_score for r in segment.segment_drivers(df, ["a", "b"]).collect()}
    for c in ("a", "b"):
        total = df.agg(F.var_samp(c)).first()[0]
        between = df.groupBy("cluster").agg(F.avg(c).alias("m")).agg(F.var_samp("m")).first()[0]
        assert got[c] == pytest.approx(between / (total + 1e-9))


def test_cluster_features_have_no_cap(spark):
    wide = spark.range(1).select(*[F.lit(1.0).alias(f"c{i}") for i in range(60)], F.lit(1).alias("safra"))
    assert len(segment.cluster_features(wide.schema)) == 60
    assert segment.cluster_features(wide.schema, ["c7", "zz", "c3"]) == ["c7", "c3"]


def test_heavy_period_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(60_000).select(F.xxhash64("id").alias("v"), F.when(F.col("id") % 50 == 0, 201602)
                                        .otherwise(201601).alias("safra"))
        sinks.write_parquet(df, str(tmp_path / "t"), partition_by="safra")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    files = list((tmp_path / "t" / "safra=201601").glob("*.parquet"))
    assert len(files) > 1 and len(list((tmp_path / "t" / "safra=201602").glob("*.parquet"))) <= len(files)


def test_scratch_tables_are_removed(spark):
    import os
    from pulsepanel.session import checkpoint_dir

    sinks.materialize(spark.range(3), "gone")
    folder = checkpoint_dir(spark).removeprefix("file:") + "/tables"
    assert any(n.startswith("gone") for n in os.listdir(folder))
    sinks.remove_scratch(spark)
    assert not os.path.exists(folder)
