"""Invariants of the registered queries (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from pulsepanel.operators import clean
from pulsepanel.plans.catalog import queries

Q = queries()


@pytest.mark.parametrize("name", ["usage_monthly", "payments_monthly", "members_monthly",
                                  "feature_join", "lag1_diff1", "model_table",
                                  "reference_model_table"])
def test_panel_key_unique_after_each_stage(spark, name):
    df = Q[name](spark, SF_SMALL)
    assert {"msno", "safra"} <= set(df.columns)
    assert df.count() > 0
    assert clean.duplicate_keys(df, ["msno", "safra"]).count() == 0


def test_shares_sum_to_one(spark):
    prof = Q["segment_profile"](spark, SF_SMALL)
    assert prof.agg(F.sum("share")).first()[0] == pytest.approx(1.0, abs=1e-5)
    drift = Q["segment_drift"](spark, SF_SMALL)
    per = drift.groupBy("safra").agg(F.sum("share").alias("s")).collect()
    assert per and all(r.s == pytest.approx(1.0, abs=1e-5) for r in per)


def test_topk_sets_nested_across_fractions(spark):
    flags = Q["topk_flags"](spark, SF_SMALL)
    cols = ["top_1", "top_3", "top_5", "top_10", "top_20"]
    bad = flags.where(" or ".join(f"{a} > {b}" for a, b in zip(cols, cols[1:])))
    assert bad.count() == 0
    sums = flags.agg(*[F.sum(c).alias(c) for c in cols]).first()
    assert [sums[c] for c in cols] == sorted(sums[c] for c in cols)


def test_recall_and_captures_monotone_in_k(spark):
    rows = sorted(Q["campaign_curve"](spark, SF_SMALL).collect(), key=lambda r: r.top_frac)
    assert [r.k for r in rows] == sorted(r.k for r in rows)
    assert [r.TP for r in rows] == sorted(r.TP for r in rows)
    assert [r.recall for r in rows] == sorted(r.recall for r in rows)
    assert all(r.TP + r.FP == r.k for r in rows)


def test_hot_key_holding_a_third_of_rows_stays_exact(spark):
    from pulsepanel.operators import panel, sample

    rows = [("hot", 201601 + (i % 3), float(i % 7), i) for i in range(300)]
    rows += [(f"k{i % 97}", 201601 + (i % 3), float(i % 5), 1000 + i) for i in range(600)]
    df = spark.createDataFrame(rows, "msno string, safra int, num_unq double, ord int")
    # panel aggregate: sums per (key, period) equal the brute force
    got = {(r.msno, r.safra): r.num_unq for r in panel.usage_monthly(df).collect()}
    want = {}
    for k, s, v, _ in rows:
        want[(k, s)] = want.get((k, s), 0.0) + v
    assert got == want
    # dedup: the hot key keeps its last row by order
    last = {r.msno: r.ord for r in clean.dedup(df, ["msno"], ["ord"], "last").collect()}
    assert last["hot"] == 299 and len(last) == 98
    # exact samples: sizes hold although one key is a third of the rows
    assert sample.uniform_sample(df, 50, ["msno", "ord"]).count() == 50
    strat = sample.stratified_sample(df, 90, "safra", ["msno", "ord"])
    assert strat.count() == 90
    assert sorted(r["count"] for r in strat.groupBy("safra").count().collect()) == [30, 30, 30]
