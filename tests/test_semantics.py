"""Semantics of the reference's traps on hand-made frames (5-20 rows)."""

import random

import pytest
from pyspark.sql import functions as F

from pulsepanel.functions import periods as P
from pulsepanel.functions import scalar as S
from pulsepanel.operators import binning, clean, labels, metrics, panel, prep, rank, sample, scenario


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ------------------------------------------------------------------ periods


def test_add_periods_year_carry(spark):
    df = spark.createDataFrame([(201611,), (201512,), (201601,)], "safra int")
    out = df.select("safra", P.add_periods("safra", 3).alias("p3"),
                    P.add_periods("safra", -1).alias("m1"), P.period_index("safra").alias("i"))
    got = {r["safra"]: (r["p3"], r["m1"]) for r in out.collect()}
    assert got[201611] == (201702, 201610)
    assert got[201512] == (201603, 201511)
    assert got[201601] == (201604, 201512)


# ------------------------------------------------------------------ panel


def test_zero_filled_means_and_null_keys(spark):
    txn = spark.createDataFrame(
        [("a", 201601, 10.0, 100.0, None, 1.0, 0.0),
         ("a", 201601, 5.0, None, 30.0, None, 1.0),
         (None, 201601, 7.0, 7.0, 7.0, 1.0, 0.0),
         ("b", 201601, "x", 50.0, 30.0, 0.0, 0.0)],
        "msno string, safra int, actual_amount_paid string, plan_list_price double, "
        "payment_plan_days double, is_auto_renew double, is_cancel double")
    out = {r["msno"]: r for r in panel.payments_monthly(txn).collect()}
    assert set(out) == {"a", "b"}                      # NULL key dropped (T5)
    assert out["a"]["paid_sum"] == 15.0
    assert out["a"]["plan_price_mean"] == 50.0         # (100 + 0) / 2, not avg(100) (T2)
    assert out["a"]["plan_days_mean"] == 15.0
    assert out["a"]["auto_renew_rate"] == 0.5
    assert out["a"]["cancel_txn_count"] == 1.0
    assert out["b"]["paid_sum"] == 0.0                 # unparsable text -> NULL -> 0 (P1)


def test_usage_ratios_guarded(spark):
    logs = spark.createDataFrame(
        [("a", 201601, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 100.0),
         ("b", 201601, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 50.0)],
        "msno string, safra int, num_25 double, num_50 double, num_75 double, num_985 double, "
        "num_100 double, num_unq double, total_secs double")
    out = {r["msno"]: r for r in panel.usage_monthly(logs).collect()}
    assert out["a"]["plays_total"] == 2.0
    assert out["a"]["completion_rate"] == pytest.approx((0.25 + 1.0) / 2)
    assert out["a"]["secs_per_play"] == 50.0
    assert out["b"]["completion_rate"] is None and out["b"]["secs_per_play"] is None  # T3


def test_members_first_non_null_by_order(spark):
    m = spark.createDataFrame(
        [("a", 201601, 3, "SP", 95.0, None, "web", 0.0),
         ("a", 201601, 1, None, 30.0, "F", None, None),
         ("a", 201601, 2, "RJ", 5.0, "M", "app", 1.0)],
        "msno string, safra int, _ord int, city string, bd double, gender string, "
        "registered_via string, is_ativo double")
    r = panel.members_monthly(m).collect()[0]
    assert r["city"] == "RJ"            # first non-NULL by order, skipping NULL (T4)
    assert r["bd"] == 30.0              # 5 and 95 are outside 10..90 (P11)
    assert r["gender"] == "F"
    assert r["registered_via"] == "app"
    assert r["is_ativo"] == 1.0         # max status


def test_lag_is_calendar_consecutive(spark):
    df = spark.createDataFrame(
        [("a", 201511, 1.0), ("a", 201512, 2.0), ("a", 201601, None), ("a", 201603, 5.0),
         ("b", 201601, 7.0)],
        "msno string, safra int, paid_sum double")
    out = {(r["msno"], r["safra"]): (r["paid_sum_lag1"], r["paid_sum_diff1"])
           for r in panel.lag_diff(df, ["paid_sum"]).collect()}
    assert out[("a", 201511)] == (None, None)          # first month (T6)
    assert out[("a", 201512)] == (1.0, 1.0)
    assert out[("a", 201601)] == (2.0, None)           # year carry; NULL side -> NULL diff (T7)
    assert out[("a", 201603)] == (None, None)          # gap: 201602 absent
    assert out[("b", 201601)] == (None, None)


# ------------------------------------------------------------------ labels


def _status(spark, data):
    return spark.createDataFrame(data, "msno string, safra int, is_ativo int")


def test_forward_label_rules(spark):
    df = _status(spark, [
        ("a", 201601, 1), ("a", 201604, 0),            # churn
        ("b", 201601, None), ("b", 201604, 1),         # NULL now -> inactive, label 0 (T8, T10)
        ("c", 201601, 1),                              # future not observed -> dropped (T9)
        ("d", 201601, 1), ("d", 201604, None),         # NULL future status -> 0 -> churn
    ])
    out = {r["msno"]: (r["is_ativo"], r["is_ativo_fut"], r["churn_3m"])
           for r in labels.churn_label(df).collect()}
    assert out == {"a": (1, 0, 1), "b": (0, 1, 0), "d": (1, 0, 1)}


def test_label_trust_branches(spark):
    data = []
    # 201601: 100 eligible, 95 churn -> rate 0.95 exactly, trusted
    for i in range(100):
        data += [(f"x{i}", 201601, 1), (f"x{i}", 201604, 0 if i < 95 else 1)]
    # 201602: observed rows but none eligible -> rows = observed, trust 0
    data += [("y", 201602, 0), ("y", 201605, 1)]
    # 201603: no observed future inside the range -> zero row
    data += [("z", 201603, 1)]
    # 201605: needs 201608 > last month -> absent
    data += [("w", 201605, 1)]
    # 201607 is the last month
    data += [("v", 201607, 1)]
    diag = labels.label_trust(labels.forward_status(_status(spark, data)))
    got = {r["safra"]: (r["rows"], r["fut_active_rate"], r["churn_rate"], r["label_trust"])
           for r in diag.collect()}
    assert got[201601] == (100, 0.05, 0.95, 1)
    assert got[201602] == (1, 1.0, 0.0, 0)
    assert got[201603] == (0, 0.0, 0.0, 0)
    assert 201605 not in got and 201607 not in got and 201606 not in got
    assert got[201604] == (0, 0.0, 0.0, 0)             # in range, nobody observed


def test_trust_threshold_strict(spark):
    data = []
    # 201601: 100 observed, 1 future-active -> 0.01 exactly, trusted iff churn ok
    for i in range(100):
        data += [(f"x{i}", 201601, 1), (f"x{i}", 201604, 1 if i == 0 else 0)]
    diag = labels.label_trust(labels.forward_status(_status(spark, data)))
    r = diag.where("safra = 201601").first()
    assert r["fut_active_rate"] == 0.01 and r["churn_rate"] == 0.99 and r["label_trust"] == 0


def test_model_table_attaches_trust(spark):
    data = [("a", 201601, 1, 1.0), ("a", 201602, 1, 2.0), ("a", 201604, 0, 3.0),
            ("a", 201605, 1, 4.0)]
    df = spark.createDataFrame(data, "msno string, safra int, is_ativo int, paid_sum double")
    mt = labels.model_table(df, ["paid_sum"], reuse=False)
    got = {r["safra"]: r for r in mt.collect()}
    assert set(got) == {201601, 201602}
    assert got[201601]["churn_3m"] == 1 and got[201601]["label_trust"] == 0  # rate 1.0 > .95
    assert got[201602]["paid_sum_lag1"] == 1.0 and got[201602]["paid_sum_diff1"] == 1.0


# ------------------------------------------------------------------ top-k


def _brute_topk(data, fracs):
    order = sorted(data, key=lambda r: (-r[2], r[0], r[1]))
    out = []
    for f in fracs:
        k = max(1, int(len(order) * f))
        tp = sum(r[3] for r in order[:k])
        out.append((f, k, tp))
    return out


@pytest.mark.parametrize("nb", [1, 3, 8])
def test_topk_ties_match_brute_force(spark, nb):
    random.seed(nb)
    data = [(k, m, float(random.choice([0.1, 0.5, 0.5, 0.9, 0.7])), random.randint(0, 1))
            for k in range(40) for m in range(3)]
    df = spark.createDataFrame(data, "msno int, safra int, p_churn double, churn_3m int")
    fracs = [0.01, 0.03, 0.05, 0.10, 0.20, 0.5]
    pref = rank.value_prefix(df.select("p_churn", "churn_3m"), "p_churn", ("churn_3m",), True, nb)
    got = rank.topk_counts(df, "p_churn", "churn_3m", fracs, ["msno", "safra"], prefix=pref)
    assert [(g["top_frac"], g["k"], g["TP"]) for g in got] == _brute_topk(data, fracs)
    flags = rank.topk_flags(df, "p_churn", fracs, ["msno", "safra"])
    sums = flags.agg(*[F.sum(f"top_{round(f * 100)}").alias(str(f)) for f in fracs]).first()
    assert [sums[str(f)] for f in fracs] == [max(1, int(len(data) * f)) for f in fracs]


def test_positions_on_string_keys_use_many_buckets(spark):
    import base64
    import hashlib

    keys = [base64.b64encode(hashlib.sha1(str(i).encode()).digest()).decode() for i in range(300)]
    keys += ["é-accent", "Ωmega", "", None]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "msno string, v int")
    got = {r.msno: r._pos for r in rank.ordered_positions(df, ["msno"], n_buckets=8).collect()}
    want = sorted(keys, key=lambda k: (k is not None, (k or "").encode()))
    assert [got[k] for k in want] == list(range(1, len(keys) + 1))
    assert len(rank._sampled_bounds(df, "msno", 8)) == 7


def test_topk_all_equal_and_tiny(spark):
    df = spark.createDataFrame([(i, 0, 0.5, i % 2) for i in range(7)],
                               "msno int, safra int, p_churn double, churn_3m int")
    got = rank.topk_counts(df, "p_churn", "churn_3m", [0.01, 0.5], ["msno", "safra"])
    assert got[0]["k"] == 1 and got[0]["TP"] == 0      # n·frac < 1 -> k = 1 (T15); key 0 first
    assert got[1]["k"] == 3 and got[1]["TP"] == 1      # keys 0,1,2 (T16)


def test_k_truncation_matches_double_arithmetic():
    assert rank.topk_size(2987795, 0.05) == 149389
    assert rank.topk_size(100, 0.29) == int(100 * 0.29)


def _auc_brute(y, p):
    pos = [s for s, t in zip(p, y) if t == 1]
    neg = [s for s, t in zip(p, y) if t == 0]
    tot = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, p):
    P_ = sum(y)
    ap, prev_r = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        sel = [t for sc, t in zip(p, y) if sc >= s]
        tp = sum(sel)
        r = tp / P_
        ap += (r - prev_r) * (tp / len(sel))
        prev_r = r
    return ap


def test_auc_ap_match_definitions(spark):
    random.seed(3)
    data = [(i, round(random.random(), 1), random.randint(0, 1)) for i in range(60)]
    df = spark.createDataFrame(data, "msno int, p_churn double, churn_3m int")
    y = [d[2] for d in data]
    p = [d[1] for d in data]
    assert metrics.roc_auc(df) == pytest.approx(_auc_brute(y, p))
    assert metrics.average_precision(df) == pytest.approx(_ap_brute(y, p))
    g = metrics.grouped_roc_auc(df.withColumn("g", F.lit("x")), "g")
    assert g["x"] == pytest.approx(_auc_brute(y, p))


def test_eval_sets_equal_one_set_at_a_time(spark):
    random.seed(11)
    data = [(k, m, random.choice(["val", "test", "train"]),
             float(random.choice([0.1, 0.5, 0.5, 0.9, 0.7, 0.3])), random.randint(0, 1))
            for k in range(50) for m in range(4)]
    df = spark.createDataFrame(data, "msno int, safra int, split string, p_churn double, "
                                     "churn_3m int")
    got = metrics.eval_sets(df, "split", ("val", "test"))
    want = [metrics.eval_set(df.where(F.col("split") == n), n, reuse=False) for n in ("val", "test")]
    assert [g["set"] for g in got] == ["val", "test"]
    for g, w in zip(got, want):
        assert g["k5"] == w["k5"]
        for c in ("roc_auc", "pr_auc", "recall_top5pct", "churnrate_top5pct", "recall_top10pct"):
            assert g[c] == pytest.approx(w[c]), c
    sub = [d for d in data if d[2] == "test"]
    assert got[1]["roc_auc"] == pytest.approx(_auc_brute([d[4] for d in sub], [d[3] for d in sub]))


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(i, 0.1 * i, 1) for i in range(5)],
                               "msno int, p_churn double, churn_3m int")
    assert metrics.roc_auc(df) is None and metrics.average_precision(df) is None  # T25


# ------------------------------------------------------------------ quantiles / bins


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    q = rank.exact_quantiles(df, "v", [0.5, 0.95, 0.0, 1.0])
    assert q[0.5] == 3.0                                  # not 2.0 (T17)
    assert q[0.95] == pytest.approx(4 + 0.85 * 5)
    assert (q[0.0], q[1.0]) == (1.0, 9.0)
    long = df.select(F.lit("a").alias("f"), "v").union(df.select(F.lit("b").alias("f"), F.col("v") * 2))
    g, _ = rank.grouped_quantiles(long, "f", "v", [0.5])
    assert g["a"][0.5] == 3.0 and g["b"][0.5] == 6.0
    assert prep.fit_medians(df, ["v"]) == {"v": 3.0}


def test_trend_bins_right_closed(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (-0.5,), (1.0,), (1.5,), (None,)], "d double")
    got = [r["b"] for r in df.select(S.trend_bin("d").alias("b")).collect()]
    assert got == ["Queda", "Queda", "Estável", "Estável", "Alta", "Estável"]  # T18, NULL -> 0


def test_age_groups_edges(spark):
    df = spark.createDataFrame([(10.0,), (20.0,), (21.0,), (60.0,), (61.0,), (90.0,)], "bd double")
    got = [r["g"] for r in df.select(S.age_group("bd").alias("g")).collect()]
    assert got == [None, "10-20", "21-30", "51-60", "61+", "61+"]


def test_quantile_bins_constant_and_two_values(spark):
    const = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert {r["b"] for r in binning.quantile_bins(const, "v", out="b").collect()} == {"Faixa única"}
    # two values: the median edge collapses onto a value -> one bin, like qcut
    two = spark.createDataFrame([(0.0,)] * 6 + [(1.0,)] * 4, "v double")
    assert {r["b"] for r in binning.quantile_bins(two, "v", out="b").collect()} == {"Faixa única"}
    three = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (1.0,), (2.0,), (2.0,)], "v double")
    got = set(rows(binning.quantile_bins(three, "v", out="b"), "v", "b"))
    assert got == {(0.0, "Q1(menor)"), (1.0, "Q2"), (2.0, "Q3(maior)")}


def test_clip_shift_keeps_null(spark):
    df = spark.createDataFrame([(-5.0,), (3.0,), (None,)], "x double")
    assert [r["y"] for r in df.select(S.clip_shift("x").alias("y")).collect()] == [1.0, 4.0, None]


def test_histogram_last_bin_closed(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 50, 90, 90]], "bd double")
    h = {r["bin"]: r["n"] for r in binning.equal_width_histogram(df, "bd", 40).collect()}
    assert h == {0: 2, 20: 1, 39: 2}


# ------------------------------------------------------------------ prep / sample / clean


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    got = sorted(r["x"] for r in prep.standardize(df, ["x"]).collect())
    assert got == [-1.0, 1.0]                            # std_pop = 1 (T20)
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r["x"] for r in prep.standardize(const, ["x"]).collect()] == [0.0, 0.0]


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "g string")
    out = prep.mode_impute(df, ["g"])
    assert sorted(r["g"] for r in out.collect()) == ["a", "a", "a", "b", "b"]


def test_stratified_sizes_half_even(spark):
    # 5 + 15 rows, max 10 -> frac 0.5: round(2.5) = 2, round(7.5) = 8 (T21)
    data = [(i, 201601) for i in range(5)] + [(100 + i, 201602) for i in range(15)]
    df = spark.createDataFrame(data, "msno int, safra int")
    s = sample.stratified_sample(df, 10, "safra", ["msno"])
    got = {r["safra"]: r["count"] for r in s.groupBy("safra").count().collect()}
    assert got == {201601: 2, 201602: 8}
    again = sample.stratified_sample(df, 10, "safra", ["msno"])
    assert rows(s, "msno") == rows(again, "msno")         # deterministic
    u = sample.uniform_sample(df, 7, ["msno"])
    assert u.count() == 7


def test_samples_match_md5_brute_force(spark):
    import hashlib

    data = [(k, 201601 + m) for k in range(60) for m in range(3)] + [(k, 201604) for k in range(7)]
    df = spark.createDataFrame(data, "msno int, safra int")

    def h(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    want = sorted(data, key=lambda r: (h(42, r[0], r[1]), r[0], r[1]))[:25]
    assert sorted(rows(sample.uniform_sample(df, 25, ["msno", "safra"]), "msno", "safra")) \
        == sorted(want)
    # 187 rows, max 40: sizes round(60*40/187) = 13 (x3) and round(7*40/187) = 1
    frac = 40 / len(data)
    picked = []
    for m in (201601, 201602, 201603, 201604):
        part = sorted((r for r in data if r[1] == m), key=lambda r: (h(42, r[0], r[1]), r[0]))
        picked += part[:min(len(part), max(1, round(len(part) * frac)))]
    picked = sorted(picked, key=lambda r: (h(42, r[0], r[1]), r[0], r[1]))[:40]
    got = rows(sample.stratified_sample(df, 40, "safra", ["msno"]), "msno", "safra")
    assert sorted(got) == sorted(picked)


def test_dedup_keep_last_and_first(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 3, 5), ("b", 1, 1)],
                               "k string, ord int, v int")
    last = {r["k"]: r["v"] for r in clean.dedup(df, ["k"], ["ord"], "last").collect()}
    first = {r["k"]: r["v"] for r in clean.dedup(df, ["k"], ["ord"], "first").collect()}
    assert last == {"a": 5, "b": 1} and first == {"a": 10, "b": 1}
    dups = clean.duplicate_keys(df, ["k"]).collect()
    assert [(r["k"], r["n_rows"]) for r in dups] == [("a", 3)]
    with pytest.raises(ValueError):
        clean.assert_unique(df, ["k"])


def test_best_policy_ties_within_a_cent_take_smaller_fraction(spark):
    g = spark.createDataFrame(
        [(2, 0.5, 0.01, -14.0 * 386877.060213), (2, 0.5, 0.03, -14.0 * 386877.060213 + 1e-9),
         (2, 0.5, 0.05, -20.0), (1, 0.5, 0.03, 5.0), (1, 0.5, 0.01, 4.99)],
        "free_months int, accept_rate double, top_frac double, expected_net_NTD double")
    got = {(r.free_months, r.top_frac) for r in scenario.best_policy(g).collect()}
    assert got == {(2, 0.05), (1, 0.03)}
    g2 = g.where("top_frac < 0.05")
    got = {(r.free_months, r.top_frac) for r in scenario.best_policy(g2).collect()}
    assert got == {(2, 0.01), (1, 0.03)}


def test_normalize_keys_rejects_bad_period(spark):
    df = spark.createDataFrame([(1, "201601"), (2, "2016-01"), (None, "201602")],
                               "msno int, safra string")
    good, bad = clean.normalize_keys(df)
    assert rows(good, "msno", "safra") == [("1", 201601)]
    assert sorted(r["_reason"] for r in bad.collect()) == ["null key", "unparsable period"]


def test_coerce_numeric_nan_to_null(spark):
    df = spark.createDataFrame([("1.5",), ("abc",), ("NaN",), (None,)], "x string")
    got = [r["y"] for r in df.select(S.coerce_numeric("x").alias("y")).collect()]
    assert got[0] == 1.5 and got[1:] == [None, None, None]


def test_results_independent_of_shuffle_partitions(spark):
    data = [(f"c{i % 7}", 201600 + 1 + i % 12, float(i % 5)) for i in range(80)]
    df = spark.createDataFrame(data, "msno string, safra int, paid_sum double").dropDuplicates(
        ["msno", "safra"])
    res = []
    for n in (1, 4, 37):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        res.append(rows(panel.lag_diff(df, ["paid_sum"]), "msno", "safra", "paid_sum_lag1"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert res[0] == res[1] == res[2]
