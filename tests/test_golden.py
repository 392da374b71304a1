"""Published report rows (tests/golden) replayed through the operators."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from pulsepanel.operators import labels, scenario

GOLDEN = os.path.join(os.path.dirname(os.path.abspath(__file__)), "golden")


def _read(name):
    with open(os.path.join(GOLDEN, name), newline="") as fh:
        return list(csv.DictReader(fh))


@pytest.fixture(scope="module")
def grid_rows():
    return _read("scenario_grid.csv")


def _grid(spark, grid_rows):
    curve = sorted({(float(r["top_frac"]), int(r["k"]), int(r["TP"]), int(r["FP"]))
                    for r in grid_rows})
    arpu = {float(r["ARPU_NTD"]) for r in grid_rows}
    base = {float(r["base_churn_rate_test"]) for r in grid_rows}
    assert len(curve) == 5 and len(arpu) == 1 and len(base) == 1
    cdf = spark.createDataFrame(curve, "top_frac double, k bigint, TP bigint, FP bigint")
    return scenario.scenario_grid(cdf, arpu.pop(), base.pop())


def test_scenario_grid_replays_published_rows(spark, grid_rows):
    got = {(r.free_months, r.accept_rate, r.top_frac): r for r in _grid(spark, grid_rows).collect()}
    assert len(got) == len(grid_rows) == 45
    for w in grid_rows:
        g = got[(int(w["free_months"]), float(w["accept_rate"]), float(w["top_frac"]))]
        assert (g.k, g.TP, g.FP) == (int(w["k"]), int(w["TP"]), int(w["FP"]))
        for c in ("precision_at_k", "lift", "expected_gain_NTD", "expected_cost_NTD",
                  "expected_net_NTD"):
            assert g[c] == pytest.approx(float(w[c]), rel=1e-9), c


def test_best_policy_replays_published_rows(spark, grid_rows):
    best = scenario.best_policy(_grid(spark, grid_rows)).collect()
    got = {(r.free_months, r.accept_rate): (r.top_frac, r.expected_net_NTD) for r in best}
    want = _read("best_policy.csv")
    assert len(got) == len(want) == 9
    for w in want:
        frac, net = got[(int(w["free_months"]), float(w["accept_rate"]))]
        assert frac == float(w["top_frac"])
        assert net == pytest.approx(float(w["expected_net_NTD"]), rel=1e-9)


def test_trust_rule_replays_published_months(spark):
    rows = _read("label_trust.csv")
    df = spark.createDataFrame(
        [(int(r["safra"]), float(r["fut_active_rate"]), float(r["churn_rate"]),
          int(r["label_trust"])) for r in rows],
        "safra int, far double, cr double, want int")
    got = df.select("safra", "want",
                    labels.trust_from_rates("far", "cr").alias("from_rates"),
                    labels.trust_from_rates("far", "cr", eligible=F.lit(0)).alias("no_eligible"))
    got = got.collect()
    # 20 of 23 verdicts follow from the two rates alone; the three months
    # before the first month with eligible customers need eligible = 0.
    differ = sorted(r.safra for r in got if r.from_rates != r.want)
    assert differ == [201510, 201511, 201512]
    assert all(r.no_eligible == r.want for r in got if r.safra in differ)
