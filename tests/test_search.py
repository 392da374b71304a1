"""Side-by-side search: one matrix, validated rounds, metrics of the written scores."""

import random
import time

import duckdb
import pytest
from pulsepanel.operators import search
from pulsepanel.operators.train import fit_churn_model

GRID = [{"max_depth": d, "learning_rate": 0.2, "max_iter": 12} for d in (1, 2, 3)]

SQL = """
with s as (select * from read_parquet('{path}/*.parquet')),
r as (select *, row_number() over (partition by split order by p_churn desc, msno, safra) as rn,
             rank() over (partition by split order by p_churn) as low,
             count(*) over (partition by split, p_churn) as tied, count(*) over (partition by split) as n,
             sum(churn_3m) over (partition by split) as pos,
             count(*) over (partition by split order by p_churn desc) as above,
             sum(churn_3m) over (partition by split order by p_churn desc) as hits from s)
select split, (sum(churn_3m * (low + (tied - 1) / 2.0)) - any_value(pos * (pos + 1)) / 2.0)
         / any_value(pos * (n - pos)), sum(churn_3m * hits::double / above) / any_value(pos),
       sum(case when rn <= greatest(1, floor(n * 0.05)) then churn_3m else 0 end)::double / any_value(pos)
from r group by split order by split desc
"""


def rows(spark, noise, n=900):
    rng = random.Random(11)
    out = []
    for i in range(n):
        x, z = rng.random(), rng.random()
        p = rng.random() if noise else 0.15 * rng.random() + (0.8 if (x > 0.5) ^ (z > 0.6) else 0.0)
        split = "train" if i % 3 == 0 else "val" if i % 3 == 1 else "test"
        out.append((i, 201601 + i % 12, x, z, rng.choice("ab"), int(p > 0.5), split))
    return spark.createDataFrame(out, "msno long, safra int, x double, z double, plan string, churn_3m int, "
                                      "split string")


@pytest.fixture(scope="module")
def found(spark):
    return search.model_search(rows(spark, noise=False), grid=GRID, categorical=["plan"])


def test_the_best_by_validation_auc(found):
    report = found.report.collect()
    assert [r.max_depth for r in report] == [1, 2, 3] and all(r.rounds == 12 for r in report)
    top = max(report, key=lambda r: r.roc_auc)
    assert top.chosen == 1 and sum(r.chosen for r in report) == 1 and found.best["max_depth"] == top.max_depth
    assert top.max_depth > 1 and top.roc_auc > 0.9  # the planted rule needs two features


def test_metrics_are_those_of_the_written_scores(spark, found):
    path = found.scores.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    want = duckdb.connect().sql(SQL.format(path=path)).fetchall()
    got = [(m["set"], m["roc_auc"], m["pr_auc"], m["recall_top5pct"]) for m in found.metrics]
    assert [g[0] for g in got] == [w[0] for w in want] == ["val", "test"]
    for g, w in zip(got, want):
        assert g[1:] == pytest.approx(w[1:])
    keys = {(r.msno, r.split) for r in found.scores.collect()}
    assert keys == {(r.msno, r.split) for r in rows(spark, False).where("split <> 'train'").collect()}


def test_the_model_is_that_of_a_single_fit(spark, found):
    """One matrix and threads do not change a fit."""
    df = rows(spark, noise=False)
    alone = fit_churn_model(df.where("split = 'train'"), params=found.best, categorical=["plan"],
                            extra_drop=["split"])
    test = df.where("split = 'test'")
    a = {r.msno: r.p_churn for r in alone.score(test).collect()}
    b = {r.msno: r.p_churn for r in found.model.score(test).collect()}
    c = {r.msno: r.p_churn for r in found.scores.where("split = 'test'").collect()}
    assert a == pytest.approx(b) and b == pytest.approx(c)


def test_validation_ends_the_rounds(spark):
    grid = [{"max_depth": 3, "learning_rate": 0.2, "max_iter": 40}]
    signal, noise = (search.model_search(rows(spark, n), grid=grid, categorical=["plan"], early_tol=0.001)
                     .report.first().rounds for n in (False, True))
    assert noise < signal <= 40 and noise <= 10


def test_fits_run_side_by_side(spark):
    df = rows(spark, noise=False)
    prep = search.fit_preparation(df.where("split = 'train'"), "churn_3m", ["msno", "safra"], ["plan"])
    matrix = search.training_matrix(df, prep, "churn_3m", ["msno", "safra"])
    grid = [{"max_depth": 3, "learning_rate": 0.1, "max_iter": 15}] * 4
    search.fit_settings(matrix, grid[:1])  # plans are compiled
    took = {}
    for threads in (1, 4):
        t = time.perf_counter()
        models = search.fit_settings(matrix, grid, threads=threads)
        took[threads] = time.perf_counter() - t
    assert took[4] < 0.8 * took[1]
    assert len({m.toDebugString.split(",", 1)[1] for m in models}) == 1  # without their own ids


def test_guards(spark):
    df = rows(spark, noise=False)
    with pytest.raises(ValueError, match="single class"):
        search.model_search(df.where("split <> 'train' or churn_3m = 1"), grid=GRID[:1])
    with pytest.raises(ValueError, match="missing columns"):
        search.model_search(df.drop("split"), grid=GRID[:1])
