"""Model search: settings fitted side by side on one training matrix.

The reference's search fits one setting after the other, each from the raw
rows.  Here the preparation (medians, modes, category index, feature vector)
is fitted once on the training rows and its result is written once; every
setting reads that matrix.  A boosting round is a few small jobs, so one fit
leaves most of a cluster idle: a small pool of driver threads runs the fits
at the same time.  With ``early_tol`` the out-of-time validation rows choose
the number of rounds.  All settings' validation scores go to one table, and
one grouped histogram gives the metrics of every setting.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsepanel.operators.metrics import eval_sets
from pulsepanel.operators.prep import fit_medians, fit_modes, one_hot_stages
from pulsepanel.operators.train import DEFAULT_PARAMS, PARAM_GRID, ChurnModel, feature_columns
from pulsepanel.sources.checked import has_rows, materialize_checked, two_classes
from pulsepanel.sources.sinks import materialize
from pulsepanel.sources.tables import require_columns

#: Fits that run at the same time.
THREADS = 4
SETTING = "max_depth int, learning_rate double, max_iter int"


def fit_preparation(train: DataFrame, label: str, extra_drop=(), categorical=()) -> ChurnModel:
    """Imputation, category index and feature vector fitted on ``train``: a
    :class:`ChurnModel` whose pipeline ends with the column ``features``."""
    numeric, cat = feature_columns(train, extra_drop=[*extra_drop, label, "split"], categorical=categorical)
    if not numeric and not cat:
        raise ValueError("no feature left after removing keys and leaks")
    medians = fit_medians(train, numeric) if numeric else {}
    modes = {c: v for c, v in (fit_modes(train, cat) if cat else {}).items() if v is not None}
    said = train.select([v.alias(c) for c, v in modes.items()]).limit(1).collect() if modes else []
    prep = ChurnModel(numeric, cat, medians, said[0].asDict() if said else {}, None)
    stages, encoded = one_hot_stages(cat)
    vector = VectorAssembler(inputCols=numeric + encoded, outputCol="features", handleInvalid="keep")
    prep.pipeline = Pipeline(stages=[*stages, vector]).fit(prep.prepare(train))
    return prep


def training_matrix(df: DataFrame, prep: ChurnModel, label: str, keys) -> DataFrame:
    """Keys, split, label and feature vector of every row, written once; the
    write counts the rows and the classes of the training rows."""
    x = prep.pipeline.transform(prep.prepare(df)).select(
        *keys, "split", label, F.col(label).cast("double").alias("_label"),
        (F.col("split") == "val").alias("_held"), "features")
    rules = {**has_rows("model table"), **two_classes("_label", F.col("split") == "train")}
    return materialize_checked(x, "training_matrix", rules)[0]


def fit_settings(matrix: DataFrame, grid, early_tol: float | None = None, seed: int = 42,
                 max_bins: int = 255, threads: int = THREADS) -> list:
    """One boosted model per setting, fitted at the same time.

    With ``early_tol`` a fit sees the validation rows as well, and ends with
    the round after which their error falls by less than that share."""
    kept = matrix.where(F.col("split").isin("train", *(["val"] if early_tol is not None else [])))

    def fit(setting):
        p = dict(DEFAULT_PARAMS, **setting)
        gbt = GBTClassifier(featuresCol="features", labelCol="_label", maxDepth=int(p["max_depth"]),
                            stepSize=float(p["learning_rate"]), maxIter=int(p["max_iter"]),
                            maxBins=max_bins, seed=seed)
        if early_tol is not None:
            gbt = gbt.setValidationIndicatorCol("_held").setParams(validationTol=early_tol)
        return gbt.fit(kept)

    fit = inheritable_thread_target(matrix.sparkSession)(fit)
    with ThreadPool(max(1, min(threads, len(grid)))) as pool:
        return pool.map(fit, grid, chunksize=1)


def _scores(matrix: DataFrame, model, keys, label: str) -> DataFrame:
    return model.transform(matrix).select(
        *keys, "split", label, vector_to_array(F.col("probability"))[1].alias("p_churn"))


@dataclass
class Search:
    """Best setting, its model, a row per setting, the written score table of
    validation and test, and the metrics of both."""

    best: dict
    model: ChurnModel
    report: DataFrame
    scores: DataFrame
    metrics: list


def model_search(df: DataFrame, label: str = "churn_3m", keys=("msno", "safra"), grid=PARAM_GRID,
                 extra_drop=(), categorical=(), early_tol: float | None = None, seed: int = 42,
                 max_bins: int = 255, threads: int = THREADS) -> Search:
    """Search, choice, score table and metrics of rows with a ``split``.

    The best setting has the highest validation ROC-AUC, the first of equals;
    without an AUC (one class in validation) the first setting is taken.  Its
    model is the one that the search fitted on the training rows: a refit with
    the same rows and seed would be the same model.
    """
    require_columns(df, ["split", label, *keys], "model table")
    keys, grid = list(keys), [dict(s) for s in grid]
    prep = fit_preparation(df.where(F.col("split") == "train"), label, [*extra_drop, *keys], categorical)
    matrix = training_matrix(df, prep, label, keys)
    models = fit_settings(matrix, grid, early_tol, seed, max_bins, threads)
    val = matrix.where(F.col("split") == "val")
    tried = [_scores(val, m, keys, label).withColumn("setting", F.lit(i)) for i, m in enumerate(models)]
    found = eval_sets(materialize(reduce(DataFrame.unionByName, tried), "search_scores"), "setting",
                      range(len(grid)), label=label, tie_keys=keys)
    auc = [-1.0 if r["roc_auc"] is None else r["roc_auc"] for r in found]
    at = auc.index(max(auc))
    rows = [(int(s["max_depth"]), float(s["learning_rate"]), int(s["max_iter"]), m.getNumTrees, r["roc_auc"],
             r["pr_auc"], r["recall_top5pct"], int(i == at))
            for i, (s, m, r) in enumerate(zip(grid, models, found))]
    report = df.sparkSession.createDataFrame(
        rows, f"{SETTING}, rounds int, roc_auc double, pr_auc double, recall_top5pct double, chosen int")
    model = ChurnModel(prep.numeric, prep.categorical, prep.medians, prep.modes,
                       PipelineModel([*prep.pipeline.stages, models[at]]), dict(DEFAULT_PARAMS, **grid[at]))
    scores = materialize(_scores(matrix.where(F.col("split").isin("val", "test")), models[at], keys, label),
                         "score_table")
    return Search(grid[at], model, report, scores,
                  eval_sets(scores, "split", ("val", "test"), label=label, tie_keys=keys))
