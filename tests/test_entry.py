"""Driver contract: entry() runs, every oracle has a query, rows-only queries
return what can be said without SQL: their keys, ranges and counts."""

import __spark_entry__ as E
import pytest
from conftest import SF_SMALL
from pulsepanel.plans import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["safra", "rows", "churn", "churn_n"]
    rows = df.collect()
    assert len(rows) > 10 and len({r.safra for r in rows}) == len(rows)
    assert all(0 <= r.churn <= 1 and r.rows > 0 for r in rows)


def test_oracles_have_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_without_the_training_data_folders(tmp_path):
    """The entry still imports when those folders are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(f"{root}/pulsepanel", tmp_path / "pulsepanel",
                    ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"],
        cwd=tmp_path, capture_output=True, text=True, check=True,
        env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql()))]


def test_without_a_package_that_only_they_need():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    said = subprocess.run(
        [sys.executable, "-W", "ignore", "-c", "import sys; sys.modules.update(xxhash=None, tokenizers=None, regex=None)\n"
         "import __spark_entry__ as e; print(len(e.queries()) >= %d)" % len(catalog.queries())],
        cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.split() == ["True"]


def _unit(v):
    return v is not None and 0 <= v <= 1


CHECKS = {
    "churn_gbt": lambda rows, n: len(rows) == n("documents") and all(_unit(r.p_churn) for r in rows),
    "permutation_importance": lambda rows, n: {r.feature for r in rows} == {
        "n_chars", "n_words", "lang", "source"} and all(-1 <= r.importance <= 1 for r in rows),
    "segment_kmeans": lambda rows, n: len(rows) == n("embeddings") == len({r.vec_id for r in rows})
    and {r.cluster for r in rows} <= set(range(10)),
    "choose_k": lambda rows, n: [r.k for r in sorted(rows)] == list(range(2, 11))
    and sum(r.chosen for r in rows) == 1
    and max(rows, key=lambda r: r.silhouette).chosen == 1,
    # a set of one class has no AUC
    "reference_churn_model": lambda rows, n: [r["set"] for r in rows] == ["val", "test"]
    and all((r.roc_auc is None or _unit(r.roc_auc)) and _unit(r.recall_top5pct) and r.k5 >= 1
            for r in rows),
    "model_search": lambda rows, n: [(r.max_depth, r.max_iter) for r in rows] == [(4, 200), (6, 300), (8, 400)]
    and sum(r.chosen for r in rows) == 1 and all(1 <= r.rounds <= r.max_iter for r in rows)
    and max(rows, key=lambda r: -1 if r.roc_auc is None else r.roc_auc).roc_auc == next(
        r.roc_auc for r in rows if r.chosen),
    "reference_segments": lambda rows, n: abs(sum(r.share for r in rows) - 1) < 1e-5
    and [r.p_churn for r in rows] == sorted((r.p_churn for r in rows), reverse=True),
    "reference_segment_reports": lambda rows, n: {r.report for r in rows} == {
        "drivers", "drift", "silhouette"},
}


def test_every_rows_only_query_has_a_check():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == set(CHECKS)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_rows_only_query(spark, name):
    rows = E.queries()[name](spark, SF_SMALL).collect()
    assert CHECKS[name](rows, lambda t: spark.read.parquet(f"{SF_SMALL}/{t}.parquet").count())
