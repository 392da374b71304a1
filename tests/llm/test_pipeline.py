"""Stages on odd rows, the whole run, and the registered SQL."""

import __spark_entry__ as E
import corpus_pipeline as cp
import pytest
from conftest import SF_SMALL
from oracle_check import compare, duck
from llm_fixtures import make_docs, no_docs, odd_docs  # noqa: F401
from pulsepanel.llm.queries import ORACLES, QUERIES
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int"


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, i % 2) for i in range(1, 12)]
    spark.createDataFrame(rows, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def kept(frame):
    return sorted((str(r.doc_id), str(r.text)) for r in frame.collect())


def test_every_stage_takes_odd_and_empty_rows(spark, odd_docs, no_docs, folder):
    for docs in (odd_docs, no_docs):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, folder)
            if name != "packing":
                assert out.columns == docs.columns, name
                assert out.schema == docs.schema or [f.dataType for f in out.schema] == [
                    f.dataType for f in docs.schema], name
            out.collect()


def test_quality_stage_with_a_constant_score(spark, make_docs, tmp_path):
    docs = make_docs(*[(i, f"word {i}", "a") for i in range(60)])
    cases = [([], True), ([(i, 0) for i in range(60)], False), ([(i, 1) for i in range(60)], True),
             ([(i, i % 2) for i in range(6)], False), ([(i, None) for i in range(60)], True)]
    for n, (labels, keeps) in enumerate(cases):
        spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/{n}/labels.parquet")
        assert cp.quality_stage(spark, docs, f"{tmp_path}/{n}").count() == (60 if keeps else 0), labels
        same = cp.quality.classify(docs, spark.read.parquet(f"{tmp_path}/{n}/labels.parquet"))
        if any(y is not None for _, y in labels):
            assert same.where("predicted = 1").count() == (60 if keeps else 0), labels


def test_exact_stage(spark, odd_docs, folder):
    got = kept(cp.exact_stage(spark, odd_docs, folder))
    ids = [i for i, _ in got]
    assert ids.count("8") == 1 and "2" not in ids and ids.count("None") == 1
    assert [i for i in ids if i in ("3", "4", "5")] == ["3", "5"]  # null and empty; one space


def test_near_stage(spark, odd_docs, folder):
    got = [i for i, _ in kept(cp.near_stage(spark, odd_docs, folder))]
    assert "6" in got and "7" not in got and "1" in got and "8" not in got
    assert {"3", "4", "5", "9", "10", "11", "12"} <= set(got)


def test_mixing_stage_repeats_rows(spark, make_docs, folder):
    docs = make_docs(*[(i, "w " * (i % 50 + 1), f"s{i % 4}") for i in range(200)])
    copies = {r.doc_id: r.copies for r in cp.mixing.mix_sources(docs).collect()}
    got = {r.doc_id: r["count"] for r in cp.mixing_stage(spark, docs, folder)
           .groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_run_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    step, sizes = docs, []
    for name, stage in cp.STAGES[:-1]:
        step = cp.materialize(stage(spark, step, SF_SMALL), "test-stage")
        assert step.columns == docs.columns
        assert step.join(docs, docs.columns, "left_anti").count() == 0, name
        sizes.append(step.count())
    assert sizes[0] < docs.count() and sizes[1] <= sizes[0] and sizes[2] < sizes[1]
    truth = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    good = cp.quality_stage(spark, docs, SF_SMALL)
    lost = truth.where("quality = 1").join(docs, "doc_id").join(good, "doc_id", "left_anti").count()
    assert lost <= 0.1 * truth.where("quality = 1").count()
    packed = cp.packing_stage(spark, step, SF_SMALL)
    assert packed.select("doc_id").distinct().count() == step.select("doc_id").distinct().count()
    per = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length"))
                                            .alias("top"))
    assert per.where("n <> top or n > 4096").count() == 0


def test_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    problems, _ = compare(spark, name, QUERIES[name], ORACLES[name], SF_SMALL, duck(SF_SMALL))
    assert not problems, problems


def test_near_stage_setting_matches_sql(spark):
    from pulsepanel.llm.ngram_join import ngram_join
    from pulsepanel.llm.queries import sql_ngram, table

    def query(spark, d):
        return ngram_join(table(spark, d, "documents"), size=cp.NEAR_WORDS, num=cp.NEAR_NUM,
                          den=cp.NEAR_DEN).drop("_row", "first")

    sql = f"with recursive {sql_ngram('documents', cp.NEAR_WORDS, cp.NEAR_NUM, cp.NEAR_DEN)} select * from joined"
    problems, _ = compare(spark, "near", query, sql, SF_SMALL, duck(SF_SMALL))
    assert not problems, problems


def test_a_user_column_named_like_the_hidden_one(spark, odd_docs, folder, tmp_path):
    docs = odd_docs.withColumn("_metadata", F.lit("m"))
    docs.write.parquet(f"{tmp_path}/odd")
    for frame in (docs, spark.read.parquet(f"{tmp_path}/odd")):
        for stage in (cp.exact_stage, cp.near_stage, cp.mixing_stage):
            out = stage(spark, frame, folder)
            assert out.columns == docs.columns and out.count() > 0
