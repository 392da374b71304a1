"""A corpus pipeline: raw documents to packed training sequences.

Each stage works on all that its predecessor kept; ``run`` writes a stage's
result under the shared checkpoint folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsepanel.llm import exact_dedup, mixing, ngram_join, packing, quality
from pulsepanel.llm.common import with_row_key
from pulsepanel.llm.queries import table, tokenizer_path
from pulsepanel.sources.sinks import materialize

#: Near duplicates: five words, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100
#: Dropped rows that are broadcast at most (16 bytes each); beyond, a shuffle.
BROADCAST_ROWS = 200_000


def _free(docs: DataFrame, name: str) -> str:
    """The name, or one like it that the table does not have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def _without(keyed: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``keyed`` without the rows of ``dropped`` (columns id, row); the key
    column goes as well."""
    did, drow = _free(keyed, "dropped_id"), _free(keyed, "dropped_row")
    dropped = materialize(dropped.toDF(did, drow), "dropped")
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    same = (F.col(row) == F.col(drow)) & F.col("doc_id").eqNullSafe(F.col(did))
    return keyed.join(dropped, same, "left_anti").drop(row)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects.

    The labels of the given folder train it; a null or empty text is scored as
    an empty text.  Few labels, or labels of one class, give one score for all
    documents, held against the same threshold; only where training sees no
    label at all is nothing rejected.
    """
    labels = table(spark, sf_dir, "labels")
    model = quality.train_quality(docs, labels)
    if not model.seen:
        return docs
    scored = quality.score_quality(docs, model)
    return scored.where(F.col("score") >= quality.THRESHOLD).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts only the row with the smallest doc_id stays."""
    row = _free(docs, "_row")
    keyed = with_row_key(docs, row)
    found = exact_dedup.exact_dedup(keyed, carry=(row,))
    return _without(keyed, found.where("not kept").select("doc_id", row), row)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates only the smallest doc_id stays."""
    row = _free(docs, "_row")
    keyed = with_row_key(docs, row)
    found = ngram_join.ngram_join(keyed, size=NEAR_WORDS, num=NEAR_NUM, den=NEAR_DEN, row_col=row)
    return _without(keyed, found.where("not first").select("doc_id", "_row"), row)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0, 1 or 2 rows."""
    row, mid, mrow, times, copy = (_free(docs, n) for n in ("_row", "_mid", "_mrow", "_times", "_copy"))
    keyed = with_row_key(docs, row)
    mix = mixing.mix_sources(keyed, carry=(row,))
    mix = materialize(mix.where("copies > 0").select("doc_id", row, "copies").toDF(mid, mrow, times),
                      "mix-copies")
    same = (F.col(row) == F.col(mrow)) & F.col("doc_id").eqNullSafe(F.col(mid))
    return (keyed.join(mix, same)
            .withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_duplicates", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
