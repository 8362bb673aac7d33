"""Training-data pipeline over ``documents``: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Between stages rows are written
as Parquet, so a stage that fails or loses executors starts again from the stage before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.llm import decontamination, quality, shingle_join, sp_encoding, surrogates
from fieldtrust.llm.common import table, written


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    names = docs.columns
    own = {c: f"__{c}" for c in ("score", "predicted", "held_out") if c in names}  # the documents' own columns of these names stay
    kept = quality.scored(docs.withColumnsRenamed(own), model).where("predicted = 1")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: SimHash links, then all pairs of a Jaccard similarity of 0.8 or more on five-word shingles."""
    return shingle_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` follows the text."""
    names = docs.columns
    own = {"n_replaced": "__n_replaced"} if "n_replaced" in names else {}
    out = surrogates.surrogates(docs.withColumnsRenamed(own), surrogates.key_of(spark))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in names])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document."""
    return sp_encoding.encode(docs.select("doc_id", "text"))


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("encoding", encode),
]

#: Neither training nor shingle sets nor piece encoding can be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
