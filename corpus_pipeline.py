"""The corpus pipeline: quality classifier, near duplicates, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.

Defined cases: null and empty texts have no quality indicator and go or stay by the model's bias; they are no near
duplicates and no leaks, and encode to no ids; of repeated rows one stays; rows without a doc_id are never near duplicates;
without labels every document stays; an empty table gives no rows; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia_spark.llm import bpe, decontaminate, jaccard, quality, shared
from scholia_spark.llm.queries import vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among ``docs``, doesn't reject."""
    model = quality.fit(docs, shared.table(spark, sf_dir, "labels"))
    score, predicted = shared.fresh(docs, "score"), shared.fresh(docs, "predicted")
    return quality.classify(docs, model, score=score, predicted=predicted).where(F.col(predicted) == 1).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles link at a Jaccard similarity of 0.8."""
    return jaccard.deduplicate(docs, n=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold an item of the benchmark, as it is or with other parameters."""
    return decontaminate.clean(docs, shared.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids: the corpus as token ids."""
    return bpe.digest_documents(docs, vocabulary(), with_ids=True, keep_words=False)


STAGES = [("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("decontaminate", drop_benchmark_leaks), ("bpe", encode)]

#: The classifier's decisions and byte-pair merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is a table in the shared folder."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
