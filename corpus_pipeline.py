"""The corpus pipeline: language, quality, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with all their columns; the last returns
their tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontaminate, jaccard, langid, quality, sentencepiece
from folioscope.llm.common import shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose likeliest language has a probability under one half."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.remove_unidentified(docs, model)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, fitted on the labelled ones among docs, scores under one half."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.remove_poor(docs, model)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group that similarity links hold together."""
    return jaccard.one_of_each_group(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a near copy of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Returns (doc_id, n_tokens, ids, round_trip) of every document that is left."""
    return sentencepiece.encode_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", classify_quality),
    ("n-gram Jaccard join", join_near_copies),
    ("benchmark decontamination", remove_benchmarks),
    ("SentencePiece encoding", encode_tokens),
]

#: Trained models and edit distances under LSH have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the documents are written to the shared folder, so no stage runs twice."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
