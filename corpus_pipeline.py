"""The corpus pipeline: quality, language, near duplicates, source mix, packing.

Every stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's documents. All but the last return the columns of
`documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm import compression_quality, language_crf, minhash_forest, mixing, packing
from crosspanel.llm.common import stage, table
from crosspanel.llm.registry import packing_vocabulary

#: SQL can express neither the compression score nor the random field.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts as good, learned from the labels outside the held-out split."""
    model = compression_quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(compression_quality.score_column(model, F.col("text")) >= model.settings.threshold)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language, learned from the documents outside the held-out split; those without a letter go."""
    model = language_crf.fit(docs)
    found = language_crf.language_column(model, F.col("text"))
    return docs.where(found["lang_pred"] != language_crf.UNKNOWN)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents: the one with the least id.

    Every row goes by its own text: texts that share an id are told apart, rows without an id are compared like others.
    """
    return minhash_forest.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target weights."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, piece by piece."""
    return packing.pack(docs, **packing_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{at}")
    return docs
