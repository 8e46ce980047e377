"""A training-corpus pipeline over ``documents``: language, quality, near copies, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearloom.llm import langid, mixing, quality, simhash
from nearloom.llm.common import table, write_shared
from nearloom.llm.labelled import labelled_sample
from nearloom.llm.queries import encoded_digests
from nearloom.session import ship_package

MIN_QUALITY = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression tells; dictionaries come from the rows with a language."""
    ship_package(spark)
    dictionaries = langid.fit(docs, F.lit(True))
    return langid.identify(docs, dictionaries).filter(~F.col("rejected")).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``MIN_QUALITY``; the model comes from labels of all folds."""
    ship_package(spark)
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality", 1, 1, quality.SAMPLE)
    return quality.score(docs, quality.fit(sample)).filter(F.col("score") >= MIN_QUALITY).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    ship_package(spark)
    return simhash.first_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    ship_package(spark)
    return mixing.training_order(mixing.plan_mix(docs, prefix="_mix_"), docs.columns, prefix="_mix_")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mix."""
    ship_package(spark)
    return encoded_digests(docs)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

# Compression, a fitted model and 64-bit fingerprints have no SQL; tests compare run() with a
# plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
