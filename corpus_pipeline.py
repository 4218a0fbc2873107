"""Training-corpus pipeline: STAGES of (name, function), applied in order.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; it is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``. Stage by stage: documents that the quality
rules reject go; one document of each SimHash group stays; personal data is
replaced by its kind; the mix repeats or shortens documents so that each source
nears its target (a document taken twice is two rows, words taken once more are
a row of their own); what is left is cut into pieces and packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latebound.llm.bin_completion import pack_documents
from latebound.llm.mixing import mixed_documents
from latebound.llm.pii import redacted_documents
from latebound.llm.quality import passing_documents
from latebound.llm.queries import tokenizer_path
from latebound.llm.simhash import one_per_group
from latebound.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return passing_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints linked at 4 or fewer bits."""
    return one_per_group(docs, shingle=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced."""
    return redacted_documents(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, as documents."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing", mixing),
    ("best-fit packing", packing),
]

#: SQL cannot express the fingerprints, the trees and the search; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
