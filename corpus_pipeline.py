"""From documents to packed training windows, one operator per stage.

Every stage reads what the one before it kept (written as Parquet and read again) and returns the columns
of documents; the last one returns the pieces of the packed windows. Null, empty and repeated rows are
treated as the operators state. Labels are read from the folder; nothing else is.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixing, nbsvm, packing, queries, rules, simhash
from paperloom.llm.common import read
from paperloom.session import shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below the threshold go. Learned from the labels of the given documents."""
    model = queries.quality_model(docs, read(spark, sf_dir, "labels"))
    return nbsvm.scored(docs, model).filter(F.col("score") >= nbsvm.THRESHOLD).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test, or whose posterior probability of good is too low, go."""
    return rules.judge(docs).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints stays."""
    return simhash.one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the copies are rows of their own."""
    return mixing.mixed(docs)


def window_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("simhash near-duplicates", near_duplicates),
    ("source mixing", source_mixing),
    ("packing", window_packing),
]

# The fitted classifier and the tokenizer have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents, each written to the shared folder and read again."""
    home = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        at = f"{home}/{number}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
