"""The corpus pipeline: five operators of emberline.llm over the documents table, each stage's rows written before the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of documents, whatever
other columns those have. Null texts and those without words are rejected by the first stage; a null source has no
verdict of its own. Repeated rows are copies, of which near-dedup keeps one. Texts may have any length. Empty tables,
of documents or of the benchmark, go through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import materialise, read_table
from emberline.llm.decontaminate import drop_leaks
from emberline.llm.host_quality import keep_good_hosts
from emberline.llm.near_dedup import one_of_each
from emberline.llm.pack import pack
from emberline.llm.weak_quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps."""
    return keep_good(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the rules nor their host's verdict reject."""
    return keep_good_hosts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the trained classifier, the hashed darts or the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written as Parquet and read again as the next one's docs."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
