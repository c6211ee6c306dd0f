"""The corpus pipeline: stages over documents, each written as Parquet and read back as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import exact_dedup, mixing, ngram_join, packing, quality
from tidemill.llm.queries import TARGETS, labelled_domains
from tidemill.llm.store import materialise, new_path, partitions, tables


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and wordless texts go; repeated rows stay or go together; without labels all stay."""
    return quality.good(docs, tables(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id, nulls last) of each text. Null texts all stay; of repeated rows one stays."""
    return exact_dedup.exact_dedup(docs, exact_dedup.DigestIndex(spark, new_path(spark, "digest-index"), partitions(spark)), "documents")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest doc_id. Rows without an id or words stay, and so do repeated rows of an id that stays."""
    return ngram_join.one_of_each(docs)


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its fitted rate gives it. Null and wordless texts go; repeated rows are drawn alike; without labels all rates are the same."""
    return mixing.repeated(docs, labelled_domains(spark, docs, sf_dir), TARGETS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 token ids as pieces of documents. Null and empty texts are in none; repeated rows and null ids are packed like others; ties take the smallest doc_id."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed_documents),
    ("best-fit packing", sequences),
]

#: The classifier and the fitted rates can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name))
    return STAGES[-1][1](spark, docs, sf_dir)
