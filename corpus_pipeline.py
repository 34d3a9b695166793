"""The training-data pipeline: five stages over ``documents``, each stage's rows written as Parquet and read by the next.

Every stage but the last keeps or drops whole documents and returns the columns it
was given. A row without a doc_id is judged by its text where a stage can (quality,
exact dedup) and passes where a stage names documents by id (near duplicates,
decontamination) and is packed. Null and empty texts are judged like others: equal
to each other, unlike anything else, clean, and packed as the end id alone. Texts
of any length are read whole, other columns may have any names, and an empty table
goes through as one.

A stage begins by releasing what the stages before it hold in the driver: their
rows are written by then. Do not run it beside unwritten results of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from residuum.llm import content_sort, decontaminate, jaccard, packing, quality
from residuum.llm.staging import release, stage, table


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids``, and those without an id."""
    return docs.join(ids, "doc_id", "leftsemi").unionByName(docs.where("doc_id IS NULL"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return content_sort.deduplicated(docs)


def unlike_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    release()
    groups = jaccard.near_duplicate_groups(docs)
    return _only(docs, groups.where("doc_id = component_id").select("doc_id"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in a benchmark window."""
    release()
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _only(docs, found.where("NOT contaminated").select("doc_id"))


def packed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release()
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("exact dedup", distinct_documents),
    ("n-gram Jaccard join", unlike_documents),
    ("benchmark decontamination", clean_documents),
    ("best-fit packing", packed_documents),
]
#: Trained scores and the packing search are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
