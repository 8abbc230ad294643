"""The corpus pipeline: quality rules, near duplicates, benchmark, mixture, shards.

Every stage takes rows with nulls in any column, empty and very long texts, repeated rows and ids,
empty tables and extra columns, which it leaves out. A rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm import decontamination, jaccard_join, mixing, sharding
from gneiss.llm.common import materialize, table
from gneiss.llm.quality_rules import kept_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Rows are judged one by one, whatever their doc_id; a null, empty or short text fails the base rules and goes.
    """
    return kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id; rows without a doc_id stay.

    A document is a doc_id with a text: texts that share a doc_id are compared each for itself,
    and rows equal in both are one document. Documents are told apart by 64-bit hashes.
    """
    docs = docs.select(*COLUMNS, F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text")).alias("_own"))
    found = jaccard_join.join(docs.select(F.col("_own").alias("doc_id"), "text")).select(F.col("doc_id").alias("_own"), "component_id").distinct()
    members = materialize(found.join(docs.select("doc_id", "_own").where("_own IS NOT NULL").distinct(), "_own"), "near-copies")
    first = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_own")).alias("_first")).select("_first._own")
    left = docs.join(members.join(first, "_own", "left_anti").select("_own"), "_own", "left_anti")
    one = left.where("_own IS NOT NULL").groupBy("_own").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("_row"), F.first("text").alias("text"))
    return one.select("_row.*", "text").select(*COLUMNS).unionByName(left.where("_own IS NULL").select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Rows are judged one by one, whatever their doc_id; a null or empty text overlaps nothing and stays.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the slots of the mixture's schedule take them: none to three times, by whole documents.

    Each source has its target to within half of one document. Rows without words take no part and stay once; a null source is a
    source of its own, and rows with a null or repeated doc_id count each for itself.
    """
    return mixing.mixed_documents(docs, COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; repeated rows have a slot each, and nulls are dealt like other rows."""
    return sharding.interleave(docs)


STAGES = [
    ("quality rules", by_quality_rules),
    ("n-gram jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixture),
    ("sharding", shards),
]

#: Hashed n-grams, Jaccard components and seeded shuffles have no DuckDB equivalent.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
