"""From documents to packed sequences: five stages, each an operator of scriptorium.llm.

A stage takes (spark, docs, sf_dir). Its result is written and read again as the next
stage's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.llm import cdc, dartminhash, packing, pfair, quality
from scriptorium.llm.tokens import default_vocabulary
from scriptorium.plans.workspace import Workspace


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality.fit(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one of least id."""
    return dartminhash.drop_near_duplicates(spark, docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out."""
    return cdc.without_repeats(spark, docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix."""
    return pfair.mixed(spark, docs)


def in_file_order(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, text and (``name``) the number of each row in the order in which the table's files hold them."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # a row per file: the files of one written table
    counts = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.element_at(F.split("_file", "/"), -1), "_file").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(F.broadcast(starts), "_file").select("doc_id", "text", (F.col("_start") + F.col("_row")).alias(name))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences, whose numbers follow the order of the written mix."""
    return packing.pack(spark, in_file_order(docs, "mixed_at"), default_vocabulary(), order="mixed_at")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The classifier is no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
