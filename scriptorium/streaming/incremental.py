"""Incremental refresh: fingerprints of what was built, what to rebuild, and a file stream that feeds it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import identity as idf

VERSION = "1"


def page_fingerprints(documents: DataFrame, mode: str = "deterministic") -> DataFrame:
    """(doc_id, fingerprint): over everything a page is made of, the way of summarising included."""
    used = [c for c in ("sha256", "source_class", "relationship", "title", "author", "year", "canonical_doc_id", "dedupe_kind", "similarity_1e4", "filename", "page_count") if c in documents.columns]
    x = documents.select("doc_id", F.lit(VERSION).alias("version"), F.lit(mode).alias("mode"), *used)
    return x.select("doc_id", idf.fingerprint("version", "mode", *used).alias("fingerprint"))


def rebuild_plan(now: DataFrame, before: DataFrame) -> DataFrame:
    """(doc_id, action): build, reuse or remove."""
    a, b = now.select("doc_id", F.col("fingerprint").alias("a")), before.select("doc_id", F.col("fingerprint").alias("b"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", F.when(F.col("a").isNull(), "remove").when(F.col("a") == F.col("b"), "reuse").otherwise("build").alias("action"))


def built(prints: DataFrame) -> DataFrame:
    """The state to store: fingerprints with the time of the build."""
    return prints.withColumn("built_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def merged(old: DataFrame, rebuilt: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows to keep of the old table, and the rebuilt ones."""
    keep = plan.where("action = 'reuse'").select("doc_id")
    return old.join(keep, "doc_id", "left_semi").unionByName(rebuilt, allowMissingColumns=True)


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None]):
    """Give the files that came since the last call to ``handle`` and stop: one run of a file stream with a stored position."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
