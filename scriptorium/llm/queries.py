"""The queries opN_<name> and the SQL that their results are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import cdc, chat, cws, dartminhash, hnsw, lengths, packing, pfair, quality, zdict
from scriptorium.llm.oracle import ORACLES
from scriptorium.llm.tokens import default_vocabulary


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = pfair.positions(spark, _table(spark, sf_dir, "documents").select("doc_id", "source"))
    return x.select("doc_id", "source", "block", "offset", "release", "deadline", "slot", "position")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.measure(spark, _table(spark, sf_dir, "documents"))
    return quality.scored(docs, quality.fit(spark, docs, _table(spark, sf_dir, "labels"), measured=True), measured=True)


def op4_cws_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(spark, _table(spark, sf_dir, "documents"))


def op5_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(_table(spark, sf_dir, "conversations"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lengths.limits(spark, lengths.length_histogram(lengths.token_lengths(docs, default_vocabulary(), end_tokens=1)))


def op8_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, dictionary = zdict.write(spark, _table(spark, sf_dir, "documents"), default_vocabulary())
    return zdict.read(spark, manifest, dictionary)


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"), default_vocabulary())


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(spark, _table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_dartminhash, op2_pfair_mix, op3_quality, op4_cws_fingerprints, op5_hnsw, op6_chat_perspectives, op7_length_histogram, op8_id_files, op9_best_two_fit, op10_gear_chunks)}
__all__ = ["ORACLES", "QUERIES"]
