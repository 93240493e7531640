"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Each whole text is encoded once; documents are counted by length before any shuffle.
A row per length that occurs, taken as a context limit, has exact totals for that limit.
The running sums go over blocks of ``BLOCK`` lengths: one window over the blocks' totals
and one within each block, so no task holds the whole histogram.

Defined results. A null or empty text has length 0 (plus end tokens, if any). Repeated
rows count each time. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.lean import lean
from scriptorium.llm.tokens import encoder
from scriptorium.plans.workspace import Workspace

#: Lengths in a block of the running sums.
BLOCK = 1024


def token_lengths(docs: DataFrame, vocabulary: str, text_col: str = "text", end_tokens: int = 0) -> DataFrame:
    """One row per document: n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = encoder(vocabulary).each
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(x) // 4 + end_tokens for x in each(t.as_py() for t in batch.column(0))], pa.int64())], ["n_tokens"])

    return docs.select(text_col).mapInArrow(lean(count), "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of the lengths that occur."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(spark: SparkSession, histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit:

    n_tokens; n_docs of that length; docs_over and tokens_over of all longer documents;
    docs_within; tokens_within of documents no longer; tokens_truncated, the total
    when every document is cut to the limit; quantile, the share of documents no longer.
    """
    ws = Workspace(spark, "lengths")
    h = ws.save(histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_all"), F.floor(F.col("n_tokens") / BLOCK).cast("long").alias("block")), "histogram")
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_all").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_later"), F.sum("d").over(all_).alias("d_all"), F.sum("t").over(all_).alias("t_all"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    own = h.select("*", F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("d_own"), F.coalesce(F.sum("n_all").over(longer), F.lit(0)).alias("t_own"))
    x = own.join(blocks, "block").select("n_tokens", "n_docs", (F.col("d_own") + F.col("d_later")).alias("docs_over"), (F.col("t_own") + F.col("t_later")).alias("tokens_over"), "d_all", "t_all")
    within = F.col("t_all") - F.col("tokens_over")
    return x.select("n_tokens", "n_docs", "docs_over", "tokens_over", (F.col("d_all") - F.col("docs_over")).alias("docs_within"), within.alias("tokens_within"), (within + F.col("docs_over") * F.col("n_tokens")).alias("tokens_truncated"), ((F.col("d_all") - F.col("docs_over")) / F.col("d_all")).alias("quantile"))


def totals_at(answers: DataFrame, limit: int) -> DataFrame:
    """One row for any limit, whether a document has that length or not: docs_over, tokens_over, tokens_truncated."""
    below = F.col("n_tokens") <= limit
    return (
        answers.agg(
            F.sum(F.when(~below, F.col("n_docs"))).alias("over"),
            F.sum(F.when(~below, F.col("n_docs") * F.col("n_tokens"))).alias("t_over"),
            F.sum(F.when(below, F.col("n_docs") * F.col("n_tokens"))).alias("t_within"),
        )
        .select(F.coalesce("over", F.lit(0)).alias("docs_over"), F.coalesce("t_over", F.lit(0)).alias("tokens_over"), (F.coalesce("t_within", F.lit(0)) + F.coalesce("over", F.lit(0)) * limit).alias("tokens_truncated"))
    )


def quantile_length(answers: DataFrame, share: float) -> DataFrame:
    """One row: the least length that at least ``share`` of all documents do not exceed."""
    return answers.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
