"""Two-stage search: fields and concepts are scored, a shortlist is ranked again with pages and chapters.

Scores are whole numbers of hundredths where they are kept, and of halves, twentieths or
hundredths inside, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import scoring as sc

#: Weights by field, doubled.
DOCUMENT = {"title": 4, "keywords": 3, "summary": 2, "search_text": 1}


def top_documents(documents: DataFrame, query: str, terms: list[str], most: int = 10, text_col: str = "text") -> DataFrame:
    """(doc_id, score2): the best texts for a query; the flagship scan, one pass and a bounded sort."""
    x = documents.select("doc_id", sc.score2(query, F.col(text_col), terms).alias("score2")).where("score2 > 0")
    return x.orderBy(F.desc("score2"), "doc_id").limit(most)


def page_matches(pages: DataFrame, query: str, terms: list[str], most: int = 3, penalty: bool = True) -> DataFrame:
    """(doc_id, page_no, score2, rank): the best pages of each document."""
    score = sc.score2(query, F.col("text"), terms)
    score = score - sc.signal_penalty2(F.col("preview")) if penalty else score
    x = pages.select("doc_id", "page_no", score.alias("score2")).where("score2 > 0")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score2"), "page_no"))).where(F.col("rank") <= most)


def chapter_matches(chapters: DataFrame, query: str, terms: list[str], most: int = 3) -> DataFrame:
    """(doc_id, chapter_number, score4, rank): the best chapters of each document, in quarters."""
    s = lambda c: sc.score2(query, F.coalesce(c, F.lit("")), terms)
    join = lambda c: F.array_join(c, " ")
    score = 8 * s(F.col("title")) + 6 * s(join("keywords")) + 4 * s(F.col("summary")) + 3 * s(join("section_previews"))
    x = chapters.select("doc_id", "chapter_number", score.alias("score4")).where("score4 > 0")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score4"), "chapter_number"))).where(F.col("rank") <= most)


def field_score2(query: str, terms: list[str], weights: dict[str, int] = DOCUMENT) -> Column:
    """Twice the weighted score of a row's fields."""
    total = F.lit(0)
    for field, w in weights.items():
        c = F.array_join(field, " ") if field == "keywords" else F.coalesce(field, F.lit(""))
        total = total + w * sc.score2(query, c, terms)
    return total


def document_scores(index: DataFrame, query: str, terms: list[str], chapters: DataFrame | None = None) -> DataFrame:
    """(doc_id, score100): fields, the two best chapters at 0.6, then factors for duplicates, rounded to hundredths."""
    x = index.select("doc_id", "source_class", "is_redundant", "dedupe_kind", (field_score2(query, terms) * 50).alias("s"))
    if chapters is not None:
        bonus = chapter_matches(chapters, query, terms, 2).groupBy("doc_id").agg((F.sum("score4") * 15).alias("b"))
        x = x.join(bonus, "doc_id", "left").withColumn("s", F.col("s") + F.coalesce("b", F.lit(0)))
    factor = F.when(F.col("source_class") == "duplicate", F.lit(25)).otherwise(100) * F.when(F.coalesce("is_redundant", F.lit(False)), F.when(F.col("dedupe_kind") == "near_duplicate_of", 15).otherwise(5)).otherwise(100)
    x = x.where("s > 0").select("doc_id", "s", factor.alias("f"))
    return x.select("doc_id", F.expr("cast((s * f * 2 + 10000) div 20000 as bigint)").alias("score100")).where("score100 > 0")


def concept_scores(concepts: DataFrame, query: str, terms: list[str]) -> DataFrame:
    """(concept_id, score100): title 5, keywords 3, summary 2, text 1.5, and a quarter per source up to eight."""
    halves = field_score2(query, terms, {"title": 10, "keywords": 6, "summary": 4, "search_text": 3})
    score = halves * 25 + 25 * F.least(F.col("source_count"), F.lit(8))
    return concepts.select("concept_id", score.cast("long").alias("score100")).where("score100 > 0")


def two_stage(spark: SparkSession, query: str, index: DataFrame, pages: DataFrame, concepts: DataFrame | None = None, chapters: DataFrame | None = None, results: int = 5, top_pages: int = 3) -> DataFrame:
    """(kind, id, score100, rank): the shortlist of max(4 results, 16) by field scores, ranked again with the evidence of pages and chapters.

    Pages are read for the shortlist only: it is limited first and its size is fixed, so it is broadcast.
    Raises ValueError if no term of the query counts.
    """
    terms = sc.terms_of(spark, query)
    if not terms:
        raise ValueError("the query has no term to search for")
    found = document_scores(index, query, terms, chapters).select(F.lit(1).alias("kind_rank"), F.col("doc_id").cast("string").alias("id"), "score100")
    if concepts is not None:
        found = concept_scores(concepts, query, terms).select(F.lit(0).alias("kind_rank"), F.col("concept_id").alias("id"), "score100").union(found)
    short = found.orderBy(F.desc("score100"), "kind_rank", "id").limit(max(4 * results, 16))
    support = short.where("kind_rank = 1").select("kind_rank", "id", F.col("id").alias("doc"), F.lit(top_pages).alias("most"))
    if concepts is not None:
        sources = concepts.select(F.col("concept_id").alias("id"), F.explode(F.slice("supporting_doc_ids", 1, min(top_pages, 3))).alias("doc"))
        support = support.union(short.where("kind_rank = 0").join(sources, "id").select("kind_rank", "id", F.col("doc").cast("string"), F.lit(1)))
    matches = page_matches(pages.withColumn("doc_id", F.col("doc_id").cast("string")).join(F.broadcast(support.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi"), query, terms, top_pages)
    evidence = support.join(matches, F.col("doc") == F.col("doc_id")).where("rank <= most").groupBy("kind_rank", "id").agg((F.sum("score2") * 50).alias("e"))
    total = short.join(evidence, ["kind_rank", "id"], "left").withColumn("score100", F.col("score100") + F.coalesce("e", F.lit(0)))
    if chapters is not None:
        own = chapter_matches(chapters, query, terms, min(top_pages, 3)).groupBy(F.col("doc_id").cast("string").alias("id")).agg((F.sum("score4") * 25).alias("c")).withColumn("kind_rank", F.lit(1))
        total = total.join(own, ["kind_rank", "id"], "left").withColumn("score100", F.col("score100") + F.coalesce("c", F.lit(0)))
    order = [F.desc("score100"), F.col("kind_rank"), F.col("id")]
    # the shortlist has a fixed size: one window over it is bounded
    ranked = total.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= results)
    return ranked.select(F.when(F.col("kind_rank") == 0, "concept").otherwise("source").alias("kind"), "id", "score100", "rank")


def compare(index: DataFrame, doc_a: object, doc_b: object) -> DataFrame:
    """One row: shared keywords in the order of a (8) and distinctive ones of each (6)."""
    side = lambda d, n: index.where(F.col("doc_id") == d).select(F.col("doc_id").alias(f"doc_{n}"), F.col("keywords").alias(n))
    x = side(doc_a, "a").join(side(doc_b, "b"), F.lit(True))
    return x.select("doc_a", "doc_b", F.slice(F.array_intersect("a", "b"), 1, 8).alias("shared"), F.slice(F.array_except("a", "b"), 1, 6).alias("only_a"), F.slice(F.array_except("b", "a"), 1, 6).alias("only_b"))
