"""Near-duplicate resolution: shingle similarity with three tiers, clusters, canonical documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import identity as idf, lexicons as lx, scoring as sc, text as tx
from scriptorium.plans.components import connected_components
from scriptorium.plans.workspace import Workspace

SHINGLE, WINDOW = 5, 5000
HIGH, LOW, ALIGNED = 0.90, 0.82, 0.75


def sampled(text: Column, window: int = WINDOW) -> Column:
    """The compacted text, of a long one its first, middle and last window."""
    t = tx.compact(text)
    n = F.length(t)
    at = lambda start: F.substring(t, start + 1, F.lit(window))
    three = F.concat_ws("\n", at(F.lit(0)), at(F.floor(n / 2).cast("int") - window // 2), at(n - window))
    return F.when(n <= 3 * window, t).otherwise(three)


def shingles(text: Column, size: int = SHINGLE, window: int = WINDOW) -> Column:
    """Distinct runs of tokens of the sampled text; of a short text shorter ones, of fewer than three tokens the tokens."""

    def runs(t: Column) -> Column:
        n = F.size(t)
        k = F.least(F.lit(size), F.greatest(F.lit(3), n))
        return F.when(n < 3, t).otherwise(F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(t, i + 1, k), " ")))

    return F.array_distinct(tx.let(tx.phrase_tokens(sampled(text, window)), runs))


def eligible(catalog: DataFrame) -> DataFrame:
    kind = F.coalesce(F.col("relationship.kind"), F.lit(""))
    return catalog.where((F.col("source_class") != "duplicate") & ~kind.isin(*lx.SEPARATE_RELATIONSHIPS))


def similar_pairs(sets: DataFrame, least: float = ALIGNED) -> DataFrame:
    """(a, b, inter, n_a, n_b) of all pairs of rows (id, shingles: distinct hashes) whose Jaccard similarity is at least ``least``; a < b.

    Prefix filter: with the hashes in order of rarity, two sets that similar share one
    among the first n - ceil(least n) + 1 of each; frequent shingles so seldom make
    candidates. Each candidate is verified on the whole sets.
    """
    x = sets.where(F.size("shingles") > 0)
    flat = x.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("f")).where("f > 1")
    # a shingle of one document alone makes no candidate, but takes a place in its prefix
    ranked = flat.join(often, "s", "left").select("id", "n", F.struct(F.coalesce("f", F.lit(1)).alias("f"), "s").alias("r"))
    first = ranked.groupBy("id", "n").agg(F.array_sort(F.collect_list("r")).alias("r"))
    length = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    prefix = first.select("id", "n", F.explode(F.filter(F.slice("r", F.lit(1), length), lambda r: r["f"] > 1)).alias("r")).select("id", "n", F.col("r.s").alias("s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    close = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * least)
    candidates = a.join(b, (F.col("a.s") == F.col("b.s")) & close).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    one, two = (x.select(F.col("id").alias(i), F.col("shingles").alias(s)) for i, s in (("a", "sa"), ("b", "sb")))
    pairs = candidates.join(one, "a").join(two, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("inter"), F.size("sa").alias("n_a"), F.size("sb").alias("n_b"))
    return pairs.where(F.col("inter") >= (F.col("n_a") + F.col("n_b") - F.col("inter")) * least - 1e-9)


def matches(catalog: DataFrame, ws: Workspace, high: float = HIGH, low: float = LOW, size: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """(a, b, inter, total, reason) of the pairs of eligible documents that a tier accepts; total is the size of the union."""
    docs = eligible(catalog)
    sets = ws.save(docs.select(F.col("doc_id").alias("id"), F.transform(shingles(F.col("text"), size, window), lambda s: F.xxhash64(s)).alias("shingles")), "shingles")
    title = F.array_distinct(tx.phrase_tokens(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string"))))
    about = docs.select("doc_id", title.alias("title"), F.array_distinct(tx.phrase_tokens(F.coalesce("author", F.lit("")))).alias("author"), "page_count", "source_class")
    sides = [about.select(*(F.col(c).alias(f"{c}_{s}") for c in about.columns)) for s in "ab"]
    x = similar_pairs(sets, min(ALIGNED, low)).join(sides[0], F.col("a") == F.col("doc_id_a")).join(sides[1], F.col("b") == F.col("doc_id_b"))
    total = F.col("n_a") + F.col("n_b") - F.col("inter")
    sim = F.col("inter") / total
    titles, authors = sc.jaccard(F.col("title_a"), F.col("title_b")), sc.jaccard(F.col("author_a"), F.col("author_b"))
    pages = sc.page_counts_close(F.col("page_count_a"), F.col("page_count_b"))
    alike = (titles >= 0.5) | (authors >= 0.5) | F.col("source_class_a").eqNullSafe(F.col("source_class_b"))
    reason = F.when(pages & (sim >= high), "very_high_text_similarity").when(pages & (sim >= low) & alike, "high_text_similarity").when(pages & (sim >= ALIGNED) & (titles >= 0.8), "title_and_text_alignment")
    return x.select("a", "b", "inter", total.alias("total"), reason.alias("reason")).where("reason is not null")


def resolution(catalog: DataFrame, pairs: DataFrame, ws: Workspace) -> DataFrame:
    """(doc_id, canonical_doc_id, status, similarity, reason) of every document.

    A cluster's canonical document has the least copy rank. A member's similarity is
    that of its pair with the canonical one, else of its best pair (ties: the least other id).
    """
    parts = ws.save(connected_components(pairs, ws, "a", "b"), "clusters")
    rank = idf.copy_rank(F.col("filename"), F.col("year"), lx.COPY_WORDS_NEAR, F.col("title"), F.col("author"))
    member = parts.join(catalog, parts["node"] == catalog["doc_id"]).select("doc_id", "component", rank.alias("rank"))
    best = member.groupBy("component").agg(F.min(F.struct("rank", F.col("doc_id").alias("id"))).alias("m")).select("component", F.col("m.id").alias("near"))
    member = member.join(best, "component").select("doc_id", "near")
    both = pairs.select("a", "b", "inter", "total", "reason").union(pairs.select("b", "a", "inter", "total", "reason")).toDF("doc_id", "other", "inter", "total", "reason")
    own = both.join(member, "doc_id").where("doc_id <> near")
    key = F.struct((F.col("other") != F.col("near")).alias("indirect"), (-F.col("inter") / F.col("total")).alias("s"), F.col("other").alias("o"))
    detail = own.groupBy("doc_id", "near").agg(F.min_by(F.struct("inter", "total", "reason"), key).alias("d"))
    detail = detail.select(F.col("doc_id").alias("id"), "near", F.col("d.inter").alias("i"), F.col("d.total").alias("t"), F.col("d.reason").alias("reason"))
    x = catalog.select("doc_id", "canonical_doc_id", "relationship").join(detail, F.col("doc_id") == F.col("id"), "left")
    exact = F.coalesce(F.col("relationship.kind"), F.lit("")) == "exact_duplicate_of"
    status = F.when(F.col("near").isNotNull(), "near_duplicate").when(exact, "exact_duplicate").otherwise("canonical")
    return x.select("doc_id", F.coalesce("near", "canonical_doc_id").alias("canonical_doc_id"), status.alias("status"), F.floor(F.col("i") * 10000 / F.col("t") + 0.5).cast("int").alias("similarity_1e4"), "reason")


def overlay(catalog: DataFrame, resolved: DataFrame) -> DataFrame:
    """``catalog`` with the resolution's canonical id, and similarity, dedupe_kind and is_redundant.

    Columns of the catalog that have the name of one of the resolution's, as a status, stay as they are.
    """
    r = resolved.select(F.col("doc_id").alias("_id"), F.col("canonical_doc_id").alias("_canonical"), F.col("status").alias("_status"), F.col("similarity_1e4").alias("_similarity"))
    x = catalog.drop("similarity_1e4").join(r, F.col("doc_id") == F.col("_id"), "left").withColumnRenamed("_similarity", "similarity_1e4")
    kind = F.when(F.col("_status") == "near_duplicate", "near_duplicate_of").otherwise(F.col("relationship.kind"))
    canonical = F.coalesce("_canonical", "canonical_doc_id")
    x = x.withColumns({"canonical_doc_id": canonical, "dedupe_kind": kind})
    redundant = F.coalesce(F.col("dedupe_kind").isin("exact_duplicate_of", "near_duplicate_of"), F.lit(False)) & (F.col("canonical_doc_id") != F.col("doc_id"))
    return x.withColumn("is_redundant", redundant).drop("_id", "_canonical", "_status")
