"""Concepts: phrases that several documents share, with their sources and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import scoring as sc, text as tx
from scriptorium.plans.workspace import Workspace

LEAST_SUPPORT, MOST_SUPPORT = 2, 24
#: Candidates that the walk of selected() takes at a time.
MOST_BLOCK = 8192


def phrase_events(index: DataFrame) -> DataFrame:
    """(doc_id, phrase, w): keywords of two words or more (5), and runs of 2 or 3 tokens of a title (4 and the length) that can name a concept."""
    x = index.where("source_class <> 'duplicate' and not coalesce(is_redundant, false)")
    words = x.select("doc_id", F.explode("keywords").alias("k")).where(F.size(F.split("k", r"\s+")) >= 2).select("doc_id", F.lower("k").alias("phrase"), F.lit(5).alias("w"))
    t = x.where(~tx.has_concept_noise(F.col("title"))).select("doc_id", tx.query_terms(F.col("title")).alias("t"))
    grams = F.flatten(F.array(*(F.filter(tx.ngrams(F.col("t"), n), tx.concept_phrase) for n in (2, 3))))
    titles = t.select("doc_id", F.explode(grams).alias("g")).select("doc_id", F.array_join("g", " ").alias("phrase"), (F.size("g") + 4).alias("w"))
    return words.union(titles)


def candidates(events: DataFrame) -> DataFrame:
    """(phrase, support, score2): phrases of 2 to 24 documents, with twice their score.

    The supporting documents are counted before they are collected, so a phrase of very
    many documents is never gathered.
    """
    x = events.groupBy("phrase", "doc_id").agg(F.sum("w").alias("w")).groupBy("phrase").agg(F.count("*").alias("support"), F.sum("w").alias("w"))
    x = x.where(F.col("support").between(LEAST_SUPPORT, MOST_SUPPORT) & (F.size(F.split("phrase", " ")) >= 2))
    return x.select("phrase", "support", (2 * F.col("w") + 8 * F.col("support") + 3 * F.size(F.split("phrase", " "))).cast("long").alias("score2"))


def _scores2(phrases: Column, words: Column, text: Column) -> Column:
    """Twice the scores of a text for each of ``phrases`` (terms, low), as scoring.score2_by has them. words: the distinct terms.

    The text is cut into tokens once, and each word is counted once, however many phrases have it.
    """

    def of(found: Column, low: Column) -> Column:
        present = F.array_intersect(words, found)
        # counted without a lambda over the tokens
        counts = F.map_from_arrays(present, F.transform(present, lambda w: F.size(found) - F.size(F.array_remove(found, w))))

        def each(counts: Column) -> Column:
            add = lambda total, t: total + F.coalesce(sc.occurrences(F.try_element_at(counts, t)), F.lit(0))
            score = lambda p: F.aggregate(p["terms"], F.lit(0), add) + F.when(low.contains(p["low"]), 6).otherwise(0)
            return F.transform(phrases, lambda p: F.when((F.size(p["terms"]) > 0) & (F.size(found) > 0), score(p)).otherwise(0))

        return tx.let(counts, each)

    return tx.let(tx.tokens(text), lambda found: tx.let(F.lower(text), lambda low: of(found, low)))


def supporting(events: DataFrame, found: DataFrame, index: DataFrame, pages: DataFrame, most: int = 6) -> DataFrame:
    """(phrase, doc_id, score2, rank): the best documents of each candidate phrase, with their two best pages.

    A document's phrases come to its fields and pages as one array, so a text is read once and not for each phrase.
    """
    pairs = events.select("phrase", "doc_id").distinct().join(found.select("phrase"), "phrase", "left_semi")
    p = F.struct("phrase", tx.query_terms(F.col("phrase")).alias("terms"), tx.compact(F.lower("phrase")).alias("low"))
    by_doc = pairs.groupBy("doc_id").agg(F.collect_list(p).alias("ps"))
    by_doc = by_doc.withColumn("words", F.array_distinct(F.flatten("ps.terms")))
    s = lambda c: _scores2(F.col("ps"), F.col("words"), F.coalesce(c, F.lit("")))
    # a row for each phrase of which anything says something
    split = lambda scores: F.explode(F.filter(F.arrays_zip(F.col("ps.phrase").alias("phrase"), scores.alias("s")), lambda z: z["s"] > 0)).alias("z")
    total = F.zip_with(
        F.zip_with(s(F.col("title")), s(F.array_join("keywords", " ")), lambda a, b: 5 * a + 3 * b),
        F.zip_with(s(F.col("summary")), s(F.col("search_text")), lambda a, b: 2 * a + b), lambda a, b: a + b,
    )
    fields = by_doc.join(index.select("doc_id", "title", "keywords", "summary", "search_text"), "doc_id")
    fields = fields.select("doc_id", split(total)).select("z.phrase", "doc_id", F.col("z.s").alias("f"))
    page = by_doc.join(pages.select("doc_id", "page_no", "preview", "text"), "doc_id")
    less = F.transform(s(F.col("text")), lambda n: n - F.col("penalty"))
    page = page.withColumn("penalty", sc.signal_penalty2(F.col("preview"))).select("doc_id", "page_no", split(less)).select("z.phrase", "doc_id", "page_no", "z.s")
    page = page.withColumn("nth", F.row_number().over(Window.partitionBy("phrase", "doc_id").orderBy(F.desc("s"), "page_no"))).where("nth <= 2").groupBy("phrase", "doc_id").agg(F.sum("s").alias("s"))
    x = fields.join(page, ["phrase", "doc_id"], "left").select("phrase", "doc_id", (F.col("f") + F.coalesce("s", F.lit(0))).cast("long").alias("score2"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("score2"), "doc_id"))).where(F.col("rank") <= most)


def _subsumed(sig: tuple, docs: set, chosen: list[tuple[tuple, set]]) -> bool:
    for other, theirs in chosen:
        if sig == other:
            return True
        short, long = sorted((sig, other), key=len)
        if any(long[i : i + len(short)] == short for i in range(len(long) - len(short) + 1)):
            least = min(len(docs), len(theirs))
            if least >= 2 and 5 * len(docs & theirs) >= 4 * least:
                return True
    return False


def selected(spark: SparkSession, events: DataFrame, index: DataFrame, pages: DataFrame, most: int = 90, most_sources: int = 6, step: int = 512) -> DataFrame:
    """(concept_id, phrase, title, keywords, source_count, score2, supporting_doc_ids): candidates in order of score that no chosen one subsumes.

    The choice is a walk in order. The candidates come to the driver in that order, a block
    at a time (``step``, then four times as many, MOST_BLOCK at most), until ``most`` are chosen or
    none is left; each has 24 documents at most. Sources are looked for where the walk gets to:
    a block's documents alone are read, and only for candidates that are not subsumed yet.
    """
    ws = Workspace(spark, "concepts")
    p = F.col("phrase")
    found = candidates(events).withColumns({"sig": tx.signature(p), "concept_id": tx.slug(p), "title": tx.titled(p), "n": F.size(F.split(p, " "))})
    left = found = ws.save(found.where("concept_id <> ''"), "candidates")
    chosen: list[tuple[tuple, set]] = []
    rows = []
    while len(rows) < most:
        block = ws.save(left.orderBy(F.desc("score2"), F.desc("n"), "phrase").limit(step), "block")
        own = ws.save(events.join(F.broadcast(block.select("phrase")), "phrase", "left_semi").select("phrase", "doc_id").distinct(), "pairs")
        block_rows = block.join(own.groupBy("phrase").agg(F.collect_set("doc_id").alias("docs")), "phrase").orderBy(F.desc("score2"), F.desc("n"), "phrase").collect()
        if not block_rows:
            break
        open_ = [r for r in block_rows if not _subsumed(tuple(r["sig"]), set(r["docs"]), chosen)]
        if open_:
            wanted = spark.createDataFrame([(r["phrase"],) for r in open_], "phrase string")
            pairs = ws.save(own.join(F.broadcast(wanted), "phrase", "left_semi"), "open")
            ids = F.broadcast(pairs.select("doc_id").distinct())
            top = supporting(pairs, wanted, index.join(ids, "doc_id", "left_semi"), pages.join(ids, "doc_id", "left_semi"), most_sources)
            top = top.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("t")).where(F.size("t") >= 2)
            sources = {r["phrase"]: r["ids"] for r in top.select("phrase", F.col("t.doc_id").alias("ids")).collect()}
            for r in open_:
                ids_ = sources.get(r["phrase"])
                if len(rows) >= most:
                    break
                if ids_ is None or _subsumed(tuple(r["sig"]), set(r["docs"]), chosen):
                    continue
                chosen.append((tuple(r["sig"]), set(ids_)))
                rows.append((r["concept_id"], r["phrase"], r["title"], list(dict.fromkeys(r["phrase"].split()))[:12], r["support"], r["score2"], ids_))
        if len(block_rows) < step:
            break
        last, step = block_rows[-1], min(4 * step, MOST_BLOCK)
        score2, n = F.lit(last["score2"]), F.lit(last["n"])
        left = found.where((F.col("score2") < score2) | ((F.col("score2") == score2) & ((F.col("n") < n) | ((F.col("n") == n) & (p > F.lit(last["phrase"]))))))
    kind = dict(index.dtypes)["doc_id"]
    return spark.createDataFrame(rows, f"concept_id string, phrase string, title string, keywords array<string>, source_count long, score2 long, supporting_doc_ids array<{kind}>")


def related(concepts: DataFrame, most: int = 6) -> DataFrame:
    """(concept_id, other, overlap, rank): concepts that share two supporting documents or more."""
    x = concepts.select("concept_id", "title", F.explode("supporting_doc_ids").alias("doc"))
    a, b = x.alias("a"), x.alias("b")
    pairs = a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.concept_id") != F.col("b.concept_id")))
    n = pairs.groupBy(F.col("a.concept_id").alias("concept_id"), F.col("b.concept_id").alias("other"), F.col("b.title").alias("title")).agg(F.count("*").alias("overlap")).where("overlap >= 2")
    rank = F.row_number().over(Window.partitionBy("concept_id").orderBy(F.desc("overlap"), "title", "other"))
    return n.withColumn("rank", rank).where(F.col("rank") <= most).select("concept_id", "other", "overlap", "rank")


def described(concepts: DataFrame) -> DataFrame:
    """``concepts`` with wiki_link, summary and search_text."""
    links = F.array_join(F.transform(F.slice("supporting_doc_ids", 1, 4), lambda d: F.concat(F.lit("[[source/"), d.cast("string"), F.lit("]]"))), ", ")
    summary = F.concat(F.lit("This concept aggregates sources related to "), F.lower("title"), F.lit(". Key supporting materials include "), links, F.lit("."))
    x = concepts.withColumns({"wiki_link": F.concat(F.lit("[[concepts/"), F.col("concept_id"), F.lit("]]")), "summary": summary})
    return x.withColumn("search_text", tx.compact(F.concat_ws("\n", "title", F.array_join("keywords", " "), "summary")))


def with_related(concepts: DataFrame) -> DataFrame:
    """``concepts`` with related: links to the concepts that share sources, best first."""
    r = related(concepts).groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("[[concepts/"), F.col("other"), F.lit("]]")).alias("l")))).alias("r"))
    x = concepts.join(r, "concept_id", "left")
    return x.withColumn("related", F.coalesce("r.l", F.array().cast("array<string>"))).drop("r")
