"""Ranked keywords of documents: single tokens, and phrases for papers, books and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import lexicons as lx, scoring as sc, text as tx

MOST = 12


def clean_pages(pages: DataFrame, most_pages: int, most_penalty2: int = 20, book: bool = False) -> DataFrame:
    """The first pages that are no front matter or boilerplate."""
    x = pages.where(F.col("page_no") <= most_pages)
    return x.where(sc.noise_penalty2(F.col("preview"), F.col("text"), F.col("page_no"), F.lit(book)) < most_penalty2)


def generic(titles: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, keyword, weight, rank): tokens of title (5), author (2) and the first 3000 characters of the first 20 clean pages (1); ties in order of appearance."""
    fields = titles.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.lit(5).alias("w"), F.col("title").alias("t")), F.struct(F.lit(1).alias("seq"), F.lit(2).alias("w"), F.col("author").alias("t")))).alias("f"))
    fields = fields.select("doc_id", "f.seq", "f.w", F.col("f.t").alias("t")).where("t is not null")
    body = clean_pages(pages, 20).select("doc_id", (F.col("page_no") + 2).alias("seq"), F.lit(1).alias("w"), F.substring("text", 1, 3000).alias("t"))
    events = fields.union(body).select("doc_id", "seq", "w", F.posexplode(tx.keyword_tokens(F.col("t"))).alias("pos", "keyword"))
    counted = events.groupBy("doc_id", "keyword").agg(F.sum("w").alias("weight"), F.min(F.struct("seq", "pos")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "keyword", "weight", "rank")


def topic_terms(pages: DataFrame, book: bool = False) -> DataFrame:
    """(doc_id, terms): informative tokens, repeats included, of the first 2000 characters of each clean page with at least 120."""
    body = clean_pages(pages, 80 if book else 20, book=book).select("doc_id", tx.compact(F.col("text")).alias("t")).where(F.length("t") >= 120)
    return body.select("doc_id", tx.informative_tokens(F.substring("t", 1, 2000)).alias("terms"))


def topic_profile(titles: DataFrame, pages: DataFrame, book: bool = False) -> DataFrame:
    """(doc_id, token, weight): informative tokens of title (8) and of the first 2000 characters of clean pages with at least 120."""
    head = titles.where("title is not null").select("doc_id", F.lit(8).alias("w"), tx.informative_tokens(F.col("title")).alias("terms"))
    body = topic_terms(pages, book).select("doc_id", F.lit(1).alias("w"), "terms")
    events = head.union(body).select("doc_id", "w", F.explode("terms").alias("token"))
    return events.groupBy("doc_id", "token").agg(F.sum("w").alias("weight"))


def phrase_events(texts: DataFrame, keys: list[str], weight2: int, book: bool = False) -> DataFrame:
    """(keys, phrase, w2): each valid phrase of 2 to 4 tokens of a text once, with twice its weight and score. texts has keys, t, title (tokens)."""
    x = texts.select(*keys, "title", F.explode(tx.keyword_phrases(tx.phrase_tokens(F.col("t")), F.col("title"))).alias("phrase"))
    score = tx.let(F.split("phrase", " "), lambda g: tx.phrase_score2(g, F.col("title"), book))
    return x.select(*keys, "phrase", (F.lit(weight2) + score).alias("w2"))


def ranked(events: DataFrame, keys: list[str], most: int, normalise: bool = True, skip: bool = False) -> DataFrame:
    """(keys, phrase, rank): phrases by weight, then words, then alphabet; one per signature, of four words at most, no weak single word."""
    sums = events.groupBy(*keys, "phrase").agg(F.sum("w2").alias("w2"))
    n_words = lambda p: F.size(F.split(p, " "))

    def ok(p: Column) -> Column:
        good = (n_words(p) <= 4) & ~((n_words(p) == 1) & p.isin(*lx.SUMMARY_GENERIC, *lx.WEAK_KEYWORDS))
        return good & ~p.isin(*lx.SKIPPED_KEYWORDS) if skip else good

    # exploded, so that a phrase is normalised once and not again in each condition
    normal = tx.normal_phrase(F.col("raw")) if normalise else F.col("raw")
    x = sums.withColumnRenamed("phrase", "raw").select(*keys, "w2", "raw", F.explode(F.filter(F.array(normal), ok)).alias("phrase"))
    order = [F.desc("w2"), F.desc(n_words(F.col("raw"))), F.col("raw")]
    x = x.withColumn("sig", tx.plural_signature(F.col("phrase")))
    x = x.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "sig").orderBy(*order))).where("nth = 1")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most).select(*keys, "phrase", "rank")


def _with_title(df: DataFrame, text: Column) -> DataFrame:
    return df.select("doc_id", text.alias("t"), F.array_distinct(tx.phrase_tokens(F.coalesce("title", F.lit("")))).alias("title"))


def explicit_list(pages: DataFrame) -> DataFrame:
    """(doc_id, phrases): what stands after ``keywords:`` on one of the first two pages."""
    low = F.lower(tx.compact(F.col("text")))
    x = pages.where("page_no <= 2").withColumn("low", low).where(F.col("low").contains("keywords:"))
    after = F.substring_index(F.get(F.split("low", "keywords:"), F.lit(1)), "abstract", 1)
    parts = F.filter(F.transform(F.split(after, "[,;]"), lambda k: F.btrim(k)), lambda k: (k != "") & (F.length(k) < 50))
    return x.groupBy("doc_id").agg(F.min_by(parts, F.col("page_no")).alias("phrases"))


def paper(titles: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, phrase, rank): the paper's own list if it has one, else phrases of the title (10) and the first page (5)."""
    listed = explicit_list(pages)
    head = _with_title(titles.where("title is not null"), F.col("title"))
    first = _with_title(pages.where("page_no = 1").select("doc_id", "text").join(titles.select("doc_id", "title"), "doc_id"), tx.compact(F.col("text")))
    events = phrase_events(head, ["doc_id"], 20).union(phrase_events(first, ["doc_id"], 10))
    found = ranked(events.join(listed, "doc_id", "left_anti"), ["doc_id"], most)
    own = listed.select("doc_id", F.posexplode("phrases").alias("i", "phrase")).select("doc_id", "phrase", (F.col("i") + 1).alias("rank"))
    return found.union(own)


def chapter(chapters: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, chapter_number, phrase, rank): phrases of a chapter's pages (0.2, counted as 1/5) and title (5). pages has chapter_number and body."""
    keys = ["doc_id", "chapter_number"]
    body = pages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_no", "body"))).alias("b")).select(*keys, F.array_join("b.body", " ").alias("t"))
    title = F.array_distinct(tx.phrase_tokens(F.coalesce("title", F.lit(""))))
    text = body.join(chapters.select(*keys, "title"), keys).select(*keys, "t", title.alias("title"))
    head = chapters.where("title is not null").select(*keys, F.col("title").alias("t"), title.alias("title"))
    # tenths of a weight: 0.2 for the text and 5.0 for the title, and scores in halves
    scale = lambda e, tenths: e.withColumn("w2", F.col("w2") * 5 + tenths)
    events = scale(phrase_events(text, keys, 0, True), 2).union(scale(phrase_events(head, keys, 0, True), 50))
    return ranked(events, keys, most, normalise=False, skip=True)


def _book_heads(preview: Column, page_no: Column, terms: Column) -> Column:
    """(once, phrase, w2) of what a page's preview says, the preview read once. once: 1 for shown and 2 for named phrases, else 0."""
    priority = lambda p: p.isin(*lx.PRIORITY_KEYWORDS)
    event = lambda once, p, w: F.struct(F.lit(once).alias("once"), p.alias("phrase"), w.cast("int").alias("w2"))
    one = lambda cond, e: F.filter(F.array(e), lambda _: cond)

    def of(clean: Column, head: Column, p: Column) -> Column:
        domain = tx.count_where(p, lambda w: w.isin(*lx.DOMAIN_TOKENS))
        generic_ = tx.count_where(p, lambda w: w.isin(*lx.PHRASE_GENERIC))
        sized, titled = F.size(p).between(2, 6), F.arrays_overlap(p, terms)
        weight = F.when(titled, 20).otherwise(0) + F.when(domain >= 2, 16).otherwise(0)
        shown = F.array_join(p, " ")
        said = F.transform(tx.explicit_phrases(clean), tx.normal_phrase)
        parts = F.concat(
            one(sized & ((domain > 0) | titled), event(1, shown, F.when(priority(shown), 40).otherwise(24))),
            one(sized & (page_no <= 140) & ~head.isin(*lx.SKIPPED_KEYWORDS) & (generic_ < F.size(p) - 1) & (weight > 0), event(0, head, weight)),
            tx.let(said, lambda n: F.concat(F.transform(n, lambda q: event(2, q, F.lit(32))), F.transform(F.filter(n, priority), lambda q: event(0, q, F.lit(20))))),
        )
        return F.when((clean != "") & ~sc.preview_is_noisy(clean), parts)

    return tx.let(tx.clean_preview(preview), lambda clean: tx.let(tx.normal_phrase(clean), lambda head: tx.let(tx.phrase_tokens(head), lambda p: of(clean, head, p))))


def book(titles: DataFrame, pages: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, phrase, rank) from a book's title, previews, headings and explicit phrases."""
    t = titles.select("doc_id", "title", F.array_distinct(tx.phrase_tokens(F.coalesce("title", F.lit("")))).alias("terms"))
    priority = lambda p: p.isin(*lx.PRIORITY_KEYWORDS)
    event = lambda df, p, w: df.select("doc_id", p.alias("phrase"), w.alias("w2"))
    whole = tx.normal_phrase(F.col("title"))
    events = [event(t.where(F.size(F.split(whole, " ")) >= 2), whole, F.lit(20))]
    said = t.select("doc_id", F.explode(F.transform(tx.explicit_phrases(F.col("title")), tx.normal_phrase)).alias("p"))
    events.append(event(said, F.col("p"), F.lit(28)))

    x = pages.join(t.select("doc_id", "terms"), "doc_id")
    x = x.select("doc_id", F.explode(_book_heads(F.col("preview"), F.col("page_no"), F.col("terms"))).alias("e")).select("doc_id", "e.*")
    # shown and named phrases count once for each book
    x = x.groupBy("doc_id", "once", "phrase").agg(F.sum("w2").alias("sum"), F.max("w2").alias("one"))
    events.append(event(x, F.col("phrase"), F.when(F.col("once") > 0, F.col("one")).otherwise(F.col("sum"))))

    body, low = tx.compact(F.col("text")), F.lower(tx.compact(F.col("preview")))
    front = (low == "preface") | low.startswith("contents") | low.contains("plan of this book")
    y = pages.where(F.col("page_no") <= 80).select("doc_id", body.alias("t"), front.alias("front"), sc.noise_penalty2(F.col("preview"), F.col("text"), F.col("page_no"), F.lit(True)).alias("noise")).where("length(t) >= 120 and (front or noise < 16)")
    cut = F.when(F.col("front"), F.substring("t", 1, 5000)).otherwise(F.substring("t", 1, 1800))
    y = y.select("doc_id", "front", F.explode(F.transform(tx.explicit_phrases(cut), tx.normal_phrase)).alias("p"))
    weight = F.when(F.col("front"), F.when(priority(F.col("p")), 40).otherwise(20)).otherwise(F.when(priority(F.col("p")), 20).otherwise(8))
    events.append(event(y, F.col("p"), weight))
    out = events[0]
    for e in events[1:]:
        out = out.union(e.withColumn("w2", F.col("w2").cast("long")))
    return ranked(out, ["doc_id"], most, skip=True)
