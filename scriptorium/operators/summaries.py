"""Extractive summaries: scored sentences, and a greedy choice of diverse ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import lexicons as lx, scoring as sc, text as tx
from scriptorium.operators import keywords as kw

NOTHING = "No summary available yet."


def _profiles(titles: DataFrame, pages: DataFrame, keys: list[str], book: bool = False) -> DataFrame:
    """(keys, title, title_terms, profile: the topic's tokens by levels of weight)."""
    head = titles.withColumn("doc_id", F.struct(*keys)) if keys != ["doc_id"] else titles
    body = pages.withColumn("doc_id", F.struct(*keys)) if keys != ["doc_id"] else pages
    # a row per page and not per token goes to its document
    p = kw.topic_terms(body, book).groupBy("doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms"))
    x = head.select("doc_id", "title", F.array_distinct(tx.informative_tokens(F.coalesce("title", F.lit("")))).alias("title_terms")).join(p, "doc_id", "left")
    x = x.select("doc_id", "title", "title_terms", sc.levels(F.col("title_terms"), F.coalesce("terms", F.array().cast("array<string>"))).alias("profile"))
    return x.select("doc_id.*", "title", "title_terms", "profile") if keys != ["doc_id"] else x


def _top_pages(x: DataFrame, keys: list[str], score: Column, most: int) -> DataFrame:
    scored = x.withColumn("page_score", score)
    return scored.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("page_score"), "page_no"))).where(F.col("nth") <= most)


def _strip_title(sentence: Column, title: Column) -> Column:
    starts = F.lower(sentence).startswith(F.concat(F.lower(title), F.lit(" ")))
    return F.when(F.coalesce(title, F.lit("")) == "", sentence).when(starts, tx.compact(F.substring(sentence, F.length(title) + 1, F.length(sentence)))).otherwise(sentence)


def diverse(scored: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, summary): sentences by (score, alphabet), without those that share half of their terms (5 at least) with the chosen ones.

    A fold over each document's sorted candidates; no shuffle beyond their grouping.
    """
    x = scored.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score20")).alias("s"), F.col("sentence"), F.col("terms")))).alias("c"))
    start = F.struct(F.array().cast("array<string>").alias("chosen"), F.array().cast("array<string>").alias("covered"))

    def step(acc: Column, c: Column) -> Column:
        shared = F.size(F.array_intersect(c["terms"], acc["covered"]))
        near = (F.size(acc["covered"]) > 0) & (shared >= F.greatest(F.lit(5), F.floor(F.size(c["terms"]) / 2).cast("int")))
        skip = near | (F.size(acc["chosen"]) >= most)
        return F.struct(F.when(skip, acc["chosen"]).otherwise(F.concat(acc["chosen"], F.array(c["sentence"]))).alias("chosen"), F.when(skip, acc["covered"]).otherwise(F.array_union(acc["covered"], c["terms"])).alias("covered"))

    return x.select(*keys, F.array_join(F.aggregate("c", start, step)["chosen"], " ").alias("summary"))


def _finish(titles: DataFrame, found: DataFrame, keys: list[str], default: str = NOTHING) -> DataFrame:
    x = titles.select(*keys, "title").join(found, keys, "left")
    return x.select(*keys, F.coalesce("summary", F.nullif("title", F.lit("")), F.lit(default)).alias("summary"))


def sentence_candidates(titles: DataFrame, pages: DataFrame, low: int = 60, high: int = 320) -> DataFrame:
    """(doc_id, page_no, sentence, terms, score20) from the eight best pages of each document."""
    about = _profiles(titles, pages, ["doc_id"])
    x = pages.select("doc_id", "page_no", "preview", "text").join(about, "doc_id")
    score = sc.page_score20(F.col("preview"), F.col("text"), F.col("page_no"), F.col("title_terms"), F.col("profile"))
    # pages are ranked without the profile, which the few that are left get again from the same shuffle
    top = _top_pages(x.select("doc_id", "page_no", "text", score.alias("_score")), ["doc_id"], F.col("_score"), 8)
    return _sentences(top.select("doc_id", "page_no", "text").join(about, "doc_id"), low, high)


def _sentences(x: DataFrame, low: int, high: int) -> DataFrame:
    """(doc_id, page_no, sentence, score20, terms): scored inside the page's row, so no sentence carries the profile."""
    title = F.col("title")
    found = F.filter(F.transform(tx.sentences(tx.compact(F.col("text"))), tx.compact), lambda s: F.length(s).between(low, high) & ~F.lower(s).eqNullSafe(F.lower(title)))

    def scored(s: Column) -> Column:
        of = lambda t, terms: F.struct(t.alias("sentence"), sc.scored20(t, terms, F.col("title_terms"), F.col("profile")).alias("score20"), terms.alias("terms"))
        return tx.let(_strip_title(s, title), lambda t: tx.let(F.array_distinct(tx.informative_tokens(t)), lambda terms: of(t, terms)))

    return x.select("doc_id", "page_no", F.explode(F.transform(found, scored)).alias("z")).select("doc_id", "page_no", "z.sentence", "z.score20", "z.terms")


def generic(titles: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, summary): up to four sentences of the eight best pages; else the title."""
    c = sentence_candidates(titles, pages).where("score20 > 0").select("doc_id", "sentence", "terms", "score20")
    return _finish(titles, diverse(c, ["doc_id"], most), ["doc_id"])


def paper(titles: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, summary): the first sentences of the abstract if one is marked on the first two pages, in their own case; else scored sentences of the first eight pages."""
    pattern = r"(?is)^(?:.*?)a\s*b\s*s\s*t\s*r\s*a\s*c\s*t[:.]?\s*(.*)$"
    marked = pages.where("page_no <= 2").withColumn("a", F.regexp_extract("text", pattern, 1)).where("a <> ''")
    marked = marked.groupBy("doc_id").agg(F.min_by("a", "page_no").alias("a"))
    cut = F.regexp_replace("a", r"(?is)(keywords|introduction).*$", "")
    abstract = marked.select("doc_id", F.array_join(F.slice(tx.sentences(tx.compact(cut)), 1, most), " ").alias("summary")).where("summary <> ''")
    x = pages.where("page_no <= 8").select("doc_id", "page_no", "text").join(_profiles(titles, pages, ["doc_id"]), "doc_id").join(abstract, "doc_id", "left_anti")
    s = _sentences(x, 60, 400)
    low = F.lower("sentence")
    bonus = F.when(tx.has_any(low, lx.PAPER_CUES), 100).otherwise(0) + F.when(low.contains("abstract"), 200).otherwise(0) + F.when(low.contains("introduction"), 40).otherwise(0)
    scored = s.withColumn("score20", F.col("score20") + bonus).where("score20 > 0").select("doc_id", "sentence", "terms", "score20")
    return _finish(titles, diverse(scored, ["doc_id"], most).unionByName(abstract), ["doc_id"])


def book(titles: DataFrame, pages: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, summary) from the preface (its first page and the next) or else overview pages."""
    x = pages.select("doc_id", "page_no", "preview", "text").join(_profiles(titles, pages, ["doc_id"], True), "doc_id")
    t = tx.compact(F.col("text"))
    x = x.withColumns({"t": t, "low": F.lower(t), "p": F.lower(tx.compact(F.col("preview")))})
    first = x.where((F.col("page_no") <= 24) & ((F.col("p") == "preface") | F.col("low").startswith("preface "))).groupBy("doc_id").agg(F.min("page_no").alias("preface"))
    x = x.join(first, "doc_id", "left")
    preface = x.where(F.col("page_no").between(F.col("preface"), F.col("preface") + 1) & (F.col("page_no") <= 24))

    terms = F.array_distinct(tx.informative_tokens(F.substring("t", 1, 2000)))
    known = sc.known(terms, F.col("profile"), 4)
    score = (
        -10 * sc.noise_penalty2(F.col("preview"), F.col("text"), F.col("page_no"), F.lit(True))
        + F.when((F.col("p") == "preface") | F.col("low").startswith("preface "), 400).otherwise(0)
        + F.when(F.col("p").contains("preface"), 160).otherwise(0)
        + F.when(F.col("p").startswith("1.1 introduction") | F.col("p").startswith("1. introduction"), 240).when(F.col("p").startswith("chapter 1"), 80).otherwise(0)
        + F.when(tx.has_any(F.substring("low", 1, 800), lx.BOOK_PAGE_CUES), 120).otherwise(0)
        + F.when(tx.has_any(F.substring("low", 1, 2000), lx.OVERVIEW_TERMS), 200).otherwise(0)
        + 50 * F.size(F.array_intersect("title_terms", terms)) + 4 * known
    )
    early = x.where("preface is null and page_no <= 60")
    overview = _top_pages(early.where("length(t) >= 160").withColumn("o", score).where("o > 0"), ["doc_id"], F.col("o"), 8)
    rest = early.join(overview.select("doc_id").distinct(), "doc_id", "left_anti")
    fallback = _top_pages(rest, ["doc_id"], sc.page_score20(F.col("preview"), F.col("text"), F.col("page_no"), F.col("title_terms"), F.col("profile"), True), 8)
    cols = ["doc_id", "title", "title_terms", "profile", "t"]
    pages_ = preface.select(*cols).union(overview.select(*cols)).union(fallback.select(*cols))

    s = pages_.select("doc_id", "title", "title_terms", "profile", F.explode(F.transform(tx.sentences(F.col("t")), tx.compact)).alias("sentence"))
    s = s.withColumn("sentence", F.when(F.lower("sentence").startswith("preface "), tx.compact(F.substring("sentence", 9, 1_000_000))).otherwise(F.col("sentence")))
    s = s.where(F.length("sentence").between(70, 320) & ~F.lower("sentence").eqNullSafe(F.lower("title"))).withColumn("sentence", _strip_title(F.col("sentence"), F.col("title")))
    s = s.where(~sc.structural_noise(F.col("sentence"))).withColumns({"low": F.lower("sentence"), "terms": F.array_distinct(tx.informative_tokens(F.col("sentence")))})
    low = F.col("low")
    any_of = lambda *f: tx.has_any(low, f)
    bonus = (
        F.when((F.coalesce("title", F.lit("")) != "") & low.contains(tx.compact(F.lower("title"))), 160).otherwise(0)
        - F.when(~tx.has_any(low, lx.SUMMARY_CUES + lx.OVERVIEW_TERMS), 100).otherwise(0)
        + F.when(any_of("we assume", "we have", "we describe"), 40).otherwise(0)
        + F.when(any_of("this book", "this textbook", "we wrote this book"), 120).otherwise(0)
        + F.when(any_of("we shall concentrate", "we shall discuss"), 80).otherwise(0)
        + F.when(any_of("the basic ideas", "emphasis on"), 80).otherwise(0)
        - F.when(low.contains("for example") & low.contains("ranging"), 40).otherwise(0)
        - F.when((F.size(F.array_intersect("title_terms", "terms")) < 1) & (F.size(F.array_intersect("terms", F.get("profile", F.lit(0)))) < 3), 120).otherwise(0)
    )
    scored = s.withColumn("score20", sc.sentence_score20(F.col("sentence"), F.col("title_terms"), F.col("profile"), True) + bonus).where("score20 > 0")
    return _finish(titles, diverse(scored.select("doc_id", "sentence", "terms", "score20"), ["doc_id"], most), ["doc_id"])


def chapter_body(text: Column) -> Column:
    """A page's lines that are running text: no leading headers, no short, upper-case or numeric lines."""
    header = lambda x: F.lower(x).rlike(r"^chapter( |$)") | tx.is_digits(x) | x.rlike(tx.ROMAN) | x.rlike(tx.SECTION_NUMBER) | x.contains("....")
    poor = lambda x: (F.size(F.split(x, " ")) < 4) | tx.is_upper(x) | (tx.char_count(x, "0-9") * 10 > F.length(x) * 4)
    start = F.array().cast("array<string>")
    kept = F.aggregate(tx.lines(text), start, lambda acc, x: F.when(((F.size(acc) == 0) & header(x)) | poor(x), acc).otherwise(F.concat(acc, F.array(x))))
    return tx.compact(F.array_join(kept, " "))


def chapter(chapters: DataFrame, pages: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, chapter_number, summary). pages carries chapter_number and pos, the place in the chapter from 1."""
    keys = ["doc_id", "chapter_number"]
    numbered = pages.withColumn("real_no", F.col("page_no"))
    profile_pages = numbered.withColumn("page_no", F.col("pos"))
    x = numbered.join(_profiles(chapters, profile_pages, keys), keys)
    clean = (F.length(tx.compact(F.col("text"))) >= 120) & (sc.noise_penalty2(F.col("preview"), F.col("text"), F.col("page_no"), F.lit(True)) < 20)
    first = x.where((F.col("pos") <= 8) & clean)
    rest = x.join(first.select(*keys).distinct(), keys, "left_anti")
    fallback = _top_pages(rest, keys, sc.page_score20(F.col("preview"), F.col("text"), F.col("page_no"), F.col("title_terms"), F.col("profile")), 6)
    cols = [*keys, "title_terms", "profile", "text"]
    s = first.select(*cols).union(fallback.select(*cols))
    s = s.select(*keys, "title_terms", "profile", F.explode(F.transform(tx.sentences(chapter_body(F.col("text"))), tx.compact)).alias("sentence"))
    s = s.where(F.length("sentence").between(60, 320)).where(~sc.structural_noise(F.col("sentence")))
    s = s.withColumns({"low": F.lower("sentence"), "terms": F.array_distinct(tx.informative_tokens(F.col("sentence")))})
    low, shared = F.col("low"), F.size(F.array_intersect("title_terms", "terms"))
    bonus = (
        -F.when(low.startswith("chapter "), 240).otherwise(0) + 30 * shared
        + F.when(low.contains("this chapter"), 80).otherwise(0)
        + F.when(tx.has_any(low, ("we will", "we describe", "we discuss")), 30).otherwise(0)
        - F.when((shared < 1) & (F.size(F.array_intersect("terms", F.get("profile", F.lit(0)))) < 3), 80).otherwise(0)
    )
    scored = s.withColumn("score20", sc.sentence_score20(F.col("sentence"), F.col("title_terms"), F.col("profile")) + bonus).where("score20 > 0")
    return _finish(chapters, diverse(scored.select(*keys, "sentence", "terms", "score20"), keys, most), keys)
