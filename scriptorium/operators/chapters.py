"""Chapters of books: where they start, their titles, pages, keywords and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import scoring as sc, text as tx
from scriptorium.operators import keywords as kw, summaries as sm


def _first_number(texts: Column) -> Column:
    return F.get(F.filter(F.transform(texts, tx.chapter_number), lambda n: n.isNotNull()), F.lit(0))


def _number_line(texts: Column) -> Column:
    """The first line of digits after a line CHAPTER."""
    seen = F.array_position(F.transform(texts, F.upper), "CHAPTER")
    after = F.slice(texts, F.greatest(seen + 1, F.lit(1)).cast("int"), F.size(texts))
    return F.when(seen > 0, F.get(F.filter(after, tx.is_digits), F.lit(0)).try_cast("int"))


def _title_lines(texts: Column, number: Column) -> Column:
    """Heading lines of a chapter's first page: a fold over its lines that skips, takes or stops."""
    low = lambda x: F.lower(x)
    start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("over"))

    def step(acc: Column, x: Column) -> Column:
        any_ = F.size(acc["got"]) > 0
        label = low(x).isin("chapter", "chapter outline") | (low(x) == F.concat(F.lit("chapter "), number.cast("string")))
        count = tx.is_digits(x) | x.rlike(tx.ROMAN) | x.rlike(tx.SECTION_NUMBER)
        end = low(x).startswith("references") | low(x).startswith("chapter outline")
        empty = x.contains("....") | ~x.rlike(r"\p{L}")
        short = F.size(tx.tokens(x)) <= 8
        take = ~label & ~count & ~end & ~empty & short
        stop = ~label & ((count & any_) | (~count & end) | (~count & ~end & ~empty & ~short & any_))
        return F.struct(F.when(~acc["over"] & take, F.concat(acc["got"], F.array(x))).otherwise(acc["got"]).alias("got"), (acc["over"] | stop).alias("over"))

    got = F.aggregate(texts, start, step)["got"]
    return F.when(F.size(got) > 0, tx.compact(F.array_join(F.slice(got, 1, 3), " ")))


def _title_from_preview(raw: Column, number: Column) -> Column:
    p = tx.clean_preview(raw)
    h = tx.section_heading(p)
    plain = (p != "") & ~sc.preview_is_noisy(p) & tx.chapter_number(p).isNull() & ~p.contains("....") & (F.size(tx.tokens(p)) <= 8)
    return F.when(h.isNotNull() & (h["chapter"] == number), h["title"]).when(plain, p)


def starts(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, chapter_number, title) of the first page of each chapter, in page order."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    x = pages.withColumns({"p": tx.compact(F.col("preview")), "low": F.lower(tx.compact(F.col("text"))), "l8": tx.lines(F.col("text"), 8), "l14": tx.lines(F.col("text"), 14)})
    ahead = [F.lead("preview", i).over(w) for i in range(5)]
    x = x.withColumns({f"n{i}": c for i, c in enumerate(ahead)})
    noisy, bare = sc.preview_is_noisy(F.col("p")), F.upper("p") == "CHAPTER"
    listing = (noisy & ~F.lower("p").contains("chapter") & F.substring("low", 1, 300).contains("contents")) | F.col("low").startswith("contents ") | F.col("low").startswith("table of contents")
    in_heading = F.coalesce(*(tx.section_heading(F.col(f"n{i}"))["chapter"] for i in (1, 2, 3)))
    number = F.coalesce(tx.chapter_number(F.col("p")), F.when(noisy | bare, _first_number(F.col("l8"))), F.when(bare, F.coalesce(_number_line(F.col("l8")), in_heading)))
    x = x.withColumn("chapter_number", F.when(~listing, number)).where("chapter_number is not null")
    n = F.col("chapter_number")
    title = F.coalesce(_title_lines(F.col("l14"), n), *(_title_from_preview(F.col(f"n{i}"), n) for i in range(5)), F.concat(F.lit("Chapter "), n.cast("string")))
    x = x.withColumn("title", title).withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "chapter_number").orderBy("page_no")))
    return x.where("nth = 1").select("doc_id", "page_no", "chapter_number", "title")


def with_chapter(pages: DataFrame, first: DataFrame) -> DataFrame:
    """``pages`` with the chapter that they belong to and their place in it; pages before the first chapter go.

    The start's number is carried forward by a window, so no range join is needed.
    """
    x = pages.join(first.select("doc_id", "page_no", F.col("chapter_number").alias("starts")), ["doc_id", "page_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("chapter_number", F.last("starts", ignorenulls=True).over(w)).where("chapter_number is not null").drop("starts")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id", "chapter_number").orderBy("page_no")))


def sections(members: DataFrame, most: int = 6) -> DataFrame:
    """(doc_id, chapter_number, section_previews): distinct titles of the chapter's headings on its first 12 pages, in order."""
    h = tx.section_heading(tx.compact(F.col("preview")))
    x = members.where(F.col("pos") <= 12).withColumn("h", h).where(F.col("h.chapter") == F.col("chapter_number"))
    x = x.groupBy("doc_id", "chapter_number", F.col("h.title").alias("label")).agg(F.min("pos").alias("pos"))
    x = x.groupBy("doc_id", "chapter_number").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("s"))
    return x.select("doc_id", "chapter_number", F.slice("s.label", 1, most).alias("section_previews"))


def compiled(pages: DataFrame) -> DataFrame:
    """(doc_id, chapter_number, title, page_start, page_end, summary, keywords, wiki_link, section_previews)."""
    keys = ["doc_id", "chapter_number"]
    first = starts(pages)
    members = with_chapter(pages, first)
    span = members.groupBy(*keys).agg(F.min("page_no").alias("page_start"), F.max("page_no").alias("page_end"))
    words = kw.chapter(first, members.withColumn("body", sm.chapter_body(F.col("text"))))
    words = words.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("k")).select(*keys, F.col("k.phrase").alias("keywords"))
    none = F.array().cast("array<string>")
    x = first.select(*keys, "title").join(span, keys).join(sm.chapter(first.select(*keys, "title"), members), keys).join(words, keys, "left").join(sections(members), keys, "left")
    link = F.concat(F.lit("[[source/"), F.col("doc_id").cast("string"), F.lit("#p"), F.col("page_start").cast("string"), F.lit("]]"))
    return x.select(*keys, "title", "page_start", "page_end", "summary", F.coalesce("keywords", none).alias("keywords"), link.alias("wiki_link"), F.coalesce("section_previews", none).alias("section_previews"))
