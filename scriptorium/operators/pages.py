"""Pages and sections of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from scriptorium.functions import text as tx

SCHEMA = "doc_id, page_no int, page_key string, section_title string, char_count int, preview string, text string"


def _finish(x: DataFrame) -> DataFrame:
    return x.withColumns({"char_count": F.length("text"), "preview": tx.preview(F.col("text"))})


def by_line(documents: DataFrame) -> DataFrame:
    """One page per line that is not blank, numbered from 1."""
    x = documents.select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("i", "text"))
    return _finish(x.select("doc_id", (F.col("i") + 1).alias("page_no"), F.concat(F.lit("p"), (F.col("i") + 1).cast("string")).alias("page_key"), F.lit(None).cast("string").alias("section_title"), "text"))


def by_form_feed(documents: DataFrame) -> DataFrame:
    """One page per part between form feeds; blank ones go, and page_key keeps the physical number."""
    x = documents.select("doc_id", F.posexplode(F.split("text", "\f")).alias("i", "text")).where(F.trim(tx.compact(F.col("text"))) != "")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return _finish(x.select("doc_id", n.alias("page_no"), F.concat(F.lit("p"), (F.col("i") + 1).cast("string")).alias("page_key"), F.lit(None).cast("string").alias("section_title"), "text"))


def by_header(documents: DataFrame) -> DataFrame:
    """Sections of Markdown: what stands before the first header is ``Frontmatter`` (kept even if empty); later sections without text go."""
    marked = F.regexp_replace("text", r"(?m)^(#+\s+.*)$", "\u0001$1\u0002")
    parts = documents.select("doc_id", F.posexplode(F.split(marked, "\u0001")).alias("i", "part"))
    head = F.when(F.col("i") == 0, "Frontmatter").otherwise(F.btrim(F.regexp_replace(F.substring_index("part", "\u0002", 1), r"^[#\s]+|[#\s]+$", "")))
    body = F.when(F.col("i") == 0, F.col("part")).otherwise(F.substring(F.col("part"), F.instr(F.col("part"), "\u0002") + 1, F.length("part")))
    body = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    x = parts.select("doc_id", "i", head.alias("section_title"), body.alias("text")).where((F.col("text") != "") | (F.col("i") == 0))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return _finish(x.select("doc_id", n.alias("page_no"), tx.slug(F.col("section_title")).alias("page_key"), "section_title", "text"))


def markdown_of_html(html: Column) -> Column:
    """The text of HTML with headings as Markdown headers; scripts, styles, comments and other markup go."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head)\b.*?</\1>", "")
    headed = F.regexp_replace(bare, r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>", "\n# $1\n")
    lines = F.regexp_replace(headed, r"(?i)</(p|div|li|tr|section|article)>|<br\s*/?>", "\n")
    plain = F.regexp_replace(F.regexp_replace(lines, r"(?s)<[^>]*>", ""), r"[ \t]*\n\s*", "\n")
    return _unescape(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""))


def by_format(documents: DataFrame) -> DataFrame:
    """Pages of documents with a file name: parts between form feeds of a PDF, sections under headers of anything else."""
    pdf = F.lower("filename").endswith(".pdf")
    return by_form_feed(documents.where(pdf)).unionByName(by_header(documents.where(~F.coalesce(pdf, F.lit(False)))))


def by_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Sections of HTML: title, then the heading and paragraphs of the article, without markup.

    Built-in expressions only; scripts, styles and comments are cut first.
    """
    bare = F.regexp_replace(html_col, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "")
    plain = lambda s: _unescape(tx.compact(F.regexp_replace(s, r"(?s)<[^>]*>", " ")))
    article = F.regexp_extract(bare, r"(?is)<article[^>]*>(.*?)</article>", 1)
    found = F.concat(
        F.transform(F.slice(F.regexp_extract_all(bare, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), 1), 1, 1), lambda s: F.struct(F.lit("title").alias("kind"), plain(s).alias("text"))),
        F.transform(F.regexp_extract_all(article, F.lit(r"(?is)<h1[^>]*>(.*?)</h1>"), 1), lambda s: F.struct(F.lit("h1").alias("kind"), plain(s).alias("text"))),
        F.transform(F.regexp_extract_all(article, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), lambda s: F.struct(F.lit("p").alias("kind"), plain(s).alias("text"))),
    )
    x = pages.select(F.col(id_col), F.posexplode(found).alias("section_no", "s"))
    return x.select(id_col, "section_no", F.col("s.kind").alias("kind"), F.col("s.text").alias("text")).where("text <> ''")


def _unescape(s):
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return s


def whole_text(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages of a document in order, joined by line breaks."""
    x = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return x.select("doc_id", F.array_join("p.text", "\n").alias("text"))


def excerpt(pages: DataFrame, most_pages: int = 10, most_chars: int = 25000) -> DataFrame:
    """(doc_id, text): the first pages, cut; what a model is asked about."""
    return whole_text(pages.where(F.col("page_no") <= most_pages)).withColumn("text", F.substring("text", 1, most_chars))


def needs_ocr(pages: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, needs_ocr): whether the mean number of characters on a page is below ``least``."""
    return pages.groupBy("doc_id").agg((F.avg("char_count") < least).alias("needs_ocr"))


def quality_flags(pages: DataFrame, ocr: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_count, text_bytes, quality_flags)."""
    x = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"), F.sum(F.octet_length("text")).alias("text_bytes"), F.max(F.col("section_title").isNotNull()).alias("sections"), (F.sum("char_count") == 0).alias("empty"))
    x = x.join(ocr.select("doc_id", F.lit(True).alias("ocr")), "doc_id", "left") if ocr is not None else x.withColumn("ocr", F.lit(False))
    flags = F.array_compact(F.array(F.when(F.col("ocr"), "ocr_extracted"), F.when(F.col("sections"), "section_chunked"), F.when(F.col("empty"), "empty_text")))
    return x.select("doc_id", "page_count", "text_bytes", flags.alias("quality_flags"))


def to_extract(catalog: DataFrame, extracted: DataFrame, force: bool = False) -> DataFrame:
    """(doc_id, action): extract, skip (same hash, extracted before) or skipped_duplicate."""
    done = extracted.where("status = 'extracted'").select("doc_id", F.col("source_sha256").alias("sha256"), F.lit(True).alias("done"))
    x = catalog.join(done, ["doc_id", "sha256"], "left")
    skip = F.coalesce("done", F.lit(False)) & F.lit(not force)
    return x.select("doc_id", F.when(F.col("source_class") == "duplicate", "skipped_duplicate").when(skip, "skip").otherwise("extract").alias("action"))
