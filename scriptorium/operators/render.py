"""Text renderings: YAML front matter, Markdown pages, BibTeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.functions import identity as idf, lexicons as lx, text as tx


def yaml_text(value: Column) -> Column:
    """A string in double quotes; null as ``null``."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(value.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))


def yaml_bare(value: Column) -> Column:
    """A number or truth value; null as ``null``."""
    return F.coalesce(value.cast("string"), F.lit("null"))


def yaml_list(name: str, items: Column) -> Column:
    listed = F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(items, lambda i: F.concat(F.lit("  - "), yaml_text(i))), "\n"))
    return F.when(F.size(F.coalesce(items, F.array().cast("array<string>"))) == 0, F.lit(f"{name}: []")).otherwise(listed)


def front_matter(*lines: Column) -> Column:
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"))


def field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def relationship(kind: Column, target: Column) -> Column:
    """``kind: [[source/target]]`` in an array, empty if either is missing."""
    line = F.concat(kind, F.lit(": [[source/"), target.cast("string"), F.lit("]]"))
    return F.when(F.coalesce(kind, F.lit("")).isin("") | target.isNull(), F.array().cast("array<string>")).otherwise(F.array(line))


def redundancy(kind: Column, target: Column, similarity: Column) -> Column:
    """The sentence of a stub; other kinds fail."""
    link = F.concat(F.lit("[[source/"), target.cast("string"), F.lit("]]"))
    near = F.concat(F.lit("Near-duplicate of "), link, F.coalesce(F.concat(F.lit(" (similarity="), similarity.cast("string"), F.lit(")")), F.lit("")), F.lit("."))
    return F.when(kind == "exact_duplicate_of", F.concat(F.lit("Exact duplicate of "), link, F.lit("."))).when(kind == "near_duplicate_of", near).otherwise(F.raise_error(F.concat(F.lit("no redundancy of kind "), F.coalesce(kind, F.lit("null")))))


def stub(d: DataFrame) -> DataFrame:
    """(doc_id, markdown) for redundant documents."""
    kind, target = F.col("dedupe_kind"), F.col("canonical_doc_id")
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string"))
    similarity = (F.col("similarity_1e4") / 10000).cast("decimal(5,4)") if "similarity_1e4" in d.columns else F.lit(None).cast("decimal(5,4)")
    head = front_matter(
        field("doc_id", yaml_text(F.col("doc_id"))), field("title", yaml_text(title)), field("source_class", yaml_text(F.col("source_class"))),
        field("canonical_doc_id", yaml_text(target)), F.lit("keywords: []"), yaml_list("aliases", F.array("filename")), yaml_list("related", relationship(kind, target)),
    )
    detail = F.when((kind == "near_duplicate_of") & similarity.isNotNull(), F.concat(F.lit("\nDetected near-duplicate similarity: `"), similarity.cast("string"), F.lit("`")))
    body = F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("# "), title), F.lit(""), F.lit("## Status"), F.lit(""), redundancy(kind, target, similarity), detail)
    return d.where("is_redundant").select("doc_id", F.concat(body, F.lit("\n")).alias("markdown"))


def page(d: DataFrame, previews: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """(doc_id, markdown) of documents with summary and keywords. previews: doc_id, page_no, page_key, section_title, preview."""
    anchor = F.coalesce("page_key", F.concat(F.lit("p"), F.col("page_no").cast("string")))
    label = F.coalesce("section_title", anchor)
    entry = F.concat_ws("\n", F.concat(F.lit("### "), label), F.lit(""), F.concat(F.lit("Anchor: #"), anchor), F.lit(""), F.coalesce(F.nullif("preview", F.lit("")), F.lit("No preview available.")), F.lit(""))
    anchors = previews.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", entry.alias("e")))).alias("a")).select("doc_id", F.array_join("a.e", "\n").alias("anchors"), F.size("a").alias("n_pages"))
    x = d.join(anchors, "doc_id", "left")
    if chapters is not None:
        lines = F.concat_ws(
            "\n", F.format_string("### Chapter %d: %s", "chapter_number", "title"), F.lit(""), F.format_string("- Pages: `p%d-p%d`", "page_start", "page_end"), F.concat(F.lit("- Link: `"), F.col("wiki_link"), F.lit("`")),
            F.when(F.size("keywords") > 0, F.concat(F.lit("- Keywords: "), F.array_join("keywords", ", "))), F.when(F.size("section_previews") > 0, F.concat(F.lit("- Sections: "), F.array_join("section_previews", ", "))),
            F.lit(""), F.col("summary"), F.lit(""),
        )
        c = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_start", lines.alias("l")))).alias("c")).select("doc_id", F.concat(F.lit("\n## Chapters\n\n"), F.array_join("c.l", "\n")).alias("chapter_text"))
        x = x.join(c, "doc_id", "left")
    else:
        x = x.withColumn("chapter_text", F.lit(None).cast("string"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("doc_id").cast("string"))
    related = relationship(F.col("relationship.kind"), F.col("relationship.target_doc_id"))
    head = front_matter(
        field("doc_id", yaml_text(F.col("doc_id"))), field("title", yaml_text(title)), field("author", yaml_text(F.col("author"))), field("year", yaml_bare(F.col("year"))),
        field("source_class", yaml_text(F.col("source_class"))), field("canonical_doc_id", yaml_text(F.col("canonical_doc_id"))), yaml_list("keywords", F.col("keywords")),
        yaml_list("aliases", F.array("filename")), yaml_list("related", related),
    )
    code = lambda name, c: F.concat(F.lit(f"- {name}: `"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("`"))
    path = F.col("path") if "path" in d.columns else F.col("filename")
    link = F.concat(F.lit("[[source/"), F.col("doc_id").cast("string"), F.lit("]]"))
    bullets = F.when(F.size("keywords") > 0, F.array_join(F.transform("keywords", lambda k: F.concat(F.lit("- "), k)), "\n"))
    body = F.concat_ws(
        "\n", head, F.lit(""), F.concat(F.lit("# "), title), F.lit("\n## Summary\n"), F.col("summary"), F.lit("\n## Keywords\n"), bullets, F.col("chapter_text"), F.lit("## Metadata\n"),
        code("Source class", F.col("source_class")), code("Doc ID", F.col("doc_id")), code("Year", F.col("year")), code("Pages", F.col("n_pages")), code("Raw file", path), code("Wiki link", link),
        F.when(F.size(related) > 0, F.concat(F.lit("\n## Relationships\n\n- "), F.get(related, F.lit(0)))), F.lit("\n## Page Anchors\n"), F.rtrim(F.coalesce("anchors", F.lit(""))),
    )
    return x.select("doc_id", F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n")).alias("markdown"))


def concept(c: DataFrame) -> DataFrame:
    """(concept_id, markdown) of described concepts; related, if there, is an array of links."""
    link = lambda d: F.concat(F.lit("[[source/"), d.cast("string"), F.lit("]]"))
    sources = F.transform("supporting_doc_ids", link)
    related = F.col("related") if "related" in c.columns else F.array().cast("array<string>")
    head = front_matter(field("concept_id", yaml_text(F.col("concept_id"))), field("title", yaml_text(F.col("title"))), yaml_list("keywords", F.col("keywords")), yaml_list("supporting_sources", sources), field("source_count", yaml_bare(F.col("source_count"))), yaml_list("related", related))
    dash = lambda a: F.array_join(F.transform(a, lambda s: F.concat(F.lit("- "), s)), "\n")
    body = F.concat_ws("\n", head, F.lit(""), F.concat(F.lit("# "), F.col("title")), F.lit("\n## Summary\n"), F.col("summary"), F.lit("\n## Key Sources\n"), dash(sources), F.lit("\n## Related Concepts\n"), F.when(F.size(related) > 0, dash(related)).otherwise(F.lit("- None identified yet.")))
    return c.select("concept_id", F.concat(body, F.lit("\n")).alias("markdown"))


def bibtex_escape(value: Column) -> Column:
    """The ten special characters of BibTeX, each replaced once."""
    known = F.create_map(*(F.lit(x) for pair in lx.BIBTEX_ESCAPES.items() for x in pair))
    return F.array_join(F.transform(F.split(value, ""), lambda c: F.coalesce(F.try_element_at(known, c), c)), "")


def bibtex(d: DataFrame) -> DataFrame:
    """(doc_id, entry) of the citeable documents that are no duplicates and not rejected, ordered by doc_id."""
    col = lambda c, kind="string": F.col(c) if c in d.columns else F.lit(None).cast(kind)
    included = F.coalesce(col("cite", "boolean"), F.lit(False))
    x = d.where(idf.citeable(F.col("title"), F.col("year"), F.col("doi"), F.col("isbn"), included))
    x = x.where((F.coalesce(col("source_class"), F.lit("")) != "duplicate") & ~F.coalesce(col("is_redundant", "boolean"), F.lit(False)) & (F.coalesce(col("status"), F.lit("")) != "rejected"))
    kind = idf.entry_type(F.col("doi"), F.col("isbn"), F.col("journal"), col("source_class"), "article", "book", "misc")
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), bibtex_escape(v), F.lit("},")))
    publisher = F.coalesce(F.nullif(F.col("publisher"), F.lit("")), col("producer"))
    entry = F.concat_ws(
        "\n", F.concat(F.lit("@"), kind, F.lit("{"), F.col("doc_id").cast("string"), F.lit(",")), line("title", F.col("title")), line("author", idf.bibtex_authors(F.col("author"))),
        F.concat(F.lit("  year = {"), F.col("year").cast("string"), F.lit("},")), line("journal", F.col("journal")), line("publisher", publisher), line("doi", F.col("doi")), line("isbn", F.col("isbn")), line("file", col("path")), F.lit("}"),
    )
    return x.select("doc_id", entry.alias("entry")).orderBy("doc_id")


def evidence(label: str, d: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, markdown): a section of an evidence pack with the best pages of one document."""
    line = F.concat(F.lit("- [[source/"), F.col("doc_id").cast("string"), F.lit("#p"), F.col("page_no").cast("string"), F.lit("]] score="), (F.col("score2") / 2).cast("decimal(12,2)").cast("string"), F.lit(": "), F.coalesce(F.nullif("preview", F.lit("")), F.lit("No preview available.")))
    p = pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    x = d.join(p, "doc_id", "left")
    body = F.concat_ws("\n", F.concat(F.lit(f"## {label}: "), F.coalesce("title", F.col("doc_id").cast("string"))), F.lit(""), F.coalesce("summary", F.lit("")), F.lit(""), F.coalesce("lines", F.lit("- No directly matching page snippets were found.")))
    return x.select("doc_id", body.alias("markdown"))
