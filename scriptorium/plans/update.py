"""The full update as one chain of DataFrames: catalog, resolution, pages, index, concepts, renderings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.operators import catalog as cat, chapters as ch, concepts as con, keywords as kw, neardup as nd, pages as pg, render, summaries as sm
from scriptorium.plans.workspace import Workspace
from scriptorium.sources import enrich, files
from scriptorium.streaming import incremental


@dataclass(frozen=True)
class Layout:
    """Names of the tables of a knowledge base below its root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


#: Tables with rows per document, which an update takes over where nothing changed.
PER_DOCUMENT = ("pages", "chapters", "index", "markdown")
TABLES = ("catalog", "resolution", *PER_DOCUMENT, "concepts", "bibtex", "fingerprints")


@dataclass(frozen=True)
class KnowledgeBase:
    catalog: DataFrame
    resolution: DataFrame
    pages: DataFrame
    chapters: DataFrame
    index: DataFrame
    concepts: DataFrame
    markdown: DataFrame
    bibtex: DataFrame
    fingerprints: DataFrame
    plan: DataFrame


def keyword_arrays(ranked: DataFrame, word: str) -> DataFrame:
    x = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(word).alias("w")))).alias("k"))
    return x.select("doc_id", F.col("k.w").alias("keywords"))


def by_class(catalog: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keywords, summaries) of all documents, by the rules of their class."""
    t = catalog.select("doc_id", "title", "author", "source_class")
    words, sums = [], []
    for label, k, s in (("book", kw.book, sm.book), ("paper", kw.paper, sm.paper), (None, kw.generic, sm.generic)):
        own = t.where(F.col("source_class") == label) if label else t.where(~F.coalesce("source_class", F.lit("")).isin("book", "paper"))
        p = pages.join(own.select("doc_id"), "doc_id", "left_semi")
        words.append(keyword_arrays(k(own, p), "keyword" if label is None else "phrase"))
        sums.append(s(own, p))
    return words[0].union(words[1]).union(words[2]), sums[0].union(sums[1]).union(sums[2])


def search_index(catalog: DataFrame, pages: DataFrame, keywords: DataFrame, summaries: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """One row per document; redundant ones have only their title to search for."""
    none = F.array().cast("array<string>")
    p = pages.where("page_no <= 8").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "preview"))).alias("page_previews"))
    x = catalog.join(keywords, "doc_id", "left").join(summaries, "doc_id", "left").join(p, "doc_id", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))
    parts = [title, F.coalesce("author", F.lit("")), F.array_join(F.coalesce("keywords", none), " "), F.coalesce("summary", F.lit(""))]
    if chapters is not None:
        line = F.concat_ws(" ", "title", F.array_join("keywords", " "), "summary", F.array_join("section_previews", " "))
        c = chapters.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_start", line.alias("l")))).alias("c")).select("doc_id", F.array_join("c.l", "\n").alias("chapter_text"))
        x = x.join(c, "doc_id", "left")
        parts.append(F.coalesce("chapter_text", F.lit("")))
    previews = F.array_join(F.filter("page_previews.preview", lambda s: s != ""), "\n")
    text = F.concat_ws("\n", *parts, F.coalesce(previews, F.lit("")))
    redundant = F.coalesce("is_redundant", F.lit(False))
    link = F.concat(F.lit("[[source/"), F.col("doc_id").cast("string"), F.lit("]]"))
    return x.select(
        "doc_id", title.alias("title"), "author", "year", "source_class", "canonical_doc_id", "relationship", "filename", link.alias("wiki_link"), F.coalesce("summary", title).alias("summary"),
        F.when(redundant, none).otherwise(F.coalesce("keywords", none)).alias("keywords"), "page_count", "page_previews", F.when(redundant, title).otherwise(text).alias("search_text"), redundant.alias("is_redundant"), "dedupe_kind",
    )


def model_summaries(whole: DataFrame, pages: DataFrame, summaries: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """``summaries`` with a model's answer on the first pages of each document where it gives one."""
    asked = pg.excerpt(pages).join(whole.select("doc_id", "title"), "doc_id")
    asked = asked.select("doc_id", enrich.summary_prompt(F.coalesce("title", F.col("doc_id").cast("string")), F.col("text")).alias("text"))
    answers = enrich.asked(asked, model)
    return summaries.join(answers, "doc_id", "left").select("doc_id", F.coalesce(F.nullif(F.btrim("answer"), F.lit("")), "summary").alias("summary"))


def concepts(spark: SparkSession, index: DataFrame, pages: DataFrame, ws: Workspace) -> DataFrame:
    """The described concepts of an index, with links to related ones."""
    return con.with_related(con.described(con.selected(spark, ws.save(con.phrase_events(index), "events"), index, pages)))


def build(
    spark: SparkSession, entries: DataFrame, pages: DataFrame | None = None, old: Mapping[str, DataFrame] | None = None, force: bool = False, only: Sequence = (), model: Callable[[str], str | None] | None = None,
) -> KnowledgeBase:
    """entries: a catalog with texts, as catalog.from_documents gives it; rejected ones are left out.

    old: the tables of the last update. Documents whose fingerprint is the same keep their
    rows, unless ``force`` is set; ``only`` (ids) are built in any case, and with it other known documents are not.
    model: a client that summarises; the extractive summary stays where it gives no answer.
    Each stage is written before the next reads it; a failure stops the run.
    """
    ws = Workspace(spark, "update")
    exact = ws.save(cat.resolve_exact(cat.live(entries)), "catalog")
    resolved = ws.save(nd.resolution(exact, ws.save(nd.matches(exact, ws), "pairs"), ws), "resolution")
    whole = ws.save(nd.overlay(exact, resolved).drop("text"), "resolved")
    prints = incremental.page_fingerprints(whole, "model" if model else "deterministic")
    before = old["fingerprints"].select("doc_id", "fingerprint") if old else prints.where("false")
    plan = incremental.rebuild_plan(prints, before)
    if force:
        plan = plan.withColumn("action", F.when(F.col("action") == "reuse", "build").otherwise(F.col("action")))
    if only:
        known = F.col("doc_id").isin(*only)
        plan = plan.join(before.select("doc_id", F.lit(True).alias("_old")), "doc_id", "left")
        plan = plan.select("doc_id", F.when((F.col("action") != "remove") & known, "build").when((F.col("action") == "build") & F.col("_old"), "reuse").otherwise(F.col("action")).alias("action"))
    plan = ws.save(plan, "plan")

    todo = plan.where("action = 'build'").select("doc_id")
    fresh = ws.save(whole.join(todo, "doc_id", "left_semi"), "fresh")
    texts = exact.join(todo, "doc_id", "left_semi")
    own_pages = ws.save(pages.join(todo, "doc_id", "left_semi") if pages is not None else pg.by_line(texts), "pages")
    live = fresh.where("not is_redundant")
    own = own_pages.join(live.select("doc_id"), "doc_id", "left_semi")
    chapters = ws.save(ch.compiled(own.join(live.where("source_class = 'book'").select("doc_id"), "doc_id", "left_semi")), "chapters")
    keywords, summaries = by_class(live, own)
    summaries = ws.save(model_summaries(live, own, summaries, model) if model else summaries, "summaries")
    index = ws.save(search_index(fresh, own_pages, ws.save(keywords, "keywords"), summaries, chapters), "index")
    markdown = ws.save(render.page(index.where("not is_redundant"), own, chapters).union(render.stub(fresh)), "markdown")
    new = {"pages": own_pages, "chapters": chapters, "index": index, "markdown": markdown}
    if old:
        new = {name: ws.save(incremental.merged(old[name], df, plan), name) for name, df in new.items()}
    about = ws.save(concepts(spark, new["index"], new["pages"], ws), "concepts")
    cited = whole
    for c in ("doi", "isbn", "journal", "publisher", "path"):
        if c not in cited.columns:
            cited = cited.withColumn(c, F.lit(None).cast("string"))
    state = prints
    if only:  # what was not built keeps its old fingerprint, so that a later update builds it
        kept = plan.where("action = 'reuse'").select("doc_id").join(before, "doc_id")
        state = prints.join(kept.select("doc_id"), "doc_id", "left_anti").unionByName(kept)
    return KnowledgeBase(whole, resolved, new["pages"], new["chapters"], new["index"], about, new["markdown"], render.bibtex(cited), ws.save(incremental.built(state), "fingerprints"), plan)


def stored(spark: SparkSession, layout: Layout) -> dict[str, DataFrame] | None:
    """The tables of the last update; None where there was none."""
    try:
        return {name: spark.read.parquet(layout.path(name)) for name in TABLES}
    except AnalysisException:
        return None


def write(kb: KnowledgeBase, layout: Layout) -> None:
    for name in TABLES:
        getattr(kb, name).write.mode("overwrite").parquet(layout.path(name))


def report(kb: KnowledgeBase) -> str:
    """A Markdown report: sizes of the tables, what was built, duplicates, documents by class."""
    lines = ["# Update report", "", f"Generated: {files.utc_now()}", ""]
    for name in ("catalog", "pages", "chapters", "concepts"):
        lines.append(f"- {name}: {getattr(kb, name).count()}")
    counts = lambda df, c: [(r[0], r[1]) for r in df.groupBy(c).count().orderBy(c).collect()]  # noqa: E731  bounded: actions, states, classes
    for title, df, c in (("Documents by action", kb.plan, "action"), ("Resolution", kb.resolution, "status"), ("Documents by class", kb.catalog, "source_class")):
        lines += ["", f"## {title}", "", *(f"- {k}: {n}" for k, n in counts(df, c))]
    return "\n".join(lines) + "\n"
