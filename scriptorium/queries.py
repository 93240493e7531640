"""One query per operator group over the driver's tables or literal rows; (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium import samples as sa
from scriptorium.functions import identity as idf, scoring as sc, text as tx
from scriptorium.operators import catalog as cat, chapters as ch, concepts as con, keywords as kw, neardup as nd, pages as pg, render, search as se, summaries as sm, sync
from scriptorium.plans import update
from scriptorium.plans.workspace import Workspace
from scriptorium.streaming import incremental

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.from_documents(table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.resolve_exact(entries(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.by_line(docs(spark, sf_dir))


def literal(spark: SparkSession, values: list, columns: str) -> DataFrame:
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], columns)


@query
def tokenize_counts(spark, d):
    return docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query
def slugify_titles(spark, d):
    return entries(spark, d).select("doc_id", tx.slug(F.col("title")).alias("slug"))


@query
def page_previews(spark, d):
    return docs(spark, d).select("doc_id", tx.preview(F.col("text")).alias("preview"))


@query
def text_lines_pages(spark, d):
    return lines(spark, d).select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("char_count").cast("long").alias("char_count"), "text")


@query
def informative_tokens(spark, d):
    return entries(spark, d).select("doc_id", F.array_join(tx.informative_tokens(F.col("title")), " ").alias("tokens"))


@query
def query_terms(spark, d):
    return entries(spark, d).select("doc_id", F.array_join(tx.query_terms(F.col("title")), " ").alias("terms"))


@query
def score_text_topk(spark, d):
    return se.top_documents(docs(spark, d), sa.QUERY, sa.TERMS).select("doc_id", F.col("score2").cast("long").alias("score2"))


@query
def page_matches_topk(spark, d):
    x = se.page_matches(lines(spark, d), sa.QUERY, sa.TERMS)
    return x.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("page_no", "score2", "rank")))


@query
def page_penalties(spark, d):
    p, t, n = F.col("preview"), F.col("text"), F.col("page_no")
    return lines(spark, d).select("doc_id", n.cast("long").alias("page_no"), sc.signal_penalty2(p).cast("long").alias("signal2"), sc.noise_penalty2(p, t, n, F.lit(False)).cast("long").alias("noise2"), sc.preview_is_noisy(p).alias("noisy"))


@query
def exact_duplicates(spark, d):
    return exact(spark, d).select("doc_id", "canonical_doc_id", "source_class", F.col("relationship.kind").alias("kind"))


@query
def catalog_class_counts(spark, d):
    return cat.class_counts(exact(spark, d), spark)


@query
def catalog_statistics(spark, d):
    return cat.statistics(entries(spark, d))


@query
def unique_ids(spark, d):
    x = docs(spark, d).select("doc_id", F.col("source").alias("id"))
    return cat.unique_ids(x, "id", "doc_id")


@query
def source_classes(spark, d):
    return literal(spark, sa.CLASSED, "filename string, title string, pages int").select("filename", idf.source_class(F.col("filename"), F.col("title"), F.col("pages")).alias("source_class"))


@query
def doc_ids(spark, d):
    return literal(spark, sa.PATHS, "path string").select("path", idf.doc_id(F.col("path")).alias("doc_id"), F.coalesce(idf.path_year(F.col("path")), F.lit(0)).alias("year"))


@query
def canonical_filenames(spark, d):
    x = literal(spark, sa.NAMED, "year int, title string, author string, doc_id string, suffix string")
    return x.select("doc_id", idf.canonical_filename(*(F.col(c) for c in ("year", "title", "author", "doc_id", "suffix"))).alias("filename"))


@query
def override_overlay(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.lit(None).cast("long").alias("quality"))
    o = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("lang"), F.col("quality").cast("long").alias("quality"))
    return cat.override(x, o).withColumn("quality", F.coalesce("quality", F.lit(-1).cast("long")))


@query
def shingle_counts(spark, d):
    x = docs(spark, d).select("doc_id", nd.shingles(F.col("text")).alias("s"))
    return x.select("doc_id", F.size("s").cast("long").alias("n"), F.array_min("s").alias("first_shingle"))


@query
def near_dup_pairs(spark, d):
    x = nd.matches(exact(spark, d), Workspace(spark, "neardup"))
    return x.select("a", "b", F.col("inter").cast("long").alias("inter"), F.col("total").cast("long").alias("total"), "reason")


@query
def near_dup_clusters(spark, d):
    ws = Workspace(spark, "neardup")
    c = exact(spark, d)
    x = nd.resolution(c, ws.save(nd.matches(c, ws), "pairs"), ws)
    return x.withColumn("similarity_1e4", F.coalesce(F.col("similarity_1e4").cast("long"), F.lit(-1).cast("long")))


@query
def keywords_generic(spark, d):
    return kw.generic(entries(spark, d), lines(spark, d)).select("doc_id", "keyword", F.col("weight").cast("long").alias("weight"), F.col("rank").cast("long").alias("rank"))


@query
def phrase_keywords(spark, d):
    return kw.paper(entries(spark, d), lines(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@query
def topic_profile(spark, d):
    return kw.topic_profile(entries(spark, d), lines(spark, d)).withColumn("weight", F.col("weight").cast("long"))


@query
def sentence_scores(spark, d):
    return sm.sentence_candidates(entries(spark, d), lines(spark, d)).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "sentence", F.col("score20").cast("long").alias("score20"))


@query
def summaries_generic(spark, d):
    return sm.generic(entries(spark, d), lines(spark, d))


def index(spark, d, ws: Workspace):
    c, p = ws.save(exact(spark, d), "catalog"), ws.save(lines(spark, d), "pages")
    c = c.withColumns({"dedupe_kind": F.col("relationship.kind"), "is_redundant": F.lit(False)})
    x = update.search_index(c, p, update.keyword_arrays(kw.generic(c, p), "keyword"), sm.generic(c, p))
    return ws.save(x, "index"), p


@query
def search_two_stage(spark, d):
    ix, p = index(spark, d, Workspace(spark, "search"))
    return se.two_stage(spark, sa.QUERY, ix, p).withColumn("rank", F.col("rank").cast("long")).withColumn("score100", F.col("score100").cast("long"))


def _events(spark, d):
    phrases = update.keyword_arrays(kw.paper(entries(spark, d), lines(spark, d)), "phrase")
    x = exact(spark, d).join(phrases, "doc_id", "left").select("doc_id", "title", "source_class", F.lit(False).alias("is_redundant"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return Workspace(spark, "events").save(con.phrase_events(x), "events")


@query
def concept_candidates(spark, d):
    return con.candidates(_events(spark, d))


@query
def related_concepts(spark, d):
    e = _events(spark, d)
    docs_of = e.join(con.candidates(e).select("phrase"), "phrase", "left_semi").groupBy("phrase").agg(F.collect_set("doc_id").alias("supporting_doc_ids"))
    x = con.related(docs_of.select(F.col("phrase").alias("concept_id"), F.col("phrase").alias("title"), "supporting_doc_ids"))
    return x.withColumn("rank", F.col("rank").cast("long"))


@query
def concept_search(spark, d):
    """All candidate phrases as described concepts, scored for a query."""
    e = _events(spark, d)
    docs_of = e.join(con.candidates(e).select("phrase"), "phrase", "left_semi").groupBy("phrase").agg(F.array_sort(F.collect_set("doc_id")).alias("supporting_doc_ids"))
    p = F.col("phrase")
    x = docs_of.select(tx.slug(p).alias("concept_id"), tx.titled(p).alias("title"), F.array_distinct(F.split(p, " ")).alias("keywords"), F.size("supporting_doc_ids").cast("long").alias("source_count"), "supporting_doc_ids")
    scores = se.concept_scores(con.described(x), sa.CONCEPT_QUERY, sc.terms_of(spark, sa.CONCEPT_QUERY))
    return con.described(x).select("concept_id", "summary").join(scores, "concept_id")


@query
def concepts_selected(spark, d):
    ws = Workspace(spark, "concepts")
    ix, p = index(spark, d, ws)
    return con.described(con.selected(spark, ws.save(con.phrase_events(ix), "events"), ix, p))


@query
def compare_keywords(spark, d):
    x = update.keyword_arrays(kw.generic(entries(spark, d), lines(spark, d)), "keyword")
    return se.compare(x, 1, 2).select(*(F.array_join(c, " ").alias(c) for c in ("shared", "only_a", "only_b")))


@query
def identifiers(spark, d):
    return literal(spark, sa.IDENTIFIED, "text string").select("text", idf.doi(idf.head(F.col("text"))).alias("doi"), idf.isbn(F.col("text")).alias("isbn"))


@query
def authors(spark, d):
    return literal(spark, sa.AUTHORS, "authors string").select("authors", F.nullif(idf.normal_authors(F.col("authors")), F.lit("")).alias("normal"))


@query
def bibtex_escape(spark, d):
    return literal(spark, sa.SPECIAL, "text string").select("text", render.bibtex_escape(F.col("text")).alias("escaped"))


@query
def bibtex_entries(spark, d):
    return render.bibtex(literal(spark, sa.CITED, sa.CITED_SCHEMA))


@query
def front_matter(spark, d):
    q, b = render.yaml_text, render.yaml_bare
    block = render.front_matter(*(render.field(c, (b if c == "year" else q)(F.col(c))) for c in ("doc_id", "title", "author", "year", "source_class")), render.yaml_list("aliases", F.array("filename")))
    return exact(spark, d).select("doc_id", block.alias("block"))


@query
def link_rewrite(spark, d):
    return literal(spark, sa.LINKED, "text string").select("text", cat.relink(F.col("text"), "old.id", "new-id").alias("rewritten"))


@query
def html_sections(spark, d):
    return pg.by_html(table(spark, d, "pages"))


@query
def form_feed_pages(spark, d):
    return pg.by_form_feed(literal(spark, sa.PAGED, "doc_id long, text string")).select("doc_id", F.col("page_no").cast("long").alias("page_no"), "page_key", "text")


@query
def markdown_sections(spark, d):
    return pg.by_header(literal(spark, sa.MARKDOWN, "doc_id long, text string"))


def book_pages(spark):
    x = literal(spark, [(1, i + 1, t) for i, t in enumerate(sa.BOOK_PAGES)], "doc_id long, page_no int, text string")
    return x.withColumns({"page_key": F.concat(F.lit("p"), F.col("page_no").cast("string")), "section_title": F.lit(None).cast("string"), "char_count": F.length("text"), "preview": tx.preview(F.col("text"))})


@query
def chapters(spark, d):
    return ch.compiled(book_pages(spark))


@query
def keywords_book(spark, d):
    return kw.book(literal(spark, [(1, "Finite Volume Methods for Turbulent Flow", None)], "doc_id long, title string, author string"), book_pages(spark))


@query
def summaries_book(spark, d):
    return sm.book(literal(spark, [(1, "Finite Volume Methods for Turbulent Flow")], "doc_id long, title string"), book_pages(spark))


@query
def extraction_plan(spark, d):
    c = exact(spark, d).select("doc_id", "sha256", "source_class")
    done = c.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("sha256")).otherwise("old").alias("source_sha256"), F.lit("extracted").alias("status"))
    return pg.to_extract(c, done)


@query
def redundancy_overlay(spark, d):
    ws = Workspace(spark, "overlay")
    c = exact(spark, d)
    found = ws.save(nd.resolution(c, ws.save(nd.matches(c, ws), "pairs"), ws), "resolution")
    return nd.overlay(c, found).select("doc_id", "canonical_doc_id", "dedupe_kind", "is_redundant", F.coalesce(F.col("similarity_1e4").cast("long"), F.lit(-1).cast("long")).alias("similarity_1e4"))


@query
def incremental_skip(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars")
    old = x.where("doc_id % 11 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return cat.changes(x.where("doc_id % 7 <> 0"), old, "doc_id", ("n_chars",))


@query
def fingerprints(spark, d):
    return incremental.page_fingerprints(exact(spark, d))


@query
def clean_orphans(spark, d):
    return cat.orphans(table(spark, d, "pages").select(F.col("page_id").alias("doc_id")), table(spark, d, "labels"))


@query
def clean_previews(spark, d):
    return entries(spark, d).select("doc_id", tx.clean_preview(F.col("title")).alias("preview"))


@query
def headings(spark, d):
    h = tx.section_heading(F.col("text"))
    x = literal(spark, sa.HEADINGS, "text string")
    return x.select("text", F.coalesce(tx.chapter_number(F.col("text")), F.lit(-1)).cast("long").alias("chapter"), F.coalesce(h["chapter"], F.lit(-1)).cast("long").alias("section_chapter"), h["title"].alias("title"))


@query
def token_forms(spark, d):
    x = docs(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("token")).distinct()
    t = F.col("token")
    return x.select("token", F.array_join(tx.signature(t), " ").alias("singular"), F.array_join(tx.plural_signature(t), " ").alias("plural_signature"), tx.titled(t).alias("titled"))


@query
def structural_noise(spark, d):
    x = docs(spark, d).select("doc_id", F.posexplode(tx.sentences(tx.compact(F.col("text")))).alias("i", "sentence"))
    return x.select("doc_id", F.col("i").cast("long").alias("i"), sc.structural_noise(F.col("sentence")).alias("noise"))


@query
def content_types(spark, d):
    suffix = F.element_at(F.array(*(F.lit(x) for x in (".pdf", ".MD", ".html", ".epub", ".xyz", "", ".txt"))), (F.col("doc_id") % 7 + 1).cast("int"))
    return docs(spark, d).select("doc_id", idf.content_type(F.concat(F.lit("files/"), "source", F.lit("-"), F.col("doc_id").cast("string"), suffix)).alias("content_type"))


def _cited(spark, d):
    """Catalog rows with made-up identifiers, so that every branch is met."""
    n = F.col("doc_id")
    return exact(spark, d).withColumns({
        "year": F.when(n % 4 != 0, 1990 + n % 30).cast("int"), "doi": F.when(n % 3 == 0, F.concat(F.lit("10.1000/"), n.cast("string"))), "isbn": F.when(n % 5 == 0, "9783161484100"), "journal": F.when(n % 2 == 0, "Journal"),
        "cite": n % 7 == 0, "path": F.concat(F.lit("library/"), "filename"), "publisher": F.lit(None).cast("string"), "author": F.when(n % 6 != 0, F.concat("source", F.lit(", Ann; Bo Ray"))),
    })


@query
def citeable_items(spark, d):
    x = _cited(spark, d)
    i = [F.col(c) for c in ("doi", "isbn", "journal", "source_class")]
    return x.select("doc_id", idf.citeable(F.col("title"), F.col("year"), F.col("doi"), F.col("isbn"), F.col("cite")).alias("citeable"), idf.entry_type(*i, "article", "book", "misc").alias("entry"), idf.entry_type(*i, "journalArticle", "book", "document").alias("item"))


@query
def bibtex_corpus(spark, d):
    return render.bibtex(_cited(spark, d))


@query
def sync_records(spark, d):
    return sync.records(_cited(spark, d)).select("sha256", "doc_id", "fingerprint", "attachment_fingerprint")


@query
def creators(spark, d):
    made = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(" Jr; "), F.lower("c_mktsegment"), F.lit("  "), "c_name", F.lit(";; solo"), F.col("c_custkey").cast("string"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), made.alias("authors"))
    each = F.transform(idf.creators(F.col("authors")), lambda c: F.concat_ws("|", F.coalesce(c["last"], F.lit("-")), F.coalesce(c["first"], F.lit("-")), F.coalesce(c["name"], F.lit("-"))))
    return x.select("k", F.array_join(each, ";").alias("creators"), idf.bibtex_authors(F.col("authors")).alias("bibtex"))


@query
def whole_texts(spark, d):
    p = lines(spark, d)
    e = pg.excerpt(p).select("doc_id", F.sha2("text", 256).alias("excerpt"))
    return pg.whole_text(p).select("doc_id", F.sha2("text", 256).alias("whole")).join(e, "doc_id")


@query
def quality_flags(spark, d):
    p = lines(spark, d)
    flags = pg.quality_flags(p, table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct())
    x = flags.join(pg.needs_ocr(p), "doc_id")
    return x.select("doc_id", F.col("page_count").cast("long").alias("page_count"), F.col("text_bytes").cast("long").alias("text_bytes"), F.array_join("quality_flags", ",").alias("flags"), "needs_ocr")


@query
def stub_pages(spark, d):
    x = exact(spark, d)
    x = x.withColumns({"dedupe_kind": F.col("relationship.kind"), "is_redundant": F.col("source_class") == "duplicate"})
    return render.stub(x)


@query
def relationship_lines(spark, d):
    return exact(spark, d).select("doc_id", F.array_join(render.relationship(F.col("relationship.kind"), F.col("relationship.target_doc_id")), "").alias("line"))


def _sync(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.sha2("c_name", 256).alias("sha256"), F.col("c_mktsegment").alias("fingerprint"))
    key = F.when(F.col("k") % 7 != 0, F.concat(F.lit("key"), F.col("k").cast("string")))
    m = s.where("k % 4 <> 0").select("sha256", key.alias("key"), F.when(F.col("k") % 3 == 0, "stale").otherwise(F.col("fingerprint")).alias("last_fingerprint"))
    return sync.plan(s.where("k % 5 <> 0"), m)


@query
def sync_plan(spark, d):
    return _sync(spark, d)


@query
def trim_plan(spark, d):
    return sync.trimmed(_sync(spark, d), 25)


@query
def topk_per_group_scale(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    x = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).alias("rank")).where("rank <= 3")
    return x.withColumn("rank", F.col("rank").cast("long"))


@query
def class_counts_scale(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("lines"), F.count_distinct("l_orderkey").alias("orders"))


@query
def full_update(spark, d):
    kb = update.build(spark, entries(spark, d))
    return reduce(DataFrame.union, [kb.index.select(F.lit("index").alias("part"), F.col("doc_id").cast("string").alias("id"), F.sha2("search_text", 256).alias("hash")), kb.markdown.select(F.lit("page"), F.col("doc_id").cast("string"), F.sha2("markdown", 256)), render.concept(kb.concepts).select(F.lit("concept"), "concept_id", F.sha2("markdown", 256))])


__all__ = ["QUERIES"]
