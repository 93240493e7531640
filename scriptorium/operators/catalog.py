"""The catalog: one row per document, exact duplicates, overrides, statistics, change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.functions import identity as idf, lexicons as lx, text as tx


def from_documents(documents: DataFrame) -> DataFrame:
    """Catalog rows of a table of texts (doc_id, text, source): the title is the first line, a page is a line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id", "source", text.alias("text"), F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.lit(None).cast("int").alias("year"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size_bytes"),
        F.size(tx.lines(text)).alias("page_count"), tx.preview(text).alias("title"), F.lit(None).cast("string").alias("author"),
    )
    return rows.withColumn("source_class", idf.source_class(F.col("filename"), F.col("title"), F.col("page_count")))


def resolve_exact(entries: DataFrame) -> DataFrame:
    """``entries`` with canonical_doc_id and relationship: of rows with equal sha256 one is canonical, the others become class duplicate.

    The canonical row comes from a grouped minimum, which is combined before the shuffle,
    so a hash that very many rows share is no burden.
    """
    rank = idf.copy_rank(F.col("filename"), F.col("year"), lx.COPY_WORDS_EXACT)
    best = entries.groupBy("sha256").agg(F.min(F.struct(rank.alias("rank"), F.col("doc_id").alias("id"))).alias("best"), F.count("*").alias("copies"))
    x = entries.join(best.select("sha256", F.col("best.id").alias("canonical_doc_id"), "copies"), "sha256")
    other = (F.col("copies") > 1) & (F.col("canonical_doc_id") != F.col("doc_id"))
    relation = F.when(other, F.struct(F.lit("exact_duplicate_of").alias("kind"), F.col("canonical_doc_id").alias("target_doc_id")))
    return x.withColumns({"relationship": relation, "source_class": F.when(other, "duplicate").otherwise(F.col("source_class"))}).drop("copies")


def unique_ids(entries: DataFrame, id_col: str, order: str) -> DataFrame:
    """``entries`` whose id gets ``-n`` from its second occurrence on, in ``order``; a suffixed id that exists already is counted on."""
    w = Window.partitionBy(id_col).orderBy(order)
    out = entries.withColumn("_n", F.row_number().over(w))
    taken = entries.select(F.col(id_col).cast("string").alias("_taken")).distinct()
    plain = F.col(id_col).cast("string")
    fresh = F.when(F.col("_n") == 1, plain).otherwise(F.concat(plain, F.lit("-"), F.col("_n").cast("string")))
    out = out.withColumn("_new", fresh).join(taken, (F.col("_n") > 1) & (F.col("_new") == F.col("_taken")), "left")
    clash = F.col("_taken").isNotNull()
    return out.withColumn(id_col, F.when(clash, F.concat(F.col("_new"), F.lit("-"), F.substring(F.sha2(F.col(order).cast("string"), 256), 1, 8))).otherwise(F.col("_new"))).drop("_n", "_new", "_taken")


def override(entries: DataFrame, overrides: DataFrame, key: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """``entries`` with the columns of the override row of the same key, nulls included; new columns are added."""
    columns = columns or [c for c in overrides.columns if c != key]
    o = overrides.select(F.col(key).alias("_key"), F.lit(True).alias("_given"), *(F.col(c).alias(f"_{c}") for c in columns))
    x = entries.join(o, entries[key] == F.col("_key"), "left")
    for c in columns:
        x = x.withColumn(c, F.when(F.col("_given"), F.col(f"_{c}")).otherwise(F.col(c) if c in entries.columns else F.lit(None)))
    return x.drop("_key", "_given", *(f"_{c}" for c in columns))


def class_counts(entries: DataFrame, spark: SparkSession, class_col: str = "source_class") -> DataFrame:
    """(source_class, documents) with a row for each known class, zero where it has none."""
    known = spark.createDataFrame([(c,) for c in lx.SOURCE_CLASSES], f"{class_col} string")
    return entries.groupBy(class_col).agg(F.count("*").alias("documents")).join(known, class_col, "full_outer").select(class_col, F.coalesce("documents", F.lit(0)).alias("documents"))


def statistics(entries: DataFrame) -> DataFrame:
    """One row: document_count, duplicate_group_count."""
    groups = entries.groupBy("sha256").agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("document_count"), F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_group_count"))


def changes(now: DataFrame, before: DataFrame, key: str = "path", same: tuple[str, ...] = ("size_bytes",)) -> DataFrame:
    """(key, action): reuse, build or remove, by the columns ``same``."""
    a = now.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_a_{c}") for c in same))
    b = before.select(F.col(key).alias("_b"), *(F.col(c).alias(f"_b_{c}") for c in same))
    equal = F.lit(True)
    for c in same:
        equal = equal & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    x = a.join(b, F.col("_k") == F.col("_b"), "full_outer")
    return x.select(F.coalesce("_k", "_b").alias(key), F.when(F.col("_k").isNull(), "remove").when(F.col("_b").isNotNull() & equal, "reuse").otherwise("build").alias("action"))


def incoming_plan(incoming: DataFrame, catalog: DataFrame) -> DataFrame:
    """(path, target, action) of files in the incoming folder: those with a known hash are rejected, the others go to the library under their canonical name."""
    known = catalog.select(F.col("sha256")).distinct()
    x = incoming.join(known.withColumn("_seen", F.lit(True)), "sha256", "left")
    suffix = F.regexp_extract(F.col("path"), r"(\.[^./]+)$", 1)
    name = idf.canonical_filename(F.col("year"), F.col("title"), F.col("author"), F.col("doc_id"), suffix)
    dup = F.coalesce("_seen", F.lit(False))
    named = x.select("path", F.when(dup, F.concat(F.lit("rejected/duplicates/"), F.substring_index("path", "/", -1))).otherwise(F.concat(F.lit("library/"), name)).alias("target"), F.when(dup, "reject").otherwise("move").alias("action"))
    n = F.row_number().over(Window.partitionBy("target").orderBy("path"))
    numbered = F.when(F.col("n") == 1, F.col("target")).otherwise(F.regexp_replace("target", r"(\.[^./]*)$", F.concat(F.lit("-"), F.col("n").cast("string"), F.lit("$1"))))
    return named.withColumn("n", n).select("path", numbered.alias("target"), "action")


def set_status(entries: DataFrame, ids: list, status: str, reason: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """``entries`` with a status and reason on the given ids; unknown ids change nothing."""
    hit = F.col(id_col).isin(*ids) if ids else F.lit(False)
    old = lambda c: F.col(c) if c in entries.columns else F.lit(None).cast("string")
    return entries.withColumns({"status": F.when(hit, status).otherwise(old("status")), "status_reason": F.when(hit, F.lit(reason)).otherwise(old("status_reason"))})


def keep_ids(df: DataFrame, ids: list, id_col: str = "doc_id") -> DataFrame:
    """The rows of the given ids; all rows for an empty list."""
    return df.where(F.col(id_col).isin(*ids)) if ids else df


def one(df: DataFrame, id_: object, id_col: str = "doc_id") -> DataFrame:
    """The row of an id; ValueError if there is none."""
    out = df.where(F.col(id_col) == id_)
    if out.isEmpty():
        raise ValueError(f"no row with {id_col} {id_!r}")
    return out


def orphans(artifacts: DataFrame, catalog: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Artifacts whose document is not in the catalog."""
    return artifacts.join(catalog.select(id_col), id_col, "left_anti")


def rename(df: DataFrame, old: object, new: object, id_col: str = "doc_id") -> DataFrame:
    """``df`` with the new id wherever it refers to a document: the id itself, the canonical one, a relationship's target, lists of supporting documents."""
    named = lambda c: F.when(c == old, F.lit(new)).otherwise(c)
    changed = {c: named(F.col(c)) for c in (id_col, "canonical_doc_id") if c in df.columns}
    if "relationship" in df.columns:
        changed["relationship"] = F.col("relationship").withField("target_doc_id", named(F.col("relationship.target_doc_id")))
    if "supporting_doc_ids" in df.columns:
        changed["supporting_doc_ids"] = F.transform("supporting_doc_ids", named)
    if "entry" in df.columns:  # the key of a BibTeX entry
        changed["entry"] = F.replace("entry", F.lit(f"{{{old},"), F.lit(f"{{{new},"))
    return df.withColumns(changed)


def relinked(df: DataFrame, old: str, new: str, columns: tuple[str, ...] = ("wiki_link", "markdown", "summary", "related")) -> DataFrame:
    """``df`` whose texts, and lists of texts, link to the new id."""
    kinds = dict(df.dtypes)
    texts = {c: relink(F.col(c), old, new) for c in columns if kinds.get(c) == "string"}
    lists = {c: F.transform(c, lambda x: relink(x, old, new)) for c in columns if kinds.get(c) == "array<string>"}
    return df.withColumns(texts | lists)


def live(entries: DataFrame) -> DataFrame:
    """``entries`` without the rejected ones."""
    return entries.where(F.coalesce("status", F.lit("")) != "rejected") if "status" in entries.columns else entries


def relink(text: Column, old: str, new: str) -> Column:
    """Links to a source, with or without a page, lead to its new id."""
    quoted = r"\Q" + old + r"\E"
    return F.regexp_replace(text, rf"\[\[source/{quoted}(#[A-Za-z0-9-]+)?\]\]", f"[[source/{new}$1]]")
