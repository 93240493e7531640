"""Metadata from outside services and language models, through injected clients; offline by default.

A transport is a function url -> (status, body). Responses are parsed by DataFrame
expressions, so recorded responses can be joined like any table.
"""

from __future__ import annotations

import shlex
import subprocess
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from scriptorium.operators.pages import excerpt

Transport = Callable[[str], tuple[int, str | None]]

CROSSREF, DATACITE = "https://api.crossref.org/works/", "https://api.datacite.org/dois/"
OPEN_LIBRARY = "https://openlibrary.org/api/books?bibkeys=ISBN:{}&format=json&jscmd=data"

_CROSSREF = "message struct<title array<string>, author array<struct<given string, family string>>, `published-print` struct<`date-parts` array<array<int>>>, `published-online` struct<`date-parts` array<array<int>>>, publisher string, `container-title` array<string>>"
_DATACITE = "data struct<attributes struct<titles array<struct<title string>>, creators array<struct<givenName string, familyName string, name string>>, publicationYear int, publisher string>>"
_BOOK = "map<string, struct<title string, authors array<struct<name string>>, publish_date string, publishers array<struct<name string>>>>"

RESOLVED = "id string, source string, body string"


def fetch_dois(dois: DataFrame, transport: Transport, id_col: str = "doi") -> DataFrame:
    """(id, source, body): the first service's answer, on 404 the second's; other failures give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d in b[id_col].dropna():
                for source, base in (("crossref", CROSSREF), ("datacite", DATACITE)):
                    try:
                        status, body = transport(base + quote(d))
                    except OSError:
                        break
                    if status == 200:
                        rows.append((d, source, body))
                    if status != 404:
                        break
            yield pd.DataFrame(rows, columns=["id", "source", "body"])

    return dois.select(id_col).distinct().mapInPandas(run, RESOLVED)


def fetch_isbns(isbns: DataFrame, transport: Transport, id_col: str = "isbn") -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i in b[id_col].dropna():
                try:
                    status, body = transport(OPEN_LIBRARY.format(i))
                except OSError:
                    continue
                if status == 200:
                    rows.append((i, "openlibrary", body))
            yield pd.DataFrame(rows, columns=["id", "source", "body"])

    return isbns.select(id_col).distinct().mapInPandas(run, RESOLVED)


def _joined(names: Column) -> Column:
    kept = F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "")
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def parsed(responses: DataFrame) -> DataFrame:
    """(id, title, author, year, publisher, journal, metadata_source)."""
    c = F.from_json("body", _CROSSREF)["message"]
    d = F.from_json("body", _DATACITE)["data"]["attributes"]
    b = F.try_element_at(F.from_json("body", _BOOK), F.concat(F.lit("ISBN:"), F.col("id")))
    full = lambda given, family: F.btrim(F.concat_ws(" ", given, family))
    people_c = F.transform(c["author"], lambda a: full(a["given"], a["family"]))
    people_d = F.transform(d["creators"], lambda a: F.coalesce(F.nullif(full(a["givenName"], a["familyName"]), F.lit("")), a["name"]))
    year_c = F.coalesce(c["published-print"]["date-parts"][0][0], c["published-online"]["date-parts"][0][0])
    year_b = F.regexp_extract(F.coalesce(b["publish_date"], F.lit("")), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")
    source = F.col("source")
    pick = lambda x, y, z: F.when(source == "crossref", x).when(source == "datacite", y).otherwise(z)
    out = responses.select(
        "id", pick(F.get(c["title"], F.lit(0)), F.get(d["titles"]["title"], F.lit(0)), b["title"]).alias("title"), pick(_joined(people_c), _joined(people_d), _joined(b["authors"]["name"])).alias("author"),
        pick(year_c, d["publicationYear"], year_b).alias("year"), pick(c["publisher"], d["publisher"], F.get(F.filter(b["publishers"]["name"], lambda n: F.coalesce(n, F.lit("")) != ""), F.lit(0))).alias("publisher"),
        pick(F.get(c["container-title"], F.lit(0)), d["publisher"], F.lit(None).cast("string")).alias("journal"), source.alias("metadata_source"),
    )
    return out.where((F.col("metadata_source") != "openlibrary") | F.col("title").isNotNull() | F.col("author").isNotNull())


def enriched(entries: DataFrame, by_doi: DataFrame, by_isbn: DataFrame) -> DataFrame:
    """``entries`` (title, author, year, doi, isbn, …) with what the services know first, the DOI's answer before the ISBN's."""
    fields = ("title", "author", "year", "publisher", "journal", "metadata_source")
    x = entries
    for name, found in (("doi", by_doi), ("isbn", by_isbn)):
        x = x.join(found.select(F.col("id").alias(f"_{name}"), *(F.col(f).alias(f"_{name}_{f}") for f in fields)), F.col(name) == F.col(f"_{name}"), "left")
    old = lambda f: F.col(f) if f in entries.columns else F.lit(None).cast("int" if f == "year" else "string")
    new = {f: F.coalesce(F.col(f"_doi_{f}"), F.col(f"_isbn_{f}"), old(f)) for f in fields}
    return x.withColumns(new).select(*entries.columns, *(f for f in fields if f not in entries.columns))


def asked(texts: DataFrame, model: Callable[[str], str | None], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, answer): a language model's answer to each text; null where it fails, never an error text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for t in b[text_col]:
                try:
                    answers.append(model(t))
                except Exception:  # noqa: BLE001  any client may raise anything; the row stays without an answer
                    answers.append(None)
            yield pd.DataFrame({id_col: b[id_col], "answer": answers})

    return texts.select(id_col, text_col).mapInPandas(run, f"{id_col} {dict(texts.dtypes)[id_col]}, answer string")


def summary_prompt(title: Column, text: Column, most: int = 15000) -> Column:
    return F.concat(F.lit("Summarize in one paragraph.\nTitle: "), title, F.lit("\n\n"), F.substring(text, 1, most))


def answered_metadata(answers: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, title, author, year) from answers in JSON, with or without code fences."""
    bare = F.btrim(F.regexp_replace("answer", r"(?s)^\s*```(?:json)?|```\s*$", ""))
    m = F.from_json(bare, "title string, author string, year int")
    return answers.select(id_col, m["title"].alias("title"), m["author"].alias("author"), m["year"].alias("year")).where("title is not null or author is not null or year is not null")


def incomplete(entries: DataFrame) -> DataFrame:
    """Entries that lack a title, an author or a year."""
    return entries.where((F.coalesce("title", F.lit("")) == "") | (F.coalesce("author", F.lit("")) == "") | F.col("year").isNull())


def book_summary(chapters: DataFrame, map_model: Callable[[str], str | None], reduce_model: Callable[[str], str | None]) -> DataFrame:
    """(doc_id, answer): a model's sentence for each chapter's first 4000 characters, then its summary of these."""
    maps = asked(chapters.select(F.struct("doc_id", "chapter_number").alias("key"), summary_prompt(F.col("title"), F.substring("text", 1, 4000)).alias("text")), map_model, "key")
    x = maps.where("answer is not null").groupBy(F.col("key.doc_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("key.chapter_number").alias("n"), "answer"))).alias("a"))
    return asked(x.select("doc_id", F.array_join("a.answer", "\n").alias("text")), reduce_model)


def http(url: str, seconds: float = 10.0) -> tuple[int, str | None]:
    """A transport over the network."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "scriptorium"}), timeout=seconds) as r:
            return r.status, r.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, None


def command_model(command: str) -> Callable[[str], str | None]:
    """A language model behind a program that gets the prompt and prints the answer; a failing call raises."""
    parts = shlex.split(command)

    def ask(prompt: str) -> str | None:
        done = subprocess.run(parts, input=prompt.encode(), capture_output=True, check=True)
        return done.stdout.decode("utf-8", "replace").strip() or None

    return ask


def resolved(entries: DataFrame, transport: Transport) -> DataFrame:
    """``entries`` with what the services know about their identifiers."""
    return enriched(entries, parsed(fetch_dois(entries, transport)), parsed(fetch_isbns(entries, transport)))


def metadata_prompt(text: Column) -> Column:
    return F.concat(F.lit("Give title, author and year of this document as JSON with the keys title, author, year; null where unknown.\n\n"), text)


def recovered(entries: DataFrame, pages: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """(doc_id, title, author, year) that a model reads from the first pages of incomplete entries; what was known stays."""
    lacking = incomplete(entries).select("doc_id", "title", "author", "year")
    texts = excerpt(pages).join(lacking, "doc_id", "left_semi").select("doc_id", metadata_prompt(F.col("text")).alias("text"))
    found = answered_metadata(asked(texts, model)).select("doc_id", *(F.col(c).alias(f"_{c}") for c in ("title", "author", "year")))
    return lacking.join(found, "doc_id").select("doc_id", *(F.coalesce(F.nullif(F.col(c), F.lit("")) if c != "year" else F.col(c), F.col(f"_{c}")).alias(c) for c in ("title", "author", "year")))
