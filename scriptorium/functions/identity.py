"""Identifiers, names, classes and fingerprints of documents, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions import lexicons as lx, text as tx

DOI = r"(?i)(10\.\d{4,9}/[-._;()/:A-Z0-9]+)"
#: Ten digits (the last may be X), or thirteen that begin with 978 or 979, with single spaces or hyphens between them.
ISBN = r"(?i)(?<![0-9])((?:97[89][- ]?)?(?:[0-9][- ]?){9}[0-9X])(?![0-9])"


def doi(text: Column) -> Column:
    """The first DOI, without dots at its end; null if there is none."""
    return F.nullif(F.regexp_replace(F.regexp_extract(text, DOI, 1), r"\.+$", ""), F.lit(""))


def isbn(text: Column, at_end: bool = False) -> Column:
    """The first ISBN's digits; with at_end only one that ends the text."""
    found = F.regexp_extract(text, ISBN + (r"$" if at_end else ""), 1)
    digits = F.regexp_replace(F.upper(found), "[^0-9X]", "")
    return F.when(F.length(digits).isin(10, 13), digits)


def head(text: Column, most: int = 15000) -> Column:
    """The part of a text that identifiers are looked for in."""
    return F.substring(text, 1, most)


def people(authors: Column) -> Column:
    """The entries of a list with semicolons, trimmed, none blank."""
    return F.filter(F.transform(F.split(authors, ";"), lambda a: tx.compact(a)), lambda a: a != "")


def _name_parts(person: Column) -> Column:
    return F.filter(F.transform(F.split(person, ","), lambda p: F.btrim(p)), lambda p: p != "")


def normal_authors(authors: Column) -> Column:
    """``Last, First`` turned round, initials spaced, joined by semicolons; null for an empty list."""

    def one(a: Column) -> Column:
        parts = F.transform(F.split(a, ","), lambda p: F.btrim(p))
        a = F.when(F.size(parts) == 2, F.concat_ws(" ", F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).otherwise(a)
        a = F.regexp_replace(tx.compact(a), r"([A-Z]\.)([A-Z][a-z])", "$1 $2")
        return F.btrim(F.regexp_replace(a, r"([A-Z]\.)([A-Z]\.)", "$1 $2"))

    return F.when(F.coalesce(authors, F.lit("")) == "", None).otherwise(F.array_join(F.transform(people(authors), one), "; "))


def creators(authors: Column) -> Column:
    """array<struct<last, first, name>> of the people; name only for those of one word."""

    def one(a: Column) -> Column:
        comma, space = _name_parts(a), F.split(a, " ")
        has_comma = a.contains(",") & (F.size(comma) >= 2)
        several = F.size(space) >= 2
        last = F.when(has_comma, F.get(comma, F.lit(0))).when(several, F.element_at(space, -1))
        first = F.when(has_comma, F.array_join(F.slice(comma, 2, 1_000_000), " ")).when(several, F.array_join(F.slice(space, 1, F.size(space) - 1), " "))
        return F.struct(last.alias("last"), first.alias("first"), F.when(last.isNull(), a).alias("name"))

    return F.transform(people(F.coalesce(authors, F.lit(""))), one)


def bibtex_authors(authors: Column) -> Column:
    """``Family, Given`` joined by ``and``; ``Unknown`` for an empty list."""
    joined = F.array_join(F.transform(creators(authors), lambda c: F.coalesce(c["name"], F.concat_ws(", ", c["last"], c["first"]))), " and ")
    return F.when(F.coalesce(authors, F.lit("")) == "", "Unknown").otherwise(joined)


def stem(path: Column) -> Column:
    """The file's name without folder and last suffix."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")


def doc_id(path: Column) -> Column:
    return tx.slug(stem(path))


def path_year(path: Column) -> Column:
    """The year that a file's name begins with, or null."""
    return F.nullif(F.regexp_extract(stem(path), r"^(\d{4})-", 1), F.lit("")).cast("int")


def source_class(filename: Column, title: Column, pages: Column) -> Column:
    """The class by words in the name or title, else by the number of pages."""
    name, head_ = F.lower(filename), F.lower(F.coalesce(title, F.lit("")))
    n = F.coalesce(pages, F.lit(0))
    out = F.when(F.lit(False), "")
    for label, hints in lx.CLASS_WORDS:
        out = out.when(tx.has_any(name, hints) | tx.has_any(head_, hints), label)
    return out.when(n >= 150, "book").when(n.between(1, 80), "paper").when(n.between(81, 149), "reference").otherwise("unknown")


def _last_name(person: Column) -> Column:
    return F.btrim(F.when(person.contains(","), F.substring_index(person, ",", 1)).otherwise(F.substring_index(person, " ", -1)))


def canonical_filename(year: Column, title: Column, author: Column, doc: Column, suffix: Column) -> Column:
    """``year-authors-short-title`` as a slug, no part twice in a row."""
    who = F.filter(F.transform(F.split(F.coalesce(author, F.lit("")), ";"), lambda a: F.btrim(a)), lambda a: a != "")
    one, two = _last_name(F.get(who, F.lit(0))), _last_name(F.get(who, F.lit(1)))
    n = F.size(who)
    names = F.when(n == 1, one).when(n == 2, F.concat_ws("-", one, two)).when(n >= 3, F.concat(one, F.lit("-etal")))
    kept = F.filter(F.split(F.coalesce(title, F.lit("")), r"(?U)\W+"), lambda w: ~F.lower(w).isin(*lx.TITLE_SMALL_WORDS))
    short = F.nullif(F.array_join(F.slice(kept, 1, 4), " "), F.lit(""))
    known = F.when(year != 0, year.cast("string"))
    bare = F.when(known.isNotNull() & F.startswith(doc, known), F.ltrim(F.substring(doc, F.length(known) + 1, F.length(doc)), F.lit("-_ "))).otherwise(doc)
    rest = F.when(names.isNull() & short.isNull(), F.nullif(bare, F.lit("")))
    parts = F.split(tx.slug(F.concat_ws("-", known, names, short, rest)), "-")
    once = F.filter(parts, lambda p, i: (i == 0) | (p != F.get(parts, i - 1)))
    whole = F.array_join(once, "-")
    empty = known.isNull() & names.isNull() & short.isNull() & rest.isNull()
    return F.concat(F.when(empty, "untitled-document").otherwise(whole), suffix)


def copy_rank(filename: Column, year: Column, words: tuple[str, ...], *missing: Column) -> Column:
    """A struct that is least for the document of a group to keep: few signs of a copy, late year, short name."""
    name = F.lower(filename)
    signs = tx.count_of(name, words) + name.endswith("2.pdf").cast("int")
    for m in missing:
        signs = signs + (F.coalesce(m, F.lit("")) == "").cast("int")
    return F.struct(signs.alias("signs"), (-F.coalesce(year, F.lit(0))).alias("year"), F.length(name).alias("length"), name.alias("name"))


def citeable(title: Column, year: Column, doi_: Column, isbn_: Column, included: Column) -> Column:
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return filled(title) & (F.coalesce(year, F.lit(0)) != 0) & (F.coalesce(included, F.lit(False)) | filled(doi_) | filled(isbn_))


def entry_type(doi_: Column, isbn_: Column, journal: Column, class_: Column, article: str, book: str, other: str) -> Column:
    filled = lambda x: F.coalesce(x, F.lit("")) != ""
    return F.when(filled(doi_) & filled(journal), article).when(filled(isbn_) | (F.coalesce(class_, F.lit("")) == "book"), book).when(filled(doi_), article).otherwise(other)


def content_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in lx.MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("application/octet-stream"))


FINGERPRINTED = ("author", "doc_id", "doi", "isbn", "journal", "path", "publisher", "source_class", "title", "year")


def fingerprint(*fields: str) -> Column:
    """SHA-256 of the fields as JSON with sorted keys and explicit nulls."""
    return F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
