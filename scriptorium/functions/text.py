"""Text normalisers and tokenisers as Column expressions.

Every function takes and gives Columns and stays in the JVM. A null text gives null,
unless a function says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from scriptorium.functions import lexicons as lx

TOKEN = r"[a-z0-9][a-z0-9+#./-]*"
LINE_BREAK = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85  ]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
ROMAN = r"(?i)^[ivxlcdm]+$"
SECTION_NUMBER = r"^\d+(\.\d+)*\b"


def let(value: Column, body) -> Column:
    """body(x) with x bound to ``value``, which is computed once for each row however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def has_any(text: Column, fragments: Sequence[str]) -> Column:
    """Whether the text holds one of the fragments."""
    out = F.lit(False)
    for f in dict.fromkeys(fragments):
        out = out | text.contains(f)
    return out


def count_of(text: Column, fragments: Sequence[str]) -> Column:
    """How many of the fragments the text holds; a fragment listed twice counts twice."""
    out = F.lit(0)
    for f in fragments:
        out = out + text.contains(f).cast("int")
    return out


def char_count(text: Column, kind: str) -> Column:
    """Characters of a regular expression's class."""
    return F.length(F.regexp_replace(text, f"[^{kind}]", ""))


def is_upper(text: Column) -> Column:
    """Upper case, with at least one letter that has case."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def is_digits(text: Column) -> Column:
    return text.rlike(r"(?U)^\d+$")


def compact(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" "))


def lowered(text: Column, body) -> Column:
    """body(t, low) with the compacted text and its lower case, each computed once for each row."""
    return let(compact(text), lambda t: let(F.lower(t), lambda low: body(t, low)))


def normal_token(token: Column) -> Column:
    """Lower case, with c++, c# and & spelled out and no punctuation at the ends."""
    t = F.lower(token)
    for sign, word in (("c++", "cpp"), ("c#", "c-sharp"), ("&", "and")):
        t = F.replace(t, F.lit(sign), F.lit(word))
    return F.btrim(t, F.lit(".-_/"))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(normal_token(text), "[^a-z0-9]+", "-"), F.lit("-"))


def tokens(text: Column) -> Column:
    """Tokens in order, repeats included; an empty array for a text without any."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)
    # most tokens are letters and digits alone and stay as they are
    return F.filter(F.transform(found, lambda t: F.when(F.translate(t, "+#./-", "") == t, t).otherwise(slug(t))), lambda t: t != "")


def _kept(text: Column, least: int, *banned: Sequence[str], digits: bool = False) -> Column:
    def keep(t: Column) -> Column:
        ok = F.length(t) >= least
        for values in banned:
            ok = ok & ~t.isin(*values)
        return ok if digits else ok & ~t.rlike("^[0-9]+$")

    return F.filter(tokens(text), keep)


def query_terms(text: Column) -> Column:
    """Tokens to search for: no stopwords, two characters at least; repeats count."""
    return _kept(text, 2, lx.STOPWORDS, digits=True)


def informative_tokens(text: Column) -> Column:
    """Tokens that say what a text is about."""
    return _kept(text, 3, lx.STOPWORDS, lx.SUMMARY_GENERIC)


def phrase_tokens(text: Column) -> Column:
    """Tokens that phrases and shingles are made of."""
    return _kept(text, 3, lx.STOPWORDS)


def keyword_tokens(text: Column) -> Column:
    """Tokens that can be keywords by themselves."""
    return _kept(text, 3, lx.STOPWORDS, lx.SUMMARY_GENERIC, lx.WEAK_KEYWORDS)


def lines(text: Column, limit: int | None = None) -> Column:
    """Lines that are not blank, compacted."""
    out = F.filter(F.transform(F.split(text, LINE_BREAK), compact), lambda x: x != "")
    return out if limit is None else F.slice(out, 1, limit)


def preview(text: Column, most: int = 160) -> Column:
    """The first line that is not blank, shortened with dots; empty if there is none."""
    cut = lambda x: F.concat(F.rtrim(F.substring(x, 1, most - 3)), F.lit("..."))
    first = F.coalesce(F.get(lines(text), F.lit(0)), F.lit(""))
    return let(first, lambda x: F.when(text.isNull(), None).when(F.length(x) > most, cut(x)).otherwise(x))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def clean_preview(text: Column) -> Column:
    """A preview without a leading chapter or section number; long dashes become spaces."""
    t = compact(text)
    t = F.regexp_replace(t, r"(?iU)^chapter\s+\d+\s*", "")
    t = F.regexp_replace(t, r"(?U)^\d+(?:\.\d+)*\s*", "")
    return compact(F.translate(t, "–—", "  "))


def chapter_number(text: Column) -> Column:
    """The number after a leading ``chapter``, or null."""
    return F.regexp_extract(F.lower(compact(text)), r"(?U)^chapter\s+(\d+)\b", 1).try_cast("int")


def section_heading(text: Column) -> Column:
    """struct(chapter, title) of a heading like ``2.3 Title``, or null."""
    pattern = r"^(\d+)\.(\d+)\s+(.+)$"
    return let(compact(text), lambda t: F.when(t.rlike(pattern), F.struct(F.regexp_extract(t, pattern, 1).try_cast("int").alias("chapter"), compact(F.regexp_extract(t, pattern, 3)).alias("title"))))


def normal_phrase(phrase: Column) -> Column:
    """A keyword phrase by the fixed rewrites, each applied once, in order."""
    p = F.translate(F.lower(compact(phrase)), "–—", "--")
    for joined in ("finite-volume", "finite-difference"):
        p = F.replace(p, F.lit(joined), F.lit(joined.replace("-", " ")))
    for prefix in lx.PHRASE_PREFIXES:
        p = F.regexp_replace(p, f"^{prefix}", "")
    for pattern, new in lx.PHRASE_REWRITES:
        p = F.regexp_replace(p, pattern, new)

    def ended(parts: Column, p: Column) -> Column:
        last = F.element_at(parts, -1)
        one = F.create_map(*(F.lit(x) for pair in lx.LAST_WORDS.items() for x in pair))
        joined = F.array_join(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.coalesce(F.try_element_at(one, last), last))), " ")
        return F.when(F.size(parts) > 0, joined).otherwise(p)

    p = let(p, lambda x: let(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != ""), lambda parts: ended(parts, x)))
    return F.regexp_replace(p, "^(compressible|incompressible) flow$", "$1 flows")


def _needed(pattern: str) -> str:
    """What stands in every match of a fixed pattern: its characters before the first that is optional or a class."""
    head = re.match(r"[^?\[]*", pattern).group()
    return head[:-1] if pattern[len(head):].startswith("?") else head


def explicit_phrases(text: Column) -> Column:
    """Matches of the fixed domain patterns, normalised, in the order of the patterns; only texts that can hold one are searched."""

    def of(t: Column) -> Column:
        found = [F.regexp_extract_all(t, F.lit(rf"(?i)(\b{p}\b)"), 1) for p in lx.EXPLICIT_PATTERNS]
        some = let(F.lower(t), lambda low: has_any(low, [_needed(p) for p in lx.EXPLICIT_PATTERNS]))
        return F.when(t.isNull() | some, F.transform(F.flatten(F.array(*found)), normal_phrase)).otherwise(F.array().cast("array<string>"))

    return let(text, of)


def singular(token: Column) -> Column:
    long = F.length(token) > 4
    return (
        F.when(token.endswith("ies") & long, F.concat(F.substring(token, F.lit(1), F.length(token) - 3), F.lit("y")))
        .when(token.endswith("s") & long & ~token.rlike("(ss|us|is)$"), F.substring(token, F.lit(1), F.length(token) - 1))
        .otherwise(token)
    )


def signature(phrase: Column) -> Column:
    """The singular words of a phrase."""
    return F.transform(F.split(phrase, " "), singular)


def plural_signature(phrase: Column) -> Column:
    """The words of a phrase without a final s where they have more than four letters."""
    return F.transform(F.split(phrase, " "), lambda t: F.when(t.endswith("s") & (F.length(t) > 4), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def titled(phrase: Column) -> Column:
    """Each word with a capital, or as the display list has it."""
    known = F.create_map(*(F.lit(x) for pair in lx.DISPLAY_WORDS.items() for x in pair))
    return F.array_join(F.transform(F.split(phrase, " "), lambda t: F.coalesce(F.try_element_at(known, t), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1_000_000))))), " ")


def has_concept_noise(text: Column) -> Column:
    """Blank, or with a fragment that titles of no use have."""
    return F.coalesce(let(F.lower(compact(text)), lambda t: (t == "") | has_any(t, lx.CONCEPT_NOISE)), F.lit(True))


def ngrams(parts: Column, n: int) -> Column:
    """All runs of n elements, as arrays; empty if there are fewer."""
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(0), F.size(parts) - n), lambda i: F.slice(parts, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def concept_phrase(parts: Column) -> Column:
    """Whether 2 or 3 tokens can name a concept."""
    edges = F.get(parts, F.lit(0)).isin(*lx.CONCEPT_GENERIC) | F.element_at(parts, -1).isin(*lx.CONCEPT_GENERIC)
    inner = F.exists(parts, lambda t: t.rlike("^[0-9]+$") | t.isin(*lx.CONCEPT_GENERIC_INNER))
    return F.size(parts).between(2, 3) & ~edges & ~inner & ~F.array_join(parts, " ").isin(*lx.CONCEPT_GENERIC_PHRASES)


def count_where(parts: Column, test) -> Column:
    return F.size(F.filter(parts, test))


def keyword_phrases(parts: Column, title: Column) -> Column:
    """The distinct phrases of 2 to 4 tokens that can be keyword phrases beside a title's tokens, as texts; those of two tokens come first.

    What a token is by itself is found once, not in each phrase that holds it.
    """

    def marked(t: Column) -> Column:
        generic = t.isin(*lx.PHRASE_GENERIC)
        return F.struct(t.alias("t"), generic.alias("generic"), (generic & ~t.isin(*lx.PHRASE_EDGES)).alias("edge"), (t.isin(*lx.DOMAIN_TOKENS) | F.array_contains(title, t)).alias("topical"))

    def valid(g: Column) -> Column:
        return ~F.get(g, F.lit(0))["edge"] & ~F.element_at(g, -1)["edge"] & F.exists(g, lambda m: m["topical"]) & (count_where(g, lambda m: ~m["generic"]) >= 2)

    def of(m: Column) -> Column:
        runs = lambda n: F.when(F.size(m) >= n, F.transform(F.sequence(F.lit(0), F.size(m) - n), lambda i: F.slice(m, i + 1, n))).otherwise(F.slice(F.array(m), 1, 0))
        return F.array_distinct(F.transform(F.filter(F.flatten(F.array(*(runs(n) for n in (2, 3, 4)))), valid), lambda g: F.array_join(g["t"], " ")))

    return let(F.transform(parts, marked), of)


def phrase_score2(parts: Column, title: Column, book: bool = False) -> Column:
    """Twice the score of a keyword phrase, an integer."""
    score = 5 * count_where(parts, lambda t: t.isin(*lx.DOMAIN_TOKENS)) + 4 * count_where(parts, lambda t: F.array_contains(title, t))
    score = score + F.when(F.size(parts) >= 2, 2).otherwise(0) + F.when(F.element_at(parts, -1).isin(*lx.METHOD_ENDS), 2).otherwise(0)
    return score + F.when(F.exists(parts, lambda t: t.isin(*lx.BOOK_SPECIALS)), 3).otherwise(0) if book else score
