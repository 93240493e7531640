"""Scores, penalties and predicates of pages, sentences and fields, as Column expressions.

Weights such as 0.35 are no binary fractions, so scores that use them are decimals or
whole numbers of a unit (twentieths), never doubles: a sum does not depend on its order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scriptorium.functions import lexicons as lx, text as tx


def _equals(term: str):
    return lambda t: t == term


def score2(query: str, text: Column, spark_terms: list[str]) -> Column:
    """Twice the lexical score of a text for a query at weight 1, a whole number.

    Each term (repeats too) that occurs gives 2 and 1 for each further occurrence, up to
    four; the query as a phrase gives 6. spark_terms: the query's terms. Only texts that
    hold a term as they stand are cut into tokens, where all terms are such that no other text can score.
    """
    if not spark_terms:
        return F.lit(0)
    phrase = " ".join(query.lower().split())

    def of(found: Column, low: Column) -> Column:
        score = F.when(low.contains(phrase), 6).otherwise(0)
        for term in spark_terms:
            score = score + occurrences(F.size(F.filter(found, _equals(term))))
        return F.when(F.size(found) > 0, score).otherwise(0)

    def maybe(low: Column) -> Column:
        whole = tx.let(tx.tokens(low), lambda found: of(found, low))
        if any(not t.isascii() or not t.isalnum() or "cpp" in t for t in spark_terms):  # tokens that are spelled otherwise in the text
            return whole
        return F.when(low.isNull() | tx.has_any(low, spark_terms), whole).otherwise(0)

    return tx.let(F.lower(text), maybe)


def occurrences(n: Column) -> Column:
    """Twice the score of a term that a text has n times."""
    return F.when(n > 0, 2 + F.least(n - 1, F.lit(4))).otherwise(0)


def score2_by(query: Column, text: Column) -> Column:
    """The same for a query in a column."""

    def of(found: Column) -> Column:
        add = lambda total, term: total + occurrences(F.size(F.filter(found, lambda t: t == term)))
        terms = tx.query_terms(query)
        score = F.aggregate(terms, F.lit(0), add) + F.when(F.lower(text).contains(tx.compact(F.lower(query))), 6).otherwise(0)
        return F.when((F.size(terms) > 0) & (F.size(found) > 0), score).otherwise(0)

    return tx.let(tx.tokens(text), of)


def terms_of(spark, query: str) -> list[str]:
    return spark.range(1).select(tx.query_terms(F.lit(query)).alias("t")).first()["t"]


def _noisy(p: Column) -> Column:
    """p: a preview, compacted and in lower case."""
    return p.isin(*lx.NOISY_PREVIEWS) | tx.is_digits(p) | p.rlike(tx.ROMAN) | p.startswith("contents") | p.startswith("table of contents")


def preview_is_noisy(preview: Column) -> Column:
    return tx.let(F.lower(tx.compact(preview)), _noisy)


def _signal2(p: Column, low: Column) -> Column:
    parts = (
        F.when(low.isin(*lx.FRONT_MATTER), 10).otherwise(0)
        + F.when(tx.is_digits(p) | p.rlike(tx.ROMAN), 8).otherwise(0)
        + F.when(F.length(p) <= 4, 4).otherwise(0)
        + F.when(tx.is_upper(p) & (F.length(p) <= 16), 3).otherwise(0)
    )
    return F.when(F.coalesce(p, F.lit("")) == "", 8).otherwise(parts)


def signal_penalty2(preview: Column) -> Column:
    """Twice the penalty of a page whose preview says little."""
    return tx.lowered(preview, _signal2)


def noise_penalty2(preview: Column, text: Column, page_no: Column, book: Column) -> Column:
    """Twice the penalty of a page that is front matter or boilerplate."""
    own = signal_penalty2(preview)
    noisy = F.when(preview_is_noisy(F.coalesce(preview, F.lit(""))), 16).otherwise(0)

    def of(t: Column, low: Column) -> Column:
        more = (
            8 * tx.count_of(low, lx.BOILERPLATE)
            + F.when(low.startswith("contents ") | low.startswith("table of contents"), 16).otherwise(0)
            + F.when(low.contains("series editors"), 16).otherwise(0)
            + F.when(low.contains("library of congress"), 12).otherwise(0)
            + F.when(low.contains("all rights reserved"), 16).otherwise(0)
            + F.when(low.contains("printed and bound"), 10).otherwise(0)
        )
        return F.when(t == "", 20).otherwise(more + noisy + F.when(book & (page_no <= 6), 4).otherwise(0))

    return own + tx.lowered(F.coalesce(text, F.lit("")), of)


#: Levels of a profile: the largest weight of a token that counts.
LEVELS = 6


def levels(title_terms: Column, terms: Column) -> Column:
    """A topic's tokens with a weight of at least 1, 2, ... LEVELS, an array each: a title's tokens weigh 8, those of pages one for each time.

    Of sorted tokens, those that the next one equals are the tokens with one occurrence less.
    """

    def of(m: Column, left: int) -> Column:
        own = F.array(F.array_union(title_terms, m))
        fewer = lambda: F.filter(m, lambda t, i: F.get(m, i + 1).eqNullSafe(t))
        return F.concat(own, tx.let(fewer(), lambda x: of(x, left - 1))) if left > 1 else own

    return tx.let(F.array_sort(terms), lambda m: of(m, LEVELS))


def known(terms: Column, profile: Column, most: int) -> Column:
    """Sum over distinct terms of their weights in the profile (levels), each up to ``most``; intersections of sets, no search for each term."""
    total = F.lit(0)
    for k in range(most):
        total = total + F.size(F.array_intersect(terms, F.get(profile, F.lit(k))))
    return total.cast("long")


def _overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def page_score20(preview: Column, text: Column, page_no: Column, title_terms: Column, profile: Column, book: bool = False) -> Column:
    """Twenty times the score of a page as a source for a summary."""
    noise = noise_penalty2(preview, text, page_no, F.lit(book))

    def of(t: Column, low: Column) -> Column:
        terms = F.array_distinct(tx.informative_tokens(F.substring(t, 1, 2000)))
        topical = tx.let(terms, lambda x: 60 * _overlap(title_terms, x) + 7 * known(x, profile, 5))
        score = -10 * noise + topical
        if book:
            cues = lambda p: (
                F.when((p == "preface") | p.startswith("1. introduction"), 200).otherwise(0)
                + F.when(p.startswith("chapter 1"), 100).otherwise(0)
                + F.when(p.contains("introduction"), 80).otherwise(0)
            )
            score = (
                score
                + F.when(low.startswith("preface ") | F.substring(low, 1, 200).contains("preface introduction"), 240).otherwise(0)
                + F.when(low.startswith("introduction "), 200).otherwise(0)
                + tx.let(F.lower(tx.compact(preview)), cues)
                + F.when(page_no.between(7, 40), 80).when(page_no.between(20, 80), 40).when(page_no.between(7, 120), 20).otherwise(0)
                - F.when(page_no <= 6, 200).otherwise(0)
            )
        else:
            score = score + F.when(page_no <= 3, 100).when(page_no <= 8, 40).otherwise(0)
        return F.when(F.length(t) < 140, F.lit(-20000)).otherwise(score)

    return tx.lowered(F.coalesce(text, F.lit("")), of)


def sentence_score20(sentence: Column, title_terms: Column, profile: Column, book: bool = False) -> Column:
    """Twenty times the score of a sentence for a summary."""
    return tx.let(F.array_distinct(tx.informative_tokens(sentence)), lambda terms: scored20(sentence, terms, title_terms, profile, book))


def scored20(sentence: Column, terms: Column, title_terms: Column, profile: Column, book: bool = False) -> Column:
    """The same with the sentence's distinct informative tokens given."""
    return tx.let(F.lower(sentence), lambda low: _scored20(sentence, low, terms, title_terms, profile, book))


def _scored20(sentence: Column, low: Column, terms: Column, title_terms: Column, profile: Column, book: bool) -> Column:
    n = F.size(terms)
    score = 80 * _overlap(title_terms, terms) + 9 * known(terms, profile, 6) + 3 * F.least(n, F.lit(14)) + 60 * tx.count_of(low, lx.SUMMARY_CUES)
    if book:
        score = (
            score
            + F.when(low.contains("this book") | low.contains("this textbook"), 60).otherwise(0)
            + F.when(low.contains("this chapter"), 100).otherwise(0)
            - F.when(~tx.has_any(low, lx.SUMMARY_CUES + lx.OVERVIEW_TERMS), 120).otherwise(0)
            - F.when(low.contains("chapter") & ~low.contains("introduc"), 40).otherwise(0)
            - F.when(tx.char_count(sentence, ":") >= 2, 100).otherwise(0)
        )
    score = (
        score
        - F.when(tx.has_any(low, lx.BOILERPLATE), 240).otherwise(0)
        - F.when(tx.has_any(low, lx.FIGURE_WORDS), 120).otherwise(0)
        - F.when(sentence.contains("@") | low.contains("http") | low.contains("www."), 160).otherwise(0)
        - F.when(tx.is_upper(sentence), 80).otherwise(0)
        - F.when(tx.char_count(sentence, "0-9") >= 8, 100).otherwise(0)
        - F.when(n < 5, 60).otherwise(0)
    )
    return F.when(n == 0, F.lit(-20000)).otherwise(score)


def structural_noise(sentence: Column) -> Column:
    cues = (*lx.BOILERPLATE, *lx.STRUCTURAL_NOISE, *lx.STRUCTURE_WORDS)
    return sentence.rlike(tx.SECTION_NUMBER) | tx.let(F.lower(sentence), lambda low: tx.has_any(low, cues)) | (tx.char_count(sentence, ":") >= 3) | (tx.char_count(sentence, "0-9") >= 8)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def page_counts_close(a: Column, b: Column) -> Column:
    """Within two pages or two in a hundred (rounded to even), or one unknown."""
    known = (F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0)
    return ~known | (F.abs(a - b) <= F.greatest(F.lit(2), F.rint(F.greatest(a, b) * 0.02).cast("int")))
