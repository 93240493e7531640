import pytest
from pyspark.sql import functions as F

from scriptorium.functions import identity as idf, scoring as sc, text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text,want",
    [("C++ and C#/x-1", ["cpp", "and", "c-sharp-x-1"]), ("", []), ("éa b", ["a", "b"]), ("R&D a.b", ["r", "d", "a-b"]), ("x x", ["x", "x"]), (None, None)],
)
def test_tokens(spark, text, want):
    assert one(spark, text, tx.tokens) == want


def test_preview_and_lines(spark):
    assert one(spark, "\n\n  a  b \n c", tx.preview) == "a b"
    assert one(spark, "", tx.preview) == ""
    assert one(spark, "x" * 161, tx.preview) == "x" * 157 + "..."
    assert one(spark, "x" * 160, tx.preview) == "x" * 160
    assert one(spark, "a\r\nb\x0cc\n \nd", tx.lines) == ["a", "b", "c", "d"]
    assert one(spark, None, tx.preview) is None


@pytest.mark.parametrize("p,want", [("Introduction to Finite-Volume methods", "finite volume method"), ("SIMPLER", "simpler method"), ("flow flow flow", "flow"), ("compressible flow", "compressible flows"), ("properties of introduction to x", "introduction to x"), ("", "")])
def test_normal_phrase(spark, p, want):
    assert one(spark, p, tx.normal_phrase) == want


def test_headings(spark):
    assert one(spark, "Chapter 12 Flows", tx.chapter_number) == 12
    assert one(spark, "chapters 1", tx.chapter_number) is None
    assert one(spark, "2.3  Grid  types", tx.section_heading).asDict() == {"chapter": 2, "title": "Grid types"}
    assert one(spark, "2 Grid", tx.section_heading) is None
    assert one(spark, "Chapter 3 1.2 – A", tx.clean_preview) == "A"


def test_singular_and_titled(spark):
    assert one(spark, "studies classes virus axis flows", tx.signature) == ["study", "classe", "virus", "axis", "flow"]
    assert one(spark, "cuda memory-model", tx.titled) == "CUDA Memory-model"


def test_scores(spark):
    assert one(spark, "Flow flow FLOW mesh. finite flow", lambda c: sc.score2("finite flow", c, ["finite", "flow"])) == 2 + (2 + 3) + 6
    assert one(spark, "nothing", lambda c: sc.score2("finite flow", c, ["finite", "flow"])) == 0
    for preview, want in (("", 8), ("contents", 10), ("12", 8 + 4), ("mix", 8 + 4), ("INDEX", 10 + 3), ("A normal preview", 0)):
        assert one(spark, preview, sc.signal_penalty2) == want
    x = spark.createDataFrame([(100, 102), (100, 103), (300, 306), (None, 5), (0, 9)], "a int, b int").select(sc.page_counts_close(F.col("a"), F.col("b")).alias("y"))
    assert [r["y"] for r in x.collect()] == [True, False, True, True, True]


def test_identity(spark):
    assert one(spark, "x 10.1000/ab.c. y", idf.doi) == "10.1000/ab.c"
    assert one(spark, "isbn 0-306-40615-X.", idf.isbn) == "030640615X"
    assert one(spark, "isbn 0-306-40615-X.", lambda c: idf.isbn(c, at_end=True)) is None
    assert one(spark, "Moser, Robert D.; J.R.Smith", idf.normal_authors) == "Robert D. Moser; J. R. Smith"
    assert one(spark, "Ann Lee; Ray, Bo; Plato", idf.bibtex_authors) == "Lee, Ann and Ray, Bo and Plato"
    assert one(spark, None, idf.bibtex_authors) == "Unknown"
    assert one(spark, "raw/2001-Flow.pdf", idf.doc_id) == "2001-flow" and one(spark, "raw/2001-Flow.pdf", idf.path_year) == 2001
    assert one(spark, "a/b.PDF", idf.content_type) == "application/pdf" and one(spark, "a/b", idf.content_type) == "application/octet-stream"


def test_canonical_filename(spark):
    from scriptorium import samples as sa

    x = spark.createDataFrame(sa.NAMED, "year int, title string, author string, doc_id string, suffix string")
    got = {r[0]: r[1] for r in x.select("doc_id", idf.canonical_filename(*(F.col(c) for c in ("year", "title", "author", "doc_id", "suffix")))).collect()}
    assert got == {"d1": "2001-smith-theory-flow-pipes.pdf", "d2": "2001-lee-ray-flow.pdf", "d3": "b-etal-flow.md", "1965-notes-x": "1965-notes-x.pdf", "only-id": "only-id.txt", "d6": "1965-report.pdf"}
