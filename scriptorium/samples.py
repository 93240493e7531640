"""Literal rows for the queries on patterns that the tables do not have, and the words that they search for."""

QUERY = "the erther"
TERMS = ["erther"]
CONCEPT_QUERY, CONCEPT_TERMS = "sources and materials", ["sources", "materials"]
CLASSED = [
    ("2001-solution.pdf", None, 10), ("x.pdf", "User Guide", 200), ("a.pdf", "Lecture Notes", 30), ("b.pdf", "Sample chapter", 9), ("c.pdf", "Encyclopedia of X", 900),
    ("d.pdf", "Flows", 150), ("e.pdf", "Flows", 80), ("f.pdf", "Flows", 81), ("g.pdf", "Flows", 149), ("h.pdf", None, 0), ("i.pdf", "", 1),
]
PATHS = ["raw/2001-smith-flow_methods.pdf", "raw/C++ Notes.md", "deep/er/1999 x.txt", "plain", "raw/.hidden.txt", "raw/20011-x.pdf", "a/R&D c#.v2.docx"]
NAMED = [
    (2001, "The Theory of Flow in Pipes", "Smith, John", "d1", ".pdf"), (2001, "Flow", "Ann Lee; Bo Ray", "d2", ".pdf"), (None, "Flow and Flow", "A B; C D; E F", "d3", ".md"), (1965, None, None, "1965-notes-x", ".pdf"), (None, None, None, "only-id", ".txt"), (1965, "1965 Report", None, "d6", ".pdf"),
]
IDENTIFIED = ["see 10.1000/xyz-123. for more", "DOI:10.1234/ABC.(5)... end", "no identifier", "ISBN 978-3-16-148410-0", "isbn: 0-306-40615-X text", "13 digits 9783161484100", "10.12/short", ""]
AUTHORS = ["Moser, Robert D.; Kim, John", "J.R. Tolkien", "J.Smith;  K.L.Jones ", "Plato", "A, B, C", " ; ", "Ann  Lee"]
SPECIAL = ["50% & more", "a_b^c~d", "{x} \\ $y #1", "plain", "é ü"]
LINKED = ["[[source/old.id]] and [[source/old.id#p12]]", "[[source/old-id]]", "[[source/oldxid]] [[source/old.id#intro-a]]", "none", "[[source/old.id2]]"]
PAGED = [(1, "one\fTwo words\f \f four"), (2, "\f\f"), (3, "single"), (4, "a\fb\fc")]
MARKDOWN = [(1, "intro\n# First\ntext one\n## Sub part\ntext two\n# Empty\n# Last\nend"), (2, "# Only\nbody"), (3, "no header at all"), (4, "")]
HEADINGS = ["2.3 Title here", "Chapter 4 Flow", "  CHAPTER   12", "2.3", "12.10  Spaced   out", "", "chapter x", "3 Not a section", "Chapter 7: More", "1.2.3 Deep"]
CITED = [
    ("d1", "Flow & Heat", "Ann Lee; Ray, Bo", 2001, "10.1/x", None, "J. Flow", None, "a/x.pdf", "paper"), ("d2", "Book_1", None, 1999, None, "9783161484100", None, "Press", None, "book"), ("d3", "No year", "A B", None, "10.1/y", None, None, None, None, "paper"),
    ("d4", "Notes", "A B", 2000, None, None, None, None, None, "notes"), ("d5", "Dup", "A B", 2000, "10.1/z", None, None, None, None, "duplicate"), ("d6", "Preprint", "Plato", 2020, "10.1/p", None, None, None, "b/p.pdf", "paper"),
]
CITED_SCHEMA = "doc_id string, title string, author string, year int, doi string, isbn string, journal string, publisher string, path string, source_class string"
_BODY = "The finite volume method conserves mass in every cell of the grid and this chapter shows how we will apply it to turbulent flows with boundary layers."
BOOK_PAGES = [
    ("Preface\nThis book provides a comprehensive introduction to turbulence models and finite volume methods for students of engineering and physics."), ("Contents\nChapter 1 Basics .... 3"),
    ("Chapter 1\nBasic Equations\n" + _BODY), ("1.1 Conservation laws\n" + _BODY + " It leads to the navier-stokes equations for incompressible flows in a natural way."), ("1.2 Boundary conditions\nWalls and inlets need boundary conditions that close the system of equations for the numerical solution."),
    ("CHAPTER\n2\nFinite Volume Methods\nThe finite volume method divides the domain into cells, and fluxes through faces are approximated by interpolation schemes."), ("2.1 Interpolation schemes\nUpwind and central schemes differ in accuracy and boundedness, as the examples of this chapter demonstrate in detail."),
    ("Chapter 3 Turbulence\nTurbulence models\nEddy viscosity models relate the Reynolds stresses to the mean velocity gradients with a scalar turbulent viscosity."), ("3.1 Eddy viscosity\nA mixing length gives the simplest closure, whereas two equation models solve transport equations for turbulence quantities."),
]
