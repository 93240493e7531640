"""Word lists and fixed values of the document operators.

The lists here are fixed values: results depend on each entry.
"""

from __future__ import annotations

# Fixed values.
SOURCE_CLASSES = (
    "book", "paper", "notes", "manual", "solution_manual", "excerpt", "duplicate", "reference", "unknown",
)
FILE_SUFFIXES = (
    ".pdf", ".epub", ".docx", ".md", ".txt", ".rst", ".html", ".htm",
)
STOPWORDS = (
    "a", "about", "above", "after", "again", "against", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other",
    "our", "ours", "ourselves", "out", "over", "own", "same", "she", "should", "so", "some", "such", "than", "that", "the", "their", "theirs", "them",
    "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was", "we", "were",
    "what", "when", "where", "which", "while", "who", "whom", "why", "with", "would", "you", "your", "yours", "yourself", "yourselves",
)
SUMMARY_GENERIC = (
    "book", "books", "chapter", "chapters", "contents", "edition", "editions", "editor", "editors", "exercise", "exercises", "figure", "figures",
    "introduction", "note", "notes", "part", "parts", "preface", "problem", "problems", "section", "sections", "series", "table", "tables",
    "university",
)
BOILERPLATE = (
    "all rights reserved", "assistant director", "cambridge, massachusetts", "all rights reserved", "cataloging-in-publication", "copyright",
    "department of computer science", "email", "information science and statistics", "library of congress", "mit press", "printed and bound",
    "professor", "series editors", "springer nature", "cambridge university press", "isbn", "issn", "doi.org", "electronic supplementary material",
)
PAPER_CUES = (
    "in this paper", "in this study", "in this work", "the present paper", "the present study", "the present work", "we propose", "we show",
    "we demonstrate", "we investigate", "our results show", "we conclude",
)
SUMMARY_CUES = (
    "this book", "this textbook", "this text", "we wrote this book", "the goal of this book", "the aim of this book", "in this book", "we introduce",
    "we present", "we describe", "we develop", "focuses on", "covers", "provides", "introduction to", "unified probabilistic approach",
)
OVERVIEW_TERMS = (
    "aimed at", "broad coverage", "comprehensive introduction", "detailed introduction", "focus", "goal", "introduction to the field", "provides a",
    "suitable for", "target audience", "this book", "this textbook", "we wrote this book",
)
BOOK_PAGE_CUES = (
    "preface", "introduction", "plan of this book", "organization", "what is",
)
NOISY_PREVIEWS = (
    "", "acknowledgments", "acknowledgements", "contents", "copyright", "dedication", "index",
)
WEAK_KEYWORDS = (
    "approach", "approaches", "approximation", "approximations", "basic", "case", "cases", "concept", "concepts", "detail", "details", "equation",
    "equations", "example", "examples", "first", "flow", "fluid", "general", "good", "grid", "grids", "implementation", "many", "mass", "may", "method",
    "methods", "model", "models", "momentum", "numerical", "one", "problem", "problems", "reader", "readers", "second", "solution", "solutions",
    "system", "systems", "third", "two", "used", "using", "value", "values", "will",
)
PHRASE_GENERIC = (
    "analysis", "approach", "approaches", "basic", "book", "books", "chapter", "chapters", "components", "concepts", "contents", "course", "detail",
    "details", "example", "examples", "first", "general", "implementation", "introduction", "many", "one", "plan", "preface", "problem", "problems",
    "reader", "readers", "summary", "section", "sections", "second", "third", "this", "two", "used", "using",
)
PHRASE_EDGES = (
    "algorithm", "algorithms", "conditions", "dynamics", "equation", "equations", "flow", "flows", "method", "methods",
)
DOMAIN_TOKENS = (
    "boundary", "cfd", "compressible", "conservation", "cuda", "convolution", "computing", "csr", "execution", "dynamics", "finite", "flow", "flows",
    "fractional-step", "fractional", "grid", "gpu", "incompressible", "kernel", "mach", "matrix", "mesh", "method", "methods", "memory", "models",
    "multigrid", "navier-stokes", "numerical", "openacc", "opencl", "parallel", "piso", "pressure", "processors", "reynolds", "scan", "scalar", "shock",
    "simple", "spmv", "spectral", "step", "sparse", "thread", "transport", "turbulence", "turbulent", "unsteady", "velocity", "volume",
)
PRIORITY_KEYWORDS = (
    "boundary conditions", "compressible flows", "direct numerical simulation", "finite difference method", "finite volume method",
    "fractional-step method", "gpu hardware performance features", "heterogeneous parallel computing", "incompressible flows",
    "matrix-matrix multiplication", "multigrid method", "navier-stokes equation", "openacc", "opencl", "parallel programming languages and models",
    "parallel scan", "piso method", "pressure-correction equation", "pressure-correction method", "sparse matrix-vector multiplication",
    "simple method", "simplec method", "simpler method", "spectral method", "turbulence models", "cuda device memory types", "cuda memory model",
    "cuda thread execution model", "convolution",
)
SKIPPED_KEYWORDS = (
    "iterative method", "steady unsteady flows", "strategies steady unsteady", "calculation strategies steady unsteady",
    "non-iterative implicit methods unsteady flows", "pressure-correction methods arbitrary mach number", "organization of the book",
    "references and further reading", "chapter outline", "background", "simpler method", "simpler", "simple method", "boundary conditions",
)
CONCEPT_GENERIC = (
    "address", "author", "authors", "bibliography", "book", "books", "cambridge", "chapter", "chapters", "contents", "copyright", "edition", "editions",
    "editor", "editors", "exercise", "exercises", "file", "files", "foreword", "format", "guide", "handbook", "house", "imprint", "introduction",
    "isbn", "issn", "kingdom", "manual", "note", "notes", "part", "parts", "preface", "press", "printing", "publisher", "publishing", "references",
    "remark", "remarks", "reserved", "reproduced", "section", "sections", "series", "textbook", "texts", "transmitted", "university", "using",
)
CONCEPT_GENERIC_PHRASES = (
    "all rights reserved", "author index", "cambridge cb2", "cambridge cb2 8bs", "data exchange", "designations used", "digital data exchange",
    "distinguish products", "document file", "document file format", "file format", "second edition", "first edition", "fourth edition",
    "imprint elsevier", "john wiley", "john wiley sons", "massachusetts institute technology", "many designations used",
    "manufacturers sellers distinguish", "may reproduced", "morgan kaufmann", "printing house", "printing house cambridge", "san francisco",
    "saddle river nj", "sellers distinguish products", "third edition", "table of contents", "transmitted form", "upper saddle river",
    "used manufacturers sellers",
)
CONCEPT_GENERIC_INNER = (
    "8bs", "author", "authors", "cambridge", "cb2", "data", "design", "document", "elsevier", "exchange", "file", "first", "form", "francisco", "house",
    "imprint", "index", "john", "kaufmann", "means", "morgan", "new", "reproduced", "san", "sons", "summary", "time", "transmitted", "united", "wiley",
    "states", "volume", "will", "york",
)
CONCEPT_NOISE = (
    "all rights reserved", "author index", "cambridge cb2", "claimed as trademarks", "copyright", "designations used by manufacturers and sellers",
    "document file format", "electronic document file format", "imprint of elsevier", "isbn", "issn", "john wiley", "many of the designations used",
    "morgan kaufmann", "pearson education", "printing house", "protected by copyright", "san francisco", "sellers to distinguish their products",
    "transmitted in any form", "university printing house", "upper saddle river", "written permission should be obtained",
)
DISPLAY_WORDS = {
    "ai": "AI", "aws": "AWS", "cfd": "CFD", "cpp": "C++", "cuda": "CUDA", "gpu": "GPU", "llm": "LLM", "mpi": "MPI", "nlp": "NLP", "openmp": "OpenMP",
    "pdf": "PDF", "pde": "PDE", "petsc": "PETSc", "vtk": "VTK",
}
SEPARATE_RELATIONSHIPS = (
    "companion_to", "excerpt_of", "exact_duplicate_of",
)

# Fixed values inside rules.
STRUCTURAL_NOISE = (
    "interested readers may find", "not be covered in this book", "special thanks", "we also hope", "for this reason, the references", "how to use the book",
    "phase 1", "phase 2", "phase 3", "final project", "project workshop", "project report", "lecture slots", "programming assignments", "teaching assistants",
    "class symposium", "ece408", "ece498",
)
FIGURE_WORDS = ("figure ", "section ", "equation", "exercise", "table ", "example:")
STRUCTURE_WORDS = ("figure ", "table ", "equation", "exercise", "appendix ")
FRONT_MATTER = ("contents", "preface", "index", "acknowledgments")
METHOD_ENDS = ("flow", "flows", "method", "methods", "equations", "conditions", "algorithm", "algorithms")
BOOK_SPECIALS = ("simple", "fractional-step", "compressible", "incompressible")
TITLE_SMALL_WORDS = ("a", "an", "the", "in", "on", "of", "and")
COPY_WORDS_EXACT = ("duplicate", "copy", "scratch", "tmp", "untitled")
COPY_WORDS_NEAR = ("copy", "scan", "ocr", "tmp", "untitled")
CLASS_WORDS = (
    ("solution_manual", ("solution", "booksol")), ("manual", ("manual", "handbook", "guide")), ("notes", ("notes", "lecture", "tutorial")),
    ("excerpt", ("excerpt", "preview", "sample")), ("reference", ("encyclopedia", "reference")),
)
EXPLICIT_PATTERNS = (
    r"finite difference methods?", r"finite volume methods?", r"fractional-step methods?", r"simple method", r"simpler", r"simplec", r"piso",
    r"compressible flows?", r"incompressible flows?", r"pressure-correction equations?", r"pressure-correction methods?", r"boundary conditions?",
    r"navier[-\u2013]stokes equations?", r"turbulence models?", r"spectral methods?", r"multigrid methods?", r"heterogeneous parallel computing",
    r"parallel programming languages and models", r"cuda memory model", r"cuda thread execution model", r"gpu hardware performance features",
    r"cuda device memory types", r"matrix[- ]matrix multiplication", r"convolution", r"parallel scan", r"sparse matrix[- ]vector multiplication",
    r"opencl", r"openacc", r"mpi/cuda",
)
PHRASE_PREFIXES = (
    "calculation strategies for ", "methods designed for ", "implementation of ", "solution of the ", "simulation of ", "the choice of ", "approximation of ",
    "introduction to ", "properties of ",
)
PHRASE_REWRITES = (
    (r": part \d+$", ""), (r"\bsimpler\b", "simpler method"), (r"\bsimplec\b", "simplec method"), (r"\bpiso\b", "piso method"),
    (r"\bturbulence with models\b", "turbulence models"), (r"\bmethods? arbitrary mach number\b", "pressure-correction method"),
    (r"\bdirect numerical simulation dns\b", "direct numerical simulation"), (r"\bpressure-correction pressure-correction method\b", "pressure-correction method"),
    (r"\b(method|equation|algorithm|flow|flows)\b(?: \1\b)+", "$1"),
)
LAST_WORDS = {"methods": "method", "equations": "equation", "algorithms": "algorithm"}
BIBTEX_ESCAPES = {
    "\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_",
    "^": r"\textasciicircum{}", "~": r"\textasciitilde{}",
}
MIME_TYPES = {
    "pdf": "application/pdf", "epub": "application/epub+zip", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "json": "application/json",
}
