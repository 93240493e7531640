"""Files: scans of a folder of documents, JSON documents, and extractors of text."""

from __future__ import annotations

import json
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.functions import identity as idf, lexicons as lx
from scriptorium.operators import pages as pg


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modified, size_bytes, suffix) of the files with a known suffix outside ``rejected``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    x = reader.load(folder).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"))
    x = x.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))
    return x.where(F.col("suffix").isin(*lx.FILE_SUFFIXES) & ~F.col("path").contains("/rejected/"))


#: Changed files that are read by their paths; more are read with their folder.
MOST_PATHS = 10_000


def contents(spark: SparkSession, folder: str | list[str], recursive: bool = True) -> DataFrame:
    """scan() with sha256, doc_id and year, of a folder or of some files; the contents are hashed where they are read."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    x = x.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), "content")
    x = x.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).where(F.col("suffix").isin(*lx.FILE_SUFFIXES) & ~F.col("path").contains("/rejected/"))
    return x.withColumns({"filename": F.substring_index("path", "/", -1), "doc_id": idf.doc_id(F.col("path")), "year": idf.path_year(F.col("path"))})


PLAIN, HTML = (".md", ".txt", ".rst"), (".html", ".htm")


def plain_text(files: DataFrame) -> DataFrame:
    """``files`` with the text of the formats that are text; HTML as Markdown."""
    text = F.decode("content", "UTF-8")
    return files.withColumn("text", F.when(F.col("suffix").isin(*PLAIN), text).when(F.col("suffix").isin(*HTML), pg.markdown_of_html(text)))


def with_text(files: DataFrame, extract: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``files`` with text, null where there is none, of all formats: outside programs read what is no text (``extract``: with_ocr)."""
    known = F.col("suffix").isin(*PLAIN, *HTML)
    other = files.where(~known)
    found = (extract or with_ocr)(other).withColumnRenamed("path", "_path")
    rest = other.join(found, F.col("path") == F.col("_path"), "left").drop("_path")
    return plain_text(files.where(known)).unionByName(rest)


def extracted(files: DataFrame, extractor: Callable[[str, bytes], str | None]) -> DataFrame:
    """(path, text): an extractor gets the suffix and bytes of each file; for formats that need an outside program."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [extractor(s, c) for s, c in zip(b["suffix"], b["content"])]})

    return files.select("path", "suffix", "content").mapInPandas(run, "path string, text string")


def program(*command: str) -> Callable[[str, bytes], str | None]:
    """An extractor that pipes a file through a program; null where the program is missing or fails."""

    def run(suffix: str, content: bytes) -> str | None:
        try:
            return subprocess.run(command, input=content, capture_output=True, check=True).stdout.decode("utf-8", "replace")
        except (OSError, subprocess.CalledProcessError):
            return None

    return run


#: Text of a PDF, of its pages as images, and of other formats as Markdown.
PDF_TEXT = program("pdftotext", "-layout", "-", "-")
MARKDOWN = program("pandoc", "-t", "markdown_strict", "--wrap=none")


def ocr(most_pages: int | None = None, dpi: int = 300) -> Callable[[str, bytes], str | None]:
    """An extractor that reads the pages of a PDF as images; pages are joined by form feeds, a failing page is empty, missing programs give null."""

    def run(suffix: str, content: bytes) -> str | None:
        if suffix != ".pdf":
            return None
        with tempfile.TemporaryDirectory() as folder:  # of the task alone, gone when it ends
            last = ["-l", str(most_pages)] if most_pages else []
            try:
                subprocess.run(["pdftoppm", "-r", str(dpi), "-png", *last, "-", f"{folder}/page"], input=content, capture_output=True, check=True)
            except (OSError, subprocess.CalledProcessError):
                return None
            pages = []
            for image in sorted(Path(folder).glob("*.png")):
                try:
                    pages.append(subprocess.run(["tesseract", str(image), "stdout"], capture_output=True, check=True).stdout.decode("utf-8", "replace"))
                except OSError:
                    return None
                except subprocess.CalledProcessError:
                    pages.append("")
        return "\f".join(pages)

    return run


def with_ocr(files: DataFrame, least: int = 50) -> DataFrame:
    """(path, text): a PDF's own text, or that of its images where a page has fewer than ``least`` characters in the mean."""
    read = ocr()

    def run(suffix: str, content: bytes) -> str | None:
        text = PDF_TEXT(suffix, content) if suffix == ".pdf" else MARKDOWN(suffix, content)
        pages = [p for p in (text or "").split("\f") if p.strip()]
        if suffix == ".pdf" and sum(map(len, pages)) < least * max(1, len(pages)):
            return read(suffix, content) or text
        return text

    return extracted(files, run)


def info_map(text) -> object:
    """A map of the ``key: value`` lines of a Column of program output."""
    rows = F.filter(F.split(text, "\n"), lambda x: x.contains(":"))
    pair = lambda x: F.struct(F.btrim(F.substring_index(x, ":", 1)), F.btrim(F.regexp_replace(x, r"^[^:]*:", "")))
    return F.map_from_entries(F.transform(rows, pair))


PDF_INFO = program("pdfinfo", "-")


def pdf_info(files: DataFrame, extractor: Callable[[str, bytes], str | None] = PDF_INFO) -> DataFrame:
    """(path, title, author, producer, pages) that PDFs say about themselves; blank fields are null."""
    said = extracted(files.where(F.col("suffix") == ".pdf"), extractor).where("text is not null")
    field = lambda name: F.nullif(F.btrim(F.regexp_extract("text", rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    return said.select("path", field("Title").alias("title"), field("Author").alias("author"), field("Producer").alias("producer"), field("Pages").try_cast("int").alias("pages"))


def text_bytes(text, size, suffix) -> object:
    """Bytes of the text: of a PDF what was extracted, else the file's."""
    return F.when(suffix == ".pdf", F.octet_length(text).cast("long")).otherwise(size)


def read_json(path: str) -> object:
    return json.loads(Path(path).read_text())


def write_json(path: str, value: object) -> None:
    """Pretty JSON in the order of the keys; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, overrides): the corrections of a JSON document ``{"overrides": {doc_id: {...}}}``; ValueError for another shape."""
    value = read_json(path).get("overrides")
    if not isinstance(value, dict):
        raise ValueError("overrides is no object")
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in value.items()], "doc_id string, overrides string")


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def moved(spark: SparkSession, plan: DataFrame, root: str) -> int:
    """Move the files of an incoming plan (path, target) below ``root``; how many. A file that is there already is not overwritten."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for r in plan.toLocalIterator():
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (r["path"], f"{root.rstrip('/')}/{r['target']}"))
        fs = source.getFileSystem(conf)
        if fs.exists(target):
            continue
        fs.mkdirs(target.getParent())
        n += bool(fs.rename(source, target))
    return n
