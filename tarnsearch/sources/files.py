"""Files and literal texts as (path, sha256, size, mtime, text)."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tarnsearch.functions.text import decoded, text_path
from tarnsearch.functions.web import html_text

#: (name, pattern of lower-case paths) in the order in which they are tried.
HANDLERS = (("txt", r"\.txt$"), ("markdown", r"\.md$"), ("pdf", r"\.pdf$"), ("docx", r"\.docx$"), ("html", r"\.html?$"), ("web", r"^https?://"))
SUPPORTED = tuple(name for name, _ in HANDLERS)
ADDED: dict[str, str] = {}


def handler(path: Column) -> Column:
    """The first handler that takes a path, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed((*HANDLERS, *ADDED.items())):
        out = F.when(F.lower(path).rlike(pattern), name).otherwise(out)
    return out


def required_handler(path: Column) -> Column:
    found = handler(path)
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no handler for "), path)))


def docx_text(content: bytes) -> str:
    """Paragraphs of the body, tables left out, joined by line breaks."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{ns}body")
    rows = body.findall(f"{ns}p") if body is not None else []
    marks = {f"{ns}t": lambda e: e.text or "", f"{ns}tab": lambda e: "\t", f"{ns}br": lambda e: "\n"}
    return "\n".join("".join(marks[e.tag](e) for e in p.iter() if e.tag in marks) for p in rows)


def pdf_text(content: bytes) -> str:
    """Pages' texts joined by line breaks; needs the optional library pypdf."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the library pypdf") from e
    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


#: Formats that need Python; more can be registered.
PARSERS: dict[str, Callable[[bytes], str]] = {"pdf": pdf_text, "docx": docx_text}


def register(name: str, parse: Callable[[bytes], str], pattern: str | None = None) -> None:
    """A parser for a kind of file. ``pattern`` matches lower-case paths of a new kind, which come after those above."""
    PARSERS[name] = parse
    if pattern is not None:
        ADDED[name] = pattern


def _parsed(content: Column, kind: Column) -> Column:
    parsers = dict(PARSERS)

    @F.pandas_udf(StringType())
    def run(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([parsers[k](bytes(c)) if k in parsers and c is not None else None for c, k in zip(content, kind, strict=True)])

    return run(content, kind)


def read(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, sha256, size, mtime, text) of a file, or of a folder's files of supported types.

    Texts, Markdown and HTML stay in the JVM; PDF and DOCX bytes go to Python.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    raw = raw.withColumn("kind", handler(F.col("path"))).where("kind is not null")
    plain, other = raw.where(~F.col("kind").isin(*PARSERS)), raw.where(F.col("kind").isin(*PARSERS))
    text = F.when(F.col("kind") == "html", html_text(decoded(F.col("content")))).otherwise(decoded(F.col("content")))
    shape = lambda rows, t: rows.select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").cast("double").alias("mtime"), t.alias("text")
    )
    return shape(plain, text).unionByName(shape(other, _parsed(F.col("content"), F.col("kind"))))


def from_texts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Literal texts: their path holds their hash, so equal texts are one source. Blank texts are left out."""
    text = F.col(text_col)
    found = rows.where(F.trim(text) != "").select(text_path(text).alias("path"), F.sha2(text, 256).alias("sha256"), F.octet_length(text).cast("long").alias("size"), F.lit(0.0).alias("mtime"), text.alias("text"))
    return found.dropDuplicates(["path"])


def dispatch(item: str, domain: bool = False) -> str:
    """What a source is: domain, url, folder, file, or text."""
    if not item.strip():
        raise ValueError("empty source")
    if item.lower().startswith(("http://", "https://")):
        return "domain" if domain else "url"
    return "folder" if os.path.isdir(item) else "file" if os.path.isfile(item) else "text"
