"""Documents from files: text, Word and PDF."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..workers import reach_workers

SUFFIXES = ("txt", "pdf", "docx")
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def is_file(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile()


def root_of(spark: SparkSession, path: str) -> str:
    """A path as Spark's file source writes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def discover(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """path and content (read only if it is used) of the files of a folder by their suffix; a single file whatever its suffix."""
    if is_file(spark, root):
        return spark.read.format("binaryFile").load(root).select("path", "content")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    files = files.where(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))
    if not recursive:
        files = files.where(~F.substring("path", len(root_of(spark, root)) + 2, 10_000).contains("/"))
    return files


def plain_text(content: Column) -> Column:
    """UTF-8 without broken bytes, every line end a line feed. A replacement character that stands in the text goes, too."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def docx_paragraphs(content: bytes | None) -> str | None:
    """Paragraphs of a Word file, one a line; None if it can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as file:
            tree = ElementTree.fromstring(file.read("word/document.xml"))
    except (TypeError, KeyError, OSError, zipfile.BadZipFile, ElementTree.ParseError):
        return None
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    return "\n".join("".join(x.text or "" if x.tag == f"{_WORD}t" else signs.get(x.tag, "") for x in p.iter()) for p in tree.iter(f"{_WORD}p"))


def pdf_text(content: bytes | None) -> str | None:
    """Text of a PDF file; None if it, or the optional library, can't be read."""
    try:
        from pdfminer.high_level import extract_text

        return extract_text(io.BytesIO(content))
    except Exception:  # noqa: BLE001  a broken file is skipped, whatever the library makes of it
        return None


@F.pandas_udf(StringType())
def office_text(path: pd.Series, content: pd.Series) -> pd.Series:
    """Word and PDF files of a batch; null for any other."""
    kind = path.str.lower()
    return pd.Series([docx_paragraphs(c) if p.endswith(".docx") else pdf_text(c) if p.endswith(".pdf") else None for p, c in zip(kind, content, strict=True)], dtype=object)


def read_documents(spark: SparkSession, root: str, recursive: bool = False, enable_office: bool = True) -> DataFrame:
    """doc_id (the path) and text; null where a file can't be read or office files are disabled.

    Only office files go through Python workers; the frame is a union of two narrow scans.
    """
    reach_workers(spark)
    files = discover(spark, root, recursive)
    office = F.lower("path").rlike(r"\.(pdf|docx)$")
    plain = files.where(~office).select(F.col("path").alias("doc_id"), plain_text(F.col("content")).alias("text"))
    text = office_text(F.col("path"), F.col("content")) if enable_office else F.lit(None).cast("string")
    return plain.unionByName(files.where(office).select(F.col("path").alias("doc_id"), text.alias("text")))


def mirrored(path: Column, root: str, single: bool = False) -> Column:
    """A path below the root, with the suffix .txt; two files that differ in their suffix alone share it."""
    below = F.regexp_replace(path, "^.*/", "") if single else F.substring(path, len(root) + 2, 10_000)
    return F.concat(F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(".txt"))
