"""Bulk document ingestion: files to text, elements joined by a blank line."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import text

JOINER = "\n\n"
# Fixed value: the WordprocessingML namespace.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def join_elements(elements: Column) -> Column:
    return F.array_join(F.filter(elements, lambda e: text.squash(e) != ""), JOINER)


def text_elements(value: Column) -> Column:
    """Paragraphs of a plain-text file: runs of non-blank lines."""
    unified = F.regexp_replace(value, r"\r\n?", "\n")
    return F.transform(F.split(unified, r"\n[ \t]*\n\s*"), text.squash)


def docx_elements(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for paragraph in body.iter(f"{_W}p"):
        line = "".join(
            node.text or "" if node.tag == f"{_W}t" else " "
            for node in paragraph.iter()
            if node.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")
        )
        if line.strip():
            out.append(line.strip())
    return out


def ingest_text(spark: SparkSession, path: str) -> DataFrame:
    """``path, document`` for plain-text files; one row per file, no shuffle."""
    raw = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    return raw.select("path", join_elements(text_elements(F.col("value"))).alias("document"))


def ingest_binary(
    spark: SparkSession,
    path: str,
    partition: Callable[[bytes], list[str]] = docx_elements,
    glob: str = "*.docx",
) -> DataFrame:
    """``path, document`` for files read by ``partition``, a bytes-to-elements function."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            elements = [partition(content) for content in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "elements": elements})

    parsed = files.select("path", "content").mapInPandas(
        parse, "path string, elements array<string>"
    )
    return parsed.select("path", join_elements(F.col("elements")).alias("document"))
