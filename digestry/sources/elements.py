"""Typed elements of mixed files: plain text, HTML and DOCX by what they hold, other types by a parser.

A file is one row of ``binaryFile``, so the session's ``spark.sql.files.maxPartitionBytes`` bounds the bytes
that a task reads, ``spark.sql.files.openCostInBytes`` how many small files (``OPEN_BYTES``, where the session
does not set it), and a file beyond ``spark.sql.sources.binaryFile.maxLength`` is refused by name. Text and
HTML are cut into elements by column expressions; one Arrow function sees the files that need a parser.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.sources.ingest import JOINER

#: Bytes of a file to ``(kind, text)`` in reading order.
Parser = Callable[[bytes], list[tuple[str, str]]]

# The WordprocessingML namespace, leading bytes of containers, names of block tags.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
ZIP = b"PK\x03\x04"
UNSEEN = ("script", "style", "noscript", "template")
BLOCK_TAGS = {
    "title": "title",
    "heading": "h[1-6]",
    "list_item": "li|dt|dd",
    "cell": "td|th|caption",
}
OTHER_BLOCKS = (
    "p|div|pre|blockquote|article|section|nav|header|footer|aside|main|ul|ol|dl|table|tr|head|body|html|hr"
)
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ",
    "&middot;": "·", "&copy;": "©", "&amp;": "&",
}
BULLET = r"[ \t]*(?:[-*•]|[0-9]{1,3}[.)])[ \t]"

# What opening a file counts for when files are dealt to tasks. Spark's own 4 MB give a task few small files,
# and every task starts over with Python.
OPEN_COST = "spark.sql.files.openCostInBytes"
OPEN_BYTES = 128 << 10

# Two control characters that carry no text: they are removed from the input before they are used.
_CUT, _NAMED = "\x01", "\x02"
_ELEMENTS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))


def text_blocks(value: Column) -> Column:
    """``array<struct<kind, text>>`` of plain text: paragraphs end at blank lines, list items start at their
    bullets, and a run of ``#`` makes a heading."""
    unified = F.regexp_replace(value, r"\r\n?", "\n")
    listed = F.regexp_replace(unified, rf"\n({BULLET})", "\n\n$1")

    def block(part: Column) -> Column:
        kind = (
            F.when(part.rlike(r"^\s*#{1,6}[ \t]"), "heading")
            .when(part.rlike(rf"^{BULLET}"), "list_item")
            .otherwise("paragraph")
        )
        return F.struct(kind.alias("kind"), text.squash(part).alias("text"))

    return _inked(F.transform(F.split(listed, r"\n[ \t]*\n\s*"), block))


def html_blocks(value: Column) -> Column:
    """``array<struct<kind, text>>`` of a page: the innermost block tag names the kind. Scripts, styles and
    comments are no text; inline tags go without a gap, ``br`` with one; unknown entities stay as written."""
    v = F.regexp_replace(value, f"[{_CUT}{_NAMED}]", "")
    v = F.regexp_replace(v, r"(?s)<!--.*?-->", "")
    for tag in UNSEEN:
        v = F.regexp_replace(v, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    v = F.regexp_replace(v, r"(?i)<br\b[^>]*>", " ")
    for kind, tags in BLOCK_TAGS.items():
        v = F.regexp_replace(v, rf"(?i)<(?:{tags})\b[^>]*>", f"{_CUT}{kind}{_NAMED}")
    closing = "|".join([*BLOCK_TAGS.values(), OTHER_BLOCKS])
    v = F.regexp_replace(v, rf"(?i)</?(?:{closing})\b[^>]*>", f"{_CUT}paragraph{_NAMED}")
    v = F.regexp_replace(v, r"<[a-zA-Z/!?][^>]*>", "")
    for entity, char in ENTITIES.items():
        v = F.replace(v, F.lit(entity), F.lit(char))
    parts = F.split(F.concat(F.lit(f"{_CUT}paragraph{_NAMED}"), v), _CUT)

    def block(part: Column) -> Column:
        named = F.split(part, _NAMED)
        body = text.squash(F.coalesce(F.get(named, F.lit(1)), F.lit("")))
        return F.struct(F.get(named, F.lit(0)).alias("kind"), body.alias("text"))

    return _inked(F.transform(parts, block))


def _inked(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["text"] != "")


def docx_blocks(content: bytes) -> list[tuple[str, str]]:
    """Paragraphs of a DOCX file in order; headings by style, list items by numbering, cells by table."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    in_cells = {id(p) for cell in root.iter(f"{_W}tc") for p in cell.iter(f"{_W}p")}
    blocks = []
    for paragraph in root.iter(f"{_W}p"):
        pieces = [
            (node.text or "") if node.tag == f"{_W}t" else " "
            for node in paragraph.iter()
            if node.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")
        ]
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        if name == "Title":
            kind = "title"
        elif name.startswith("Heading"):
            kind = "heading"
        elif paragraph.find(f"{_W}pPr/{_W}numPr") is not None:
            kind = "list_item"
        else:
            kind = "cell" if id(paragraph) in in_cells else "paragraph"
        blocks.append((kind, "".join(pieces)))
    return blocks


PARSERS: dict[bytes, Parser] = {ZIP: docx_blocks}


def _parsed(content: Column, parsers: Mapping[bytes, Parser]) -> Column:
    """Elements of the files that a parser takes, by leading bytes; null for others."""
    chosen = dict(parsers)

    @F.arrow_udf("array<struct<kind: string, text: string>>")
    def run(files: pa.Array) -> pa.Array:
        out = []
        for held in files:
            value = held.as_py()
            parse = value and next((f for lead, f in chosen.items() if value.startswith(lead)), None)
            out.append([{"kind": k, "text": t} for k, t in parse(value)] if parse else None)
        return pa.array(out, type=_ELEMENTS)

    blocks = run(content)
    return _inked(
        F.transform(
            blocks, lambda b: F.struct(b["kind"].alias("kind"), text.squash(b["text"]).alias("text"))
        )
    )


def _decoded(content: Column) -> Column:
    """UTF-16 where a mark says so, else UTF-8 without its mark; broken bytes become replacements."""
    mark = F.hex(F.substring(content, 1, 3))
    wide = mark.startswith("FFFE") | mark.startswith("FEFF")
    plain = F.when(mark == "EFBBBF", F.expr("substring(content, 4)")).otherwise(content)
    return F.when(wide, F.decode(content, "UTF-16")).otherwise(plain.cast("string"))


def file_elements(
    spark: SparkSession, path: str, parsers: Mapping[bytes, Parser] = PARSERS, glob: str | None = None
) -> DataFrame:
    """``path, content_type, elements``, one row per file of a folder and its subfolders.

    ``content_type`` is ``parsed`` (leading bytes of a parser), ``html`` (starts like a page) or ``text``. A
    file with NUL bytes that no parser takes stops the job: nothing with bytes is left out. Spark
    reads no file of zero bytes, so these give no row; a blank file has no elements.
    """
    if spark.conf.get(OPEN_COST, None) is None:
        spark.conf.set(OPEN_COST, str(OPEN_BYTES))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    content = F.col("content")
    leads = [F.hex(F.substring(content, 1, len(b))) == b.hex().upper() for b in parsers]
    taken = F.lit(False)
    for lead in leads:
        taken = taken | lead
    files = reader.load(path).select("path", "content").withColumn("_taken", taken)
    typed = files.withColumn("_body", F.when(~F.col("_taken"), _decoded(content)))
    page = F.substring("_body", 1, 1024).rlike(r"(?i)^\s*<(!doctype\s+html|html|head|body)\b")
    typed = typed.withColumn(
        "content_type", F.when(F.col("_taken"), "parsed").when(page, "html").otherwise("text")
    )
    refused = F.raise_error(F.concat(F.lit("no parser for binary file "), F.col("path")))
    blocks = (
        F.when(F.col("content_type") == "parsed", _parsed(F.when(F.col("_taken"), content), parsers))
        .when(F.instr("_body", "\0") > 0, refused.cast("array<struct<kind: string, text: string>>"))
        .when(F.col("content_type") == "html", html_blocks(F.col("_body")))
        .otherwise(text_blocks(F.col("_body")))
    )
    return typed.select("path", "content_type", blocks.alias("elements"))


def read_elements(
    spark: SparkSession, path: str, parsers: Mapping[bytes, Parser] = PARSERS, glob: str | None = None
) -> DataFrame:
    """``path, pos, kind, text``: positions count from 0 within a file; no shuffle."""
    # The outer form: for the inner one Catalyst adds a filter on the size, which cuts each file twice.
    numbered = file_elements(spark, path, parsers, glob).select(
        "path", F.posexplode_outer("elements").alias("pos", "e")
    )
    return numbered.where("pos IS NOT NULL").select("path", "pos", "e.kind", "e.text")


def read_documents(
    spark: SparkSession, path: str, parsers: Mapping[bytes, Parser] = PARSERS, glob: str | None = None,
    leave_out: tuple[str, ...] = (),
) -> DataFrame:
    """``path, document``: the elements of a file, but for kinds left out, joined by a blank line in order."""
    kept = F.filter("elements", lambda e: ~e["kind"].isin(*leave_out)) if leave_out else F.col("elements")
    joined = F.array_join(F.transform(kept, lambda e: e["text"]), JOINER)
    return file_elements(spark, path, parsers, glob).select("path", joined.alias("document"))
