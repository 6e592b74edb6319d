"""Files of mixed types, written from the tables and read back as elements and documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain, groupby
from operator import itemgetter
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.catalog.registry import query
from digestry.catalog.views import norm, table
from digestry.session import work_path
from digestry.sources import elements

BUNDLE = 16
#: Files in a folder, which is listed by one task.
FOLDER = 1024


def _written(rows: DataFrame, out: str, gap: str) -> None:
    """One file for ``BUNDLE`` neighbouring ids, each value followed by ``gap``.

    Tasks write a shared folder's files themselves: Spark's writer makes a folder of each, and Hadoop starts
    several processes to set the modes of a local file. Other stores go through Spark's writer.
    """
    bundled = rows.withColumn("file_no", F.expr(f"id div {BUNDLE}"))
    placed = bundled.repartition(F.col("file_no")).sortWithinPartitions("file_no", "id")
    values = placed.select("file_no", F.coalesce("value", F.lit("")).alias("value"))
    place = urlsplit(out)
    if place.scheme not in ("", "file"):
        values.write.partitionBy("file_no").option("lineSep", gap).text(out)
        return
    write = _file_writer(unquote(place.path), gap.encode())
    values.select("file_no", F.col("value").cast("binary")).mapInArrow(write, "files long").agg(
        F.sum("files")
    ).collect()


def _file_writer(folder: str, gap: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of ``file_no, value``, in order, to files; a file has its name once it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*(c.to_pylist() for c in batch.columns)) for batch in batches)
        files = 0
        for file_no, held in groupby(rows, key=itemgetter(0)):
            place = Path(folder, "none" if file_no is None else str(file_no // FOLDER))
            place.mkdir(parents=True, exist_ok=True)
            begun = place / f".{uuid.uuid4().hex}"
            with begun.open("wb") as sink:
                for _, value in held:
                    sink.write(value + gap)
            begun.replace(place / f"file_no={file_no}")
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return write


def mixed_files(spark, sf) -> str:
    """A folder with the documents as plain text files and the pages as HTML files."""
    out = work_path(spark, "files")
    documents, pages = table(spark, sf, "documents"), table(spark, sf, "pages")
    _written(documents.select(F.col("doc_id").alias("id"), F.col("text").alias("value")), f"{out}/txt", "\n\n")
    _written(pages.select(F.col("page_id").alias("id"), F.col("html").alias("value")), f"{out}/html", "\n")
    return out


def _placed(rows: DataFrame, *rest: str) -> DataFrame:
    part = r"/(txt|html)/(?:[^/]+/)?file_no=([0-9]+)(?:/|$)"
    return rows.select(
        F.regexp_extract("path", part, 1).alias("folder"),
        F.regexp_extract("path", part, 2).cast("long").alias("file_no"),
        *rest,
    )


def _page_sql() -> str:
    # The tags and entities of a page, as the operator documents them.
    v = "replace(replace(body, chr(1), ''), chr(2), '')"
    v = f"regexp_replace({v}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "noscript", "template"):
        v = rf"regexp_replace({v}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', '', 'g')"
    v = rf"regexp_replace({v}, '(?i)<br\b[^>]*>', ' ', 'g')"
    opening = (("title", "title"), ("heading", "h[1-6]"), ("list_item", "li|dt|dd"), ("cell", "td|th|caption"))
    for kind, tags in opening:
        v = rf"regexp_replace({v}, '(?i)<({tags})\b[^>]*>', chr(1) || '{kind}' || chr(2), 'g')"
    blocks = (
        "title|h[1-6]|li|dt|dd|td|th|caption|p|div|pre|blockquote|article|section|nav|header|footer|aside|main|"
        "ul|ol|dl|table|tr|head|body|html|hr"
    )
    v = rf"regexp_replace({v}, '(?i)</?({blocks})\b[^>]*>', chr(1) || 'paragraph' || chr(2), 'g')"
    v = f"regexp_replace({v}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "),
        ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"),
    ):
        v = f"replace({v}, '{entity}', '{char}')"
    return f"string_split(chr(1) || 'paragraph' || chr(2) || {v}, chr(1))"


_BULLET = r"[ \t]*(?:[-*•]|[0-9]{1,3}[.)])[ \t]"
_ELEMENTS = rf"""WITH bundles AS (
  SELECT 'txt' AS folder, doc_id // {BUNDLE} AS file_no,
         string_agg(coalesce(text, '') || chr(10) || chr(10), '' ORDER BY doc_id) AS body
  FROM documents GROUP BY ALL
  UNION ALL
  SELECT 'html', page_id // {BUNDLE}, string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id)
  FROM pages GROUP BY ALL),
parts AS (
  SELECT folder, file_no, list_transform(
    string_split_regex(regexp_replace(regexp_replace(body, '\r\n?', chr(10), 'g'),
      '\n({_BULLET})', chr(10) || chr(10) || '\1', 'g'), '\n[ \t]*\n\s*'),
    lambda p: {{'kind': CASE WHEN regexp_matches(p, '^\s*#{{1,6}}[ \t]') THEN 'heading'
                            WHEN regexp_matches(p, '^{_BULLET}') THEN 'list_item'
                            ELSE 'paragraph' END, 'text': {norm("p")}}}) AS held
  FROM bundles WHERE folder = 'txt'
  UNION ALL
  SELECT folder, file_no, list_transform({_page_sql()},
    lambda p: {{'kind': split_part(p, chr(2), 1), 'text': {norm("split_part(p, chr(2), 2)")}}})
  FROM bundles WHERE folder = 'html'),
blocks AS (
  SELECT folder, file_no, list_filter(held, lambda e: e.text <> '') AS held FROM parts)"""


@query(
    "ingest_elements",
    f"""{_ELEMENTS}, numbered AS (
          SELECT folder, file_no, unnest(range(len(held))) AS n, held FROM blocks)
        SELECT folder, file_no, CAST(n AS INTEGER) AS pos, held[n + 1].kind AS kind,
               held[n + 1].text AS text FROM numbered""",
)
def ingest_elements(spark, sf):
    return _placed(elements.read_elements(spark, mixed_files(spark, sf)), "pos", "kind", "text")


@query(
    "ingest_files",
    f"""{_ELEMENTS} SELECT folder, file_no, array_to_string(list_transform(
          list_filter(held, lambda e: e.kind NOT IN ('title', 'list_item')), lambda e: e.text),
          chr(10) || chr(10)) AS document FROM blocks""",
)
def ingest_files(spark, sf):
    out = mixed_files(spark, sf)
    return _placed(elements.read_documents(spark, out, leave_out=("title", "list_item")), "document")
