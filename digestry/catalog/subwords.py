"""Subword budgets and windows, and chunks along separators, over whole documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from digestry.catalog.documents import CONTEXT, MAX_SUMMARY, OVERLAP, SIZE
from digestry.catalog.registry import query
from digestry.catalog.views import dealt_pairs, norm, table, wc
from digestry.functions import tokens
from digestry.functions.subwords import Measured, SubwordTokenizer, chars_per_token
from digestry.operators import chunks
from digestry.session import dealt

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
MAX_LENGTH, WINDOW, STRIDE_BACK = 256, 200, 40


def measured(spark, sf):
    tokenizer = SubwordTokenizer.from_file(spark, VOCABULARY)
    return tokenizer, tokenizer.measure(dealt_pairs(spark, sf), d_ends="document", s_ends="summary")


DOCUMENT = lambda: Measured(F.col("document"), F.col("d_ends"))
SUMMARY = lambda: Measured(F.col("summary"), F.col("s_ends"))


# Byte-pair codes have no SQL form; the three queries are tested against the tokenizer's own library.


@query("truncate_subword")
def truncate_subword(spark, sf):
    tokenizer, rows = measured(spark, sf)
    cut = tokens.truncate_measured(DOCUMENT(), SUMMARY(), MAX_LENGTH, tokenizer)
    return rows.select(
        "row_id", DOCUMENT().count().alias("document_tokens"),
        SUMMARY().count().alias("summary_tokens"), cut.alias("document"),
    )


@query("fits_subword")
def fits_subword(spark, sf):
    tokenizer = SubwordTokenizer.from_file(spark, VOCABULARY)
    n = F.col("n_tokens")
    return tokenizer.counted(dealt_pairs(spark, sf), n_tokens="document").select(
        "row_id", n, tokens.fits(n, CONTEXT, MAX_SUMMARY, tokenizer).alias("fits"),
        F.round(chars_per_token(F.col("document"), n), 6).alias("chars_per_token"),
    )


@query("windows_subword")
def windows_subword(spark, sf):
    _, rows = measured(spark, sf)
    windows = rows.select("row_id", DOCUMENT().windows(WINDOW, STRIDE_BACK).alias("chunks"))
    return chunks.explode_chunks(windows, ["row_id"]).select("row_id", "pos", "chunk")


@query("chunk_subword")
def chunk_subword(spark, sf):
    """Chunks of so many subword tokens at the document's own average, along separators."""
    tokenizer = SubwordTokenizer.from_file(spark, VOCABULARY)
    docs = dealt(table(spark, sf, "documents"), "doc_id", "text").select(
        F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("document")
    )
    cut = chunks.with_chunks(
        tokenizer.measure(docs, d_ends="document"), WINDOW, STRIDE_BACK, "segment",
        chars_per_token=DOCUMENT().chars_per_token(),
    )
    return chunks.explode_chunks(cut, ["row_id"]).select("row_id", "pos", "chunk")


# ---- chunks along separators ----------------------------------------------------------------------

#: After a mark of the same levels, as text that is replaced; ``chr(1)`` parts the segments.
_MARKS = (
    (r"(\n\n\n+)", r"'\1' || chr(1)"),
    (r"(\n\n+)", r"'\1' || chr(1)"),
    (r"(\n+)", r"'\1' || chr(1)"),
    (r"([.!?])([ \t\n])", r"'\1' || chr(1) || '\2'"),
    (r"([ \t]+)", r"'\1' || chr(1)"),
)


def _parts(piece: str, level: int) -> str:
    if level == len(_MARKS):
        return (
            f"list_transform(range(0, (length({piece}) - 1) // room + 1), "
            f"lambda i: least(room, length({piece}) - i * room))"
        )
    pattern, mark = _MARKS[level]
    marked = f"regexp_replace({piece}, '{pattern}', {mark}, 'g')"
    if level == 0:
        marked = rf"regexp_replace({marked}, '\n(#{{1,6}} )', chr(10) || chr(1) || '\1', 'g')"
    own = f"x{level}"
    return (
        f"flatten(list_transform(string_split({marked}, chr(1)), lambda {own}: "
        f"CASE WHEN length({own}) <= room THEN [length({own})] ELSE {_parts(own, level + 1)} END))"
    )


_SEGMENTS = f"""
sized AS (
  SELECT row_id, body, CAST(floor({SIZE} * cpt) AS BIGINT) AS size,
         CAST(floor({OVERLAP} * cpt) AS BIGINT) AS overlap FROM (
    SELECT doc_id AS row_id, coalesce(text, '') AS body,
           CASE WHEN {norm("coalesce(text, '')")} = '' THEN 4.0::DOUBLE
                ELSE greatest(1.0::DOUBLE, length(text) / {wc(norm("text"))}) END AS cpt
    FROM documents)),
roomy AS (SELECT *, greatest(size - overlap, 1) AS room FROM sized),
listed AS (
  SELECT row_id, room, list_filter({_parts("body", 0)}, lambda n: n > 0) AS lengths FROM roomy),
segment AS (
  SELECT row_id, room, unnest(lengths) AS n, generate_subscripts(lengths, 1) AS i FROM listed),
pack AS (
  SELECT row_id, room, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS reached, CAST(0 AS BIGINT) AS start
  FROM roomy
  UNION ALL
  SELECT p.row_id, p.room, p.i + 1, p.reached + s.n,
         CASE WHEN p.reached + s.n - p.start > p.room THEN p.reached ELSE p.start END
  FROM pack p JOIN segment s ON s.row_id = p.row_id AND s.i = p.i + 1),
chunk AS (SELECT row_id, start, max(reached) AS ending FROM pack GROUP BY row_id, start),
cut AS (
  SELECT row_id, start, trim(substring(body, greatest(start - overlap, 0) + 1,
                             ending - greatest(start - overlap, 0)),
                             ' ' || chr(9) || chr(10) || chr(13)) AS chunk
  FROM chunk JOIN roomy USING (row_id))"""


@query(
    "chunk_segments",
    f"""WITH RECURSIVE {_SEGMENTS}
        SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY start) - 1 AS INTEGER) AS pos,
               chunk FROM cut WHERE {norm("chunk")} <> ''""",
)
def chunk_segments(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.coalesce("text", F.lit("")).alias("document")
    )
    cut = chunks.with_chunks(docs, SIZE, OVERLAP, "segment")
    return chunks.explode_chunks(cut, ["row_id"]).select("row_id", "pos", "chunk")
