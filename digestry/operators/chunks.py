"""Cutting long documents into overlapping chunks; each document stays in its row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.functions import text, tokens
from digestry.operators.segments import segment_chunks


def char_budgets(
    document: Column,
    size_tokens: int,
    overlap_tokens: int,
    tokenizer=tokens.WORDS,
    per_token: Column | None = None,
) -> tuple[Column, Column]:
    """Token budgets turned into whole characters at the document's own average token length."""
    if per_token is None:
        per_token = tokens.chars_per_token(document, tokenizer)
    return (
        (F.lit(size_tokens) * per_token).cast("int"),
        (F.lit(overlap_tokens) * per_token).cast("int"),
    )


def strided_chunks(document: Column, size: Column, overlap: Column) -> Column:
    """Fixed-width chunks; the last one is the first that reaches the end. Blank ones drop out."""

    def cut(v: Column) -> Column:
        last = F.greatest(F.ceil((v["length"] - v["size"]) / v["step"]), F.lit(0)).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.substring(v["document"], i * v["step"] + 1, v["size"]),
        )

    pieces = text.bind(
        cut,
        document=document,
        length=F.char_length(document),
        size=size,
        step=F.greatest(size - overlap, F.lit(1)),
    )
    return F.filter(pieces, text.has_ink)


def cut_at_spaces(value: str, size: int, overlap: int) -> list[str]:
    """Greedy cuts at the last space that keeps a chunk within ``size`` characters.

    The next chunk opens with the closing characters of the previous one, ``overlap`` in all with
    the joining space. Without a usable space the cut falls at ``size``.
    """
    if size <= 0 or overlap >= size:
        raise ValueError("chunk size must be positive and larger than the overlap")
    out = []
    rest = value.strip()
    while len(rest) > size:
        space = rest.rfind(" ", max(overlap, 1), size + 1)  # further on than the overlap goes back
        if space < 0:
            out.append(rest[:size].rstrip())
            rest = rest[size - overlap :].lstrip()
            continue
        head = rest[:space].rstrip()
        rest = rest[space + 1 :].lstrip()
        if overlap > 1 and rest:
            rest = head[1 - overlap :].lstrip() + " " + rest
        out.append(head)
    if rest:
        out.append(rest)
    return [chunk for chunk in out if chunk.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _spaced_chunks(value: pd.Series, size: pd.Series, overlap: pd.Series) -> pd.Series:
    cut = [cut_at_spaces(v or "", s, o) for v, s, o in zip(value, size, overlap)]
    return pd.Series(cut, dtype=object)


def spaced_chunks(document: Column, size: Column, overlap: Column) -> Column:
    return _spaced_chunks(document, size.cast("int"), overlap.cast("int"))


def with_chunks(
    df: DataFrame,
    size_tokens: int,
    overlap_tokens: int | None = None,
    boundary: str = "word",
    column: str = "document",
    out: str = "chunks",
    tokenizer=tokens.WORDS,
    chars_per_token: Column | None = None,
) -> DataFrame:
    """Adds the array of chunks, sized in tokens.

    ``boundary``: ``segment`` for the hierarchy of separators, ``word`` for the last space, ``none`` for
    fixed widths. ``chars_per_token`` replaces the tokenizer's count where texts are measured already.
    """
    if size_tokens < 1:
        raise ValueError("no room for a chunk: enlarge the context or lower the reserve")
    overlap_tokens = size_tokens // 4 if overlap_tokens is None else overlap_tokens
    if not 0 <= overlap_tokens < size_tokens:
        raise ValueError("overlap must be smaller than the chunk")
    size, overlap = char_budgets(
        F.col(column), size_tokens, overlap_tokens, tokenizer, chars_per_token
    )
    sized = df.withColumns({"_size": size, "_overlap": overlap})
    cut = {"segment": segment_chunks, "word": spaced_chunks, "none": strided_chunks}[boundary]
    return sized.withColumn(out, cut(F.col(column), F.col("_size"), F.col("_overlap"))).drop(
        "_size", "_overlap"
    )


def explode_chunks(df: DataFrame, keys: list[str], chunks: str = "chunks") -> DataFrame:
    """``keys, pos, chunk, parts, is_last``; ``parts`` counts the document's chunks.

    The outer form of explode keeps Spark from cutting twice to test the size.
    """
    rows = df.select(
        *keys, F.size(chunks).alias("parts"), F.posexplode_outer(chunks).alias("pos", "chunk")
    )
    return rows.where(F.col("chunk").isNotNull()).select(
        *keys, "pos", "chunk", "parts", (F.col("pos") == F.col("parts") - 1).alias("is_last")
    )


def token_windows(document: Column, size: int, overlap: int, normalized: bool = False) -> Column:
    """Overlapping windows of whole tokens, stepping until the tokens run out."""
    step = max(1, size - overlap)

    def cut(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(v["t"]) - 1, F.lit(0)), F.lit(step)),
            lambda i: F.array_join(F.slice(v["t"], i + 1, F.lit(size)), " "),
        )

    windows = text.bind(cut, t=text.words(document, normalized))
    return F.array_remove(windows, "")
