"""Token counting and truncation behind a small plug-in interface."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.functions.prompts import SUMMARIZE
from digestry.functions.subwords import Measured, SubwordTokenizer


class WordTokenizer:
    """Whitespace tokens; every method is a plain Column expression.

    ``normalized`` promises single-space text, whose words need no regular expression.
    """

    def __init__(self, normalized: bool = False):
        self.normalized = normalized

    def count(self, value: Column) -> Column:
        return text.word_count(value, self.normalized)

    def count_text(self, value: str) -> int:
        return len(value.split())

    def head(self, value: Column, n: Column) -> Column:
        listed = text.words(value, self.normalized)
        return F.array_join(F.slice(listed, F.lit(1), F.greatest(n, F.lit(0))), " ")


class EncoderTokenizer:
    """Wraps a user's ``encode(str) -> list`` and ``decode(list) -> str`` as pandas UDFs."""

    def __init__(self, encode: Callable[[str], list], decode: Callable[[list], str]):
        self._encode = encode

        @F.pandas_udf("int")
        def count(values: pd.Series) -> pd.Series:
            return values.map(lambda v: len(encode(v or "")))

        @F.pandas_udf("string")
        def head(values: pd.Series, limits: pd.Series) -> pd.Series:
            return pd.Series(
                [decode(encode(v or "")[: max(n, 0)]) for v, n in zip(values, limits)], dtype=object
            )

        self._count = count
        self._head = head

    def count(self, value: Column) -> Column:
        return self._count(value)

    def count_text(self, value: str) -> int:
        return len(self._encode(value))

    def head(self, value: Column, n: Column) -> Column:
        return self._head(value, n.cast("int"))


WORDS = WordTokenizer()
CLEAN_WORDS = WordTokenizer(normalized=True)


def fits(document_tokens: Column, context: int, reserve: int, tokenizer=WORDS) -> Column:
    """Does a document of this many tokens fit beside the prompt and the reserved output?"""
    return document_tokens <= F.lit(context - tokenizer.count_text(SUMMARIZE.text("")) - reserve)


def truncate_to_budget(
    document: Column, summary: Column, max_length: int, tokenizer=WORDS
) -> Column:
    """Cut the document to what prompt, summary and two closing tokens leave of ``max_length``.

    A budget of zero or less leaves the document whole, as does a document within budget.
    """
    budget = document_budget(tokenizer.count(summary), max_length, tokenizer)
    over = (budget > 0) & (budget < tokenizer.count(document))
    return F.when(over, tokenizer.head(document, budget)).otherwise(document)


def document_budget(summary_tokens: Column, max_length: int, tokenizer=WORDS) -> Column:
    """Tokens that prompt, summary and two closing tokens leave of ``max_length``."""
    overhead = tokenizer.count_text(SUMMARIZE.text("")) + 2
    return F.lit(max_length - overhead) - summary_tokens


def truncate_measured(
    document: Measured, summary: Measured, max_length: int, tokenizer: SubwordTokenizer
) -> Column:
    """``truncate_to_budget`` for texts that are measured already."""
    budget = document_budget(summary.count(), max_length, tokenizer)
    over = (budget > 0) & (budget < document.count())
    return F.when(over, document.head(budget)).otherwise(document.text)


def chunk_budget(
    context: int, max_sequence: int, max_summary: int, tokenizer=WORDS
) -> tuple[int, int]:
    """Chunk size and overlap in tokens."""
    size = min(context - tokenizer.count_text(SUMMARIZE.text("")) - max_summary, max_sequence)
    return size, size // 4


def chars_per_token(document: Column, tokenizer=WORDS) -> Column:
    n = tokenizer.count(document)
    return F.when(
        n > 0, F.greatest(F.lit(1.0), F.char_length(document) / F.greatest(n, F.lit(1)))
    ).otherwise(F.lit(4.0))
