"""Text expressions. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode whitespace class. (?U)\s misses the separators U+001C..U+001F.
BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
INK_RUN = r"(?U)[^\s\x1c-\x1f]+"

ROUGE_BREAK = r"[^a-z0-9]+"
LETTER_WORD = r"\p{L}+(?:['-]\p{L}+)*"

# The "13a" tokenization rules, applied in this order. The first set leaves the
# space out: padding a space with spaces changes no token.
ENTITY_UNESCAPES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))
RULES_13A = (
    (r"([\{-~\[-`!-&\(-\+:-@/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def squash(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK_RUN, " "))


def has_ink(text: Column) -> Column:
    """Is there anything but whitespace? Stops at the first such character."""
    return F.coalesce(F.regexp_like(text, F.lit(r"(?U)[^\s\x1c-\x1f]")), F.lit(False))


def word_count(text: Column, normalized: bool = False) -> Column:
    """Whitespace-separated words. Normalized text needs no regular expression."""
    if normalized:
        return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))
    return F.coalesce(F.regexp_count(text, F.lit(INK_RUN)), F.lit(0))


def words(text: Column, normalized: bool = False) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.array_remove(F.split(text if normalized else squash(text), " "), "")


def length_ratio(summary_words: Column, document_words: Column) -> Column:
    return summary_words / F.greatest(document_words, F.lit(1))


def content_key(document: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as 32 raw bytes: half the shuffle width of the hex form."""
    return F.unhex(F.sha2(document, 256))


def content_hex(document: Column) -> Column:
    return F.sha2(document, 256)


def short_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def rouge_tokens(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), ROUGE_BREAK)
    return F.array_remove(parts, "")


def bleu_tokens(text: Column) -> Column:
    line = F.coalesce(text, F.lit(""))
    line = F.replace(line, F.lit("<skipped>"), F.lit(""))
    line = F.replace(line, F.lit("-\n"), F.lit(""))
    line = F.replace(line, F.lit("\n"), F.lit(" "))
    for entity, plain in ENTITY_UNESCAPES:
        line = F.replace(line, F.lit(entity), F.lit(plain))
    line = F.concat(F.lit(" "), line, F.lit(" "))
    for pattern, replacement in RULES_13A:
        line = F.regexp_replace(line, pattern, replacement)
    return words(line)


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by whitespace."""
    marked = F.regexp_replace(squash(text), r"([.!?]) ", "$1\n")
    return F.array_remove(F.split(marked, "\n"), "")


def letter_words(sentence: Column) -> Column:
    return F.regexp_extract_all(F.lower(sentence), F.lit(LETTER_WORD), F.lit(0))


def bind(build: Callable[[Column], Column], **values: Column) -> Column:
    """``build`` over a struct of values that are evaluated once per row.

    Inside a higher-order function an inlined expression would run again for every element.
    """
    record = F.struct(*[value.alias(name) for name, value in values.items()])
    return F.get(F.transform(F.array(record), build), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams of a token array, each as one string; empty when the array is too short."""
    if n == 1:
        return tokens
    last = F.size(tokens) - (n - 1)
    return F.when(
        last > 0,
        F.transform(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: F.array_join(F.slice(tokens, i, n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))
