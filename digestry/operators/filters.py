"""Row predicates and interquartile-range filters on document/summary pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.operators.dedup import SPLITS
from digestry.operators.quantiles import iqr_fences
from digestry.session import stored


@dataclass(frozen=True)
class WordBounds:
    min_document: int = 20
    max_document: int = 10_000
    min_summary: int = 5
    max_summary: int = 500


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "source") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"'{name}' lacks columns {missing}; it has {df.columns}")


def to_pairs(
    df: DataFrame, document: str, summary: str, keep: Sequence[str] = (), name: str = "source"
) -> DataFrame:
    """Project, rename, normalize, and drop pairs that would have an empty side.

    The emptiness test looks at the raw text, so that no text is normalized twice.
    """
    require_columns(df, [document, summary, *keep], name)
    return df.where(text.has_ink(F.col(document)) & text.has_ink(F.col(summary))).select(
        *keep,
        text.squash(F.col(document)).alias("document"),
        text.squash(F.col(summary)).alias("summary"),
    )


def with_source(df: DataFrame, name: str) -> DataFrame:
    return df if "source" in df.columns else df.withColumn("source", F.lit(name))


def with_lengths(df: DataFrame, normalized: bool = False) -> DataFrame:
    """Adds word counts ``dw``, ``sw`` and their ``ratio``, once, for every later stage."""
    return df.withColumns(
        {
            "dw": text.word_count(F.col("document"), normalized),
            "sw": text.word_count(F.col("summary"), normalized),
        }
    ).withColumn("ratio", text.length_ratio(F.col("sw"), F.col("dw")))


def within_bounds(bounds: WordBounds = WordBounds()) -> Column:
    dw, sw = F.col("dw"), F.col("sw")
    return (
        dw.between(bounds.min_document, bounds.max_document)
        & sw.between(bounds.min_summary, bounds.max_summary)
        & (sw < dw)
    )


def hard_filter(df: DataFrame, bounds: WordBounds = WordBounds()) -> DataFrame:
    return df.where(within_bounds(bounds))


def inside_fences(value: Column) -> Column:
    """Inclusive; a zero range keeps everything."""
    return (F.col("iqr") == 0) | value.between(F.col("lo"), F.col("hi"))


def outside_fences(value: Column) -> Column:
    """Strict, without an exception for a zero range."""
    return (value < F.col("lo")) | (value > F.col("hi"))


def attach_fences(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    k: float = 1.5,
    weight: Column | None = None,
    closed: bool = False,
) -> DataFrame:
    """``lo``, ``hi`` and ``iqr`` of the row's group on every row.

    With the closed set of splits the fences of these are broadcast in one plan, so the source is
    read once; rows of any other group get none. Otherwise the fences are written, and their size
    in bytes decides how they are joined.
    """
    fences = iqr_fences(df, by, {column: F.col(column)}, k, weight, closed)
    fences = fences.select(*by, "lo", "hi", "iqr")
    if closed and list(by) == ["split"]:
        return df.join(F.broadcast(fences.where(F.col("split").isin(*SPLITS))), "split", "left")
    return df.join(stored(fences, "fences"), list(by), "left")


def iqr_filter(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    column: str = "ratio",
    k: float = 1.5,
    closed: bool = False,
) -> DataFrame:
    fenced = attach_fences(df, by, column, k, closed=closed)
    return fenced.where(inside_fences(F.col(column))).drop("lo", "hi", "iqr")


def outlier_mask(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    column: str = "ratio",
    k: float = 1.5,
    closed: bool = False,
) -> DataFrame:
    fenced = attach_fences(df, by, column, k, closed=closed)
    return fenced.withColumn("is_outlier", outside_fences(F.col(column))).drop("lo", "hi", "iqr")
