"""Pair tables: named sources, ``dataset=/split=`` folders and their discovery."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.operators.dedup import SPLITS
from digestry.operators.filters import to_pairs
from digestry.sources import read_tree

# Folder names that never count as datasets.
RESERVED = ("all", "processed", "processed_tokenized")


@dataclass(frozen=True)
class SourceSpec:
    """Where a source lives and which of its columns hold the document and the summary."""

    name: str
    path: str
    document_column: str
    summary_column: str
    format: str = "parquet"
    keep: tuple[str, ...] = ()
    options: dict[str, str] = field(default_factory=dict)


# The column names of the known public sources.
KNOWN_COLUMNS = {
    "booksum": ("chapter", "summary_text"),
    "cnn": ("article", "highlights"),
    "xsum": ("document", "summary"),
}


def known_source(name: str, path: str, **kwargs) -> SourceSpec:
    document, summary = KNOWN_COLUMNS[name]
    return SourceSpec(name, path, document, summary, **kwargs)


def scan_source(spark: SparkSession, spec: SourceSpec, split: str | None = None) -> DataFrame:
    """Raw rows of one source, or of one split folder below its path."""
    path = f"{spec.path}/{split}" if split else spec.path
    return spark.read.format(spec.format).options(**spec.options).load(path)


def scan_pairs(spark: SparkSession, spec: SourceSpec, split: str | None = None) -> DataFrame:
    raw = scan_source(spark, spec, split)
    return to_pairs(raw, spec.document_column, spec.summary_column, spec.keep, spec.name)


def combine(parts: dict[str, DataFrame], column: str = "dataset") -> DataFrame:
    """Union by name; each part is labelled with its name unless it has the column already."""
    if not parts:
        raise FileNotFoundError("no datasets to combine")
    labelled = [
        df if column in df.columns else df.withColumn(column, F.lit(name))
        for name, df in sorted(parts.items())
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), labelled)


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("dataset", "split").parquet(path)


def _table(spark: SparkSession, root: str) -> DataFrame:
    table = read_tree(spark, root, {"dataset", "split"})
    return table.where(~F.col("dataset").isin(*RESERVED) & F.col("split").isin(*SPLITS))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Dataset and split names with their row counts, from file footers and folder names."""
    found = (
        _table(spark, root)
        .groupBy("dataset", "split")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy("dataset", "split")
    )
    if found.isEmpty():
        raise FileNotFoundError(f"no datasets under {root}")
    return found


def scan_split(
    spark: SparkSession,
    root: str,
    split: str,
    datasets: Sequence[str] | None = None,
    required: bool = False,
) -> DataFrame:
    """All datasets' rows of one split; datasets without that split are skipped."""
    rows = _table(spark, root).where(F.col("split") == split)
    if datasets is not None:
        rows = rows.where(F.col("dataset").isin(*datasets))
    if required and rows.isEmpty():
        raise FileNotFoundError(f"no rows for split '{split}' under {root}")
    return rows if "source" in rows.columns else rows.withColumn("source", F.col("dataset"))
