"""The profiling report: every table of one corpus review."""

from __future__ import annotations

from pyspark.sql import DataFrame

from digestry.operators.dedup import duplicate_report, split_overlap
from digestry.operators.profile import (
    histogram,
    measures,
    outlier_counts,
    profile_pairs,
    scatter_sample,
    validation_report,
)
from digestry.session import stored


def corpus_report(pairs: DataFrame, sample_rows: int | None = None) -> dict[str, DataFrame]:
    """Named report tables. The texts are read once for lengths and once for digests."""
    lengths = stored(measures(pairs, ["split", "row_id"]))
    return {
        "profile": profile_pairs(lengths, sample_rows=sample_rows),
        "validation": validation_report(lengths),
        "outliers": outlier_counts(lengths),
        "histograms": histogram(lengths, bins=50),
        "split_histograms": histogram(lengths, bins=60),
        "scatter": scatter_sample(lengths),
        "duplicates": duplicate_report(pairs),
        "overlap": split_overlap(pairs),
    }
