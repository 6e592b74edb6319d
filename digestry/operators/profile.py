"""Corpus profile, threshold violations, validation report and histograms.

Every report starts from the same collapsed table: one row per split and combination of lengths
with a count, built by map-side aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.operators.filters import attach_fences, outside_fences
from digestry.operators.order import group_head, row_window
from digestry.operators.quantiles import five_number, iqr_fences
from digestry.session import stored

# The threshold checks, in report order.
CHECKS = (
    ("doc_words < 30", "dw < 30"),
    ("doc_words > 1500", "dw > 1500"),
    ("sum_words < 10", "sw < 10"),
    ("sum_words > 150", "sw > 150"),
    ("ratio > 1.0", "ratio > 1.0"),
    ("ratio < 0.02", "ratio < 0.02"),
    ("ratio > 0.6", "ratio > 0.6"),
)
CHECK_FLAG_PCT = 1.0
OUTLIER_FLAG_PCT = 5.0

# The names of the profiled features in the output.
FEATURES = {
    "document_chars": "dc",
    "summary_chars": "sc",
    "document_words": "dw",
    "summary_words": "sw",
    "summary_to_doc_word_ratio": "ratio",
}


MEASURES = ("dw", "sw", "dc", "sc", "ratio")


def measures(
    pairs: DataFrame, keep: Sequence[str] = ("split",), normalized: bool = False
) -> DataFrame:
    """Word and character counts per row; no text leaves this projection.

    A table that holds the measures already is only narrowed, so that several reports can share
    one reading of the texts.
    """
    if set(MEASURES) <= set(pairs.columns):
        return pairs.select(*keep, *MEASURES)
    document, summary = F.col("document"), F.col("summary")
    return pairs.select(
        *keep,
        text.word_count(document, normalized).alias("dw"),
        text.word_count(summary, normalized).alias("sw"),
        F.coalesce(F.char_length(document), F.lit(0)).alias("dc"),
        F.coalesce(F.char_length(summary), F.lit(0)).alias("sc"),
    ).withColumn("ratio", text.length_ratio(F.col("sw"), F.col("dw")))


def collapsed(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``split, columns, n``: equal rows merged before any shuffle."""
    return (
        measures(pairs)
        .groupBy("split", *columns)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def profile_pairs(
    pairs: DataFrame, order_by: Sequence[str] = ("row_id",), sample_rows: int | None = 5000
) -> DataFrame:
    """Per split: row count, sample size, blank rates and five-number summaries of the sample.

    The lengths are materialized once; every figure comes from that narrow table.
    """
    rows = stored(measures(pairs, ["split", *order_by]))
    if rows.isEmpty():
        raise ValueError("nothing to profile")
    sample = rows if sample_rows is None else group_head(rows, ["split"], order_by, sample_rows)
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    rates = sample.groupBy("split").agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.avg(F.when(F.col("dw") == 0, 1.0).otherwise(0.0)).alias("empty_document_ratio"),
        F.avg(F.when(F.col("sw") == 0, 1.0).otherwise(0.0)).alias("empty_summary_ratio"),
    )
    blocks = five_number(sample, ["split"], {name: F.col(c) for name, c in FEATURES.items()})
    # All three tables hold one row per split (and feature); AQE joins them by their size.
    return blocks.drop("n").join(counts, "split").join(rates, "split")


def profile_wide(profile: DataFrame) -> DataFrame:
    """One row per split, with a struct per feature."""
    block = F.struct("min", "p25", "p50", "p75", "max")
    heads = ["n_rows", "sample_size", "empty_document_ratio", "empty_summary_ratio"]
    return profile.groupBy("split", *heads).agg(
        *[F.max(F.when(F.col("feature") == name, block)).alias(name) for name in FEATURES]
    )


def blank_rates(pairs: DataFrame, columns: Sequence[str] = ("document", "summary")) -> DataFrame:
    blank = [
        F.avg(F.when(text.word_count(F.col(c)) == 0, 1.0).otherwise(0.0)).alias(f"blank_{c}")
        for c in columns
    ]
    return pairs.groupBy("split").agg(*blank)


def violations(pairs: DataFrame) -> DataFrame:
    """``split, n`` and one count column ``v0..v6`` per threshold check."""
    rows = measures(pairs)
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.expr(rule)).alias(f"v{i}") for i, (_, rule) in enumerate(CHECKS)],
    )


def _percent(count: Column, n: Column) -> Column:
    return count / n * 100


def validation_report(pairs: DataFrame) -> DataFrame:
    """``split, check, count, pct, flagged``: seven thresholds and two outlier checks."""
    grouped = collapsed(pairs, ["dw", "sw", "ratio"])
    watched = ("ratio", "dw")
    fences = (
        iqr_fences(grouped, ["split"], {c: F.col(c) for c in watched}, weight=F.col("n"))
        .groupBy("split")
        .agg(
            *[
                F.max(F.when(F.col("feature") == c, F.col(edge))).alias(f"{edge}_{c}")
                for c in watched
                for edge in ("lo", "hi")
            ]
        )
    )
    fenced = grouped.join(F.broadcast(fences), "split").withColumns(  # one row per split
        {
            f"out_{c}": (F.col(c) < F.col(f"lo_{c}")) | (F.col(c) > F.col(f"hi_{c}"))
            for c in watched
        }
    )
    rules = [(name, F.expr(rule), CHECK_FLAG_PCT) for name, rule in CHECKS] + [
        ("IQR outlier on ratio", F.col("out_ratio"), OUTLIER_FLAG_PCT),
        ("IQR outlier on doc_words", F.col("out_dw"), OUTLIER_FLAG_PCT),
    ]
    zero = F.lit(0).cast("long")
    totals = fenced.groupBy("split").agg(
        F.sum("n").alias("n"),
        *[
            F.sum(F.when(rule, F.col("n")).otherwise(zero)).alias(f"c{i}")
            for i, (_, rule, _) in enumerate(rules)
        ],
    )
    entries = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("check"),
                    F.col(f"c{i}").alias("count"),
                    F.lit(limit).alias("limit"),
                )
                for i, (name, _, limit) in enumerate(rules)
            ]
        )
    )
    pct = _percent(F.col("e.count"), F.col("n"))
    return totals.select("split", "n", entries.alias("e")).select(
        "split",
        F.col("e.check").alias("check"),
        F.col("e.count").alias("count"),
        pct.alias("pct"),
        (pct > F.col("e.limit")).alias("flagged"),
    )


def outlier_counts(pairs: DataFrame, column: str = "ratio") -> DataFrame:
    grouped = collapsed(pairs, [column])
    fenced = attach_fences(grouped, ["split"], column, weight=F.col("n"))
    return fenced.groupBy(
        "split", outside_fences(F.col(column)).alias("is_outlier")
    ).agg(F.sum("n").alias("n"))


def histogram(
    pairs: DataFrame, columns: Sequence[str] = ("dw", "sw", "ratio"), bins: int = 50
) -> DataFrame:
    """``split, feature, bin, left, right, n, density``: equal widths, last bin closed.

    A constant column gets the range half a unit to either side. Empty bins have no row.
    """
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                for c in columns
            ]
        )
    )
    valued = (
        measures(pairs)
        .select("split", each.alias("v"))
        .groupBy("split", F.col("v.feature").alias("feature"), F.col("v.x").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    flat = F.col("lo0") == F.col("hi0")
    spans = (
        valued.groupBy("split", "feature")
        .agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"), F.sum("n").alias("total"))
        .select(
            "split",
            "feature",
            "total",
            F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
            F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
        )
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(bins)
    bin_no = F.least(
        F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)
    ).cast("int")
    counted = (
        valued.join(F.broadcast(spans), ["split", "feature"])  # splits x features rows
        .groupBy("split", "feature", "lo", "hi", "total", bin_no.alias("bin"))
        .agg(F.sum("n").alias("n"))
    )
    return counted.select(
        "split",
        "feature",
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right"),
        "n",
        (F.col("n") / (F.col("total") * width)).alias("density"),
    )


def scatter_sample(
    pairs: DataFrame, order_by: Sequence[str] = ("row_id",), n: int | None = 2000
) -> DataFrame:
    """Word counts of the first ``n`` rows, of which alone the texts are read for counting; of all rows
    when ``n`` is None."""
    head = row_window(pairs, order_by, 0, n)
    return measures(head, order_by).select(*order_by, "dw", "sw")
