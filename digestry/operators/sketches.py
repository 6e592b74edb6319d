"""Quantile sketches that add up: counts per narrow bucket of values, with the extremes of each bucket.

A sketch is a small table, ``by..., feature, bucket, held, low, high``. Sketches of files, days or deliveries
are stored as they come, and merged by one aggregation, so new quantiles never read old rows. Counts are exact,
so the bucket of a rank is exact too: the quantile over all rows lies between the two bounds that are given
with each estimate, less than 1.6 % of its size apart (where magnitudes are above 1e-9). Buckets of a single
value, such as small counts, give exact results.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.operators.quantiles import value_bucket

PARTS = ("held", "low", "high")


def _merged(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by, "feature", "bucket").agg(
        F.sum("held").alias("held"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def sketch(
    df: DataFrame, by: Sequence[str], features: Mapping[str, Column], weight: Column | None = None
) -> DataFrame:
    """The sketch of every feature per group; nulls are left out, NaN and infinite values too, as they have
    no place between others. ``weight`` is how many rows a row stands for."""
    w = F.lit(1) if weight is None else weight
    values = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("feature"), value.cast("double").alias("x"))
                for name, value in features.items()
            ]
        )
    )
    rows = df.select(*by, w.cast("long").alias("held"), values.alias("v")).select(
        *by, "held", "v.feature", "v.x"
    )
    finite = rows.where((F.abs("x") < float("inf")) & (F.col("held") > 0))
    return _merged(
        finite.select(
            *by, "feature", value_bucket(F.col("x")).alias("bucket"), "held",
            F.col("x").alias("low"), F.col("x").alias("high"),
        ),
        by,
    )


def merge(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """One sketch per group from any number of them; in any order and nesting the same."""
    return _merged(sketches, by)


def store(sketches: DataFrame, path: str, delivery: str) -> None:
    """Keep the sketches of one delivery; the same delivery again replaces its own."""
    sketches.write.mode("overwrite").parquet(f"{path}/delivery={delivery}")


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantiles(sketches: DataFrame, by: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``by, feature, n, min_value, max_value, q, at_least, at_most`` (arrays, as ``probs``).

    Linear interpolation between neighbouring order statistics, each placed evenly within its bucket. The
    exact quantile is never below ``at_least`` nor above ``at_most``. Groups meet as buckets only, whose
    number does not grow with the rows.
    """
    group = [*by, "feature"]
    whole = Window.partitionBy(*group)
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = merge(sketches, by).select(
        *group, *PARTS, F.sum("held").over(whole).alias("n"),
        (F.sum("held").over(upto) - F.col("held")).alias("before"),
    )
    ranks = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    sums = [F.min("low").alias("min_value"), F.max("high").alias("max_value")]
    for i, rank in enumerate(ranks):
        for side, whole_rank in (("f", F.floor(rank)), ("c", F.ceil(rank))):
            at = whole_rank - F.col("before")
            here = (at >= 0) & (at < F.col("held"))
            step = (F.col("high") - F.col("low")) / F.greatest(F.col("held") - 1, F.lit(1))
            for name, value in (
                ("q", F.col("low") + step * at), ("at_least", F.col("low")), ("at_most", F.col("high"))
            ):
                sums.append(F.max(F.when(here, value)).alias(f"_{name}{side}{i}"))
    found = placed.groupBy(*group, "n").agg(*sums)

    def between(name: str) -> Column:
        parts = []
        for i, rank in enumerate(ranks):
            low, high = F.col(f"_{name}f{i}"), F.col(f"_{name}c{i}")
            parts.append(low + (high - low) * (rank - F.floor(rank)))
        return F.array(*parts).alias(name)

    return found.select(
        *group, "n", "min_value", "max_value", between("q"), between("at_least"), between("at_most")
    )


def fences(sketches: DataFrame, by: Sequence[str], k: float = 1.5) -> DataFrame:
    """``n, q1, q3, iqr, lo, hi`` per group and feature, as ``iqr_fences`` gives from whole rows."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return (
        quantiles(sketches, by, (0.25, 0.75))
        .select(*by, "feature", "n", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))
        .withColumn("lo", F.col("q1") - F.lit(k) * F.col("iqr"))
        .withColumn("hi", F.col("q3") + F.lit(k) * F.col("iqr"))
    )
