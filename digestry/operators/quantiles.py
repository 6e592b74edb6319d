"""Exact interpolated quantiles without holding a group's values in one task.

Values are first collapsed to (value, count), which removes hot values map-side. Logarithmic
buckets of the value range then locate the wanted ranks; only the buckets that hold one are
sorted, each on its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.operators.dedup import SPLITS

BUCKETS_PER_E = 64
# Magnitudes below this share one bucket with zero.
TINY = 1e-9


def value_bucket(x: Column) -> Column:
    """A non-decreasing function of ``x`` with buckets about 1.6% wide."""
    magnitude = F.floor(F.ln(F.greatest(F.abs(x), F.lit(TINY)) / F.lit(TINY)) * BUCKETS_PER_E)
    return F.when(x < 0, -magnitude).otherwise(magnitude).cast("int")


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    features: Mapping[str, Column],
    probs: Sequence[float],
    weight: Column | None = None,
    closed: bool = False,
) -> DataFrame:
    """One row per group and feature: ``n, min_value, max_value`` and ``q`` (array, as ``probs``).

    Linear interpolation between the neighbouring order statistics; nulls are left out.
    ``closed`` says that the groups are the known splits: only these are kept, and their rows are
    broadcast. Other groupings are joined by size.
    """
    by = list(by)
    group = [*by, "feature"]
    each = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("feature"), value.cast("double").alias("x"))
                for name, value in features.items()
            ]
        )
    )
    w = F.lit(1) if weight is None else weight
    counted = (
        df.select(*by, w.cast("long").alias("w"), each.alias("v"))
        .select(*by, "w", "v.feature", "v.x")
        .where(F.col("x").isNotNull())
        .groupBy(*group, "x")
        .agg(F.sum("w").alias("w"))
        .withColumn("bucket", value_bucket(F.col("x")))
    )
    whole = Window.partitionBy(*group)
    preceding = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        counted.groupBy(*group, "bucket")
        .agg(F.sum("w").alias("held"), F.min("x").alias("low"), F.max("x").alias("high"))
        .select(
            *group,
            "bucket",
            "held",
            F.sum("held").over(whole).alias("n"),
            F.min("low").over(whole).alias("min_value"),
            F.max("high").over(whole).alias("max_value"),
            F.coalesce(F.sum("held").over(preceding), F.lit(0)).alias("before"),
        )
    )
    begin, end = F.col("before"), F.col("before") + F.col("held")
    ranks = [f(_rank(p)) for p in probs for f in (F.floor, F.ceil)]
    wanted = buckets.where(_any((rank >= begin) & (rank < end) for rank in ranks)).drop("held")
    # At most two buckets per group and probability.
    if closed and by == ["split"]:
        wanted = F.broadcast(wanted.where(F.col("split").isin(*SPLITS)))
    joined = counted.join(wanted, [*group, "bucket"])
    upto = F.sum("w").over(
        Window.partitionBy(*group, "bucket")
        .orderBy("x")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = joined.withColumn("upto", F.col("before") + upto)
    statistics = placed.groupBy(*group, "n", "min_value", "max_value").agg(
        *[F.max(F.when(_holds(rank), F.col("x"))).alias(f"_s{i}") for i, rank in enumerate(ranks)]
    )
    values = []
    for i, p in enumerate(probs):
        low, high = F.col(f"_s{2 * i}"), F.col(f"_s{2 * i + 1}")
        values.append(low + (high - low) * (_rank(p) - F.floor(_rank(p))))
    return statistics.select(
        *group, "n", "min_value", "max_value", F.array(*values).alias("q")
    )


def _rank(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(p))


def _holds(rank: Column) -> Column:
    """Does the row's run of equal values cover this 0-based rank?"""
    return (rank >= F.col("upto") - F.col("w")) & (rank < F.col("upto"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def iqr_fences(
    df: DataFrame,
    by: Sequence[str],
    features: Mapping[str, Column],
    k: float = 1.5,
    weight: Column | None = None,
    closed: bool = False,
) -> DataFrame:
    """``n, q1, q3, iqr, lo, hi`` per group and feature."""
    q1, q3 = F.col("q")[0], F.col("q")[1]
    return (
        exact_quantiles(df, by, features, (0.25, 0.75), weight, closed)
        .select(*by, "feature", "n", q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))
        .withColumn("lo", F.col("q1") - F.lit(k) * F.col("iqr"))
        .withColumn("hi", F.col("q3") + F.lit(k) * F.col("iqr"))
    )


def five_number(
    df: DataFrame,
    by: Sequence[str],
    features: Mapping[str, Column],
    weight: Column | None = None,
    closed: bool = False,
) -> DataFrame:
    """Minimum, quartiles and maximum per group and feature."""
    q = F.col("q")
    return exact_quantiles(df, by, features, (0.25, 0.5, 0.75), weight, closed).select(
        *by,
        "feature",
        "n",
        F.col("min_value").alias("min"),
        q[0].alias("p25"),
        q[1].alias("p50"),
        q[2].alias("p75"),
        F.col("max_value").alias("max"),
    )
