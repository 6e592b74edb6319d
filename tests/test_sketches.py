"""Mergeable quantile sketches against exact quantiles."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from digestry.catalog.feeds import frozen_references
from digestry.operators import sketches
from digestry.session import work_path
from digestry.streaming.feed import sketched_fences, start_feed
from tests.test_storage import PAIR_SCHEMA, skewed_pairs

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


def held_rows(spark, values):
    return spark.createDataFrame(
        [("a" if i % 3 else "b", i % 4, v) for i, v in enumerate(values)], "g string, day int, x double"
    )


def assert_bounds(spark, values):
    rows = held_rows(spark, values)
    days = sketches.sketch(rows, ["day", "g"], {"x": F.col("x")})
    got = {r["g"]: r for r in sketches.quantiles(days, ["g"], PROBS).collect()}
    for g in ("a", "b"):
        mine = [v for i, v in enumerate(values) if ("a" if i % 3 else "b") == g]
        finite = np.array([v for v in mine if v is not None and np.isfinite(v)])
        if not len(finite):
            assert g not in got
            continue
        row = got[g]
        assert row["n"] == len(finite)
        assert (row["min_value"], row["max_value"]) == (finite.min(), finite.max())
        for exact, q, low, high in zip(np.quantile(finite, PROBS), row["q"], row["at_least"], row["at_most"]):
            slack = 1e-9 * max(1.0, abs(exact))
            assert low - slack <= exact <= high + slack and low - slack <= q <= high + slack
            assert high - low <= 0.016 * max(abs(low), abs(high)) + 2.1e-9


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    assert_bounds(spark, [float(v) for v in rng.lognormal(0, 2, 3000)])
    assert_bounds(spark, [float(v) for v in rng.normal(0, 5, 2000)])
    assert_bounds(spark, [0.5] * 1000 + [float(v) for v in rng.integers(-3, 4, 500)])
    assert_bounds(spark, [1.0, None, float("nan"), float("inf"), None, 2.0, -float("inf")])
    assert_bounds(spark, [None] * 6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e12, 1e12, allow_nan=False), min_size=1, max_size=40))
def test_bounds_hold_for_any_values(spark, values):
    assert_bounds(spark, values)


def test_merging_is_the_sketch_of_all_rows(spark):
    values = [float(v) for v in np.random.default_rng(1).lognormal(0, 1, 500)]
    rows = held_rows(spark, values)
    whole = sketches.sketch(rows, ["g"], {"x": F.col("x")})
    days = sketches.sketch(rows, ["day", "g"], {"x": F.col("x")})
    nested = sketches.merge(sketches.merge(days, ["day", "g"]), ["g"])
    order = ["g", "feature", "bucket", "held", "low", "high"]
    assert sorted(map(tuple, whole.select(order).collect())) == sorted(
        map(tuple, nested.select(order).collect())
    )
    doubled = sketches.sketch(rows, ["g"], {"x": F.col("x")}, weight=F.lit(2))
    assert doubled.agg(F.sum("held")).first()[0] == 2 * len(values)


def test_a_delivery_replaces_itself(spark):
    path = work_path(spark, "sketches")
    one = sketches.sketch(held_rows(spark, [1.0, 2.0, 3.0]), ["g"], {"x": F.col("x")})
    for delivery in ("1", "2", "2"):
        sketches.store(one, path, delivery)
    merged = sketches.quantiles(sketches.stored_sketches(spark, path), ["g"], (0.5,))
    assert {r["g"]: r["n"] for r in merged.collect()} == {"a": 4, "b": 2}


def test_feed_leaves_sketches_of_all_rows(spark):
    rows = spark.createDataFrame(skewed_pairs(3, 240), PAIR_SCHEMA)
    keys, fences = frozen_references(rows)
    inbox, out, progress, held = (work_path(spark, n) for n in ("inbox", "out", "progress", "sketches"))
    rows.select("split", "row_id", "source", "document", "summary").repartition(3).write.parquet(inbox)
    start_feed(
        spark, inbox, out, progress, keys, fences, files_per_trigger=1, sketches=held
    ).awaitTermination()
    assert spark.read.parquet(held).select("delivery").distinct().count() == 3
    exact = {r["split"]: r for r in fences.collect()}
    for row in sketched_fences(spark, held).collect():
        assert abs(row["lo"] - exact[row["split"]]["lo"]) < 0.05 * max(abs(exact[row["split"]]["hi"]), 0.01)
        assert abs(row["hi"] - exact[row["split"]]["hi"]) < 0.05 * max(abs(exact[row["split"]]["hi"]), 0.01)
