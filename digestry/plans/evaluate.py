"""Summarize with every strategy and system, score, and compare."""

from __future__ import annotations

import time
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from digestry.functions import text, tokens
from digestry.operators.order import row_window
from digestry.operators.scores import ROUGE_KINDS, compare_systems, long_scores, score
from digestry.operators.summarize import (
    STRATEGIES,
    Summarizer,
    stage,
    strategy_entries,
)


def test_sample(rows: DataFrame, order_by: list[str], n: int | None = 500) -> DataFrame:
    """The first ``n`` rows in order, or all of them when there are fewer or ``n`` is None."""
    return row_window(rows, order_by, 0, n)


def predictions(
    pairs: DataFrame,
    systems: dict[str, Summarizer],
    strategies: tuple[str, ...] = STRATEGIES,
    context: int = 32_768,
    max_sequence: int = 1024,
    min_summary: int = 64,
    max_summary: int = 1024,
    boundary: str = "word",
    tokenizer=tokens.WORDS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``row_id, system, strategy, strategy_rank, route, prediction, reference``, and ``keep``.

    Chunks and extracts are made once per document and shared by all systems; every system and
    strategy is a column of the document's row, so the fan-out needs no join.
    """
    staged = stage(
        pairs, "row_id", strategies, context, max_sequence, max_summary, boundary, tokenizer
    )
    each = F.array(
        *[
            F.struct(
                F.lit(name).alias("system"),
                strategy_entries(
                    summarizer, strategies, context, min_summary, max_summary, tokenizer
                ).alias("entries"),
            )
            for name, summarizer in systems.items()
        ]
    )
    by_system = staged.select(
        "row_id", *keep, F.col("summary").alias("reference"), F.explode_outer(each).alias("s")
    )
    return by_system.select(
        "row_id", *keep, "reference", F.col("s.system").alias("system"),
        F.explode_outer("s.entries").alias("e"),
    ).select(
        "row_id",
        "system",
        "e.strategy",
        "e.strategy_rank",
        "e.route",
        F.col("e.summary").alias("prediction"),
        "reference",
        *keep,
    )


def timed_predictions(
    pairs: DataFrame,
    systems: dict[str, Summarizer],
    out: str,
    strategies: tuple[str, ...] = STRATEGIES,
    tokenizer=tokens.WORDS,
    **options,
) -> DataFrame:
    """Write the predictions of each strategy and system to ``out`` in a run of its own, and return what
    the runs tell: ``strategy, system, metric, value`` with ``n_rows``, ``tokens_in`` and ``tokens_out``,
    observed while rows were written, and ``duration_sec``.

    Documents are cut and ranked by each run anew, as the time of a run is that of all its work. Compare
    durations with ``lower_is_better=("duration_sec",)``.
    """
    spark = pairs.sparkSession
    found = []
    for strategy in strategies:
        for name, summarizer in systems.items():
            staged = stage_rows(pairs, summarizer, name, (strategy,), tokenizer, options)
            seen = Observation(f"{strategy}/{name}")
            watched = staged.observe(
                seen,
                F.count(F.lit(1)).alias("n_rows"),
                F.sum("tokens_in").alias("tokens_in"),
                F.sum(tokenizer.count(F.col("prediction"))).alias("tokens_out"),
            )
            start = time.perf_counter()
            watched.drop("tokens_in").write.mode("overwrite").parquet(
                f"{out}/strategy={strategy}/system={name}"
            )
            values = {**seen.get, "duration_sec": round(time.perf_counter() - start, 3)}
            found += [(strategy, name, metric, float(v or 0)) for metric, v in values.items()]
    return spark.createDataFrame(found, "strategy string, system string, metric string, value double")


def stage_rows(
    pairs: DataFrame, summarizer: Summarizer, name: str, strategies: tuple[str, ...], tokenizer, options: dict
) -> DataFrame:
    """``predictions`` of one system without its name, and the tokens of each document."""
    rows = predictions(
        pairs.withColumn("_in", tokenizer.count(F.col("document"))),
        {name: summarizer}, strategies, tokenizer=tokenizer, keep=("_in",), **options,
    )
    return rows.select("row_id", "route", "prediction", "reference", F.col("_in").alias("tokens_in"))


def evaluate(
    pairs: DataFrame, systems: dict[str, Summarizer], stemmed: bool = True, encode=None, **options
) -> DataFrame:
    """``strategy, system, metric, value`` in long form."""
    rows = predictions(pairs, systems, **options)
    table = score(rows, ["strategy", "system"], stemmed, encode)
    return long_scores(table, ["strategy", "system"])


def evaluate_and_compare(
    pairs: DataFrame, systems: dict[str, Summarizer], stemmed: bool = True, encode=None, **options
) -> DataFrame:
    """``strategy, metric, base, adapter, delta, winner``."""
    return compare_systems(
        evaluate(pairs, systems, stemmed, encode, **options), ["strategy", "metric"]
    )


def strategy_pairs(rows: DataFrame, strategies: tuple[str, ...] = STRATEGIES) -> DataFrame:
    """``row_id, pair, prediction, reference``: each two strategies of a document, in order.

    ``rows`` have the summaries of a document as ``entries`` (structs with ``strategy`` and
    ``prediction``), from which the pairs are read in the row; or one row a strategy, which meet in one
    row of fixed width first. The earlier strategy is the prediction.
    """
    if "entries" not in rows.columns:
        rows = (
            rows.where(F.col("strategy").isin(*strategies))
            .groupBy("row_id")
            .agg(F.collect_list(F.struct("strategy", "prediction")).alias("entries"))
        )

    def of(name: str, entries: Column) -> Column:
        return F.get(F.filter(entries, lambda e: e["strategy"] == name), F.lit(0))["prediction"]

    def paired(v: Column) -> Column:
        return F.array(
            *[
                F.struct(
                    F.lit(f"{a} vs {b}").alias("pair"),
                    of(a, v["entries"]).alias("prediction"),
                    of(b, v["entries"]).alias("reference"),
                )
                for a, b in combinations(strategies, 2)
            ]
        )

    pairs = text.bind(paired, entries=F.col("entries"))
    return (
        rows.select("row_id", F.explode_outer(pairs).alias("e"))
        .select("row_id", "e.*")
        .where(F.col("prediction").isNotNull() & F.col("reference").isNotNull())
    )


def cross_comparison(
    rows: DataFrame,
    strategies: tuple[str, ...] = STRATEGIES,
    stemmed: bool = True,
    encode=None,
    rounded: bool = True,
    kinds: Sequence[str] = ROUGE_KINDS,
) -> DataFrame:
    """Each strategy pair of each document, scored as a corpus of one."""
    ids = ["row_id", "pair"]
    return score(strategy_pairs(rows, strategies), ids, stemmed, encode, rounded, kinds)
