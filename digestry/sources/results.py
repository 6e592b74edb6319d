"""Result sinks: score tables, nested JSON export and summary-only text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_scores(scores: DataFrame, path: str) -> None:
    """Save a finished strategy at once: other strategies' partitions are left alone."""
    (
        scores.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("strategy")
        .parquet(path)
    )


def scores_json(scores: DataFrame) -> DataFrame:
    """``strategy, json`` from ``strategy, system, metric, value``: ``{system: {metric: value}}``.

    Both nested maps are bounded by the number of systems and metrics.
    """
    per_system = scores.groupBy("strategy", "system").agg(
        F.sort_array(F.collect_list(F.struct("metric", "value"))).alias("m")
    )
    per_strategy = per_system.groupBy("strategy").agg(
        F.sort_array(F.collect_list(F.struct("system", "m"))).alias("s")
    )
    nested = F.map_from_entries(
        F.transform("s", lambda e: F.struct(e["system"], F.map_from_entries(e["m"])))
    )
    return per_strategy.select("strategy", F.to_json(nested).alias("json"))


def write_json(scores: DataFrame, path: str) -> None:
    """One document ``{strategy: {system: {metric: value}}}``; its size is strategies x systems x
    metrics."""
    lines = scores_json(scores).select(
        F.struct("strategy", F.from_json("json", "map<string,map<string,double>>").alias("v")).alias("e")
    )
    nested = lines.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("json"))
    nested.coalesce(1).write.mode("overwrite").text(path)


def write_summaries(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """One JSON object a line, so that line breaks inside a summary do not part it."""
    df.select(F.to_json(F.struct(*keys, "summary")).alias("line")).write.mode("overwrite").text(path)
