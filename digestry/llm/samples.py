"""Bounded samples of labelled rows for fitting classifiers, without moving texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import remainder, save


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    label: str,
    parts: int,
    held_out: int,
    per_class: int,
) -> tuple[DataFrame, dict[int, int]]:
    """``text, label`` of at most ``per_class`` training rows of each class, and the class sizes.

    Rows whose key leaves remainder ``held_out`` modulo ``parts`` are never used. The rows are those
    of the least hash of their key; equal texts count once. Keys with labels that disagree count as
    class 1. Only the chosen keys are sent to the texts.
    """
    usable = (
        labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
        .where(remainder(key, parts) != held_out)
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("label"))
    )
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    chosen = None
    for value in (0, 1):
        some = usable.where(F.col("label") == value).orderBy(F.xxhash64(key), key).limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    # at most 2 * per_class keys
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)
    whole = F.coalesce("text", F.lit(""))
    distinct = rows.select(whole.alias("text"), "label").groupBy("text").agg(
        F.max("label").alias("label")
    )
    return save(distinct, "sample"), sizes
