"""Corpus build: sources to pairs, pairs to a clean sharded corpus, and its funnel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.functions.prompts import training_text
from digestry.operators.dedup import SPLITS
from digestry.operators.filters import (
    WordBounds,
    attach_fences,
    inside_fences,
    with_source,
    within_bounds,
)
from digestry.operators.order import group_head
from digestry.sources.pairs import SourceSpec, combine, scan_pairs, write_pairs
from digestry.sources.shards import assign_shards, write_sharded


def prepare(
    spark: SparkSession,
    specs: list[SourceSpec],
    out: str,
    order_by: list[str],
    limit_rows: int | None = None,
    splits: tuple[str, ...] = SPLITS,
) -> None:
    """Normalize every source's splits into one ``dataset=/split=`` pair table."""
    parts = {
        f"{spec.name}/{split}": scan_pairs(spark, spec, split).withColumns(
            {"dataset": F.lit(spec.name), "split": F.lit(split)}
        )
        for spec in specs
        for split in splits
    }
    pairs = combine(parts)
    if limit_rows is not None:
        pairs = group_head(pairs, ["dataset", "split"], order_by, limit_rows)
    write_pairs(pairs, out)


def staged_groups(
    pairs: DataFrame, bounds: WordBounds = WordBounds(), normalized: bool = False
) -> DataFrame:
    """The funnel's working table: copies collapsed, with a flag per stage.

    Rows of one split with equal document digest, ``dw`` and ``sw`` pass or fail every stage
    together, so they become one row with a count ``n`` and the first ``row_id``. The collapse
    happens map-side; what is left per digest is bounded by the distinct summary lengths. Stage
    order: leakage on raw rows, hard bounds, quartile fences over what is left, then first copy.
    """
    groups = (
        pairs.where(F.col("split").isin(*SPLITS))
        .select(
            "split",
            "row_id",
            text.content_key(F.col("document")).alias("_key"),
            text.word_count(F.col("document"), normalized).alias("dw"),
            text.word_count(F.col("summary"), normalized).alias("sw"),
        )
        .groupBy("split", "_key", "dw", "sw")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))
        .withColumn("ratio", text.length_ratio(F.col("sw"), F.col("dw")))
    )
    in_train = F.max(F.col("split") == "train").over(Window.partitionBy("_key"))
    flagged = groups.withColumn("clean", (F.col("split") == "train") | ~in_train).withColumn(
        "hard", F.col("clean") & within_bounds(bounds)
    )
    counted = flagged.withColumn("_x", F.when(F.col("hard"), F.col("ratio")))
    fenced = attach_fences(counted, ["split"], "_x", weight=F.col("n"), closed=True)
    return fenced.withColumn(
        "iqr_ok", F.col("hard") & inside_fences(F.col("ratio"))
    ).drop("lo", "hi", "iqr", "_x")


def survivors(
    pairs: DataFrame, bounds: WordBounds = WordBounds(), normalized: bool = False
) -> DataFrame:
    """``split, row_id`` of the rows that the corpus build keeps."""
    return (
        staged_groups(pairs, bounds, normalized)
        .where("iqr_ok")
        .groupBy("split", "_key")
        .agg(F.min("row_id").alias("row_id"))
        .select("split", "row_id")
    )


def prep_funnel(
    pairs: DataFrame, bounds: WordBounds = WordBounds(), normalized: bool = False
) -> DataFrame:
    """Rows per split that enter and leave each stage."""

    def passed(flag: str):
        return F.sum(F.when(F.col(flag), F.col("n")).otherwise(F.lit(0)))

    per_key = (
        staged_groups(pairs, bounds, normalized)
        .groupBy("split", "_key")
        .agg(
            F.sum("n").alias("input"),
            passed("clean").alias("clean"),
            passed("hard").alias("hard"),
            passed("iqr_ok").alias("iqr_ok"),
            F.max("iqr_ok").cast("int").alias("kept"),
        )
    )
    return per_key.groupBy("split").agg(
        F.sum("input").alias("input"),
        F.sum("clean").alias("after_leakage"),
        F.sum("hard").alias("after_hard"),
        F.sum("iqr_ok").alias("after_iqr"),
        F.sum("kept").cast("long").alias("after_dedup"),
    )


def process(
    pairs: DataFrame,
    out: str,
    rows_per_shard: int = 100_000,
    min_shards: int = 1,
    bounds: WordBounds = WordBounds(),
    source: str = "unknown",
    normalized: bool = False,
) -> None:
    """Clean, render prompts and write ``out/split=/shard=``.

    All decisions are taken on digests and counts; the texts are joined once, at the end, to the
    surviving row ids and their shard numbers.
    """
    assigned = assign_shards(
        survivors(pairs, bounds, normalized), ["row_id"], ["split"], rows_per_shard, min_shards
    )
    texts = with_source(pairs, source).select("split", "row_id", "source", "document", "summary")
    prompt = {"text": training_text(F.col("document"), F.col("summary"))}
    write_sharded(texts, out, ["row_id"], ["split"], assigned=assigned, derived=prompt)
