"""Training and validation feeds over a sharded corpus, and the step plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import tokens
from digestry.functions.prompts import training_text
from digestry.operators.order import repeat_epochs, row_window, seeded_shuffle
from digestry.sources.shards import scan_shards

ORDER = ("shard_rank", "row_id")


def render(rows: DataFrame, max_length: int | None, tokenizer=tokens.WORDS) -> DataFrame:
    """``text`` from document and summary, cut to the token budget; its inputs are dropped."""
    document = F.col("document")
    if max_length:
        document = tokens.truncate_to_budget(document, F.col("summary"), max_length, tokenizer)
    return rows.withColumn("text", training_text(document, F.col("summary"))).drop(
        "document", "summary", "source"
    )


def training_feed(
    spark: SparkSession,
    path: str,
    max_length: int | None = 1024,
    shards: Sequence[int] | None = None,
    shard_offset: int = 0,
    offset: int = 0,
    max_rows: int | None = None,
    epochs: int = 1,
    seed: int = 42,
    tokenizer=tokens.WORDS,
) -> DataFrame:
    """Selected rows, each epoch in its own reproducible order, rendered."""
    rows = row_window(scan_shards(spark, path, shards, shard_offset), ORDER, offset, max_rows)
    rendered = render(rows, max_length, tokenizer)  # only the cut text is repeated and sorted
    return seeded_shuffle(repeat_epochs(rendered, epochs), "row_id", seed, "epoch")


def validation_feed(
    spark: SparkSession,
    path: str,
    max_length: int | None = 1024,
    shards: Sequence[int] | None = None,
    shard_offset: int = 0,
    offset: int = 0,
    max_rows: int | None = None,
    tokenizer=tokens.WORDS,
) -> DataFrame:
    """Selected rows in stored order, rendered; callers may ``persist`` a capped one."""
    rows = row_window(scan_shards(spark, path, shards, shard_offset), ORDER, offset, max_rows)
    return render(rows, max_length, tokenizer)


def stored_row_count(spark: SparkSession, path: str) -> DataFrame:
    """``n_rows`` of stored shards from the footers of their files: no column is read.

    The count is pushed into the file source, which the session's default reader does not do, so it runs
    in a session of its own that shares everything else.
    """
    counting = spark.newSession()
    counting.conf.set("spark.sql.sources.useV1SourceList", "")
    counting.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return counting.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


def plan_steps(
    rows: DataFrame,
    offset: int = 0,
    max_rows: int | None = None,
    batch_size: int = 2,
    accumulation: int = 4,
    epochs: int = 1,
    warmup_ratio: float = 0.03,
) -> DataFrame:
    """One row: ``num_rows, steps_per_epoch, max_steps, warmup_steps``.

    ``rows`` are the rows to train on, or one row with their stored count as ``n_rows``.
    """
    stored_count = rows.columns == ["n_rows"]
    total = F.coalesce(F.sum("n_rows"), F.lit(0)) if stored_count else F.count(F.lit(1))
    left = F.greatest(total - F.lit(offset), F.lit(0))
    num_rows = left if max_rows is None else F.least(left, F.lit(max_rows))
    per_step = batch_size * accumulation
    return (
        rows.agg(num_rows.cast("long").alias("num_rows"))
        .withColumn("steps_per_epoch", F.ceil(F.col("num_rows") / F.lit(per_step)))
        .withColumn("max_steps", F.col("steps_per_epoch") * F.lit(epochs))
        .withColumn(
            "warmup_steps",
            F.greatest(
                F.lit(1), F.floor(F.lit(float(warmup_ratio)) * F.col("max_steps"))
            ).cast("long"),
        )
    )
