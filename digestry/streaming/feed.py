"""Incremental corpus feed: new pair files are cleaned with frozen references and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from digestry.functions.prompts import training_text
from digestry.functions.text import content_key
from digestry.operators import sketches as quantile_sketches
from digestry.operators.dedup import SPLITS, drop_known_keys
from digestry.operators.filters import WordBounds, inside_fences, to_pairs, with_lengths, within_bounds

RAW_SCHEMA = "split string, row_id long, source string, document string, summary string"


def bounded(raw: DataFrame, bounds: WordBounds = WordBounds()) -> DataFrame:
    """Normalized rows within bounds, with their ``ratio`` and the digest ``_key`` of their document."""
    pairs = to_pairs(raw, "document", "summary", keep=("split", "row_id", "source"))
    return with_lengths(pairs).where(within_bounds(bounds)).select(
        "split", "row_id", "source", "document", "summary", "ratio",
        content_key(F.col("document")).alias("_key"),
    )


def fenced(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """The rows of ``bounded`` within the fences of their split."""
    known = F.broadcast(fences.where(F.col("split").isin(*SPLITS)))  # one row per split
    return rows.join(known, "split").where(inside_fences(F.col("ratio")))


def rendered(kept: DataFrame, train_keys: DataFrame) -> DataFrame:
    """Drop evaluation rows whose digest is a training document's, and render."""
    is_train = F.col("split") == "train"
    evals = drop_known_keys(kept.where(~is_train), train_keys)
    return (
        kept.where(is_train).unionByName(evals)
        .withColumn("text", training_text(F.col("document"), F.col("summary")))
        .select("split", "row_id", "source", "document", "summary", "text")
    )


def clean(
    raw: DataFrame, train_keys: DataFrame, fences: DataFrame, bounds: WordBounds = WordBounds()
) -> DataFrame:
    """Normalize, bound, apply fixed fences, drop leakage, render.

    ``train_keys`` holds ``_key``, the distinct digests of the training documents; ``fences`` holds
    ``split, lo, hi, iqr``, one row per split.
    """
    return rendered(fenced(bounded(raw, bounds), fences), train_keys)


def sketched_fences(spark: SparkSession, path: str) -> DataFrame:
    """Fences of the ratio per split from all sketches stored so far; no row is read again."""
    held = quantile_sketches.stored_sketches(spark, path).where("feature = 'ratio'")
    return quantile_sketches.fences(held, ["split"]).select("split", "lo", "hi", "iqr")


def start_feed(
    spark: SparkSession,
    inbox: str,
    out: str,
    checkpoint: str,
    train_keys: DataFrame,
    fences: DataFrame,
    bounds: WordBounds = WordBounds(),
    files_per_trigger: int = 1000,
    sketches: str | None = None,
) -> StreamingQuery:
    """Process what the inbox holds, append it to ``out/batch=N``, and stop; restart to continue.

    A batch that is run again after a failure overwrites its own folder, so rows appear once. With a
    folder for ``sketches``, each batch also leaves the sketch of its ratios there before any fence, so that
    ``sketched_fences`` of a later start follow all rows seen so far.
    """

    def append(batch: DataFrame, number: int) -> None:
        # texts are normalized, counted and digested once; the parts below read what is held
        held = bounded(batch, bounds).persist()
        try:
            if sketches:
                ratios = quantile_sketches.sketch(held, ["split"], {"ratio": F.col("ratio")})
                quantile_sketches.store(ratios, sketches, f"batch-{number}")
            rendered(fenced(held, fences), train_keys).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            held.unpersist()

    return (
        spark.readStream.schema(RAW_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(inbox)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
    )
