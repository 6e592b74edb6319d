"""Exact-content deduplication, train leakage and overlap between splits.

Every job shuffles digests and row ids only. Copies are collapsed map-side before any shuffle,
so a document that makes up a large part of the corpus costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.session import stored

SPLITS = ("train", "validation", "test")


def first_copies(df: DataFrame, row_id: str = "row_id", by: Sequence[str] = ("split",)) -> DataFrame:
    """Per group and document: the first row id and the number of copies."""
    return (
        df.select(*by, row_id, text.content_key(F.col("document")).alias("_key"))
        .groupBy(*by, "_key")
        .agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"))
        .drop("_key")
    )


def dedup_first(df: DataFrame, row_id: str = "row_id", by: Sequence[str] = ("split",)) -> DataFrame:
    """Keep the first row of each document in row-id order, per group."""
    return df.join(first_copies(df, row_id, by).drop("copies"), [*by, row_id], "left_semi")


def drop_leaked(evals: DataFrame, train: DataFrame) -> DataFrame:
    """Evaluation rows whose document is absent from train; copies among them stay."""
    return drop_known(evals, document_keys(train))


def document_keys(df: DataFrame) -> DataFrame:
    """``_key``: each distinct document digest once."""
    return df.select(text.content_key(F.col("document")).alias("_key")).distinct()


def drop_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose document digest is not among ``known`` (distinct ``_key``)."""
    keyed = rows.withColumn("_key", text.content_key(F.col("document")))
    return drop_known_keys(keyed, known).drop("_key")


def drop_known_keys(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose digest ``_key`` is not among ``known`` (distinct ``_key``).

    The digests on both sides meet first, each once; Catalyst broadcasts a small batch of rows
    against the known set instead of shuffling it, by its size in bytes. Only the overlap then
    meets the rows, in a join whose hot keys AQE splits. The digests are written,
    so the texts are read once for them and once for the result.
    """
    mine = stored(keyed.select("_key").distinct(), "keys")
    overlap = stored(known.join(mine, "_key", "left_semi"), "overlap")
    return keyed.join(overlap, "_key", "left_anti")


def index_keys(rows: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Add the document digests of ``rows`` to the index ``name``, a table at ``path`` that is dealt by
    digest into a fixed number of buckets, and return it.

    A later join by digest reads the buckets as they lie: only the other side is shuffled, to as many
    partitions. Digests that are in the index already are not added again, so they stay distinct.
    """
    spark = rows.sparkSession
    keys = document_keys(rows)
    if spark.catalog.tableExists(name):
        keys = keys.join(spark.table(name), "_key", "left_anti")
    (
        keys.repartition(buckets, "_key").sortWithinPartitions("_key")
        .write.mode("append").option("path", path)
        .bucketBy(buckets, "_key").sortBy("_key").saveAsTable(name)
    )
    return spark.table(name)


def split_key_counts(df: DataFrame) -> DataFrame:
    """``split, _key, n``: the collapsed form that the reports below share."""
    return (
        df.select("split", text.content_key(F.col("document")).alias("_key"))
        .groupBy("split", "_key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def leakage_counts(df: DataFrame) -> DataFrame:
    """Rows per evaluation split whose document also occurs in train."""
    per_key = _per_key(df, SPLITS)
    evals = [s for s in SPLITS if s != "train"]
    leaked = [
        F.coalesce(F.sum(F.when(F.col("train") > 0, F.col(s))), F.lit(0)).alias(s) for s in evals
    ]
    pairs = ", ".join(f"'{s}', {s}" for s in evals)
    return per_key.agg(*leaked).selectExpr(f"stack({len(evals)}, {pairs}) as (split, leaked)")


def duplicate_report(df: DataFrame) -> DataFrame:
    return (
        split_key_counts(df)
        .groupBy("split")
        .agg(F.sum("n").alias("n_rows"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))
        .withColumn("flagged", F.col("duplicates") > 0)
    )


def split_overlap(df: DataFrame, splits: Sequence[str] = SPLITS) -> DataFrame:
    """Distinct shared documents for each pair of splits, zero rows included."""
    pairs = list(combinations(splits, 2))
    counts = [
        F.count_if((F.col(a) > 0) & (F.col(b) > 0)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)
    ]
    rows = ", ".join(f"'{a}', '{b}', _{i}" for i, (a, b) in enumerate(pairs))
    return (
        _per_key(df, splits)
        .agg(*counts)
        .selectExpr(f"stack({len(pairs)}, {rows}) as (split_a, split_b, shared)")
        .withColumn("leaking", F.col("shared") > 0)
    )


def shared_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection of two document sets, as hex digests."""
    key = text.content_hex(F.col("document")).alias("h")
    return a.select(key).intersect(b.select(key))


def _per_key(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """One row per digest with its row count in each split."""
    return (
        df.select("split", text.content_key(F.col("document")).alias("_key"))
        .groupBy("_key")
        .agg(*[F.count_if(F.col("split") == s).alias(s) for s in splits])
    )
