"""Numbered shards: contiguous row ranges of near-equal size, one file per shard."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from digestry.operators.order import positions
from digestry.session import stored
from digestry.sources import read_tree


def shard_label(shard: Column, shards: Column) -> Column:
    return F.format_string("data-%05d-of-%05d", shard, shards)


def _sized(totals: DataFrame, rows_per_shard: int, min_shards: int) -> DataFrame:
    if rows_per_shard < 1 or min_shards < 0:
        raise ValueError("rows_per_shard must be positive and min_shards not negative")
    shards = F.greatest(F.ceil(F.col("total") / F.lit(rows_per_shard)), F.lit(min_shards))
    size = F.ceil(F.col("total") / F.nullif(shards, F.lit(0)))
    return totals.withColumns(
        {"shards": shards.cast("int"), "shard_size": F.coalesce(size, F.lit(0))}
    )


def shard_plan(
    totals: DataFrame, rows_per_shard: int = 100_000, min_shards: int = 1
) -> DataFrame:
    """From ``... , total``: one row per shard, trailing empty ones included, with its range."""
    sized = _sized(totals, rows_per_shard, min_shards).where(F.col("shards") > 0)
    each = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    start = F.least(F.col("shard") * F.col("shard_size"), F.col("total"))
    end = F.least((F.col("shard") + 1) * F.col("shard_size"), F.col("total"))
    return each.select(
        *[c for c in totals.columns],
        "shard",
        shard_label(F.col("shard"), F.col("shards")).alias("label"),
        start.alias("first_row"),
        (end - start).alias("n_rows"),
    )


def assign_shards(
    df: DataFrame,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    rows_per_shard: int = 100_000,
    min_shards: int = 1,
) -> DataFrame:
    """``by + order_by + pos, shard``, on keys only."""
    ranked = positions(df, order_by, by)
    totals = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    sized = _sized(totals, rows_per_shard, min_shards).select(*by, "shard_size", "shards")
    if by:
        placed = ranked.join(stored(sized, "sizes"), list(by))
    else:
        row = sized.first()
        placed = ranked.withColumns(
            {"shard_size": F.lit(row["shard_size"]), "shards": F.lit(row["shards"])}
        )
    shard = F.floor(F.col("pos") / F.greatest(F.col("shard_size"), F.lit(1)))
    return placed.withColumn("shard", shard.cast("int")).drop("shard_size", "shards")


def write_sharded(
    df: DataFrame,
    path: str,
    order_by: Sequence[str],
    by: Sequence[str] = (),
    rows_per_shard: int = 100_000,
    min_shards: int = 1,
    assigned: DataFrame | None = None,
    derived: Mapping[str, Column] | None = None,
) -> None:
    """Write ``path/[by=.../]shard=N``; rows inside a shard keep the order.

    ``assigned`` may hold precomputed ``assign_shards`` keys; rows without one are left out.
    ``derived`` columns are made from the others after the last exchange.
    """
    keys = [*by, *order_by]
    if assigned is None:
        assigned = assign_shards(df, order_by, by, rows_per_shard, min_shards)
    assigned = stored(assigned.drop("pos"), "assigned")
    # One task per (group, shard), numbered densely, so that no two shards share a task by chance.
    before = Window.orderBy(*by or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(
        assigned.groupBy(*by)
        .agg((F.max("shard") + 1).alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))),
        "bases",
    )
    total = bases.agg(F.sum("_n")).first()[0] or 0
    if total == 0:
        empty = df.limit(0).withColumns(derived or {}).withColumn("shard", F.lit(0))
        empty.write.mode("overwrite").parquet(path)
        return
    placed = assigned.join(bases, list(by)) if by else assigned.withColumn("_base", F.lit(0))
    (
        df.join(placed, keys)
        .repartitionById(total, (F.col("_base") + F.col("shard")).cast("int"))
        .sortWithinPartitions(*by, "shard", *order_by)
        .drop("_base", "_n")
        .withColumns(derived or {})
        .write.mode("overwrite")
        .partitionBy(*by, "shard")
        .parquet(path)
    )


def scan_shards(
    spark: SparkSession,
    path: str,
    shards: Sequence[int] | None = None,
    shard_offset: int = 0,
) -> DataFrame:
    """Rows of the chosen shards with ``shard_rank``; order by ``(shard_rank, row key)``.

    An explicit list wins over the offset, keeps its order, and ignores absent shards. A shard that
    is listed twice is read twice, under either rank.
    """
    table = read_tree(spark, path, {"shard"})
    if shards is not None:
        if any(i < 0 for i in shards):
            raise ValueError("shard indices must not be negative")
        if not shards:
            return table.limit(0).withColumn("shard_rank", F.lit(0))
        listed = F.array(*[F.lit(i) for i in shards])
        places = F.filter(
            F.transform(listed, lambda x, i: F.when(x == F.col("shard"), i)),
            lambda i: i.isNotNull(),
        )
        chosen = table.where(F.col("shard").isin(list(dict.fromkeys(shards))))
        return chosen.withColumn("shard_rank", F.explode(places))
    if shard_offset < 0:
        raise ValueError("shard_offset must not be negative")
    chosen = table.where(F.col("shard") >= shard_offset)
    return chosen.withColumn("shard_rank", F.col("shard") - F.lit(shard_offset))
