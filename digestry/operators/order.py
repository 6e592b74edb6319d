"""Positions, row windows and group heads over an explicit unique order key.

Nothing here sorts a whole table, or a whole group, in one task. Keys alone are range-partitioned
and sorted; partition totals turn local ranks into positions.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.session import stored

_LOCAL_BITS = 33


def positions(
    df: DataFrame, order_by: Sequence[str], by: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """``by + order_by + out``: the dense 0-based position of each key, within each ``by`` group.

    The sorted keys are written before their partition numbers are used: range boundaries
    come from sampling, and a recomputed partition must not land on other boundaries.
    """
    keys = [*by, *order_by]
    ranged = df.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    slotted = stored(ranged.withColumn("_slot", F.monotonically_increasing_id()), "slots")
    placed = slotted.select(
        *keys,
        F.shiftright("_slot", _LOCAL_BITS).alias("_part"),
        F.col("_slot").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"),
    )
    # One row per (partition, group): at most partitions + groups, since groups are contiguous.
    totals = placed.groupBy(*by, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first")
    )
    before = F.sum("_n").over(
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = totals.select(
        *by, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")
    )
    return placed.join(stored(starts, "starts"), [*by, "_part"]).select(
        *keys, (F.col("_local") + F.col("_shift")).alias(out)
    )


def _key(order_by: Sequence[str]) -> Column:
    return F.col(order_by[0]) if len(order_by) == 1 else F.struct(*order_by)


def _literal(row, order_by: Sequence[str], df: DataFrame) -> Column:
    parts = [F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order_by]
    return parts[0] if len(parts) == 1 else F.struct(*parts)


def row_window(
    df: DataFrame, order_by: Sequence[str], offset: int = 0, limit: int | None = None
) -> DataFrame:
    """Skip ``offset`` rows, then take ``limit``, in key order.

    The two edge keys are looked up first; the wide rows are then cut by a key-range filter that
    reaches the scan, so no wide row is shuffled or sorted.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("offset and limit must not be negative")
    if limit == 0:
        return df.limit(0)
    if offset == 0 and limit is None:
        return df
    ranked = positions(df, order_by)
    wanted = [offset] if limit is None else [offset, offset + limit - 1]
    edges = {r["pos"]: r for r in ranked.where(F.col("pos").isin(wanted)).collect()}
    if offset not in edges:
        return df.limit(0)
    lead, lead_type = order_by[0], df.schema[order_by[0]].dataType
    out = df
    if offset:
        first = edges[offset]
        # The bound on the leading column alone can prune partitions and row groups.
        out = out.where(F.col(lead) >= F.lit(first[lead]).cast(lead_type))
        out = out.where(_key(order_by) >= _literal(first, order_by, df))
    if limit is not None and wanted[-1] in edges:
        last = edges[wanted[-1]]
        out = out.where(F.col(lead) <= F.lit(last[lead]).cast(lead_type))
        out = out.where(_key(order_by) <= _literal(last, order_by, df))
    return out


def group_head(df: DataFrame, by: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in key order; a hot group is spread over many tasks."""
    if n < 1:
        return df.limit(0)
    cutoff = (
        positions(df, order_by, by)
        .where(F.col("pos") == n - 1)
        .select(*by, _key(order_by).alias("_cutoff"))
    )
    kept = df.join(stored(cutoff, "cutoffs"), list(by), "left").where(
        F.col("_cutoff").isNull() | (_key(order_by) <= F.col("_cutoff"))
    )
    return kept.drop("_cutoff")


def shuffle_key(seed: int, epoch: Column, row_id: Column) -> Column:
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), row_id.cast("string"))
    )


def seeded_shuffle(
    df: DataFrame, row_id: str, seed: int = 42, epoch: str | None = None
) -> DataFrame:
    """Reproducible full shuffle: a range sort on a keyed digest of the row id."""
    keyed = df.withColumn(
        "shuffle_key", shuffle_key(seed, F.col(epoch) if epoch else F.lit(0), F.col(row_id))
    )
    return keyed.orderBy(*([epoch] if epoch else []), "shuffle_key", row_id)


def repeat_epochs(df: DataFrame, epochs: int, out: str = "epoch") -> DataFrame:
    """Every row once per epoch, without a join."""
    if epochs < 1:
        return df.withColumn(out, F.lit(0)).limit(0)
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias(out))


def buffer_shuffle(
    df: DataFrame,
    shard: str,
    row_id: str,
    buffer: int = 10_000,
    seed: int = 42,
    epoch: int = 0,
    out: str = "pos",
) -> DataFrame:
    """Rows in the order in which a bounded buffer gives them out, with their place there.

    Rows of a shard come in stored order. A full buffer gives out a random one of its rows for every new
    one; what is left at the end of the shard follows in random order. Nothing is exchanged, and a task
    holds ``buffer`` rows at most. The order depends on seed, epoch, shard and rows alone, so a task that
    is run again gives the same; a shard that several tasks read has a buffer, and places, in each.
    A row is never given out more than ``buffer`` places before its own.
    """
    if buffer < 1:
        raise ValueError("the buffer must hold a row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current, draw, place = None, random.Random(), 0
        for batch in batches:
            key, name = (batch.schema.get_field_index(c) for c in (shard, row_id))
            given: list[tuple] = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if not place or row[key] != current:
                    draw.shuffle(held)
                    given += [(*r, n) for n, r in enumerate(held, place - len(held))]
                    held, place, current = [], 0, row[key]
                    draw = random.Random(f"{seed}:{epoch}:{current}:{row[name]}")
                place += 1
                if len(held) < buffer:
                    held.append(row)
                else:
                    at = draw.randrange(buffer)
                    given.append((*held[at], place - 1 - buffer))
                    held[at] = row
            schema = batch.schema.append(pa.field(out, pa.int64()))
            if given:
                yield _batch(given, schema)
        draw.shuffle(held)
        for first in range(0, len(held), GIVEN_ROWS):
            part = held[first : first + GIVEN_ROWS]
            yield _batch([(*r, n) for n, r in enumerate(part, place - len(held) + first)], schema)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


#: Rows that are given out together when a buffer is emptied.
GIVEN_ROWS = 1000


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), schema.types)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
