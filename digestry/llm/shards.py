"""Shard numbers by jump consistent hashing, with column expressions only.

The published recurrence walks from bucket to bucket by a 64-bit linear congruential generator that
is seeded with the key. Products modulo 2^64 are taken in limbs of 24 bits, which never overflow.
One walk gives the shard for a count and for one shard more. Nothing is stored for the ring, and a
row moves only into the shard that is appended.

Results for edge cases: a null key counts as key 0, a null text as empty. Rows that agree in all
that is kept get neighbouring slots. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.llm.common import body, let, save

#: Multiplier of the generator. Fixed value of the published method.
MULTIPLIER = 2862933555777941757
LIMB = 24
MASK = (1 << LIMB) - 1
#: Slots are counted in so many buckets of each shard.
SLOT_BUCKETS = 1024


def _times(k2: Column, k1: Column, k0: Column) -> Column:
    """Limbs of ``key * MULTIPLIER + 1`` modulo 2^64."""
    a0, a1, a2 = MULTIPLIER & MASK, (MULTIPLIER >> LIMB) & MASK, MULTIPLIER >> (2 * LIMB)
    low = k0 * a0 + 1
    return let(
        lambda v: let(
            lambda u: F.struct(
                (u["t2"] + F.shiftright(u["t1"], LIMB)).bitwiseAND(0xFFFF).alias("k2"),
                u["t1"].bitwiseAND(MASK).alias("k1"),
                u["low"].bitwiseAND(MASK).alias("k0"),
            ),
            low=v["low"],
            t1=F.shiftright(v["low"], LIMB) + v["k0"] * a1 + v["k1"] * a0,
            t2=v["k0"] * a2 + v["k1"] * a1 + v["k2"] * a0,
        ),
        low=low, k0=k0, k1=k1, k2=k2,
    )


def jump(key: Column, shards: int) -> Column:
    """``struct(shard, grown)``: the bucket of an integer key among ``shards`` and one more."""
    start = F.struct(
        F.shiftrightunsigned(key, 2 * LIMB).alias("k2"),
        F.shiftrightunsigned(key, LIMB).bitwiseAND(MASK).alias("k1"),
        key.bitwiseAND(MASK).alias("k0"),
        F.lit(0).cast("long").alias("next"),
        F.lit(0).cast("long").alias("shard"),
        F.lit(0).cast("long").alias("grown"),
    )

    def step(held: Column, _: Column) -> Column:
        def moved(k: Column) -> Column:
            draw = F.shiftleft(k["k"]["k2"], 15) + F.shiftright(k["k"]["k1"], 9) + 1
            far = (held["next"] + 1) * (F.lit(float(1 << 31)) / draw)
            return F.struct(
                k["k"]["k2"].alias("k2"),
                k["k"]["k1"].alias("k1"),
                k["k"]["k0"].alias("k0"),
                F.floor(far).alias("next"),
                F.when(held["next"] < shards, held["next"])
                .otherwise(held["shard"])
                .alias("shard"),
                held["next"].alias("grown"),
            )

        walked = let(moved, k=_times(held["k2"], held["k1"], held["k0"]))
        return F.when(held["next"] <= shards, walked).otherwise(held)

    turns = F.array(*[F.lit(i) for i in range(shards + 1)])
    return F.aggregate(
        turns,
        start,
        step,
        lambda h: F.struct(
            h["shard"].cast("int").alias("shard"), h["grown"].cast("int").alias("grown")
        ),
    )


def stable_key(df: DataFrame, key: str) -> Column:
    """The key itself where it is an integer, else its 64-bit hash."""
    column = F.col(key)
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        column = F.when(column.isNotNull(), F.xxhash64(column))
    return F.coalesce(column.cast("long"), F.lit(0).cast("long"))


def assign(docs: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """``key, size, text_crc32, shard, grown_shard`` of every row; no shuffle."""
    raw = body(text).cast("binary")
    return docs.select(
        F.col(key),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        jump(stable_key(docs, key), shards).alias("at"),
    ).select(
        key,
        "size",
        "text_crc32",
        F.col("at.shard").alias("shard"),
        F.col("at.grown").alias("grown_shard"),
    )


def number(rows: DataFrame, shard: str, slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps.

    Equal rows are counted before any shuffle. The others are spread over hash buckets of the shard;
    a table of ``shards x SLOT_BUCKETS`` totals gives the first slot of each bucket.
    """
    columns = rows.columns
    counted = save(
        rows.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(SLOT_BUCKETS))),
        "slots",
    )
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        counted.groupBy(shard, "_bucket")
        .agg(F.sum("_n").alias("_total"))
        .select(
            shard, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_first")
        )
    )
    inside = (
        Window.partitionBy(shard, "_bucket")
        .orderBy(*columns)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = counted.withColumn(
        "_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ).join(F.broadcast(firsts), [shard, "_bucket"])  # at most shards x SLOT_BUCKETS rows
    start = F.col("_first") + F.col("_before")
    return placed.select(
        *columns, F.explode(F.sequence(start, start + F.col("_n") - 1)).alias(slot)
    )
