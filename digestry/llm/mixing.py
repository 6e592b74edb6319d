"""Mixing sources to target weights, block by block.

The texts of a source are one stream of words, in the order of a hash of their rows, and the stream is
cut into blocks of a fixed length. A source's target is its share by weight of the words to be taken,
at most ``most`` times its size; its quota is that target in blocks. Output shards have a fixed number of
slots. For each shard the numbers of slots by source are drawn from the multinomial law of what is left
of the quotas, and slots of a source that is used up are drawn again; the quotas of a stretch of shards
are set beforehand, so all stretches are drawn at the same time and together they use up every quota
exactly. The slots of a source count through a pseudorandom permutation of its blocks, another one for
each pass, so no block comes a second time before all have come once. Slots and blocks are joined by
source and block number.

Everything that is drawn depends on ``seed``, the numbers of sources, stretches and shards and on the
rows themselves, never on partitions, so reruns and recomputed tasks agree.

Results for edge cases: a null or empty text has no words and is never taken; its row is returned with
``taken`` 0. A null source is a source, the last one. Rows that agree in id, source and text are
consecutive in the stream, and each has its own part of what is taken; rows with a null id are rows like
all others. A source of few words has one short block. An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestry.llm.common import SPACE, body, ready, save, words
from digestry.operators.order import positions

WEIGHTS = (3.0, 1.0, 2.0)
#: Words taken as a share of all words, and at most so often the words of a source.
SHARE, MOST = 1.5, 2
BLOCK = 64
#: Slots of an output shard, and shards whose quotas are set together.
SLOTS, STRETCH = 4096, 32
#: Shards of one stretch are numbered in so many bits.
SHARD_BITS = 20
#: Copies of a row that are listed at once.
COPIES = 4096
SEED = 42
KEYS = ("source", "doc_id", "size", "digest")


@dataclass
class Mix:
    """``targets``: source, number, source_size, target, blocks, quota. ``rows``: ``KEYS``, number,
    copies, and where the first of these copies starts in the stream of its source. ``slots``: shard,
    slot, number, block; ``block`` is the length of a block."""

    targets: DataFrame
    rows: DataFrame
    slots: DataFrame
    block: int

    def plan(self) -> DataFrame:
        """``shard, slot, at, number, row, start, length``: which words stand where in the output;
        ``row`` is the row's place in the stream of its source."""
        return self.slots.join(cut(self.rows, self.block), ["number", "block"]).select(
            "shard", "slot", "at", "number", "row", "start", "length"
        )

    def taken(self) -> DataFrame:
        """``doc_id, source, size, source_size, target, taken`` of every row."""
        number = self.plan().groupBy("number", "row").agg(F.sum("length").alias("taken"))
        each = each_copy(self.rows)
        fields = ("number", "doc_id", "source", "size")
        counted = each.where(F.col("size") > 0).join(number, ["number", "row"], "left")
        empty = each.where(F.col("size") == 0).select(*fields, F.lit(0).cast("long").alias("taken"))
        # one row a source: sent to every task below the session's size limit, else shuffled and split
        goals = self.targets.select("number", "source_size", "target")
        return (
            counted.select(*fields, F.coalesce("taken", F.lit(0)).alias("taken"))
            .unionByName(empty).join(goals, "number").drop("number")
        )

    def sequences(self, docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
        """``shard, slot, words``: the words of every slot, from the rows that the mix was made of."""
        texts = described(docs, key, text, source, keep_text=True).where(F.col("size") > 0)
        texts = texts.groupBy(*KEYS).agg(F.any_value("text").alias("text"))
        places = self.rows.select(*[F.col(c).alias(f"of_{c}") for c in KEYS], "number", "copies", "first")
        same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in KEYS]
        parts = cut(texts.join(places, same).withColumn("words", words(F.col("text"))), self.block, "words")
        return (
            self.slots.join(parts, ["number", "block"])
            .groupBy("shard", "slot")
            .agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("parts"))
            .select("shard", "slot", F.flatten(F.col("parts.words")).alias("words"))
        )


def described(docs: DataFrame, key: str, text: str, source: str, keep_text: bool = False) -> DataFrame:
    """``KEYS`` of every row: all that decides where it stands."""
    whole = body(text)
    return docs.select(
        F.col(source).alias("source"),
        F.col(key).alias("doc_id"),
        F.regexp_count(whole, F.lit(f"[^{SPACE[1:-1]}]+")).cast("long").alias("size"),
        F.xxhash64(whole).alias("digest"),
        *([whole.alias("text")] if keep_text else []),
    )


def streams(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``KEYS, copies, first``: each different row with its place in the stream of its source.

    The rows of a source are dealt to buckets by a hash; totals of the buckets give the first place of
    each, so neither a source nor a bucket is sorted whole by more than its own number of rows.
    """
    counted = save(
        described(docs, key, text, source).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("copies")),
        "described",
    )
    buckets = max(1, int(counted.count() ** 0.5))
    dealt = counted.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "size", "digest"), F.lit(buckets))
    )
    length = F.col("size") * F.col("copies")
    cells = dealt.groupBy("source", "bucket").agg(F.sum(length).alias("total"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = save(
        cells.select(
            F.col("source").alias("of_source"), F.col("bucket").alias("of_bucket"),
            F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"),
        ),
        "cells",
    )
    inside = (
        Window.partitionBy("source", "bucket")
        .orderBy("doc_id", "size", "digest")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = dealt.withColumn("inside", F.coalesce(F.sum(length).over(inside), F.lit(0)))
    same = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("bucket") == F.col("of_bucket"))
    return placed.join(cells, same).select(
        *KEYS, "copies", (F.col("before") + F.col("inside")).alias("first")
    )


def targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """``source, number, source_size, target`` from ``source, source_size``, as a written table.

    Sources are numbered by code point, null last, and have the weights in turn. A target is weight
    times a level, or ``most`` times the size where that is less; each round raises the level to what the
    capped sources leave to the others, until none is above. Only three sums a round reach the driver.
    """
    by_point = sizes.withColumn("none", F.col("source").isNull())
    placed = positions(by_point, ["none", "source", "source_size"], out="number")
    turn = F.pmod("number", F.lit(len(weights))).cast("int")
    weighed = save(
        placed.select(
            "source", "number", "source_size",
            F.get(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
            (F.col("source_size") * float(most)).alias("cap"),
        ),
        "sources",
    )
    total = share * (weighed.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("cap") if capped >= 0 else F.lit(False)
        state = weighed.agg(
            F.count_if(above).alias("n"),
            F.sum(F.when(above, F.col("cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        if state["n"] == capped or not state["weight"]:
            break
        capped, level = state["n"], (total - state["full"]) / state["weight"]
    target = F.least(F.col("weight") * level, F.col("cap"))
    return weighed.select("source", "number", "source_size", target.alias("target"))


def with_quotas(goals: DataFrame, block: int) -> DataFrame:
    """Adds ``blocks`` of each source and ``quota``: how many blocks the mix takes of it."""
    blocks = F.ceil(F.col("source_size") / block)
    quota = F.round(F.try_divide(F.col("target"), F.col("source_size")) * blocks)
    return goals.withColumn("blocks", blocks.cast("long")).withColumn(
        "quota", F.coalesce(quota, F.lit(0)).cast("long")
    )


def each_copy(rows: DataFrame) -> DataFrame:
    """Every copy of every row, with its place ``row`` in the stream; a few copies at a time."""
    some = F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))
    few = F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1)
    return (
        rows.select("*", F.explode(some).alias("from"))
        .select("*", F.explode(few).alias("copy"))
        .withColumn("row", F.col("first") + F.col("copy") * F.col("size"))
        .drop("from", "copy")
    )


def cut(rows: DataFrame, block: int, *lists: str) -> DataFrame:
    """``number, block, row, start, length, at``: the pieces of every row in the blocks of its source's
    stream; ``lists`` have one entry a word and are cut along."""
    whole = each_copy(rows.where(F.col("size") > 0))
    blocks = F.sequence(F.expr(f"row div {block}"), F.expr(f"(row + size - 1) div {block}"))
    pieces = whole.select("number", "size", "row", *lists, F.explode(blocks).alias("block"))
    start = F.greatest(F.col("block") * block, F.col("row")) - F.col("row")
    end = F.least((F.col("block") + 1) * block, F.col("row") + F.col("size")) - F.col("row")
    placed = pieces.select("*", start.alias("start"), (end - start).alias("length"))
    return placed.select(
        "number", "block", "row", "start", "length",
        (F.col("row") + F.col("start") - F.col("block") * block).alias("at"),
        *[
            F.slice(name, (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias(name)
            for name in lists
        ],
    )


# ---- drawing -------------------------------------------------------------------------------------


def permuted(at: np.ndarray, size: int, seed: tuple[int, ...]) -> np.ndarray:
    """The places of ``at`` in a pseudorandom permutation of ``range(size)``.

    A Feistel network of four rounds permutes the next power of four; what falls beyond ``size`` goes
    through it again until it falls inside.
    """
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.SeedSequence(seed).generate_state(4, np.uint64)
    value = at.astype(np.uint64)
    out = np.ones(len(value), dtype=bool)
    while out.any():
        left, right = value[out] >> np.uint64(half), value[out] & mask
        for key in keys:
            mixed = (right ^ key) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        value[out] = (left << np.uint64(half)) | right
        out = value >= size
    return value.astype(np.int64)


def draw_shard(left: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """How many of a shard's slots each source gets: multinomial by what is left of the quotas; slots
    of sources that are used up are drawn again."""
    if slots >= left.sum():
        return left.copy()
    counts = np.zeros_like(left)
    while (need := slots - int(counts.sum())) > 0:
        rest = left - counts
        drawn = rng.multinomial(need, rest / rest.sum())
        counts += np.minimum(drawn, rest)
    return counts


def stretches(goals: DataFrame, count: int) -> DataFrame:
    """``stretch, number, blocks, turn, share``: the part of every quota that each stretch has, from
    which draw of the source on; only parts that are not empty.

    A quota is dealt evenly, shifted by a hash of the source's number, so that sources of fewer draws
    than there are stretches do not all fall into the same ones. All in whole numbers.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.least(F.col("quota"), F.lit(count)) - 1)
    dealt = (
        goals.where(F.col("quota") > 0)
        .withColumn("shift", F.pmod(F.xxhash64("number"), F.lit(count).cast("long")))
        .select("*", F.explode(parts).alias("i"))
    )
    # the stretch of a source's i-th draw, where it has fewer draws than there are stretches
    single = F.expr(f"((i + 1) * {count}L - shift + quota - 1) div quota - 1")
    turn = F.expr(f"(quota * stretch + shift) div {count}L")
    following = F.expr(f"(quota * (stretch + 1) + shift) div {count}L")
    return dealt.withColumn(
        "stretch", F.when(F.col("quota") < count, single).otherwise(F.col("i"))
    ).select("stretch", "number", "blocks", turn.alias("turn"), (following - turn).alias("share"))


def slots(goals: DataFrame, per_shard: int, per_stretch: int, seed: int) -> DataFrame:
    """``shard, slot, number, block`` of the whole output; a stretch is one group of bounded size."""
    total = goals.agg(F.sum("quota").alias("n")).first()["n"] or 0
    count = max(1, -(-total // (per_shard * per_stretch)))

    def run(parts: pa.Table) -> pa.Table:
        order = np.argsort(parts.column("number").to_numpy())
        stretch, number, blocks, turn, left = (
            parts.column(c).to_numpy()[order].astype(np.int64)
            for c in ("stretch", "number", "blocks", "turn", "share")
        )
        rng = np.random.default_rng([seed, int(stretch[0])])
        shard = int(stretch[0]) << SHARD_BITS
        out: tuple[list, list, list, list] = ([], [], [], [])
        while left.any():
            counts = draw_shard(left, per_shard, rng)
            used = np.flatnonzero(counts)
            for s in used:
                turns = turn[s] + np.arange(counts[s])
                found, passes = np.empty_like(turns), turns // blocks[s]
                for one in np.unique(passes):
                    inside = passes == one
                    name = (seed, int(number[s]), int(one))
                    found[inside] = permuted(turns[inside] % blocks[s], int(blocks[s]), name)
                out[3].append(found)
            slots = int(counts.sum())
            out[0].append(np.full(slots, shard))
            out[1].append(rng.permutation(slots))
            out[2].append(np.repeat(number[used], counts[used]))
            turn, left, shard = turn + counts, left - counts, shard + 1
        names = ["shard", "slot", "number", "block"]
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=names)

    # stated in number, so that few small rows, each of which becomes many, are not put into one task
    tasks = min(count, 4 * goals.sparkSession.sparkContext.defaultParallelism)
    dealt = stretches(goals, count).repartition(max(tasks, 1), "stretch")
    return dealt.groupBy("stretch").applyInArrow(
        run, "shard long, slot long, number long, block long"
    )


def mix(
    docs: DataFrame,
    key: str,
    text: str,
    source: str,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    per_shard: int = SLOTS,
    per_stretch: int = STRETCH,
    block: int = BLOCK,
    seed: int = SEED,
) -> Mix:
    """Plan a mix of the words of ``docs``: see ``Mix`` for what comes out."""
    ready(docs.sparkSession)
    placed = save(streams(docs, key, text, source), "streams")
    sizes = placed.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size")
    )
    goals = save(with_quotas(targets(sizes, weights, share, most), block), "targets")
    named = goals.select(F.col("source").alias("of_source"), "number")
    rows = placed.join(named, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    drawn = save(slots(goals, per_shard, per_stretch, seed), "slots")
    return Mix(goals, rows, drawn, block)
