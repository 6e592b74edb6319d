"""Near duplicates by SimHash fingerprints, blocks by the pigeonhole, and Hamming distance.

Equal fingerprints collapse to one class before anything is joined. A class is posted once for each
choice of ``BLOCKS - bits`` of its ``BLOCKS`` blocks; two fingerprints within ``bits`` bits agree in
at least one choice. Rows of one posting are compared inside a sorted partition, and only a spanning
forest of the verified links leaves it, never the pairs. Postings with many classes are posted again
by the blocks of their free bits, which leaves so few free bits that a posting is bounded.

Results for edge cases: a null or empty text, or one of white space, has fingerprint zero and is
linked like any other. Rows with a null id take part and cannot name a component. Equal rows share
a component. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import body, fresh, ready, remembered, save
from digestry.llm.components import components

SEED = 42
WIDTH = 64
BLOCKS = 6
#: Postings with more classes than this are posted again by their free bits.
HOT_POSTING = 1024


def fingerprint(text: str, words: int) -> int:
    """Majority bits of the shingle hashes; ``words`` words make a shingle."""
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return 0
    if len(parts) > words:
        shingles = list(map(b" ".join, zip(*(parts[i:] for i in range(words)))))
    else:
        shingles = [b" ".join(parts)]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype=">u8")
    counts = np.zeros(WIDTH, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, fp``: the fingerprint as a signed 64-bit integer."""
    ready(docs.sparkSession)
    bare = docs.select(F.col(key).alias("key"), body(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("simhash")  # nothing, but the worker gives back what others remember
        for batch in batches:
            found = [fingerprint(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found, pa.int64())], names=["key", "fp"]
            )

    return bare.mapInArrow(run, f"key {bare.schema['key'].dataType.simpleString()}, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << WIDTH) if mask >= 1 << (WIDTH - 1) else mask


def cut_bits(bits: list[int], parts: int) -> list[list[int]]:
    """The bit places in ``parts`` runs of nearly equal length."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(edges, edges[1:])]


def choices(bits: list[int], blocks: int, distance: int) -> list[int]:
    """Masks of all choices of ``blocks - distance`` blocks of the given bit places."""
    cut = cut_bits(bits, blocks)
    return [
        sum(1 << b for block in chosen for b in block)
        for chosen in combinations(cut, blocks - distance)
    ]


def _post(fp: Column, masks: list[int]) -> Column:
    """One ``struct(choice, block)`` for each mask."""
    return F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("block")
                )
                for i, m in enumerate(masks)
            ]
        )
    )


def _repost(choice: Column, fp: Column, masks: list[int], distance: int) -> Column:
    """The postings of a hot posting's member by the bits that its choice leaves free."""
    value = F.array().cast("array<struct<choice:int,block:bigint>>")
    for i, mask in enumerate(masks):
        free = [b for b in range(WIDTH) if not mask >> b & 1]
        finer = [mask | m for m in choices(free, BLOCKS, distance)]
        posts = F.array(
            *[
                F.struct(
                    F.lit((i + 1) * 1000 + j).alias("choice"),
                    fp.bitwiseAND(F.lit(_signed(m))).alias("block"),
                )
                for j, m in enumerate(finer)
            ]
        )
        value = F.when(choice == i, posts).otherwise(value)
    return F.explode(value)


def _forest(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows, the least row that the links reach."""
    label = np.arange(n)
    while len(first):
        least = np.minimum(label[first], label[second])
        before = label.copy()
        np.minimum.at(label, first, least)
        np.minimum.at(label, second, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _links_inside(choice: np.ndarray, block: np.ndarray, fp: np.ndarray, distance: int):
    """A spanning forest of the verified links among rows of equal posting, rows being sorted."""
    n, starts = len(fp), np.arange(len(fp))
    firsts, seconds = [], []
    lag = 1
    while len(starts):
        starts = starts[starts < n - lag]
        same = (choice[starts] == choice[starts + lag]) & (block[starts] == block[starts + lag])
        starts = starts[same]
        apart = np.bitwise_count((fp[starts] ^ fp[starts + lag]).view(np.uint64))
        near = starts[(apart <= distance) & (apart > 0)]
        firsts.append(near)
        seconds.append(near + lag)
        lag += 1
        if sum(map(len, firsts)) > 1 << 22 or not len(starts):
            root = _forest(np.concatenate(firsts), np.concatenate(seconds), n)
            firsts, seconds = [root], [np.arange(n)]
    if not firsts:
        return fp[:0], fp[:0]
    root = _forest(np.concatenate(firsts), np.concatenate(seconds), n)
    linked = np.flatnonzero(root != np.arange(n))
    return fp[root[linked]], fp[linked]


def links(classes: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links of distinct fingerprints that connect all within ``distance`` bits."""
    masks = choices(list(range(WIDTH)), BLOCKS, distance)
    posted = classes.select("fp", _post(F.col("fp"), masks).alias("p")).select("p.*", "fp")
    sizes = posted.groupBy("choice", "block").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") > HOT_POSTING).drop("n")
    on = ["choice", "block"]
    cold = posted.join(hot, on, "left_anti")
    finer = (
        posted.join(hot, on, "left_semi")
        .select("fp", _repost(F.col("choice"), F.col("fp"), masks, distance).alias("p"))
        .select("p.*", "fp")
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links_inside(*columns, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            got = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            held = [np.concatenate(pair) for pair in zip(held, got)]
            if not len(held[0]):
                continue
            last = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            stop = len(last) - int(last.sum())  # the last posting may go on in the next batch
            yield linked([c[:stop] for c in held])
            held = [c[stop:] for c in held]
        if len(held[0]):
            yield linked(held)

    # rows of one posting meet in one task: at most HOT_POSTING, or all values of the free bits
    together = cold.unionByName(finer).repartition("choice", "block")
    ordered = together.sortWithinPartitions("choice", "block", "fp")
    return ordered.mapInArrow(scan, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, key: str, text: str, words: int = 3, distance: int = 3
) -> DataFrame:
    """``doc_id, fingerprint, component_id``: for every row the 16 hex digits of its fingerprint
    and the least id among all rows that links of at most ``distance`` bits connect it to."""
    marked = save(fingerprints(docs, key, text, words), "fingerprints")
    classes = save(marked.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    roots = components(links(classes, distance), "a", "b")
    joined = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = joined.join(named, "root").select("fp", "component_id")
    # a fingerprint that many rows share makes this join uneven; AQE splits it
    return marked.join(of_class, "fp").select(
        F.col("key").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, key: str, text: str, words: int = 3, distance: int = 3) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, with all its columns: that of the least key,
    null keys last, and of equal keys the one that comes first in the written table.

    Rows are grouped by a number of their own, so keys may be null or repeat. Every text is written once
    more and moves once, to the number that stays; decisions are made on numbers and fingerprints.
    """
    name = fresh(docs, "_number")
    numbered = save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(numbered, name, text, words, distance)
    keys = numbered.select(F.col(name).alias("doc_id"), F.col(key).alias("key"))
    first = (
        groups.join(keys, "doc_id")
        .groupBy("component_id")
        .agg(F.min(F.struct(F.col("key").isNull(), "key", "doc_id")).alias("first"))
    )
    stays = save(first.select(F.col("first.doc_id").alias(name)), "stays")
    # the numbers that stay are hashed, so that no wide row is sorted
    return numbered.join(stays.hint("shuffle_hash"), name, "left_semi").drop(name)
