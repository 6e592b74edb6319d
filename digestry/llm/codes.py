"""Vector codes: every part of a vector becomes the number of its nearest codebook entry.

A vector of whole numbers is cut into equal consecutive parts, each with a codebook of its own. Entries
start as the parts of the rows of least id; each round assigns every part to its nearest entry and
moves the entry to the floor of the mean of its parts. The nearest entry is found over a lexicographic
trie of the distinct parts that a task holds: a depth-first walk hands the distances to all entries,
added up over the components so far, from a prefix to everything that begins with it, and a leaf takes
the least one. Equal parts are one leaf with a weight.

Rows stay where they are: only sums by part and entry cross the network, and only codebooks, of a fixed
size, reach the driver.

Results for edge cases: vectors that are null or empty, hold a null or non-finite component, are of
another length than that of the row of least id, or cannot be cut into equal parts are dropped. Whole
components stop at 2^27 either way. Null ids come last; rows of one id go by their vectors. With fewer
rows than entries, codebooks have so many entries. Equal rows are coded each for itself. A sum of errors
beyond 64 bits is null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.llm.common import ready, save
from digestry.llm.vectors import SCALE, finite, matrix, whole, width_of_first

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A task puts so many rows together into one trie.
TRIE_ROWS = 1 << 16
#: A branch of so many leaves is walked level by level, all its nodes at once.
BRANCH = 2048


@dataclass
class Codebooks:
    """``entries`` by part, entry and position within the part."""

    entries: np.ndarray

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    @property
    def width(self) -> int:
        return self.parts * self.entries.shape[2]

    def digest(self) -> str:
        listed = ",".join(map(str, self.entries.ravel().tolist()))
        return hashlib.sha256(listed.encode()).hexdigest()


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, the place there of each row, and their counts."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.ones(len(parts), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    place = np.empty(len(parts), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, np.bincount(place, minlength=int(new.sum()))


def walk(leaves: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each leaf and its squared distance; ties go to the lower number.

    ``leaves`` are distinct and in lexicographic order, so that the node of a prefix is a range of them.
    """
    best = np.empty(len(leaves), dtype=np.int64)
    error = np.empty(len(leaves), dtype=np.int64)
    width = leaves.shape[1]
    nodes = [(0, 0, len(leaves), np.zeros(len(entries), dtype=np.int64))] if len(leaves) else []
    while nodes:
        depth, low, high, above = nodes.pop()
        if high - low <= BRANCH:
            sums = _branch(leaves[low:high], depth, above, entries)
            best[low:high] = sums.argmin(axis=1)
            error[low:high] = sums.min(axis=1)
        elif depth == width - 1:  # leaves are the children: any cut will do
            middle = (low + high) // 2
            nodes += [(depth, middle, high, above), (depth, low, middle, above)]
        else:
            value = leaves[low:high, depth]
            first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            last = np.append(first[1:], high - low)
            for start, end in zip(first[::-1].tolist(), last[::-1].tolist()):
                apart = value[start] - entries[:, depth]
                nodes.append((depth + 1, low + start, low + end, above + apart * apart))
    return best, error


def _branch(leaves: np.ndarray, depth: int, above: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The distances of each leaf to each entry; ``above`` has those of their common prefix."""
    new = np.zeros(len(leaves), dtype=bool)
    new[0] = True
    sums, node = above[None, :], np.zeros(len(leaves), dtype=np.int64)
    for at in range(depth, leaves.shape[1]):
        value = leaves[:, at]
        new[1:] |= value[1:] != value[:-1]
        first = np.flatnonzero(new)
        apart = value[first][:, None] - entries[None, :, at]
        sums = sums[node[first]] + apart * apart
        node = np.cumsum(new) - 1
    return sums


def _collected(
    batches: Iterator[pa.RecordBatch], width: int
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches put together until they have ``TRIE_ROWS`` rows, with their vectors."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= TRIE_ROWS:
            table = pa.Table.from_batches(held)
            yield table, matrix(table.column("v"), width)
            held = []
    if held:
        table = pa.Table.from_batches(held)
        yield table, matrix(table.column("v"), width)


def kept(
    df: DataFrame, key: str, vector: str, label: str, parts: int = PARTS, scale: int = SCALE
) -> DataFrame:
    """``id, label, v`` of the rows that take part, as a written table of whole numbers."""
    ready(df.sparkSession)
    good = df.where(finite(vector)).select(
        F.col(key).alias("id"), F.col(label).alias("label"), whole(vector, scale).alias("v")
    )
    rows = save(good.where((F.size("v") > 0) & (F.size("v") % parts == 0)), "whole")
    width = width_of_first(rows, F.col("id").asc_nulls_last(), F.col("v"))
    return rows.where(F.size("v") == width)


def first_entries(rows: DataFrame, parts: int, entries: int) -> Codebooks:
    """The parts of the rows of least id; at most ``entries`` rows come to the driver."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    width = len(first[0]["v"]) // parts if first else 1
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, parts, width)
    return Codebooks(start.transpose(1, 0, 2))


def improve(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry that parts are nearest to moves to the floor of their mean."""
    parts, count, size = books.entries.shape
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        sums = np.zeros((parts, count, size + 1), dtype=np.int64)
        for _, vectors in _collected(batches, held.width):
            for p in range(parts):
                leaves, _, weight = distinct_parts(vectors[:, p * size : (p + 1) * size])
                best, _ = walk(leaves, held.entries[p])
                np.add.at(sums[p, :, :size], best, leaves * weight[:, None])
                np.add.at(sums[p, :, size], best, weight)
        used = np.flatnonzero(np.broadcast_to(sums[:, :, size :] > 0, sums.shape))
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(sums.ravel()[used])], names=["cell", "total"]
        )

    cells = (
        rows.select("v").mapInArrow(run, "cell long, total long")
        .groupBy("cell").agg(F.sum("total").alias("total"))
        .toArrow()
    )  # at most parts x entries x (size + 1) rows
    total = np.zeros(parts * count * (size + 1), dtype=np.int64)
    total[cells.column("cell").to_numpy()] = cells.column("total").to_numpy()
    total = total.reshape(parts, count, size + 1)
    number = total[:, :, size:]
    moved = total[:, :, :size] // np.maximum(number, 1)  # floors, below zero too
    return Codebooks(np.where(number > 0, moved, books.entries))


def fit(
    rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks for the rows of ``kept``."""
    books = first_entries(rows, parts, entries)
    for _ in range(rounds if books.entries.size else 0):
        books = improve(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``id, label, codes, error``: one byte a part, and the squared distances added over the parts."""
    if books.entries.shape[1] > 256:
        raise ValueError("a code is one byte: at most 256 entries")
    shared = rows.sparkSession.sparkContext.broadcast(books)
    size = books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for table, vectors in _collected(batches, held.width):
            codes = np.empty((len(vectors), held.parts), dtype=np.uint8)
            error = np.zeros(len(vectors), dtype=np.int64)
            for p in range(held.parts):
                leaves, place, _ = distinct_parts(vectors[:, p * size : (p + 1) * size])
                best, apart = walk(leaves, held.entries[p])
                codes[:, p] = best[place]
                error += apart[place]
            packed = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(held.parts), len(codes), [None, pa.py_buffer(codes.tobytes())]
            ).cast(pa.binary())
            done = table.select(["id", "label"]).append_column("codes", packed)
            yield from done.append_column("error", pa.array(error)).to_batches()

    fields = [rows.schema["id"], rows.schema["label"]]
    coded = T.StructType(fields).add("codes", T.BinaryType()).add("error", T.LongType())
    return rows.mapInArrow(run, coded)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with the vector ``v`` that its codes stand for; columns only."""
    digits = F.hex("codes")
    entry = [
        F.conv(F.substring(digits, 2 * p + 1, 2), 16, 10).cast("int") for p in range(books.parts)
    ]
    tables = [
        F.array(*[F.array(*[F.lit(int(x)) for x in row]) for row in book]) for book in books.entries
    ]
    return coded.withColumn("v", F.concat(*[F.get(t, e) for t, e in zip(tables, entry)]))


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds ``label_error``: the errors of all rows of the same label, nulls being one label."""
    held = save(coded, "codes")
    total = save(
        held.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors"
    )
    # one row a label: sent to every task below the session's size limit, else shuffled and split
    named = total.withColumnRenamed("label", "of_label")
    return held.join(named, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
