"""Hard negatives: rows of another label that score nearly as well as an anchor's positives.

A threshold join over an inverted index, in blocks of rows. For a threshold, the index of a block leaves
out the last dimensions of a row where the lengths of the rest of row and anchor (suffix norms) cannot
reach the threshold together. An anchor adds up its partial scores over the postings, a few dimensions
at a time, and gives up rows whose partial score and remaining norms stay below the threshold. What is
left is scored in full. Thresholds start high and fall until every window of the block is full, or down
to the window's lower end. Scores are inner products of whole numbers, so they are exact.

Blocks of anchors meet blocks of rows, both of bounded size; every row is searched. As a search of one
row in a hundred against all rows, the work grows with anchors x rows.

Results for edge cases: rows with a null id, null label or null vector, with a null or non-finite
component, or with a vector of another length than that of the row of least id take no part. Whole
components stop at 2^27 either way. Rows that repeat id, label and vector count once; rows with the
anchor's id are its own. Where one id is an anchor with several vectors, each is an anchor for itself.
Ties go to the smaller id. A positive of negative score has no negatives. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.llm.common import ready, save
from digestry.llm.vectors import SCALE, finite, matrix, whole, width_of_first

POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least and at most so many hundredths of the positive's.
LOWEST, HIGHEST = 80, 100
ROW_BLOCK, ANCHOR_BLOCK = 16384, 4096
#: So many dimensions are added before rows are given up again.
STEP = 8
#: The first thresholds for positives, as shares of the greatest possible score; then none.
SHARES = (0.5, 0.35, 0.25, 0.125)
#: The first thresholds for negatives, as places between a window's lower end and its top; then 0.
DEPTHS = (0.5,)
NONE = -(1 << 62)


def usable(df: DataFrame, key: str, label: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``id, label, v`` of the rows that take part, each once, as a written table."""
    good = df.where(
        F.col(key).isNotNull() & F.col(label).isNotNull() & finite(vector)
    ).select(
        F.col(key).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        whole(vector, scale).alias("v"),
    )
    rows = save(good.distinct(), "whole")
    width = width_of_first(rows, F.col("id"), F.col("label"), F.col("v"))
    return rows.where((F.size("v") == width) & (F.size("v") > 0))


def suffix_norms(vectors: np.ndarray) -> np.ndarray:
    """The length of what is left of each row from every ``STEP``-th dimension on, rounded up."""
    squares = vectors.astype(np.float64) ** 2
    ends = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    norms = np.sqrt(ends[:, ::STEP]) * (1 + 1e-9)
    return np.concatenate([norms, np.zeros((len(vectors), 1))], axis=1)


class Index:
    """Postings of one block of rows for anchors with a threshold each.

    Rows stand by how many dimensions of theirs are indexed, most first, so the posting of a dimension is
    a run from the first row on.
    """

    def __init__(self, vectors: np.ndarray, norms: np.ndarray, reach: np.ndarray):
        """``reach``: the greatest share of its threshold that an anchor's rest has per unit of length,
        from every ``STEP``-th dimension on."""
        open_ = norms[:, :-1] * reach[None, :-1] >= 1
        cut = np.where(open_.any(axis=1), open_.shape[1] - open_[:, ::-1].argmax(axis=1), 0)
        self.order = np.argsort(-cut, kind="stable")
        cut = cut[self.order]
        self.vectors, self.norms = vectors[self.order], norms[self.order]
        self.lengths = [int((cut > step).sum()) for step in range(open_.shape[1])]
        # what an unindexed rest can still add is bounded from the row's own cut on
        self.cut = cut

    def at_least(self, anchor: np.ndarray, anchor_norms: np.ndarray, threshold: int):
        """The rows that score ``threshold`` or more, and their scores."""
        alive = np.arange(self.lengths[0] if self.lengths else 0)
        partial = np.zeros(len(alive), dtype=np.int64)
        for step, length in enumerate(self.lengths):
            posted = int(np.searchsorted(alive, length))
            if not posted:
                break
            rows, at = alive[:posted], slice(step * STEP, (step + 1) * STEP)
            partial[:posted] += self.vectors[rows, at] @ anchor[at]
            bound = partial[:posted] + self.norms[rows, step + 1] * anchor_norms[step + 1]
            bound += 1 + 1e-9 * np.abs(bound)
            good = np.append(bound >= threshold, np.ones(len(alive) - posted, bool))
            alive, partial = alive[good], partial[good]
        score = self.vectors[alive] @ anchor
        found = score >= threshold
        return self.order[alive[found]], score[found]


@dataclass
class Block:
    """Rows of one block, all dimensions of most weight first."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    dimensions: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, width: int, anchors: np.ndarray) -> Block:
        vectors = matrix(table.column("v"), width)
        weight = (vectors.astype(np.float64) ** 2).sum(axis=0) * (
            anchors.astype(np.float64) ** 2
        ).sum(axis=0)
        dimensions = np.argsort(-weight, kind="stable")
        vectors = np.ascontiguousarray(vectors[:, dimensions])
        return cls(
            table.column("id").to_numpy(),
            table.column("label").to_numpy(),
            vectors,
            suffix_norms(vectors),
            dimensions,
        )

    def index(self, anchor_norms: np.ndarray, thresholds: np.ndarray) -> Index:
        if (thresholds <= 0).any():  # anything can reach it
            reach = np.full(self.norms.shape[1], np.inf)
            return Index(self.vectors, np.maximum(self.norms, 1e-300), reach)
        reach = (anchor_norms / thresholds[:, None]).max(axis=0) * (1 + 1e-9)
        return Index(self.vectors, self.norms, reach)

    def search(
        self,
        anchors: np.ndarray,
        levels: Callable[[int], list[int]],
        use: Callable[[int, np.ndarray, np.ndarray, bool], bool],
    ) -> None:
        """Lower the thresholds until each anchor is done.

        ``levels(a)`` are an anchor's thresholds, falling; ``use(a, rows, scores, last)`` takes all rows at
        the threshold or above, best first, and tells whether that is enough.
        """
        anchors = np.ascontiguousarray(anchors[:, self.dimensions])
        norms = suffix_norms(anchors)
        falling = [levels(a) for a in range(len(anchors))]
        open_ = [a for a in range(len(anchors)) if falling[a]]
        turn = 0
        while open_:
            thresholds = np.array([float(falling[a][turn]) for a in open_])
            index = self.index(norms[open_], thresholds)
            still = []
            for a in open_:
                rows, score = index.at_least(anchors[a], norms[a], falling[a][turn])
                best = np.lexsort((self.ids[rows], -score))
                last = turn + 1 == len(falling[a])
                if not use(a, rows[best], score[best], last) and not last:
                    still.append(a)
            open_, turn = still, turn + 1


def _table(columns: list[list[np.ndarray]], names: list[str]) -> pa.Table:
    flat = [np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64) for c in columns]
    return pa.table([pa.array(c) for c in flat], names=names)


POSITIVE = ["anchor", "label", "positive_id", "positive_score"]


def positives_of_block(anchors: pa.Table, rows: pa.Table, width: int, most: int) -> pa.Table:
    """The best rows of one block with each anchor's label."""
    asked = matrix(anchors.column("v"), width)
    own, label = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    number = anchors.column("anchor").to_numpy()
    block = Block.of(rows, width, asked)
    top = block.norms[:, 0].max(initial=0.0)
    length = np.sqrt((asked.astype(np.float64) ** 2).sum(axis=1))
    out: list[list[np.ndarray]] = [[], [], [], []]

    def use(a: int, found: np.ndarray, score: np.ndarray, last: bool) -> bool:
        good = (block.labels[found] == label[a]) & (block.ids[found] != own[a])
        found, score = found[good][:most], score[good][:most]
        if len(found) < most and not last:
            return False
        same = np.ones(len(found), dtype=np.int64)
        for column, values in zip(out, (number[a] * same, label[a] * same, block.ids[found], score)):
            column.append(values)
        return True

    def levels(a: int) -> list[int]:
        return [int(share * length[a] * top) for share in SHARES] + [NONE]

    block.search(asked, levels, use)
    return _table(out, POSITIVE)


NEGATIVE = ["anchor", "positive_id", "positive_score", "negative_id", "negative_score"]


def negatives_of_block(
    anchors: pa.Table, rows: pa.Table, width: int, most: int, lowest: int, highest: int
) -> pa.Table:
    """The best rows of one block in each window of each anchor, of other labels than its own."""
    asked = matrix(anchors.column("v"), width)
    own, label = anchors.column("id").to_numpy(), anchors.column("label").to_numpy()
    number = anchors.column("anchor").to_numpy()
    windows = [
        list(dict.fromkeys((p["id"], p["score"]) for p in listed if p["score"] >= 0))
        for listed in anchors.column("positives").to_pylist()
    ]
    block = Block.of(rows, width, asked)
    out: list[list[np.ndarray]] = [[], [], [], [], []]

    def levels(a: int) -> list[int]:
        if not windows[a]:
            return []
        low = min(-(-lowest * score // 100) for _, score in windows[a])
        top = min(highest * score // 100 for _, score in windows[a])
        return [low + int(depth * (top - low)) for depth in DEPTHS if top > low] + [low]

    def use(a: int, found: np.ndarray, score: np.ndarray, last: bool) -> bool:
        other = (block.labels[found] != label[a]) & (block.ids[found] != own[a])
        found, score = found[other], score[other]
        taken = []
        for _, value in windows[a]:
            inside = (100 * score >= lowest * value) & (100 * score <= highest * value)
            taken.append(np.flatnonzero(inside)[:most])
        if not last and any(len(t) < most for t in taken):
            return False
        for (positive, value), t in zip(windows[a], taken):
            same = np.ones(len(t), dtype=np.int64)
            fields = (number[a] * same, positive * same, value * same, block.ids[found[t]], score[t])
            for column, values in zip(out, fields):
                column.append(values)
        return True

    block.search(asked, levels, use)
    return _table(out, NEGATIVE)


def meet(
    anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], names: list[str],
    search: Callable[[pa.Table, pa.Table], pa.Table],
) -> DataFrame:
    """``search`` over every block of anchors with every block of rows."""
    row_blocks, anchor_blocks = blocks
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    one = lambda mixed, count: F.pmod(mixed, F.lit(count)).cast("int")
    held = rows.select(
        "*", one(F.xxhash64("id", "label", "v"), row_blocks).alias("rows_in")
    ).select("*", every(anchor_blocks).alias("anchors_in"))
    asked = anchors.select(
        "*", one(F.xxhash64("anchor"), anchor_blocks).alias("anchors_in")
    ).select("*", every(row_blocks).alias("rows_in"))
    on = ["anchors_in", "rows_in"]

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return _table([[] for _ in names], names)
        return search(asked, held)

    return asked.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(
        run, ", ".join(f"{name} long" for name in names)
    )


def mine(
    df: DataFrame,
    key: str,
    label: str,
    vector: str,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
    scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on ``id``.
    """
    spark = ready(df.sparkSession)
    rows = usable(df, key, label, vector, scale)
    width = rows.select(F.size("v").alias("n")).limit(1).collect()
    if not width:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kinds)
    width = width[0]["n"]
    # an id is an anchor once for each of its vectors, so anchors have numbers of their own
    anchors = save(
        rows.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors"
    )
    blocks = tuple(
        max(1, -(-table.count() // size)) for table, size in ((rows, ROW_BLOCK), (anchors, ANCHOR_BLOCK))
    )
    near = meet(
        anchors, rows, blocks, POSITIVE, lambda a, r: positives_of_block(a, r, width, positives)
    )
    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    first = (
        near.withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= positives)
        .groupBy("anchor")
        .agg(
            F.collect_list(
                F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))
            ).alias("positives")
        )
    )
    asked = save(anchors.join(first, "anchor"), "asked")
    found = meet(
        asked, rows, blocks, NEGATIVE,
        lambda a, r: negatives_of_block(a, r, width, negatives, lowest, highest),
    )
    order = Window.partitionBy("anchor", "positive_id", "positive_score").orderBy(
        F.desc("negative_score"), "negative_id"
    )
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    return ranked.join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
