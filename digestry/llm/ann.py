"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots of a fixed set, in order. Each block of rows keeps a posting
list for every pivot: the rows that have it among their nearest, and at which place. A query reads the
postings of its own nearest pivots only and adds up by how much each row's footrule distance (Spearman's,
pivots that are not listed standing behind the others) falls below that of a row without common pivots.
Places tell the angle only, so this correlation times the row's length stands for the inner product; the
rows of the greatest such product, with all ties of the last one, and the longest rows are ranked again by
the exact one. Blocks of queries meet blocks of rows, both of bounded size.

The index covers every row. The pivots are a bounded sample: the ``PIVOTS`` different vectors of least
hash. ``SHARE`` and ``RERANKED`` set how many rows of a block are ranked again; a share of 1 ranks all of
them and makes the search exact. ``recall`` measures what is found against all rows.

Results for edge cases: vectors that are null, zero, of another length than the first pivot, or
that hold a null or non-finite component take no part, nor do rows with a null id. Rows that repeat
an id and vector count once; rows with the query's id are its own. Ties go to the smaller id. A product
beyond double range is infinite, and such products tie; where both signs overflow, the products of the
scaled vectors tell which. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.llm.common import ready, save

#: Pivots (at most 256), and how many of them a row is listed with.
PIVOTS, LISTED = 128, 40
SHARE, RERANKED, LONGEST = 0.2, 128, 32
ROW_BLOCK, QUERY_BLOCK = 4096, 8192
#: Added to the footrule correlation, about its error, so that long rows are not missed by it.
MARGIN = 0.15


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vector`` as doubles, of the rows that take part, each once."""
    parts = F.col(vector).cast("array<double>")
    finite = F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    some = F.exists(parts, lambda x: x != 0)
    return (
        df.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & some)
        .select(F.col(key).cast("long").alias("id"), parts.alias("vector"))
        .distinct()
    )


def units(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def choose_pivots(rows: DataFrame, count: int) -> np.ndarray:
    """Unit vectors of the different vectors of least hash; at most ``count`` come to the driver."""
    different = rows.select("vector").distinct()
    picked = different.orderBy(F.xxhash64("vector"), "vector").limit(count).collect()
    width = len(picked[0]["vector"]) if picked else 0
    return units(np.array([r["vector"] for r in picked if len(r["vector"]) == width]).reshape(-1, max(width, 1)))


def represent(rows: DataFrame, pivots: np.ndarray, listed: int) -> DataFrame:
    """``id, vector, nearest``: the vector's doubles and its ``listed`` nearest pivots, packed."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            vectors = np.array(batch.column("vector").to_pylist()).reshape(-1, p.shape[1])
            if not len(vectors):
                continue
            order = np.argsort(-(units(vectors) @ p.T), axis=1, kind="stable")
            nearest = order[:, :listed].astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([v.tobytes() for v in nearest], pa.binary()),
                ],
                names=["id", "vector", "nearest"],
            )

    whole = rows.where(F.size("vector") == pivots.shape[1])
    return whole.mapInArrow(run, "id long, vector binary, nearest binary")


def unpack(table: pa.Table, name: str, kind: type) -> np.ndarray:
    packed = table.column(name).to_pylist()
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1)


def inner_products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """In double precision, adding component after component, so equal vectors score equally."""
    total = np.zeros(len(vectors))
    with np.errstate(over="ignore", invalid="ignore"):
        for component, value in zip(vectors.T, query):
            total += component * value
    odd = np.flatnonzero(~np.isfinite(total))
    if len(odd):
        large, most = np.abs(vectors[odd]).max(axis=1), np.abs(query).max()
        scaled = (vectors[odd] / large[:, None]) @ (query / most)
        with np.errstate(over="ignore"):
            total[odd] = scaled * large * most
    return total


def lengths(vectors: np.ndarray) -> np.ndarray:
    """To 16 bits, so that rows of unit length up to rounding tie."""
    top = np.abs(vectors).max(axis=1)
    with np.errstate(over="ignore"):
        part, power = np.frexp(np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1)) * top)
    return np.ldexp(np.round(part * 65536) / 65536, power)


class Postings:
    """For every pivot the rows of a block that list it, with its place there."""

    def __init__(self, nearest: np.ndarray, pivots: int):
        order = np.argsort(nearest.ravel(), kind="stable")
        self.rows, self.places = order // nearest.shape[1], order % nearest.shape[1]
        self.starts = np.append(0, np.cumsum(np.bincount(nearest.ravel(), minlength=pivots)))
        self.count, self.listed = len(nearest), nearest.shape[1]
        steps = np.arange(self.listed)
        self.top = self.listed * (self.listed + 1)
        # what rows of unrelated order have in common with a query
        self.expected = float(((2 * steps + 1) * (self.listed - steps)).sum() * 2 / pivots / self.top)

    def correlation(self, nearest: np.ndarray) -> np.ndarray:
        """How much less than without common pivots the footrule is, as a share of the most possible."""
        less = np.zeros(self.count, dtype=np.int64)
        for place, pivot in enumerate(nearest.tolist()):
            at = slice(self.starts[pivot], self.starts[pivot + 1])
            less[self.rows[at]] += self.listed - np.maximum(self.places[at], place)
        return 2 * less / self.top - self.expected


def search_block(
    queries: pa.Table, rows: pa.Table, nearest: int, share: float, reranked: int, pivots: int
) -> pa.Table:
    """The best of one block of rows for one block of queries."""
    ids = rows.column("id").to_numpy()
    vectors = unpack(rows, "vector", np.float64)
    postings = Postings(unpack(rows, "nearest", np.uint8), pivots)
    depth = min(len(ids), int(np.ceil(share * len(ids))) + reranked)
    length = lengths(vectors)
    longest = np.zeros(len(ids), dtype=bool)
    longest[np.lexsort((ids, -length))[:LONGEST]] = True
    out: tuple[list, list, list] = ([], [], [])
    for query, vector, listed in zip(
        queries.column("id").to_pylist(),
        unpack(queries, "vector", np.float64),
        unpack(queries, "nearest", np.uint8),
    ):
        hope = length * (MARGIN + postings.correlation(listed))
        worst = np.partition(hope, len(hope) - depth)[len(hope) - depth]
        near = np.flatnonzero(((hope >= worst) | longest) & (ids != query))
        score = inner_products(vectors[near], vector)
        best = np.lexsort((ids[near], -score))[:nearest]
        out[0].append(np.full(len(best), query))
        out[1].append(ids[near[best]])
        out[2].append(score[best])
    return pa.table(
        [pa.array(np.concatenate([*c, np.empty(0, k)]).astype(k)) for c, k in zip(out, (int, int, float))],
        names=["query_id", "vec_id", "score"],
    )


def search(
    df: DataFrame,
    key: str,
    vector: str,
    is_query: Column,
    nearest: int,
    share: float = SHARE,
    reranked: int = RERANKED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``is_query``, a condition on ``id``, the
    ``nearest`` other rows by inner product."""
    spark = ready(df.sparkSession)
    result = "query_id long, vec_id long, score double"
    rows = save(usable(df, key, vector), "vectors")
    pivots = choose_pivots(rows, PIVOTS)
    if not len(pivots):
        found = spark.createDataFrame([], result)
    else:
        listed = min(LISTED, len(pivots))
        index = save(represent(rows, pivots, listed), "index")
        sizes = index.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q")).first()
        row_blocks = max(1, -(-sizes["n"] // ROW_BLOCK))
        query_blocks = max(1, -(-sizes["q"] // QUERY_BLOCK))
        mixed = F.xxhash64("id", "vector")
        one = lambda blocks: F.pmod(mixed, F.lit(blocks)).cast("int")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        held = index.select("*", one(row_blocks).alias("rows_in")).select(
            "*", every(query_blocks).alias("queries_in")
        )
        asked = (
            index.where(is_query)
            .select("*", one(query_blocks).alias("queries_in"))
            .select("*", every(row_blocks).alias("rows_in"))
        )
        on = ["queries_in", "rows_in"]

        def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
            if not queries.num_rows or not rows.num_rows:
                return pa.table(
                    [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )
            return search_block(queries, rows, nearest, share, reranked, len(pivots))

        found = asked.groupBy(*on).cogroup(held.groupBy(*on)).applyInArrow(run, result)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )


def recall(found: DataFrame, df: DataFrame, key: str, vector: str, nearest: int) -> float:
    """The share of true neighbours that ``found`` has, over its own queries; for tests."""
    rows = usable(df, key, vector).toPandas()
    ids, vectors = rows["id"].to_numpy(), np.array(rows["vector"].tolist())
    hit = all_ = 0
    for query, group in found.toPandas().groupby("query_id"):
        score = inner_products(vectors, vectors[ids == query][0])
        others = np.flatnonzero(ids != query)
        best = others[np.lexsort((ids[others], -score[others]))[:nearest]]
        hit += len(set(ids[best]) & set(group["vec_id"]))
        all_ += len(best)
    return hit / max(all_, 1)
