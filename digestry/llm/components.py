"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import save


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("least"))


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % (1 << 31)).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has an edge; the root is the least node it can reach.

    Every round ends in a written table, so a lost executor repeats one round at most. Minima are
    combined before the shuffle; the joins on a node can be split by AQE where one node is hot.
    """
    links = save(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges"
    )
    state = None
    while (now := _state(links)) != state:
        state = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least(both), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        )
        large = save(large.where("u <> v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(down)
        small = (
            down.join(least, "u")
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .unionByName(least.select("u", F.col("least").alias("v")))
        )
        links = save(small.where("u <> v").distinct(), "small")
    roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
