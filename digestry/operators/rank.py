"""Sentence-graph ranking without listing sentence pairs.

Two sentences weigh ``sum over shared words of c_i * c_j``, divided by the sum of the logarithms of
their word counts. The numerator factors through the word and the divisor depends on the lengths
only, so one step of the walk is: sum rank over (word, sentence length), then read those sums back
through each sentence's words. That is exact and linear in the words of a document, where the pair
list is quadratic in its sentences.

Documents are one row each and are ranked inside it, in memory linear in their words. Through the same
step written as joins and aggregates, which spreads one document over many tasks, go on request documents
above a sentence limit, and for edge weights the rows that share their key.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.functions import text
from digestry.session import drop_stored, stored

# Damping, guard against empty rows, stop threshold on the change's Euclidean norm.
DAMPING = 0.85
ROW_GUARD = 1e-7
STOP = 1e-4
# The change shrinks by DAMPING per round from at most 2, so this many rounds always suffice.
MAX_ROUNDS = math.ceil(math.log(STOP / 2) / math.log(DAMPING)) + 1
RANK_DECIMALS = 10

EXPANDED_ENTRIES = 8_000_000


def top_count(sentence_count: Column) -> Column:
    return F.greatest(F.lit(5), F.floor(sentence_count / 4)).cast("int")


def with_sentences(df: DataFrame, column: str = "document") -> DataFrame:
    """Adds ``sentences`` and ``word_lines``: each sentence's words, space-joined."""
    return df.withColumn("sentences", text.sentences(F.col(column))).withColumn(
        "word_lines",
        F.transform("sentences", lambda s: F.array_join(text.letter_words(s), " ")),
    )


def _line_step(lines: Sequence[str]):
    """``_step`` of one document's sentences, given as space-joined words."""
    n = len(lines)
    vocabulary: dict[str, int] = {}
    at, word, times, length = [], [], [], np.zeros(n)
    for i, line in enumerate(lines):
        tokens = line.split()
        length[i] = len(tokens)
        for token, count in Counter(tokens).items():
            at.append(i)
            word.append(vocabulary.setdefault(token, len(vocabulary)))
            times.append(count)
    return _step(np.array(at, int), np.array(word, int), np.array(times, float), length)


def degree_lines(lines: Sequence[str]) -> np.ndarray:
    """The total edge weight of each of one document's sentences; 0 for those without words."""
    return _line_step(lines)(np.ones(len(lines)))


def rank_lines(lines: Sequence[str]) -> np.ndarray:
    """Ranks of one document's sentences, given as space-joined words."""
    n = len(lines)
    if n == 0:
        return np.zeros(0)
    step = _line_step(lines)
    weight = step(np.ones(n)) + ROW_GUARD
    rank = np.full(n, 1.0 / n)
    for _ in range(MAX_ROUNDS):
        following = (1 - DAMPING) / n + DAMPING * step(rank / weight)
        change = np.linalg.norm(following - rank)
        rank = following
        if change <= STOP:
            break
    return rank


def _divisor(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.log(a) + np.log(b)
    return np.where(np.isclose(total, 0.0), 1.0, total)


def _step(at: np.ndarray, word: np.ndarray, times: np.ndarray, length: np.ndarray):
    """One application of the symmetric weight matrix, as a function of a vector."""
    n = len(length)
    if len(at) == 0:
        return lambda y: np.zeros(n)
    lengths, cls = np.unique(length, return_inverse=True)
    slots, slot_of = np.unique(word * len(lengths) + cls[at], return_inverse=True)
    slot_length = lengths[slots % len(lengths)]
    per_word = np.bincount(slots // len(lengths), minlength=word.max() + 1)
    first_slot = np.concatenate(([0], np.cumsum(per_word)[:-1]))
    fan = per_word[word]

    def expand(begin: int, end: int):
        entry = np.repeat(np.arange(begin, end), fan[begin:end])
        starts = np.repeat(np.cumsum(fan[begin:end]) - fan[begin:end], fan[begin:end])
        slot = first_slot[word[entry]] + np.arange(len(entry)) - starts
        factor = times[entry] / _divisor(length[at[entry]], slot_length[slot])
        return at[entry], slot, factor

    bounds = [0]
    filled = np.cumsum(fan)
    while bounds[-1] < len(at):
        done = filled[bounds[-1] - 1] if bounds[-1] else 0
        reach = int(np.searchsorted(filled, done + EXPANDED_ENTRIES, side="right"))
        bounds.append(max(reach, bounds[-1] + 1))
    kept = expand(0, len(at)) if len(bounds) == 2 else None

    def step(y: np.ndarray) -> np.ndarray:
        sums = np.bincount(slot_of, weights=y[at] * times, minlength=len(slots))
        out = np.zeros(n)
        for begin, end in zip(bounds, bounds[1:]):
            target, slot, factor = kept or expand(begin, end)
            out += np.bincount(target, weights=factor * sums[slot], minlength=n)
        return out

    return step


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _ranks(lines: pd.Series) -> pd.Series:
    return pd.Series([rank_lines(line) for line in lines], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _degrees(lines: pd.Series) -> pd.Series:
    return pd.Series([degree_lines(line) for line in lines], dtype=object)


def word_incidence(df: DataFrame, key: str) -> DataFrame:
    """``key, i, word, times, length`` from ``word_lines``.

    The outer form of explode keeps Spark from evaluating an array twice to test its size.
    """
    lines = df.select(key, F.posexplode_outer("word_lines").alias("i", "line"))
    listed = lines.select(key, "i", F.split("line", " ").alias("ws"))
    words = listed.select(key, "i", F.size("ws").alias("length"), F.explode_outer("ws").alias("word"))
    return (
        words.where("word != ''")
        .groupBy(key, "i", "length", "word")
        .agg(F.count(F.lit(1)).alias("times"))
    )


def graph_step(incidence: DataFrame, key: str, vector: DataFrame | None = None) -> DataFrame:
    """``key, i, value``: the weight matrix applied to ``vector`` (``key, i, value``), or to ones."""
    if vector is None:
        held = incidence.withColumn("value", F.lit(1.0))
    else:
        held = incidence.join(vector, [key, "i"])
    sums = held.groupBy(key, "word", F.col("length").alias("other")).agg(
        F.sum(F.col("value") * F.col("times")).alias("mass")
    )
    norm = F.ln("length") + F.ln("other")
    divisor = F.when((F.col("length") == 1) & (F.col("other") == 1), 1.0).otherwise(norm)
    return (
        incidence.join(sums, [key, "word"])
        .groupBy(key, "i")
        .agg(F.sum(F.col("times") * F.col("mass") / divisor).alias("value"))
    )


def sentence_degrees(df: DataFrame, key: str, keys: DataFrame | None = None) -> DataFrame:
    """``key, i, value``: the total edge weight of every sentence that has words, from ``word_lines``.

    A row whose key is its own is worked in place, without a shuffle of its words. Rows that share a key
    are one document, worked by joins; rows without a key give none. ``keys`` may hold the keys of ``df``
    and others, where they cost less to read.
    """
    named = (df if keys is None else keys).where(F.col(key).isNotNull())
    shared = stored(named.groupBy(key).count().where("count > 1").select(key), "shared_keys")
    alone = df.where(F.col(key).isNotNull()).join(shared, key, "left_anti")
    # The outer form keeps Spark from working each row twice, once to test its number of sentences.
    in_row = alone.select(key, F.posexplode_outer(_degrees("word_lines")).alias("i", "value")).where("value > 0")
    together = word_incidence(df.join(shared, key, "left_semi"), key)
    return in_row.unionByName(graph_step(together, key))


def rank_by_rounds(df: DataFrame, key: str) -> DataFrame:
    """``key, ranks`` by driver-stepped rounds over all documents at once.

    Every round is written and its predecessor removed; documents that have settled leave the walk.
    """
    incidence = stored(word_incidence(df, key))
    nodes = stored(
        df.select(
            key, F.size("word_lines").alias("n"), F.posexplode_outer("word_lines").alias("i", "_l")
        ).drop("_l")
    )
    degree = graph_step(incidence, key)
    state = stored(
        nodes.join(degree.withColumnRenamed("value", "degree"), [key, "i"], "left").select(
            key,
            "i",
            "n",
            (F.coalesce("degree", F.lit(0.0)) + ROW_GUARD).alias("degree"),
            (1.0 / F.col("n")).alias("rank"),
            F.lit(False).alias("settled"),
        )
    )
    settled = df.sparkSession.createDataFrame([], state.schema)
    for _ in range(MAX_ROUNDS):
        walking = state.where("not settled")
        share = walking.select(key, "i", (F.col("rank") / F.col("degree")).alias("value"))
        moved = walking.join(graph_step(incidence, key, share), [key, "i"], "left").withColumn(
            "following",
            (1 - DAMPING) / F.col("n") + DAMPING * F.coalesce("value", F.lit(0.0)),
        )
        change = moved.groupBy(key).agg(
            (F.sqrt(F.sum(F.pow(F.col("following") - F.col("rank"), 2))) <= STOP).alias("_done")
        )
        advanced = stored(
            moved.join(change, key).select(
                key, "i", "n", "degree", F.col("following").alias("rank"), F.col("_done").alias("settled")
            )
        )
        finished = advanced.where("settled")
        if not finished.isEmpty():
            settled = settled.unionByName(stored(finished, "settled"))
        drop_stored(state)
        state = advanced
        if state.where("not settled").isEmpty():
            break
    final = settled.unionByName(state.where("not settled"))
    return final.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "rank"))), lambda e: e["rank"]).alias("ranks")
    )


def with_ranks(
    df: DataFrame, key: str, column: str = "document", row_sentences: int | None = None
) -> DataFrame:
    """Adds ``sentences`` and ``ranks``.

    With ``row_sentences``, documents of more sentences than that are ranked by rounds.
    """
    listed = with_sentences(df, column)
    if row_sentences is None:
        return listed.withColumn("ranks", _ranks("word_lines")).drop("word_lines")
    size = F.size("sentences")
    in_row = listed.where(size <= row_sentences).withColumn("ranks", _ranks("word_lines"))
    large = listed.where(size > row_sentences)
    ranked = rank_by_rounds(large.select(key, "word_lines"), key)
    return in_row.unionByName(large.join(ranked, key)).drop("word_lines")


def best_sentences(sentences: Column, ranks: Column, k: Column) -> Column:
    """The ``k`` best as structs ``pos, sentence, rank``, in document order.

    Ranks are compared after rounding, so that mathematically equal ones tie and go by position.
    """
    scored = F.transform(
        F.arrays_zip(sentences.alias("s"), ranks.alias("r")),
        lambda e, i: F.struct(
            (-F.round(e["r"], RANK_DECIMALS)).alias("order"),
            i.alias("pos"),
            e["s"].alias("sentence"),
            e["r"].alias("rank"),
        ),
    )
    top = F.slice(F.array_sort(scored), F.lit(1), k)
    return F.array_sort(
        F.transform(top, lambda e: F.struct(e["pos"].alias("pos"), e["sentence"].alias("sentence"), e["rank"].alias("rank")))
    )


def textrank(
    df: DataFrame,
    key: str,
    column: str = "document",
    k: Column | None = None,
    row_sentences: int | None = None,
) -> DataFrame:
    """Adds ``extract``, the array of best sentences, and ``extracted``, their text."""
    ranked = with_ranks(df, key, column, row_sentences)
    k = top_count(F.size("sentences")) if k is None else k
    return (
        ranked.withColumn("extract", best_sentences(F.col("sentences"), F.col("ranks"), k))
        .withColumn("extracted", F.array_join(F.col("extract.sentence"), " "))
        .drop("sentences", "ranks")
    )
