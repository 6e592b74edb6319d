"""Corpus metrics of the user's own: a state per group and task, added to batch by batch, merged, finished.

Only the states are shuffled, one per group for each task, so a metric costs one pass over the pairs and moves
no text. A state is any small value that can be pickled; its size must not grow with the rows it has seen.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that a task holds states for; beyond it states are handed on early, with the same result.
GROUPS_HELD = 4_096
#: States of a group meet in this many tasks before the last one.
MEETINGS = 64


@dataclass(frozen=True)
class PairMetric:
    """``add(state, predictions, references)`` and ``merge(state, state)`` return a state; ``merge`` must not
    care for order. ``finish(state)`` is the value, or None where there is none. Null texts come as empty."""

    name: str
    start: Callable[[], Any]
    add: Callable[[Any, list[str], list[str]], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], float | None]


def _emit(states: dict[tuple, list], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = [pa.array([key[i] for key in states], type=f.type) for i, f in enumerate(fields)]
    packed = pa.array([pickle.dumps(held) for held in states.values()], type=pa.binary())
    return pa.RecordBatch.from_arrays([*columns, packed], names=[*(f.name for f in fields), "_states"])


def pair_metrics(pairs: DataFrame, by: Sequence[str], metrics: Sequence[PairMetric]) -> DataFrame:
    """``by, metric, value`` (one row per group and metric) over ``prediction`` and ``reference``.

    Null groups are groups. A table without rows has no groups, and so no rows.
    """
    by, chosen = list(by), list(metrics)
    rows = pairs.select(
        *by,
        *[F.coalesce(c, F.lit("")).cast("string").alias(f"_{c}") for c in ("prediction", "reference")],
    )
    keys = [f for f in rows.schema.fields if f.name in by]
    partial = T.StructType([*keys, T.StructField("_states", T.BinaryType())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        fields: list[pa.Field] = []
        for batch in batches:
            fields = [batch.schema.field(name) for name in by]
            groups: dict[tuple, list[int]] = {}
            listed = [batch.column(name).to_pylist() for name in by]
            for i, key in enumerate(zip(*listed) if by else [()] * batch.num_rows):
                groups.setdefault(key, []).append(i)
            for key, places in groups.items():
                held = states.setdefault(key, [m.start() for m in chosen])
                texts = [
                    batch.column(side).take(pa.array(places)).to_pylist()
                    for side in ("_prediction", "_reference")
                ]
                states[key] = [m.add(state, *texts) for m, state in zip(chosen, held)]
            if len(states) > GROUPS_HELD:
                yield _emit(states, fields)
                states = {}
        if states:
            yield _emit(states, fields)

    def meet(held: pa.Table) -> pa.Table:
        merged = None
        for packed in held.column("_states").to_pylist():
            states = pickle.loads(packed)
            merged = states if merged is None else [
                m.merge(a, b) for m, a, b in zip(chosen, merged, states)
            ]
        return held.slice(0, 1).select(by).append_column("_states", pa.array([pickle.dumps(merged)]))

    @F.arrow_udf("array<struct<metric: string, value: double>>")
    def finished(packed: pa.Array) -> pa.Array:
        out = []
        for value in packed.to_pylist():
            states = pickle.loads(value)
            out.append([{"metric": m.name, "value": m.finish(s)} for m, s in zip(chosen, states)])
        kind = pa.list_(pa.struct([("metric", pa.string()), ("value", pa.float64())]))
        return pa.array(out, type=kind)

    states = rows.mapInArrow(gather, partial)
    place = F.pmod(F.spark_partition_id(), F.lit(MEETINGS))
    first = states.withColumn("_place", place).groupBy(*by, "_place").applyInArrow(meet, partial)
    last = first.groupBy(*by).applyInArrow(meet, partial)
    return last.select(*by, F.explode_outer(finished("_states")).alias("m")).select(
        *by, "m.metric", "m.value"
    )


def mean_of(name: str, each: Callable[[str, str], float]) -> PairMetric:
    """The mean over all pairs of a function of prediction and reference."""

    def add(state, predictions, references):
        values = [each(p, r) for p, r in zip(predictions, references)]
        return state[0] + sum(values), state[1] + len(values)

    return PairMetric(
        name, lambda: (0.0, 0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]),
        lambda s: s[0] / s[1] if s[1] else None,
    )


def ratio_of(name: str, parts: Callable[[str, str], tuple[float, float]]) -> PairMetric:
    """The quotient of two corpus sums; None where the second is zero."""

    def add(state, predictions, references):
        for p, r in zip(predictions, references):
            above, below = parts(p, r)
            state = state[0] + above, state[1] + below
        return state

    return PairMetric(
        name, lambda: (0, 0), add, lambda a, b: (a[0] + b[0], a[1] + b[1]),
        lambda s: s[0] / s[1] if s[1] else None,
    )
