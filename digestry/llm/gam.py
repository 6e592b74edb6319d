"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees over the bins of one feature at a time are boosted in turn, and summed into one lookup
table per feature; then the pairs of features whose cut explains most of what is left get a table of
two dimensions the same way. A score adds a few table cells for a text, for whole batches at once.

The fit uses at most ``SAMPLE`` labelled texts of each class, chosen by hash and outside the
held-out remainder. Inputs of a score are measures of the text only.

Results for edge cases: a null or empty text is scored by its measures, which are all zero. Without
labelled texts of both classes every score is 1 or 0 after the only class, and 0.5 without labels.
Equal texts get equal scores. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm import rules
from digestry.llm.common import body, let, ready
from digestry.llm.samples import labelled_sample

SAMPLE = 10_000
HELD_OUT, PARTS = 1, 3
THRESHOLD = 0.5
BINS = 32
COARSE = 8
ROUNDS, PAIR_ROUNDS = 120, 60
RATE = 0.1
PAIRS = 6
#: Added to the curvature of a leaf, so that a leaf of few rows moves little.
RIDGE = 5.0

FEATURES = (
    ("log_words", lambda m: F.log1p(m["n_words"])),
    ("word_length", lambda m: _ratio(m["word_chars"], m["n_words"])),
    ("symbols", lambda m: _ratio(m["n_symbols"], m["n_words"])),
    ("stop_words", lambda m: _ratio(m["n_stop_words"], m["n_words"])),
    ("letter_words", lambda m: _ratio(m["n_letter_words"], m["n_words"])),
    ("letters", lambda m: _ratio(m["n_letters"], m["word_chars"])),
    ("capitals", lambda m: _ratio(m["n_capitals"], m["n_letters"])),
    ("exclamations", lambda m: _ratio(m["n_exclamations"], m["n_words"])),
    ("repeated_words", lambda m: _ratio(m["n_repeat_words"], m["n_words"])),
    ("repeated_lines", lambda m: _ratio(m["n_dup_lines"], m["n_lines"])),
    ("words_per_line", lambda m: F.log1p(_ratio(m["n_words"], m["n_lines"]))),
    ("bullet_lines", lambda m: _ratio(m["n_bullet_lines"], m["n_lines"])),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def features(text: Column) -> Column:
    """The features of a text as an array of doubles."""
    return let(
        lambda v: F.array(*[build(v["m"]).cast("double") for _, build in FEATURES]),
        m=rules.measures(text),
    )


class Additive:
    """Cut points, one table per feature, and tables of two dimensions for some pairs."""

    def __init__(self, cuts: list[np.ndarray], base: float):
        self.cuts, self.base = cuts, base
        self.tables = [np.zeros(len(c) + 1) for c in cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack(
            [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        )

    def coarse(self, bins: np.ndarray) -> np.ndarray:
        width = np.array([max(1, -(-(len(c) + 1) // COARSE)) for c in self.cuts])
        return bins // width

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        coarse = self.coarse(bins)
        for (f, g), table in self.pairs.items():
            total += table[coarse[:, f], coarse[:, g]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self.bins(x)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def shallow_tree(grad: np.ndarray, curve: np.ndarray, splits: int = 2) -> np.ndarray:
    """Leaf values by bin of a tree with ``splits`` cuts over the ordered bins."""
    edges = [0, len(grad)]
    sums = np.concatenate([[0.0], np.cumsum(grad)])
    weights = np.concatenate([[0.0], np.cumsum(curve)])

    def gain(a, b):
        return (sums[b] - sums[a]) ** 2 / (weights[b] - weights[a] + RIDGE)

    for _ in range(splits):
        best = (1e-12, None)
        for a, b in zip(edges, edges[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                won = gain(a, at) + gain(at, b) - gain(a, b)
                top = int(won.argmax())
                best = max(best, (float(won[top]), int(at[top])), key=lambda t: t[0])
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = (sums[b] - sums[a]) / (weights[b] - weights[a] + RIDGE)
    return out


def quadrants(grad: np.ndarray, curve: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts both dimensions once."""
    corner = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = corner(grad), corner(curve)
    best, value = 0.0, np.zeros_like(grad)
    rows, columns = grad.shape
    whole = g[-1, -1] ** 2 / (h[-1, -1] + RIDGE)
    for i in range(1, rows):
        for j in range(1, columns):
            parts = [
                (t[i, j], t[i, -1] - t[i, j], t[-1, j] - t[i, j],
                 t[-1, -1] - t[i, -1] - t[-1, j] + t[i, j])
                for t in (g, h)
            ]
            leaves = [a / (b + RIDGE) for a, b in zip(*parts)]
            won = sum(a * leaf for a, leaf in zip(parts[0], leaves)) - whole
            if won > best:
                best, value = won, np.empty_like(grad)
                value[:i, :j], value[:i, j:], value[i:, :j], value[i:, j:] = leaves
    return best, value


def train(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Additive:
    """Boost the features in turn, then the pairs that explain most of the rest in turn."""
    cuts = [
        np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        for f in range(x.shape[1])
    ]
    share = np.average(label, weights=weight)
    model = Additive(cuts, float(np.log(share / (1 - share))))
    bins = model.bins(x)
    margin = model.margin(bins)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = sigmoid(margin)
        return weight * (label - p), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            grad, curve = residual()
            size = len(table)
            step = RATE * shallow_tree(
                np.bincount(bins[:, f], grad, size), np.bincount(bins[:, f], curve, size)
            )
            table += step
            margin += step[bins[:, f]]
    coarse = model.coarse(bins)
    sizes = coarse.max(axis=0, initial=0) + 1
    sizes = np.maximum(sizes, [len(t) // max(1, -(-len(t) // COARSE)) + 1 for t in model.tables])

    def grid(pair: tuple[int, int], values: np.ndarray) -> np.ndarray:
        f, g = pair
        shape = int(sizes[f]), int(sizes[g])
        cell = coarse[:, f] * shape[1] + coarse[:, g]
        return np.bincount(cell, values, shape[0] * shape[1]).reshape(shape)

    grad, curve = residual()
    gains = {
        pair: quadrants(grid(pair, grad), grid(pair, curve))[0]
        for pair in combinations(range(x.shape[1]), 2)
    }
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    model.pairs = {p: np.zeros((int(sizes[p[0]]), int(sizes[p[1]]))) for p in chosen}
    for _ in range(PAIR_ROUNDS):
        for pair in chosen:
            grad, curve = residual()
            _, value = quadrants(grid(pair, grad), grid(pair, curve))
            model.pairs[pair] += RATE * value
            margin += RATE * value[coarse[:, pair[0]], coarse[:, pair[1]]]
    return model


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Additive:
    """Fit on a bounded sample of ``labels`` (``key, quality``) outside the held-out remainder."""
    ready(docs.sparkSession)
    sample, sizes = labelled_sample(docs, labels, key, text, "quality", PARTS, HELD_OUT, SAMPLE)
    rows = sample.select(features(F.col("text")).alias("x"), "label").toArrow().to_pandas()
    counts = rows["label"].value_counts().to_dict()
    if len(counts) < 2:
        only = 0.0 if not counts else (60.0 if 1 in counts else -60.0)
        return Additive([np.empty(0)] * len(FEATURES), only)
    label = rows["label"].to_numpy(dtype=float)
    weight = np.where(label == 1, sizes[1] / counts[1], sizes[0] / counts[0])
    return train(np.array(rows["x"].tolist()), label, weight / weight.mean())


def score(docs: DataFrame, key: str, text: str, model: Additive) -> DataFrame:
    """``key, score`` of every row, from 0 to 1; whole batches add up their table cells."""
    shared = ready(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(F.col(key), features(body(text)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            scores = shared.value.scores(x.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(scores, pa.float64())], names=[key, "score"]
            )

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, score double")
