"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

For toxic and for ordinary texts, the next character of a word is predicted from up to five before
it. A class counts in how many of its texts a word stands; what it has rarely seen it takes from
continuation counts that both classes share, so a spelling that neither knows tells nothing. The
difference of the two log-likelihoods of the whole text divided by its length, of the words that
stand out most, and of all that stand out are weighed by a logistic curve. The curve is fitted on
differences that come from the other half of the sample.

The fit uses at most ``SAMPLE`` labelled texts of each class and all character sequences in them;
the model holds those whose context enough texts have. Every text is scored whole.

Results for edge cases: a null or empty text, or one without letters, is scored as ordinary text of
length zero. Without labelled texts of both classes every score is the share of class 1 (0 if there
are no labels). Equal texts get equal scores. Other columns of the input stay as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import body, ready, remembered, save
from digestry.llm.samples import labelled_sample

SAMPLE = 5_000
CONTEXT = 5
#: A class has its own counts for a context from so many of its texts on.
LEAST_TEXTS = 5
DISCOUNT = 0.75
HELD_OUT, PARTS = 2, 4
THRESHOLD = 0.3
#: Distinct words whose difference a Python worker remembers.
REMEMBERED = 150_000
#: Whole texts reach a task in batches of so many bytes.
BATCH_BYTES = 8 << 20
TOP = 3
#: A word stands out above this difference.
STANDS_OUT = 1.5
FEATURES = 5

WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Model:
    """Differences of log-likelihood by character sequence, and the curve over text features."""

    def __init__(self, grams: dict[str, float], contexts: dict[str, float]):
        self.grams, self.contexts = grams, contexts
        self.weights = np.zeros(FEATURES + 1)
        self.shift, self.scale = np.zeros(FEATURES), np.ones(FEATURES)
        self.words: dict[str, float] = {}

    def __reduce__(self):
        return _rebuild, (self.grams, self.contexts, self.weights, self.shift, self.scale)

    def word(self, word: str) -> float:
        line, total = f"^{word}$", 0.0
        for i in range(1, len(line)):
            first = max(0, i - CONTEXT)
            value = self.grams.get(line[first : i + 1])
            total += self.contexts.get(line[first:i], 0.0) if value is None else value
        return total

    def features(self, text: str) -> tuple[float, ...]:
        """Difference per character, of the most telling word and of the top few different ones, of
        all different words that stand out, and log length."""
        words = tokens(text)
        if not words:
            return (0.0,) * FEATURES
        times = Counter(words)
        found = list(map(self.words.get, times))
        if None in found:
            if len(self.words) > REMEMBERED:
                self.words = {}
            self.words.update((w, self.word(w)) for w in times if w not in self.words)
            found = list(map(self.words.__getitem__, times))
        values, counts = np.array(found), np.array(list(times.values()))
        top = np.append(np.partition(values, -min(TOP, len(values)))[-TOP:], [0.0] * TOP)[:TOP]
        out = np.maximum(values - STANDS_OUT, 0).sum()
        size = sum(map(len, words)) + len(words)
        return values @ counts / size, top.max(), top.mean(), np.log1p(out), np.log1p(len(words))

    def standard(self, features: np.ndarray) -> np.ndarray:
        bounded = np.column_stack([features[:, :1], np.clip(features[:, 1:], -20, 20)])
        return np.column_stack([np.ones(len(features)), (bounded - self.shift) / self.scale])

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.standard(features) @ self.weights, -30, 30)))

    def fit_curve(self, features: np.ndarray, label: np.ndarray, weight: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        bounded = self.standard(features)[:, 1:]
        self.shift, self.scale = bounded.mean(axis=0), bounded.std(axis=0) + 1e-9
        x = self.standard(features)
        ridge = np.diag([1e-6, *[1e-2] * FEATURES]) * weight.sum() / 100
        for _ in range(25):
            p = self.scores(features)
            step = np.linalg.solve(
                (x * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ x + ridge,
                x.T @ (weight * (label - p)) - ridge @ self.weights,
            )
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-6:
                break


def _rebuild(grams, contexts, weights, shift, scale) -> Model:
    model = Model(grams, contexts)
    model.weights, model.shift, model.scale = weights, shift, scale
    return model


#: Texts of either class in either half of the sample.
COUNTS = ("toxic_0", "ordinary_0", "toxic_1", "ordinary_1")


def half(text: str) -> int:
    return zlib.crc32(text.encode("utf-8")) & 1


def spelling_counts(sample: DataFrame) -> DataFrame:
    """``gram`` and ``COUNTS``: contexts with their next character, by texts of each class."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity")
        for batch in batches:
            seen = [Counter() for _ in COUNTS]
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen[2 * half(text) + 1 - label].update(set(tokens(text)))
            names = list(set().union(*seen))
            counts = [pa.array([c[w] for w in names], pa.int64()) for c in seen]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), *counts], names=["word", *COUNTS]
            )

    sums = [F.sum(c).alias(c) for c in COUNTS]
    kinds = ", ".join(f"{c} long" for c in COUNTS)
    counted = sample.mapInArrow(words, f"word string, {kinds}").groupBy("word").agg(*sums)
    line = F.concat(F.lit("^"), "word", F.lit("$"))
    grams = F.transform(
        F.sequence(F.lit(2), F.length(line)),
        lambda i: F.substring(
            line, F.greatest(i - CONTEXT, F.lit(1)), F.least(i, F.lit(CONTEXT + 1))
        ),
    )
    return counted.select(F.explode(grams).alias("gram"), *COUNTS).groupBy("gram").agg(*sums)


def shared_counts(grams: DataFrame) -> DataFrame:
    """``gram, kinds``: before how many different characters each shorter sequence stands."""
    tails = F.transform(
        F.sequence(F.lit(2), F.length("gram")), lambda n: F.right(F.col("gram"), n)
    )
    return (
        grams.select(F.explode(tails).alias("long"))
        .distinct()
        .groupBy(F.substr("long", F.lit(2)).alias("gram"))
        .agg(F.count(F.lit(1)).alias("kinds"))
    )


def shared_probabilities(counts: DataFrame) -> DataFrame:
    """``gram, lower``: the interpolated Kneser-Ney probability of the last character after the
    others, from the continuation counts of both classes. Every shorter end of a sequence is one too.
    """
    context = F.expr("left(gram, length(gram) - 1)")
    contexts = counts.groupBy(context.alias("context")).agg(
        F.sum("kinds").alias("total"), F.count(F.lit(1)).alias("types")
    )
    placed = save(counts.withColumn("context", context).join(contexts, "context"), "placed")
    found = None
    for size in range(1, CONTEXT + 1):
        level = placed.where(F.length("gram") == size)
        if found is None:
            level = level.withColumn("rest", 1 / F.col("types"))  # types: all letters
        else:
            shorter = found.select(F.col("gram").alias("end"), F.col("lower").alias("rest"))
            level = level.withColumn("end", F.expr("substr(gram, 2)")).join(shorter, "end")
        value = (F.col("kinds") - DISCOUNT + DISCOUNT * F.col("types") * F.col("rest")) / F.col("total")
        level = save(level.select("gram", value.alias("lower")), "level")
        found = level if found is None else found.unionByName(level)
    return found


def differences(grams: DataFrame, lower: DataFrame, halves: tuple[int, ...]) -> Model:
    """The difference of the two classes for every sequence of these halves of the sample whose
    context enough texts of either class have; only these come to the driver."""
    names = ("toxic", "ordinary")
    seen = grams.select(
        "gram",
        F.expr("left(gram, length(gram) - 1)").alias("context"),
        *[sum((F.col(f"{c}_{h}") for h in halves), F.lit(0)).alias(c) for c in names],
    ).where("toxic + ordinary > 0")
    sums = seen.groupBy("context").agg(
        *[F.sum(c).alias(f"{c}_all") for c in names],
        *[F.count_if(F.col(c) > 0).alias(f"{c}_types") for c in names],
    )
    enough = {c: F.col(f"{c}_all") >= LEAST_TEXTS for c in names}
    contexts = save(
        sums.where(enough["toxic"] | enough["ordinary"]).select(
            "*",
            *[
                F.when(enough[c], DISCOUNT * F.col(f"{c}_types") / F.col(f"{c}_all"))
                .otherwise(1.0).alias(f"{c}_spare")
                for c in names
            ],
        ),
        "contexts",
    )
    p = [
        F.when(enough[c], F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0)
        + F.col(f"{c}_spare") * F.col("lower")
        for c in names
    ]
    held = (
        seen.join(contexts, "context")
        .withColumn("end", F.expr("substr(gram, 2)"))
        .join(lower.withColumnRenamed("gram", "end"), "end")
        .select("gram", F.log(p[0] / p[1]).alias("value"))
    )
    spare = contexts.select("context", F.log(F.col("toxic_spare") / F.col("ordinary_spare")))
    tables = [table.toArrow() for table in (held, spare)]
    return Model(*[dict(zip(t.column(0).to_pylist(), t.column(1).to_pylist())) for t in tables])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on a bounded sample of ``labels`` (``key, toxic``) outside the held-out remainder."""
    ready(docs.sparkSession, BATCH_BYTES)
    sample, sizes = labelled_sample(docs, labels, key, text, "toxic", PARTS, HELD_OUT, SAMPLE)
    in_sample = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(in_sample) < 2:
        model = Model({}, {})
        share = (1 + 1e-9) * float(bool(in_sample.get(1)))
        model.weights[0] = math.log((share + 1e-9) / (1 - min(share, 1 - 1e-9)))
        return model
    grams = save(spelling_counts(sample), "spelling")
    lower = shared_probabilities(shared_counts(grams))
    others = docs.sparkSession.sparkContext.broadcast(
        [differences(grams, lower, (1,)), differences(grams, lower, (0,))]
    )
    model = differences(grams, lower, (0, 1))

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(v) for v in others.value[half(t)].features(t)] for t in texts])

    rows = sample.select(features("text").alias("x"), "label").toArrow().to_pandas()
    others.unpersist()
    label = rows["label"].to_numpy(dtype=float)
    weight = np.where(label == 1, sizes[1] / in_sample[1], sizes[0] / in_sample[0])
    model.fit_curve(np.array(rows["x"].tolist()), label, weight / weight.mean())
    return model


def score(docs: DataFrame, text: str, model: Model, out: str = "toxicity") -> DataFrame:
    """Adds the double ``out``, from 0 to 1."""
    shared = ready(docs.sparkSession, BATCH_BYTES).sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        held = shared.value
        remembered("toxicity")
        if not len(texts):
            return pd.Series([], dtype=float)
        return pd.Series(held.scores(np.array([held.features(t) for t in texts])))

    return docs.withColumn(out, scored(body(text)))
