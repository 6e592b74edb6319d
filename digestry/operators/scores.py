"""ROUGE, BLEU and embedding-match scores, and comparisons of systems.

Pairs have ``prediction`` and ``reference``. Everything about one pair is computed in its row, so a
corpus score shuffles only one partial sum per task and group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import overlap, text

BLEU_ORDERS = (1, 2, 3, 4)


def f_measure(match: Column, predicted: Column, expected: Column) -> Column:
    precision = match / F.greatest(predicted, F.lit(1))
    recall = match / F.greatest(expected, F.lit(1))
    total = precision + recall
    return F.when(total > 0, 2 * precision * recall / F.nullif(total, F.lit(0.0))).otherwise(0.0)


def shared_counts(left: list[str], right: list[str], orders: Sequence[int]) -> list[int]:
    """For each order, the size of the multiset intersection of the n-grams; linear in the tokens."""
    shared = []
    for n in orders:
        seen = Counter(zip(*(left[i:] for i in range(n))))
        other = Counter(zip(*(right[i:] for i in range(n))))
        small, large = sorted((seen, other), key=len)
        shared.append(sum(min(k, large[gram]) for gram, k in small.items() if gram in large))
    return shared


def clipped_overlap(left: Column, right: Column, orders: Sequence[int]) -> Column:
    """The clipped n-gram matches of two lines of space-parted tokens, as an array by ``orders``."""
    wanted = tuple(orders)

    @F.pandas_udf("array<int>")
    def matches(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([shared_counts(x.split(), y.split(), wanted) for x, y in zip(a, b)])

    return matches(left, right)


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence with one bit per position of ``a``."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


ROUGE_KINDS = ("rouge1", "rouge2", "rougeL")


def _counted(
    pairs: DataFrame, left: Column, right: Column, names: Sequence[str], orders, lcs: bool, cut: overlap.Cut
) -> DataFrame:
    """Adds the columns ``names`` with what ``overlap.overlaps`` counts, in one pass over the pairs."""
    wanted = tuple(orders)

    @F.arrow_udf("array<int>")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        return overlap.overlaps(a, b, wanted, lcs, cut)

    counted = pairs.withColumn("_counts", count(left, right))
    return counted.withColumns(
        {name: F.get("_counts", F.lit(i)) for i, name in enumerate(names)}
    ).drop("_counts")


def _with_rouge(pairs: DataFrame, kinds: Sequence[str], stemmed: bool) -> DataFrame:
    """Adds one F measure column per kind."""
    orders = [int(kind[-1]) for kind in kinds if kind != "rougeL"] or [1]
    lcs = "rougeL" in kinds
    texts = [F.lower(F.coalesce(c, F.lit(""))) for c in ("prediction", "reference")]
    names = ["_np", "_nr", *[f"_m{n}" for n in orders], *(["_lcs"] if lcs else [])]
    counted = _counted(pairs, *texts, names, orders, lcs, overlap.STEMMED if stemmed else overlap.ROUGE)
    values = {}
    for kind in kinds:
        if kind == "rougeL":
            values[kind] = f_measure(F.col("_lcs"), F.col("_np"), F.col("_nr"))
            continue
        n = int(kind[-1])
        values[kind] = f_measure(F.col(f"_m{n}"), _total("_np", n), _total("_nr", n))
    return counted.withColumns(values).drop(*names)


def _with_bleu(pairs: DataFrame) -> DataFrame:
    """Adds the token counts ``_bnp``, ``_bnr`` and the matches ``_bm1`` to ``_bm4``."""
    texts = [F.coalesce(c, F.lit("")) for c in ("prediction", "reference")]
    names = ["_bnp", "_bnr", *[f"_bm{n}" for n in BLEU_ORDERS]]
    return _counted(pairs, *texts, names, BLEU_ORDERS, False, overlap.BLEU)


def _total(length: str, n: int) -> Column:
    return F.greatest(F.col(length) - (n - 1), F.lit(0))


def rouge_pairs(
    pairs: DataFrame,
    ids: Sequence[str],
    kinds: Sequence[str] = ROUGE_KINDS,
    stemmed: bool = True,
) -> DataFrame:
    """``ids`` and the F measure of each kind, per pair."""
    return _with_rouge(pairs, kinds, stemmed).select(*ids, *kinds)


def rouge(
    pairs: DataFrame,
    by: Sequence[str],
    kinds: Sequence[str] = ROUGE_KINDS,
    stemmed: bool = True,
) -> DataFrame:
    """Mean F measure per group."""
    scored = _with_rouge(pairs, kinds, stemmed)
    return scored.groupBy(*by).agg(*[F.avg(k).alias(k) for k in kinds])


def _bleu_sums() -> list[Column]:
    return [
        F.sum("_bnp").alias("sys_len"),
        F.sum("_bnr").alias("ref_len"),
        *[F.sum(f"_bm{n}").alias(f"match_{n}") for n in BLEU_ORDERS],
        *[F.sum(_total("_bnp", n)).alias(f"total_{n}") for n in BLEU_ORDERS],
    ]


def bleu_counts(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Corpus sums per group: lengths, clipped matches and totals for n = 1..4."""
    return _with_bleu(pairs).groupBy(*by).agg(*_bleu_sums())


def bleu_score() -> Column:
    """Closed form over the columns of ``bleu_counts``: exponential smoothing, effective order."""
    zero = F.lit(0.0)
    logs, usable = zero, F.lit(0)
    zeros = F.lit(0)
    open_ = F.lit(True)
    for n in BLEU_ORDERS:
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        open_ = open_ & (total > 0)
        missed = open_ & (match == 0)
        zeros = zeros + F.when(missed, 1).otherwise(0)
        safe = F.greatest(total, F.lit(1))
        precision = F.when(missed, 100.0 / (F.pow(F.lit(2.0), zeros) * safe)).otherwise(
            100.0 * F.greatest(match, F.lit(1)) / safe
        )
        logs = logs + F.when(open_, F.ln(precision)).otherwise(zero)
        usable = usable + F.when(open_, 1).otherwise(0)
    sys_len, ref_len = F.col("sys_len"), F.col("ref_len")
    brevity = F.when(sys_len >= ref_len, 1.0).otherwise(
        F.exp(1 - ref_len / F.greatest(sys_len, F.lit(1)))
    )
    any_match = sum((F.col(f"match_{n}") for n in BLEU_ORDERS), F.lit(0)) > 0
    return F.when(any_match, brevity * F.exp(logs / F.greatest(usable, F.lit(1)))).otherwise(zero)


def bleu(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    return bleu_counts(pairs, by).select(*by, bleu_score().alias("bleu4"))


def greedy_match(pred: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best cosine of every row of ``pred`` in ``ref``, and the other way round."""

    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(norm > 0, norm, 1.0)

    cosine = unit(pred) @ unit(ref).T
    return cosine.max(axis=1), cosine.max(axis=0)


def embedding_match(
    vectors: DataFrame, pair: Sequence[str], block: int = 256
) -> DataFrame:
    """``pair, precision, recall, f1`` from token vectors ``pair, side, pos, embedding``.

    ``side`` is ``pred`` or ``ref``. Tokens are packed into blocks by position, and blocks of the
    two sides meet, so neither a task nor a row holds a whole pair, however many tokens it has.
    """
    pair = list(pair)
    blocks = (
        vectors.groupBy(*pair, "side", F.floor(F.col("pos") / F.lit(block)).alias("blk"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "embedding"))).alias("rows"))
        .select(*pair, "side", "blk", F.col("rows.pos").alias("pos"), F.col("rows.embedding").alias("v"))
    )

    # Every block learns how many the other side has, so that block pairs are keys of their own.
    counts = blocks.groupBy(*pair).agg(
        *[
            F.max(F.when(F.col("side") == name, F.col("blk"))).alias(f"{tag}_last")
            for name, tag in (("pred", "p"), ("ref", "r"))
        ]
    )
    spread = blocks.join(counts.where("p_last IS NOT NULL AND r_last IS NOT NULL"), pair)

    def side(name: str, tag: str, other: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_last")))
        return spread.where(F.col("side") == name).select(
            *pair,
            F.col("blk").alias(f"{tag}_blk"),
            every.alias(f"{other}_blk"),
            F.col("pos").alias(f"{tag}_pos"),
            F.col("v").alias(f"{tag}_v"),
        )

    @F.pandas_udf("struct<p: array<double>, r: array<double>>")
    def best(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = [
            greedy_match(np.stack(a).astype("float64"), np.stack(b).astype("float64"))
            for a, b in zip(p, r)
        ]
        return pd.DataFrame({"p": [x for x, _ in rows], "r": [y for _, y in rows]})

    met = side("pred", "p", "r").join(side("ref", "r", "p"), [*pair, "p_blk", "r_blk"]).select(
        *pair, "p_pos", "r_pos", best("p_v", "r_v").alias("b")
    )
    each = F.explode(
        F.concat(
            F.transform(F.arrays_zip("p_pos", F.col("b.p").alias("s")), _sided("pred", "p_pos")),
            F.transform(F.arrays_zip("r_pos", F.col("b.r").alias("s")), _sided("ref", "r_pos")),
        )
    )
    per_token = (
        met.select(*pair, each.alias("t"))
        .groupBy(*pair, F.col("t.side").alias("side"), F.col("t.pos").alias("pos"))
        .agg(F.max("t.score").alias("score"))
    )
    means = per_token.groupBy(*pair).agg(
        F.avg(F.when(F.col("side") == "pred", F.col("score"))).alias("precision"),
        F.avg(F.when(F.col("side") == "ref", F.col("score"))).alias("recall"),
    )
    return means.withColumn("f1", _harmonic(F.col("precision"), F.col("recall")))


def _sided(name: str, pos: str):
    return lambda e: F.struct(
        F.lit(name).alias("side"), e[pos].alias("pos"), e["s"].alias("score")
    )


def _harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r != 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)


def encoder_udf(encode: Callable[[list[str]], list[np.ndarray]]):
    """A UDF of prediction and reference that gives ``precision, recall, f1``."""

    @F.pandas_udf("struct<precision: double, recall: double, f1: double>")
    def match(predictions: pd.Series, references: pd.Series) -> pd.DataFrame:
        out = []
        sides = encode(list(predictions)), encode(list(references))
        for p, r in zip(*sides):
            if len(p) == 0 or len(r) == 0:
                out.append((0.0, 0.0, 0.0))
                continue
            best_p, best_r = greedy_match(np.asarray(p), np.asarray(r))
            a, b = float(best_p.mean()), float(best_r.mean())
            out.append((a, b, 2 * a * b / (a + b) if a + b else 0.0))
        return pd.DataFrame(out, columns=["precision", "recall", "f1"])

    return match


def encoded_match(
    pairs: DataFrame, ids: Sequence[str], encode: Callable[[list[str]], list[np.ndarray]]
) -> DataFrame:
    """``ids, precision, recall, f1`` with a user's encoder: texts to token-vector matrices.

    Vectors are made and matched in the same task; only three numbers per pair leave it.
    """
    matched = encoder_udf(encode)(
        F.coalesce("prediction", F.lit("")), F.coalesce("reference", F.lit(""))
    )
    return pairs.select(*ids, matched.alias("m")).select(*ids, "m.precision", "m.recall", "m.f1")


# Decimals of each reported metric.
DECIMALS = {"rouge1": 4, "rouge2": 4, "rougeL": 4, "bleu4": 2, "bertscore_f1": 4}


def score(
    pairs: DataFrame,
    by: Sequence[str],
    stemmed: bool = True,
    encode: Callable[[list[str]], list[np.ndarray]] | None = None,
    rounded: bool = True,
    kinds: Sequence[str] = ROUGE_KINDS,
) -> DataFrame:
    """All metrics per group, one column each. The embedding metric needs an encoder.

    One pass over the pairs: predictions made upstream in the same plan are made once.
    """
    by = list(by)
    rows = pairs
    extra = []
    if encode is not None:
        matched = encoder_udf(encode)(
            F.coalesce("prediction", F.lit("")), F.coalesce("reference", F.lit(""))
        )
        rows = rows.withColumn("_f1", matched["f1"])
        extra = [F.avg("_f1").alias("bertscore_f1")]
    scored = _with_bleu(_with_rouge(rows, kinds, stemmed))
    sums = scored.groupBy(*by).agg(
        *[F.avg(kind).alias(kind) for kind in kinds], *_bleu_sums(), *extra
    )
    table = sums.withColumn("bleu4", bleu_score())
    metrics = [m for m in DECIMALS if m in table.columns]
    return table.select(
        *by, *[(F.round(m, DECIMALS[m]) if rounded else F.col(m)).alias(m) for m in metrics]
    )


def long_scores(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, metric, value`` from one column per metric."""
    metrics = [c for c in scores.columns if c not in by]
    return scores.unpivot(list(by), metrics, "metric", "value")


def compare_systems(
    scores: DataFrame,
    by: Sequence[str] = ("metric",),
    base: str = "base",
    adapter: str = "adapter",
    lower_is_better: Sequence[str] = (),
) -> DataFrame:
    """``by, base, adapter, delta, winner`` from ``by, system, value``.

    Larger wins, durations included, unless the metric is listed as lower-is-better.
    """
    both = (
        scores.where(F.col("system").isin(base, adapter))
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("system") == base, F.col("value"))).alias("base"),
            F.max(F.when(F.col("system") == adapter, F.col("value"))).alias("adapter"),
        )
        .where(F.col("base").isNotNull() & F.col("adapter").isNotNull())
        .withColumn("delta", F.col("adapter") - F.col("base"))
    )
    gain = F.col("delta")
    if lower_is_better:
        gain = F.when(F.col("metric").isin(*lower_is_better), -gain).otherwise(gain)
    winner = F.when(gain > 0, adapter).when(gain < 0, base).otherwise("tie")
    return both.withColumn("winner", winner)
