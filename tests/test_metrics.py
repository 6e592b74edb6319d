"""User metrics as partial aggregates; the built-in scores written as such give the same values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.operators import metrics, scores

ROWS = [
    ("a", "the cat sat on the mat today", "the cat lay on the mat all day"),
    ("a", "one two three four five", "one two three four six"),
    ("a", "", "nothing here"),
    ("b", "x y z", "x y z"),
    ("b", None, "lost"),
    (None, "alone it stands here now", "alone it stands there now"),
] * 40


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(ROWS, "g string, prediction string, reference string").repartition(7)


def grams(tokens, n):
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def add_bleu(state, predictions, references):
    state = list(state)
    for p, r in zip(predictions, references):
        p, r = p.split(), r.split()
        state[0] += len(p)
        state[1] += len(r)
        for n, shared in enumerate(scores.shared_counts(p, r, (1, 2, 3, 4)), 1):
            state[1 + n] += shared
            state[5 + n] += len(grams(p, n))
    return state


def finish_bleu(state):
    sys_len, ref_len, matches, totals = state[0], state[1], state[2:6], state[6:10]
    if not any(matches):
        return 0.0
    logs, used, halving = 0.0, 0, 1.0
    for match, total in zip(matches, totals):
        if not total:
            break
        if match:
            logs += math.log(100 * match / total)
        else:
            halving *= 2
            logs += math.log(100 / (halving * total))
        used += 1
    brevity = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return brevity * math.exp(logs / used)


BLEU = metrics.PairMetric(
    "bleu4", lambda: [0] * 10, add_bleu, lambda a, b: [x + y for x, y in zip(a, b)], finish_bleu
)


def unigram_f(prediction, reference):
    p, r = (re.findall(r"[a-z0-9]+", s.lower()) for s in (prediction, reference))
    (match,) = scores.shared_counts(p, r, (1,))
    return 2 * match / (len(p) + len(r)) if match else 0.0


def values(frame, by=("g",)):
    return {(*(r[c] for c in by), r["metric"]): r["value"] for r in frame.collect()}


def test_built_in_scores_as_user_metrics(pairs):
    tokens = [F.array_join(text.bleu_tokens(F.coalesce(c, F.lit(""))), " ").alias(c) for c in ("prediction", "reference")]
    got = values(metrics.pair_metrics(pairs.select("g", *tokens), ["g"], [BLEU]))
    filled = pairs.fillna("", ["prediction"])
    for row in scores.bleu(filled, ["g"]).collect():
        assert got[row["g"], "bleu4"] == pytest.approx(row["bleu4"])
    got = values(metrics.pair_metrics(pairs, ["g"], [metrics.mean_of("rouge1", unigram_f)]))
    for row in scores.rouge(filled, ["g"], ("rouge1",), stemmed=False).collect():
        assert got[row["g"], "rouge1"] == pytest.approx(row["rouge1"])
    assert len(got) == 3


def test_states_meet_in_any_number_of_tasks(spark, pairs, monkeypatch):
    longest = metrics.PairMetric("longest", lambda: "", lambda s, p, r: max([s, *p]), max, len)
    ratio = metrics.ratio_of("ratio", lambda p, r: (len(p), 0))
    expected = values(metrics.pair_metrics(pairs.coalesce(1), ["g"], [longest, ratio]))
    assert expected["b", "ratio"] is None and expected["b", "longest"] == 5
    assert values(metrics.pair_metrics(pairs.repartition(23), ["g"], [longest, ratio])) == expected
    monkeypatch.setattr(metrics, "MEETINGS", 2)
    assert values(metrics.pair_metrics(pairs.repartition(9), ["g"], [longest, ratio])) == expected
    whole = metrics.pair_metrics(pairs, [], [longest]).collect()
    assert [(r["metric"], r["value"]) for r in whole] == [("longest", len("x y z"))]
    assert metrics.pair_metrics(pairs.where("false"), ["g"], [longest]).collect() == []


def test_many_groups_are_handed_on_early(spark):
    rows = spark.range(3 * metrics.GROUPS_HELD, numPartitions=1).select(
        (F.col("id") % (metrics.GROUPS_HELD + 700)).alias("g"),
        F.lit("a b").alias("prediction"), F.lit("a").alias("reference"),
    )
    found = metrics.pair_metrics(rows, ["g"], [metrics.ratio_of("n", lambda p, r: (1, 0.5))])
    assert found.agg(F.count("*"), F.min("value"), F.max("value")).first() == (
        metrics.GROUPS_HELD + 700, 2.0, 2.0,
    )


def test_no_text_is_shuffled(pairs):
    found = metrics.pair_metrics(pairs, ["g"], [BLEU])
    plan = found._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 2 and plan.count("MapInArrow") == 1
    below = plan.split("MapInArrow")[1]
    assert "Exchange hashpartitioning" not in below
