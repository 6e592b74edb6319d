import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from digestry.functions import overlap, text
from digestry.functions.stem import stem, stem_line
from digestry.operators import scores
from tests.test_text import brute_13a

CASES = [
    ("the cat sat on the mat", "the cat sat on the mat"),
    ("abc def", "ghi jkl"),
    ("", ""),
    ("", "something here"),
    ("word", "word"),
    ("the the the the cat cat cat", "the the cat cat cat cat the"),
    ("Running QUICKLY, he ran!", "he runs quick"),
    ("costs 1,000.5 dollars", "costs 1,000.5 or 3-4 dollars"),
    ("el niño comió", "el nino comió"),
    ("a b a b a b", "b a b a"),
]


def rouge_words(value, stemmed):
    import re

    found = re.findall(r"[a-z0-9]+", value.lower())
    return [stem(w) if stemmed and len(w) > 3 else w for w in found]


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def f_value(match, a, b):
    p, r = match / max(a, 1), match / max(b, 1)
    return 2 * p * r / (p + r) if p + r else 0.0


def brute_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def brute_rouge(p, r, stemmed):
    p, r = rouge_words(p, stemmed), rouge_words(r, stemmed)
    out = []
    for n in (1, 2):
        match = sum((grams(p, n) & grams(r, n)).values())
        out.append(f_value(match, max(len(p) - n + 1, 0), max(len(r) - n + 1, 0)))
    return [*out, f_value(brute_lcs(p, r), len(p), len(r))]


def brute_bleu(pairs):
    match, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for prediction, reference in pairs:
        p, r = brute_13a(prediction), brute_13a(reference)
        sys_len, ref_len = sys_len + len(p), ref_len + len(r)
        for n in range(4):
            match[n] += sum((grams(p, n + 1) & grams(r, n + 1)).values())
            total[n] += max(len(p) - n, 0)
    if not any(match):
        return 0.0
    logs, zeros = [], 0
    for m, t in zip(match, total):
        if t == 0:
            break
        if m == 0:
            zeros += 1
        logs.append(math.log(100 * m / t if m else 100 / (2**zeros * t)))
    brevity = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return brevity * math.exp(sum(logs) / len(logs))


def frame(spark, cases):
    rows = [(i, p, r) for i, (p, r) in enumerate(cases)]
    return spark.createDataFrame(rows, "id int, prediction string, reference string")


@pytest.mark.parametrize("stemmed", [True, False])
def test_rouge_per_pair(spark, stemmed):
    got = scores.rouge_pairs(frame(spark, CASES), ["id"], stemmed=stemmed).orderBy("id").collect()
    for row, (p, r) in zip(got, CASES):
        np.testing.assert_allclose([row["rouge1"], row["rouge2"], row["rougeL"]], brute_rouge(p, r, stemmed))
    swapped = scores.rouge_pairs(frame(spark, [(r, p) for p, r in CASES]), ["id"], stemmed=stemmed)
    for a, b in zip(got, swapped.orderBy("id").collect()):
        np.testing.assert_allclose(a[1:], b[1:])


def test_bleu_per_corpus(spark):
    single = scores.bleu(frame(spark, CASES), ["id"]).orderBy("id").collect()
    for row, case in zip(single, CASES):
        assert row["bleu4"] == pytest.approx(brute_bleu([case]))
    whole = scores.bleu(frame(spark, CASES).withColumn("g", F.lit(1)), ["g"]).first()
    assert whole["bleu4"] == pytest.approx(brute_bleu(CASES))


def test_overlap_of_multisets(spark):
    rng = random.Random(0)
    cases = [([], []), (["a"], []), (["a"] * 50, ["a"] * 37 + ["b"])]
    for _ in range(60):
        alphabet = "abcdefgh"[: rng.randint(1, 8)]
        cases.append(
            tuple([rng.choice(alphabet) for _ in range(rng.randint(0, 40))] for _ in range(2))
        )
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    lines = [F.array_join(c, " ") for c in ("a", "b")]
    got = df.select("i", scores.clipped_overlap(*lines, (1, 2)).alias("m")).orderBy("i").collect()

    def brute(a, b, n):
        grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b)]
        return sum((grams[0] & grams[1]).values())

    assert [r["m"] for r in got] == [[brute(a, b, n) for n in (1, 2)] for a, b in cases]


def test_overlap_of_one_repeated_token_is_quick():
    start = time.perf_counter()
    assert scores.shared_counts(["a"] * 20_000, ["a"] * 20_000, (1, 2, 3, 4)) == [
        20_000, 19_999, 19_998, 19_997,
    ]
    assert time.perf_counter() - start < 1


words = st.lists(st.sampled_from("abcd"), max_size=30)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs(a, b):
    assert scores.lcs_length(a, b) == brute_lcs(a, b) == scores.lcs_length(b, a)


def test_score_matches_parts_and_rounds(spark):
    rows = frame(spark, CASES).withColumn("g", F.col("id") % 2)
    table = {r["g"]: r for r in scores.score(rows, ["g"], rounded=False).collect()}
    for g in (0, 1):
        mine = [c for i, c in enumerate(CASES) if i % 2 == g]
        means = np.mean([brute_rouge(p, r, True) for p, r in mine], axis=0)
        row = table[g]
        np.testing.assert_allclose([row["rouge1"], row["rouge2"], row["rougeL"]], means)
        assert row["bleu4"] == pytest.approx(brute_bleu(mine))
    short = scores.score(rows, ["g"]).where("g = 0").first()
    assert short["rouge1"] == round(table[0]["rouge1"], 4)
    assert short["bleu4"] == round(table[0]["bleu4"], 2)


def embed(texts):
    """Letter-count vectors per word: any deterministic encoder will do."""
    out = []
    for value in texts:
        rows = [[w.count(c) + 0.1 for c in "abcdefgh"] for w in value.split()]
        out.append(np.array(rows) if rows else np.zeros((0, 8)))
    return out


def brute_match(p, r):
    if len(p) == 0 or len(r) == 0:
        return 0.0, 0.0, 0.0
    cosine = (p / np.linalg.norm(p, axis=1, keepdims=True)) @ (r / np.linalg.norm(r, axis=1, keepdims=True)).T
    a, b = cosine.max(axis=1).mean(), cosine.max(axis=0).mean()
    return a, b, 2 * a * b / (a + b)


def test_embedding_match_by_blocks_and_by_encoder(spark):
    cases = [("abc bad face hag deaf", "cab bed ab"), ("a b", "a b"), ("", "a b")]
    expected = [brute_match(*(embed([v])[0] for v in case)) for case in cases]
    by_encoder = scores.encoded_match(frame(spark, cases), ["id"], embed).orderBy("id").collect()
    for row, want in zip(by_encoder, expected):
        np.testing.assert_allclose(row[1:], want)
    vectors = [
        (i, side, pos, [float(x) for x in v])
        for i, case in enumerate(cases)
        for side, value in zip(("pred", "ref"), case)
        for pos, v in enumerate(embed([value])[0])
    ]
    df = spark.createDataFrame(vectors, "id int, side string, pos int, embedding array<float>")
    for block in (2, 256):
        got = scores.embedding_match(df, ["id"], block).orderBy("id").collect()
        assert [r["id"] for r in got] == [0, 1]  # a pair without vectors on one side has no match
        for row, want in zip(got, expected):
            np.testing.assert_allclose(row[1:], want, rtol=1e-6)
    scored = scores.score(frame(spark, cases[:2]).withColumn("g", F.lit(1)), ["g"], encode=embed).first()
    assert scored["bertscore_f1"] == pytest.approx(np.mean([e[2] for e in expected[:2]]), abs=1e-4)


def test_published_comparison(spark):
    # Published scores of two systems and their differences.
    base = {"rouge1": 0.3079, "rouge2": 0.1256, "rougeL": 0.2057, "bleu4": 5.38, "bertscore_f1": 0.8819}
    adapter = {"rouge1": 0.3597, "rouge2": 0.1479, "rougeL": 0.2526, "bleu4": 9.42, "bertscore_f1": 0.8872}
    delta = {"rouge1": 0.0518, "rouge2": 0.0223, "rougeL": 0.0469, "bleu4": 4.04, "bertscore_f1": 0.0053}
    rows = [("base", m, v) for m, v in base.items()] + [("adapter", m, v) for m, v in adapter.items()]
    rows += [("base", "duration_sec", 5.0), ("adapter", "duration_sec", 9.0), ("base", "x", 1.0), ("adapter", "x", 1.0)]
    df = spark.createDataFrame(rows, "system string, metric string, value double")
    got = {r["metric"]: r for r in scores.compare_systems(df).collect()}
    for metric, want in delta.items():
        assert got[metric]["delta"] == pytest.approx(want)
        assert got[metric]["winner"] == "adapter"
    assert got["duration_sec"]["winner"] == "adapter" and got["x"]["winner"] == "tie"
    kinder = scores.compare_systems(df, lower_is_better=["duration_sec"])
    assert kinder.where("metric = 'duration_sec'").first()["winner"] == "base"


ODD = [
    "", " ", "a", "The cat. The cat, sat-on 3-4 1.5 ,,.. end.", "x&amp;y &quot;q&quot; <skipped> co-\nop a\nb\tc d",
    "..,, 1,2 .5 5. -- 7-- (a) a\x1cb\x85c　d e", "İstanbul K ﬁ the the the cats running", "&am<skipped>p; - \n -\n",
]


@pytest.mark.parametrize("block", [1, 4 << 20])
def test_overlaps_equal_plain_counts(spark, monkeypatch, block):
    monkeypatch.setattr(overlap, "BLOCK_BYTES", block)
    couples = [(a, b) for a in ODD for b in ODD] + [("a b c " * 50, "c a b a b " * 30), ("tired, tires.", "tire tiring")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(couples)], "i int, p string, r string").coalesce(1)
    ways = {
        "rouge": (overlap.ROUGE, F.lower, lambda c: F.array_join(text.rouge_tokens(F.col(c)), " ")),
        "stemmed": (overlap.STEMMED, F.lower, lambda c: stem_line(F.array_join(text.rouge_tokens(F.col(c)), " "))),
        "bleu": (overlap.BLEU, F.col, lambda c: F.array_join(text.bleu_tokens(F.col(c)), " ")),
    }
    for cut, given, plain in ways.values():
        rows = df.select(*[f(c).alias(f"{n}{c}") for c in "pr" for n, f in (("g", given), ("t", plain))]).toArrow()
        left, right = (rows[c].combine_chunks() for c in ("gp", "gr"))
        got = overlap.overlaps(left, right, (1, 2, 3, 4), True, cut).to_pylist()
        for a, b, found in zip(rows["tp"].to_pylist(), rows["tr"].to_pylist(), got):
            a, b = a.split(), b.split()
            assert found == [
                len(a), len(b), *scores.shared_counts(a, b, (1, 2, 3, 4)), scores.lcs_length(a, b)
            ]
