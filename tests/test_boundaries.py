"""Learned abbreviations, sentences inside paragraphs, and the figures of timed runs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from digestry.functions import tokens
from digestry.operators import boundaries, scores, summarize
from digestry.plans import evaluate
from digestry.session import work_path


@pytest.fixture(scope="module")
def talk(spark):
    """Prose in which "approx." and "e.g." stand inside sentences and other words end them."""
    rng = random.Random(2)
    words = ["river", "stone", "walks", "green", "house", "under", "Dr", "cat"]
    texts = []
    for _ in range(200):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            line = []
            for _ in range(rng.randrange(1, 4)):
                some = [rng.choice(words) for _ in range(rng.randrange(2, 7))]
                if rng.random() < 0.4:
                    some.insert(1, rng.choice(["approx. 7", "e.g. the"]))
                line.append(" ".join(some).capitalize() + rng.choice(".!?."))
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    return texts + [None, "", "  ", ". . .", "# Heading\n- item one\n- item two. Done"]


def test_word_types_match_a_plain_count(spark, talk):
    types = boundaries.word_types(spark.createDataFrame([(t,) for t in talk], "document string"))
    expected = {}
    for value in talk:
        listed = (value or "").split()
        for at, token in enumerate(listed):
            word = token[:-1] if token.endswith(".") else token
            if word and word[-1].isalpha() and all(c.isalpha() or c == "." for c in word):
                row = expected.setdefault(word.lower(), [0, 0, 0])
                following = listed[at + 1] if at + 1 < len(listed) else ""
                row[0 if token.endswith(".") else 1] += 1
                lower = following[:1].islower() or following[:1].isdigit()
                row[2] += token.endswith(".") and lower
    got = {r["word"]: [r["n_period"], r["n_plain"], r["n_lower"]] for r in types.collect()}
    assert got == expected
    scored = {r["word"]: r["score"] for r in boundaries.abbreviation_scores(types).collect()}
    total, plain = (sum(v[i] for v in expected.values()) for i in (0, 1))
    usual = (total + 1) / (total + plain + 2)
    assert set(scored) == {w for w, v in expected.items() if v[0]}
    for word, (n, m, low) in expected.items():
        if n:
            ratio = n * math.log(0.99 / usual) + m * math.log(0.01 / (1 - usual))
            assert scored[word] == pytest.approx(2 * ratio * low / n / len(word))
    known = boundaries.abbreviations(boundaries.abbreviation_scores(types))
    assert set(known) == {"approx", "e.g"}
    assert boundaries.abbreviations(boundaries.abbreviation_scores(types), most=1) == known[:1]


def split(spark, values, known):
    rows = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    got = rows.select("id", boundaries.sentences(F.col("t"), known).alias("s")).orderBy("id").collect()
    return [r["s"] or [] for r in got]


def test_sentences_stay_in_their_paragraphs(spark, talk):
    known = ["approx", "e.g"]
    values = [
        "It holds approx. 7 cups, e.g. the blue one. Then it ends! Yes?",
        "Approx. Seven is a new one. e.g. This too.",
        "# Heading\n- item one\n- item two. Done",
        "a stop. small letters go on? no. 9 lives",
        None, "", " \n ", "no mark",
    ]
    assert split(spark, values, known) == [
        ["It holds approx. 7 cups, e.g. the blue one.", "Then it ends!", "Yes?"],
        ["Approx.", "Seven is a new one.", "e.g.", "This too."],
        ["# Heading", "- item one", "- item two.", "Done"],
        ["a stop.", "small letters go on?", "no.", "9 lives"],
        [], [], [], ["no mark"],
    ]
    for value, listed in zip(talk, split(spark, talk, known)):
        assert " ".join(listed).split() == (value or "").split()
    assert split(spark, values[:1], [])[0][0] == "It holds approx."


def test_timed_runs_observe_what_they_write(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20 + 60 * i)), "w0 w1") for i in range(4)]
    pairs = spark.createDataFrame(rows, "row_id long, document string, summary string")
    systems = {"base": summarize.gathered(3), "adapter": summarize.gathered(9)}
    out = work_path(spark, "timed")
    options = dict(context=120, max_summary=20, min_summary=4, boundary="none")
    found = evaluate.timed_predictions(pairs, systems, out, tokenizer=tokens.CLEAN_WORDS, **options)
    table = {(r["strategy"], r["system"], r["metric"]): r["value"] for r in found.collect()}
    written = spark.read.parquet(out).toPandas()
    assert len(written) == len(rows) * len(systems) * len(summarize.STRATEGIES)
    for (strategy, system), group in written.groupby(["strategy", "system"]):
        assert table[strategy, system, "n_rows"] == len(group) == len(rows)
        assert table[strategy, system, "tokens_in"] == sum(len(d.split()) for _, d, _ in rows)
        assert table[strategy, system, "tokens_out"] == group["prediction"].str.split().str.len().sum()
        assert table[strategy, system, "duration_sec"] > 0
    compared = scores.compare_systems(found, ["strategy", "metric"], lower_is_better=("duration_sec",))
    for r in compared.where("metric = 'duration_sec'").collect():
        assert r["winner"] == ("adapter" if r["delta"] < 0 else "base" if r["delta"] > 0 else "tie")
