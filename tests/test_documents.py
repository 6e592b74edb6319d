import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from digestry.functions import prompts
from digestry.operators import chunks, rank, summarize
from digestry.plans import evaluate
from digestry.session import shared_dir


def dense_ranks(lines):
    """Every sentence pair, written out."""
    docs = [line.split() for line in lines]
    n = len(docs)
    weight = np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            a, b = Counter(docs[i]), Counter(docs[j])
            shared = sum(a[w] * b[w] for w in a)
            if shared:
                norm = math.log(len(docs[i])) + math.log(len(docs[j]))
                weight[i, j] = shared if math.isclose(norm, 0, abs_tol=1e-12) else shared / norm
    weight /= weight.sum(axis=1, keepdims=True) + rank.ROW_GUARD
    matrix = (1 - rank.DAMPING) / n + rank.DAMPING * weight.T
    vector = np.full(n, 1 / n)
    while True:
        following = (1 - rank.DAMPING) / n * np.ones(n) + rank.DAMPING * weight.T @ vector
        change = np.linalg.norm(following - vector)
        vector = following
        if change <= rank.STOP:
            assert matrix.shape == (n, n)
            return vector


def random_lines(seed, n):
    rng = random.Random(seed)
    return [" ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(rng.choice([0, 1, 1, 3, 8, 15]))) for _ in range(n)]


SPECIAL = [["only one"], ["same words here"] * 4, ["a b", "c d", "e f"], ["a", "a", "b"], ["", ""], ["", "a b"]]


def test_ranks_equal_dense_walk(monkeypatch):
    for lines in SPECIAL + [random_lines(s, 5 + 7 * s) for s in range(8)]:
        np.testing.assert_allclose(rank.rank_lines(lines), dense_ranks(lines), rtol=1e-9)
    monkeypatch.setattr(rank, "EXPANDED_ENTRIES", 50)  # several blocks, rebuilt in every round
    lines = random_lines(99, 60)
    np.testing.assert_allclose(rank.rank_lines(lines), dense_ranks(lines), rtol=1e-9)
    assert len(rank.rank_lines([])) == 0


def test_ranks_by_rounds_equal_ranks_in_rows(spark):
    texts = [". ".join(x or "1" for x in random_lines(s, 6 + 3 * s)) + "." for s in range(5)] + ["One here.", "Same. Same. Same."]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, document string")
    in_rows = {r["row_id"]: r for r in rank.textrank(df, "row_id").collect()}
    by_rounds = {r["row_id"]: r for r in rank.textrank(df, "row_id", row_sentences=4).collect()}
    assert set(in_rows) == set(by_rounds) == set(range(7))
    for i, row in in_rows.items():
        assert [e["pos"] for e in row["extract"]] == [e["pos"] for e in by_rounds[i]["extract"]]
        np.testing.assert_allclose(
            [e["rank"] for e in row["extract"]], [e["rank"] for e in by_rounds[i]["extract"]], rtol=1e-9
        )
    tied = in_rows[6]["extract"]
    assert [e["pos"] for e in tied] == [0, 1, 2] and in_rows[5]["extracted"] == "One here."
    two = rank.textrank(df.where("row_id = 6"), "row_id", k=F.lit(2)).first()["extract"]
    assert [e["pos"] for e in two] == [0, 1]


def degrees_of(frame):
    return sorted((r["row_id"], r["i"], round(r["value"], 9)) for r in frame.collect())


def test_edge_weights_travel_only_for_shared_keys(spark):
    texts = [". ".join(x or "1" for x in random_lines(s, 9)) + "." for s in range(8)] + ["One.", "1. 2.", " "]
    df = rank.with_sentences(spark.createDataFrame(list(enumerate(texts)), "row_id int, document string"))
    frame = rank.sentence_degrees(df, "row_id")
    got = degrees_of(frame)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert got == degrees_of(rank.graph_step(rank.word_incidence(df, "row_id"), "row_id"))
    assert {r[0] for r in got} == set(range(9))


def test_edge_weights_of_rows_with_one_key_are_one_documents(spark):
    rows = [(1, "a b. c a."), (1, "a b. d."), (1, "a. b c d. a a."), (2, "a b."), (None, "a b."), (None, "b.")]
    df = rank.with_sentences(spark.createDataFrame(rows, "row_id int, document string"))
    got = degrees_of(rank.sentence_degrees(df, "row_id"))
    assert got == degrees_of(rank.graph_step(rank.word_incidence(df, "row_id"), "row_id"))
    assert [r[:2] for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0)]
    ids = spark.createDataFrame([(1,), (1,), (2,), (2,), (None,), (3,)], "row_id int")
    assert degrees_of(rank.sentence_degrees(df, "row_id", ids)) == got


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcxyz", min_size=1, max_size=9), max_size=40), st.integers(3, 30), st.data())
def test_word_chunks_cover_the_text(tokens, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    value = " ".join(tokens)
    cut = chunks.cut_at_spaces(value, size, overlap)
    assert all(0 < len(c) <= size for c in cut)
    if len(value) <= size:
        assert cut == ([value] if value else [])
    letters = Counter(value.replace(" ", ""))
    covered = Counter("".join(cut).replace(" ", ""))
    assert all(covered[c] >= n for c, n in letters.items())
    if overlap <= 1 and all(len(t) <= size for t in tokens):
        assert " ".join(cut).split() == tokens


def test_word_chunk_edges():
    assert chunks.cut_at_spaces("aaaa bbbb cccc", 9, 0) == ["aaaa bbbb", "cccc"]
    assert chunks.cut_at_spaces("aaaa bbbb cccc", 9, 3) == ["aaaa bbbb", "bb cccc"]
    assert chunks.cut_at_spaces("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert chunks.cut_at_spaces("   ", 4, 1) == []
    with pytest.raises(ValueError):
        chunks.cut_at_spaces("abc", 4, 4)


def test_strided_chunks_and_windows(spark):
    df = spark.createDataFrame([(0, "abcdefghij"), (1, "abc"), (2, ""), (3, "abcd")], "i int, d string")
    cut = df.select("i", chunks.strided_chunks(F.col("d"), F.lit(4), F.lit(1)).alias("c")).orderBy("i")
    assert [r["c"] for r in cut.collect()] == [["abcd", "defg", "ghij"], ["abc"], [], ["abcd"]]
    toks = df.select(chunks.token_windows(F.lit("a b c d e"), 3, 1).alias("c")).first()["c"]
    assert toks == ["a b c", "c d e", "e"]
    assert df.where("i = 2").select(chunks.token_windows(F.col("d"), 3, 1)).first()[0] == []
    with pytest.raises(ValueError):
        chunks.with_chunks(df.withColumnRenamed("d", "document"), 4, 4)
    flags = chunks.explode_chunks(df.select("i", F.split("d", "").alias("chunks")), ["i"]).where("i = 1")
    assert [r["is_last"] for r in flags.orderBy("pos").collect()] == [False, False, True]


def lead_words(value, n):
    return value.split()[:n]


def brute_fold(parts, n, least, most):
    if not parts:
        return ""
    held = " ".join(lead_words(parts[0], min(n, most)))
    for i, part in enumerate(parts[1:], 1):
        count = min(max(n, least if i == len(parts) - 1 else 0), most)
        held = " ".join(lead_words(held, count // 2) + lead_words(part, count - count // 2))
    return held


def brute_tree(parts, n, least, most):
    if not parts:
        return ""
    level = [" ".join(lead_words(p, min(n, most))) for p in parts]
    while len(level) > 1:
        count = min(max(n, least if len(level) <= 2 else 0), most)
        joined = ["\n\n".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        level = [" ".join(lead_words(j, count)) for j in joined]
    return level[0]


def test_fold_and_tree(spark):
    rng = random.Random(3)
    parts = [[" ".join(f"{d}.{c}.{w}" for w in range(rng.randint(1, 9))) for c in range(n)] for d, n in enumerate([0, 1, 2, 3, 4, 5, 8, 13])]
    df = spark.createDataFrame([(10 * i, p) for i, p in enumerate(parts)], "row_id int, chunks array<string>")
    for n, least, most in ((4, 6, 20), (6, 2, 5)):
        got = df.select(
            "row_id",
            summarize.refine(F.col("chunks"), summarize.lead(n), least, most).alias("fold"),
            summarize.merge_tree(F.col("chunks"), summarize.lead(n), least, most).alias("tree"),
        ).orderBy("row_id").collect()
        assert [r["fold"] for r in got] == [brute_fold(p, n, least, most) for p in parts]
        assert [r["tree"] for r in got] == [brute_tree(p, n, least, most) for p in parts]
    rows = chunks.explode_chunks(df, ["row_id"])
    by_rounds = summarize.merge_by_rounds(rows, "row_id", summarize.lead(4), 6, 20).collect()
    assert {r["row_id"]: r["summary"] for r in by_rounds} == {
        10 * i: brute_tree(p, 4, 6, 20) for i, p in enumerate(parts) if p
    }


def echo(prompt_texts, least, most):
    """A stand-in model that shows what it was asked."""
    return [f"<{least}:{most}:{len(p)}:{p[-40:-18]}>" for p in prompt_texts]


def brute_model(parts, strategy, least, most):
    one = lambda p, low: echo([p], low, most)[0]
    held = [one(prompts.SUMMARIZE.text(p), 0) for p in parts]
    if strategy == "map-refine":
        state = held[0]
        for i, part in enumerate(parts[1:], 1):
            state = one(prompts.REFINE.text(state, part), least if i == len(parts) - 1 else 0)
        return state
    while len(held) > 1:
        low = least if len(held) <= 2 else 0
        held = [one(prompts.MERGE.text("\n\n".join(held[i : i + 2])), low) for i in range(0, len(held), 2)]
    return held[0]


def test_python_model_strategies(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(n)) for n in (3, 40, 75, 160, 333)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id int, document string")
    options = dict(context=60, max_sequence=1024, max_summary=20)
    staged = summarize.stage(df, "row_id", **options).cache()
    size = 60 - len(prompts.SUMMARIZE.text("").split()) - 20
    parts = {r["row_id"]: r["chunks"] for r in staged.collect()}
    for strategy in ("map-refine", "hierarchical"):
        got = summarize.summarize_batches(staged, "row_id", echo, strategy, 60, 5, 20)
        for r in got.collect():
            value = texts[r["row_id"]]
            if not value:
                assert r["summary"] == ""
            elif len(value.split()) <= size:
                assert r["summary"] == echo([prompts.SUMMARIZE.text(value)], 5, 20)[0]
            else:
                assert r["summary"] == brute_model(parts[r["row_id"]], strategy, 5, 20)
    extracts = {r["row_id"]: (r["extracted"], r["extract_chunks"]) for r in staged.collect()}
    got = summarize.summarize_batches(staged, "row_id", echo, "extract-abstract", 60, 5, 20)
    for r in got.where("row_id < 5").collect():
        value, (extracted, cut) = texts[r["row_id"]], extracts[r["row_id"]]
        source = value if len(value.split()) <= size else extracted
        if len(source.split()) <= size:
            assert r["summary"] == echo([prompts.SUMMARIZE.text(source)], 5, 20)[0]
        else:
            assert r["summary"] == brute_model(cut, "map-refine", 5, 20)


def test_short_documents_hide_the_strategy(spark):
    df = spark.createDataFrame([(0, "a few words"), (1, " ".join(["long"] * 300)), (2, "")], "row_id int, document string")
    rows = summarize.summarize(df, "row_id", summarize.lead(3), context=120, min_summary=4, max_summary=20)
    by = {(r["row_id"], r["strategy"]): r for r in rows.collect()}
    assert len(by) == 9
    assert {by[0, s]["route"] for s in summarize.STRATEGIES} == {"direct"}
    assert {by[0, s]["summary"] for s in summarize.STRATEGIES} == {"a few words"}
    assert [by[1, s]["route"] for s in summarize.STRATEGIES] == list(summarize.STRATEGIES)
    assert by[2, "hierarchical"]["summary"] == ""
    with pytest.raises(ValueError):
        summarize.stage(df, "row_id", ("other",))
    with pytest.raises(ValueError):
        summarize.stage(df, "row_id", context=10, max_summary=20)


def test_generation_record_and_pairs(spark):
    df = spark.createDataFrame([(0, "one two three four")], "row_id int, document string")
    rows = summarize.summarize(df, "row_id", summarize.lead(2), min_summary=0)
    record = summarize.generation_record(rows, "m", None).first()
    assert record["metadata"].asDict() == {
        "strategy": "map-refine", "model": "m", "adapter": None, "tokens_in": 4, "tokens_out": 2,
    }
    named = rows.withColumnRenamed("summary", "prediction")
    pairs = [r["pair"] for r in evaluate.strategy_pairs(named).collect()]
    assert pairs == [
        "map-refine vs hierarchical", "map-refine vs extract-abstract", "hierarchical vs extract-abstract",
    ]


def test_every_chunk_changes_the_spaced_summary(spark):
    parts = [" ".join(f"c{i}w{j}" for j in range(60)) for i in range(8)]
    variants = [parts, *[[*parts[:i], "junk " * 60, *parts[i + 1 :]] for i in range(8)]]
    df = spark.createDataFrame([(v,) for v in variants], "chunks array<string>")
    for combine in (summarize.refine, summarize.merge_tree):
        out = df.select(combine(F.col("chunks"), summarize.spaced(30), 14, 48).alias("s")).collect()
        whole, *changed = [r["s"] for r in out]
        assert all("junk" in s and s != whole for s in changed)


def test_rounds_remove_their_predecessors(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    held = lambda: {p for p in folder.glob("table-*") if any(p.glob("*.parquet"))}
    before = held()
    chunks_ = spark.range(32).selectExpr(
        "1 AS id", "id AS pos", "32L AS parts", "concat('c', id, ' x y') AS chunk"
    )
    merged = summarize.merge_by_rounds(chunks_, "id", summarize.spaced(30), 14, 48).collect()
    assert len(merged) == 1 and len(held() - before) == 1


def under_way(sizes, kind):
    for i, n in enumerate(sizes):
        yield pa.scalar(i), kind([f"d{i}p{j}" for j in range(n)], 5, 20)


@pytest.mark.parametrize("strategy", ["map-refine", "hierarchical"])
def test_lists_of_prompts_stay_full(strategy):
    rng = random.Random(4)
    sizes = [rng.choice([1, 2, 3, 5]) for _ in range(300)] + [120, 90] + [2, 0, 4] * 40
    kind = summarize._fold_steps if strategy == "map-refine" else summarize._tree_steps
    ended, early, asked = [], [], 0

    def rows():
        yield from under_way(sizes, kind)
        ended.append(True)

    def model(prompts, least, most):
        nonlocal asked
        asked += len(prompts)
        assert len(prompts) <= live
        if not ended:
            early.append(len(prompts))
        return echo(prompts, least, most)

    live = 16
    got = {k.as_py(): v for k, v in summarize._refilled(rows(), model, live)}
    assert sorted(got) == list(range(len(sizes)))
    for i, n in enumerate(sizes):
        assert got[i] == (brute_model([f"d{i}p{j}" for j in range(n)], strategy, 5, 20) if n else "")
    # Every list is full until the rows run out; then the longest documents end step by step.
    assert set(early) == {live} and sum(early) >= asked // 2
    alone = {k.as_py(): v for k, v in summarize._refilled(under_way(sizes, kind), echo, 1)}
    assert alone == got


def test_a_model_must_answer_every_prompt():
    with pytest.raises(ValueError, match="2 prompts got 1 answers"):
        list(summarize._refilled(under_way([1, 1], summarize._fold_steps), lambda p, a, b: ["x"], 2))
    with pytest.raises(ValueError):
        list(summarize._refilled(under_way([1], summarize._fold_steps), echo, 0))
    assert list(summarize._refilled(iter(()), echo, 4)) == []
