"""Subword tokens, chunks along separators, buffers, stored counts, the digest index and summaries of
many chunks, against plain Python."""

import random
import re
from pathlib import Path

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from digestry.catalog import QUERIES
from digestry.catalog.documents import CONTEXT, MAX_SUMMARY
from digestry.catalog.feeds import BUFFER, SEED, written_shards
from digestry.catalog.subwords import MAX_LENGTH, STRIDE_BACK, VOCABULARY, WINDOW
from digestry.catalog.views import pairs, prediction_rows
from digestry.functions import subwords
from digestry.functions.prompts import SUMMARIZE
from digestry.functions.subwords import Measured, SubwordTokenizer
from digestry.operators import chunks, dedup, order, summarize
from digestry.plans import evaluate, feed
from digestry.session import work_path

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


# ---- subword tokens ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def ends_of(library, value):
    return [e for _, e in library.encode(value, add_special_tokens=False).offsets]


def test_subword_queries_match_the_library(spark, library):
    rows = {r["row_id"]: r for r in pairs(spark, SF).collect()}
    prompt = len(ends_of(library, SUMMARIZE.text("")))
    cut_some = 0
    for r in QUERIES["truncate_subword"](spark, SF).collect():
        row = rows[r["row_id"]]
        ends, n = ends_of(library, row["document"]), len(ends_of(library, row["summary"]))
        budget = MAX_LENGTH - prompt - 2 - n
        over = 0 < budget < len(ends)
        cut_some += over
        assert (r["document_tokens"], r["summary_tokens"]) == (len(ends), n)
        assert r["document"] == (row["document"][: ends[budget - 1]] if over else row["document"])
    assert 0 < cut_some < len(rows)
    fits = QUERIES["fits_subword"](spark, SF).collect()
    assert len(fits) == len(rows) and len({r["fits"] for r in fits}) == 2
    for r in fits:
        document = rows[r["row_id"]]["document"]
        n = len(ends_of(library, document))
        assert r["n_tokens"] == n and r["fits"] == (n <= CONTEXT - prompt - MAX_SUMMARY)
        assert r["chars_per_token"] == pytest.approx(max(1, len(document) / n), abs=1e-6)
    windows = {}
    for r in sorted(QUERIES["windows_subword"](spark, SF).collect()):
        windows.setdefault(r["row_id"], []).append(r["chunk"])
    for i, row in rows.items():
        ends = [0, *ends_of(library, row["document"])]
        last = len(ends) - 1
        spans = [(s, min(s + WINDOW, last)) for s in range(0, last, WINDOW - STRIDE_BACK)]
        assert windows[i] == [row["document"][ends[a] : ends[b]].strip(" ") for a, b in spans]


def test_texts_are_encoded_in_one_python_node(spark):
    plan = QUERIES["truncate_subword"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", plan)) == 1


def test_subword_ends_of_odd_texts(spark, library):
    tokenizer = SubwordTokenizer.from_file(spark, VOCABULARY)
    texts = [None, "", " ", "a", "é😀漢字 <|endoftext|>", "x" * 3000, "\n\n", "tail "]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    measured = Measured(F.col("t"), F.col("e"))
    got = tokenizer.measure(rows, e="t").select(
        "id", "e", *[measured.head(F.lit(n)).alias(f"h{n}") for n in (0, 1, 3, 10**6)],
        measured.chars_per_token().alias("c"), measured.windows(2, 5).alias("w"),
    )
    for r in got.collect():
        value = texts[r["id"]] or ""
        own = ends_of(library, value)
        assert len(r["e"]) == len(own) and r["e"] == sorted(r["e"])
        if value:
            assert r["h0"] == "" and r["h1000000"] == value and value.startswith(r["h1"])
            assert r["h1"] == value[: r["e"][0]]
        assert r["c"] >= 1 and (own or r["c"] == 4.0)
        assert tokenizer.count_text(value) == len(own)
    twice = tokenizer.measure(rows.withColumn("u", F.lit("two words")), a="t", b="u").collect()
    assert {len(r["b"]) for r in twice} == {2}


def test_few_texts_are_encoded_at_a_time(spark):
    """However many rows an Arrow batch has, a worker holds the tokens of few of them."""

    def load():
        def encode(texts):
            if sum(map(len, texts)) > 1 << 20:
                raise ValueError("too much text at once")
            return [list(range(1, len(t) // 1000 + 1)) for t in texts]

        return encode

    tokenizer = SubwordTokenizer(load)
    texts = [None if i % 7 == 3 else "x" * (1000 * (i % 180)) for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    rows = rows.withColumn("u", F.lit("y" * 2000))
    found = tokenizer.measure(rows, e="t", f="u").select("id", "e", "f").collect()
    counted = {r["id"]: (r["a"], r["b"]) for r in tokenizer.counted(rows, a="t", b="u").collect()}
    assert len(found) == len(counted) == 200
    for r in found:
        n = len(texts[r["id"]] or "") // 1000
        assert r["e"] == list(range(1, n + 1)) and r["f"] == [1, 2] and counted[r["id"]] == (n, 2)


def test_a_worker_holds_one_library_for_all_its_tasks(spark):
    definition = Path(VOCABULARY).read_text()
    assert subwords._library(definition) is subwords._library(str(definition))


def test_counts_are_those_of_the_ends(spark):
    tokenizer = SubwordTokenizer.from_file(spark, VOCABULARY)
    texts = [None, "", " ", "é😀漢字 <|endoftext|>", "x" * 3000, "tail "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    both = tokenizer.counted(tokenizer.measure(rows, e="t"), n="t").collect()
    assert [r["n"] for r in both] == [len(r["e"]) for r in both]


# ---- chunks along separators ---------------------------------------------------------------------

#: In plain words: the cuts of each level, as places in a text.
BREAKS = [
    lambda t, i: t[max(0, i - 3) : i] == "\n\n\n" and t[i : i + 1] != "\n"
    or (t[i - 1] == "\n" and re.match(r"#{1,6} ", t[i:]) is not None),
    lambda t, i: t[max(0, i - 2) : i] == "\n\n" and t[i : i + 1] != "\n",
    lambda t, i: t[i - 1] == "\n" and t[i : i + 1] != "\n",
    lambda t, i: t[i - 1] in ".!?" and t[i : i + 1] in (" ", "\t", "\n"),
    lambda t, i: t[i - 1] in " \t" and t[i : i + 1] not in (" ", "\t"),
]


def plain_segments(value, room, level=0):
    if level == len(BREAKS):
        return [value[i : i + room] for i in range(0, len(value), room)]
    cuts = [0, *[i for i in range(1, len(value)) if BREAKS[level](value, i)], len(value)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        piece = value[a:b]
        out += [piece] if len(piece) <= room else plain_segments(piece, room, level + 1)
    return [p for p in out if p]


def plain_chunks(value, size, overlap):
    room = max(size - overlap, 1)
    spans, start, at = [], 0, 0
    for piece in plain_segments(value, room):
        if at + len(piece) - start > room:
            spans.append((start, at))
            start = at
        at += len(piece)
    spans.append((start, at))
    cut = [value[max(0, a - overlap) if n else a : b].strip(" \t\n\r") for n, (a, b) in enumerate(spans)]
    return [c for c in cut if c.strip()]


PIECES = ["one", "two.", "Three!", "é", "x" * 9, " ", " ", "\n", "\n\n", "\n\n\n", "\n# ", "\t", "? ", "#"]


def segmented(spark, values, size, overlap):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, document string")
    cut = chunks.segment_chunks(F.col("document"), F.lit(size), F.lit(overlap))
    return [r["c"] for r in rows.select("id", cut.alias("c")).orderBy("id").collect()]


@settings(max_examples=8, deadline=None)
@given(st.data())
def test_segments_match_plain_python(spark, data):
    values = ["".join(data.draw(st.lists(st.sampled_from(PIECES), max_size=40))) for _ in range(30)]
    size = data.draw(st.integers(2, 40))
    overlap = data.draw(st.integers(0, size - 1))
    found = segmented(spark, values, size, overlap)
    assert found == [plain_chunks(v, size, overlap) for v in values]
    for value, cut in zip(values, found):
        assert all(0 < len(c) <= size for c in cut)
        if not overlap:  # every character but white space is covered, in order
            assert re.sub(r"\s", "", "".join(cut)) == re.sub(r"\s", "", value)


def test_segments_end_at_the_highest_boundary(spark):
    value = "# One\nshort line\nother line\n\nnew paragraph here.\n\n\n# Two\nThe last. It ends!"
    got = segmented(spark, [value, None, "", " \n "], 60, 0)
    assert got[0] == ["# One\nshort line\nother line\n\nnew paragraph here.", "# Two\nThe last. It ends!"]
    assert got[1] in (None, []) and got[2] == [] and got[3] == []
    assert segmented(spark, [value], 30, 0)[0] == [
        "# One\nshort line\nother line", "new paragraph here.", "# Two\nThe last. It ends!",
    ]
    assert segmented(spark, ["abc def ghij"], 8, 3)[0] == ["abc", "bc def", "ef ghij"]


# ---- feeds ---------------------------------------------------------------------------------------


def plain_walk(ids, shard, buffer, seed, epoch=0):
    draw, held, given = random.Random(f"{seed}:{epoch}:{shard}:{ids[0]}"), [], []
    for i in ids:
        if len(held) < buffer:
            held.append(i)
        else:
            at = draw.randrange(buffer)
            given.append(held[at])
            held[at] = i
    draw.shuffle(held)
    return given + held


def test_buffer_feed_is_a_walk_with_a_buffer(spark):
    got = QUERIES["buffer_feed"](spark, SF).toPandas()
    rows = spark.read.parquet(written_shards(spark, SF)).toPandas().set_index("row_id")
    for shard, group in got.groupby("shard"):
        ids = sorted(rows[rows["shard"] == shard].index)
        assert group.sort_values("pos")["row_id"].tolist() == plain_walk(ids, shard, BUFFER, SEED)
    assert (rows.loc[got["row_id"], "document"].to_numpy() == got["document"]).all()


@pytest.mark.parametrize("buffer", [1, 7, 5000])
def test_buffer_shuffle_bounds(spark, buffer):
    rows = spark.range(0, 3000, 1, 3).withColumn("shard", F.floor(F.col("id") / 400))
    shuffled = order.buffer_shuffle(rows, "shard", "id", buffer, seed=1)
    assert "Exchange" not in plan_of(shuffled)
    got = shuffled.collect()
    assert sorted(got) == sorted(shuffled.collect()) and sorted(r["id"] for r in got) == list(range(3000))
    other = order.buffer_shuffle(rows, "shard", "id", buffer, seed=1, epoch=1).collect()
    assert (sorted(got) == sorted(other)) == (buffer == 1)
    starts = {}
    for r in sorted(got, key=lambda r: r["id"]):
        task = r["id"] // 1000
        first = starts.setdefault((r["shard"], task), r["id"])
        assert r["pos"] > r["id"] - first - buffer  # never given out long before its turn
    places = pd.DataFrame(got, columns=["id", "shard", "pos"])
    places["task"] = places["id"] // 1000
    for _, group in places.groupby(["shard", "task"]):
        assert sorted(group["pos"]) == list(range(len(group)))
    assert order.buffer_shuffle(rows.limit(0), "shard", "id").collect() == []


def test_stored_count_reads_footers_only(spark):
    path = written_shards(spark, SF)
    counted = feed.stored_row_count(spark, path)
    assert [r["n_rows"] for r in counted.collect()] == [spark.read.parquet(path).count()]
    plan = plan_of(counted)
    assert "PushedAggregation: [COUNT(*)]" in plan and "document" not in plan.split("Physical Plan")[1]
    steps = feed.plan_steps(feed.stored_row_count(spark, path), 10, 50).first()
    assert (steps["num_rows"], steps["steps_per_epoch"]) == (50, 7)


def test_digest_index_is_joined_without_shuffling_it(spark):
    path = work_path(spark, "index")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    rows = pairs(spark, SF)
    train, evals = rows.where("split = 'train'"), rows.where("split != 'train'")
    dedup.index_keys(train.where("row_id % 2 = 0"), name, path, 8)
    index = dedup.index_keys(train, name, path, 8)
    expected = {r["_key"] for r in dedup.document_keys(train).collect()}
    assert sorted(r["_key"] for r in index.collect()) == sorted(expected)  # each once
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mine = dedup.document_keys(evals)
        plan = index.join(mine, "_key", "left_semi")._jdf.queryExecution().executedPlan().toString()
        own, other = re.search(r"SortMergeJoin \[_key#(\d+)\], \[_key#(\d+)\]", plan).groups()
        assert "Bucketed: true" in plan and f"Exchange hashpartitioning(_key#{own}" not in plan
        assert f"Exchange hashpartitioning(_key#{other}, 8)" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    got = sorted(r["row_id"] for r in dedup.drop_known(evals, index).collect())
    assert got == sorted(r["row_id"] for r in dedup.drop_leaked(evals, train).collect())


# ---- summaries of many chunks --------------------------------------------------------------------


@pytest.mark.parametrize("count", [1, 2, 8, 64, 65])
def test_every_chunk_shows_in_gathered_summaries(spark, count):
    parts = [[" ".join(f"c{i}w{j}" for j in range(20)) for i in range(count)]]
    df = spark.createDataFrame([(0, parts[0])], "id long, chunks array<string>")
    model = summarize.gathered(5, 2)
    fold, tree = df.select(
        summarize.refine(F.col("chunks"), model, 14, 48),
        summarize.merge_tree(F.col("chunks"), model, 14, 48),
    ).first()
    rounds = summarize.merge_by_rounds(chunks.explode_chunks(df, ["id"]), "id", model, 14, 48)
    assert rounds.first()["summary"] == tree
    for value in (fold, tree):
        shown = [int(c) for c in re.findall(r"c(\d+)w", value)]
        assert set(shown) == set(range(count)) and shown == sorted(shown)
    assert len(fold.split()) == (5 if count == 1 else max(5 + 2 * (count - 1), 14))
    assert tree.count("[") == tree.count("]") == sum(
        -(-count // 2**k) for k in range(1, max(count - 1, 0).bit_length() + 1)
    )


def test_strategy_pairs_move_no_text(spark):
    scored = evaluate.cross_comparison(prediction_rows(spark, SF, systems=("adapter",)), stemmed=False)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "prediction" not in exchanges[0] and "Sort" not in plan
    listed = prediction_rows(spark, SF, systems=("adapter",))
    flat = listed.select("row_id", F.explode("entries").alias("e")).select("row_id", "e.*")
    both = [sorted(map(tuple, evaluate.strategy_pairs(x).collect())) for x in (listed, flat)]
    assert both[0] == both[1] and len(both[0]) == 3 * listed.count()
