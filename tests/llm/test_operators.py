"""Every operator against a plain re-computation, and on null, empty, long and repeated rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from digestry.llm import ann, bpe, brown, gam, packing, pii, rules, shards, simhash, toxicity
from digestry.llm.components import components
from tests.llm import brute
from tests.llm.conftest import DOCS, EDGES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return bpe.share_vocabulary(spark, PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


# ---- personal data ----------------------------------------------------------------------------

PERSONAL = [
    "a@b.c_d@e.fg x.y@z", "a@b@c.de and 1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112", "41111111111111111111111", "+1 (784) 555-8120 +44",
    "é😀 me@x.org, tel +49 30 1234567.", "iban DE89 3704 0044 0532 0130 00 GB82WEST12345698765432",
    "ssn 123-45-6789 and 123-45-6789", "credit card 378282246310005", "call 555-123-4567 now",
]


def test_pii_spans(spark, docs):
    rng = random.Random(3)
    noise = [
        "".join(rng.choice("ab1234.@+- ()\n") for _ in range(rng.randrange(80))) for _ in range(300)
    ]
    texts = EDGES + PERSONAL + noise
    found = pii.find(docs(texts), "text", "found").select("doc_id", "found").collect()
    for row in found:
        base = [(s["kind"], s["start"], s["end"]) for s in row["found"] if s["kind"] in pii.BASE]
        assert base == brute.spans(texts[row["doc_id"]])
        assert all((texts[row["doc_id"]] or "")[s["start"] : s["end"]] == s["text"] for s in row["found"])
    kinds = {r["doc_id"] - len(EDGES): {s["kind"] for s in r["found"]} for r in found}
    assert kinds[6] == {"account"} and "social" in kinds[7]
    assert kinds[8] == {"short_card"} and kinds[9] == {"local_phone"}


def test_pii_many_spans_and_redaction(spark, docs):
    text = "1.2.3.4 " * 5000
    row = pii.find(docs([text]), "text").first()
    assert [s["start"] for s in row["spans"]] == list(range(0, 40000, 8))
    masked = pii.redact(docs(["mail a@b.cd at 10.0.0.1, card 4111 1111 1111 1111.", None, "x"]), "text")
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == [
        "mail <EMAIL> at <IP>, card <CARD>.", None, "x",
    ]
    assert pii.find(docs([]), "text").count() == 0


def test_redaction_masks_the_reported_spans(spark, docs):
    """Also where kinds overlap."""
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab1234.@+- ()😀") for _ in range(rng.randrange(80))) for _ in range(200)]
    texts = ["+33.1.23.45.67.89", "a +33.1.23.45.67.89, b@c.de é😀 1.2.3.4.5", "1.2.3.4 " * 3000]
    texts += PERSONAL + EDGES + noise
    spans = {r["doc_id"]: r["spans"] for r in pii.find(docs(texts), "text").collect()}
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs(texts), "text").collect()}
    assert got[0] == "<PHONE>" and got[1].startswith("a <PHONE>, <EMAIL> é😀 <IP>")
    for i, text in enumerate(texts):
        groups = []
        for s in sorted(spans[i], key=lambda s: s["start"]):
            if groups and s["start"] < max(g["end"] for g in groups[-1]):
                groups[-1].append(s)
            else:
                groups.append([s])
        masked = text
        for group in reversed(groups):
            best = max(group, key=lambda s: (s["score"], s["end"] - s["start"], -s["start"], s["kind"]))
            end = max(s["end"] for s in group)
            masked = masked[: group[0]["start"]] + f"<{best['kind'].upper()}>" + masked[end:]
        assert got[i] == masked


# ---- neighbours ---------------------------------------------------------------------------------


def test_ann_recall_ties_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype("float32").tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[40][1]) for i in range(30)] + [rows[60]] * 3
    rows += [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16),
             (None, [1.0] * 16), (3080, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>").withColumn("score", F.lit("x"))
    found = ann.search(df, "vec_id", "v", F.col("id") % 20 == 0, 20).cache()
    assert ann.recall(found, df.where("vec_id < 3000"), "vec_id", "v", 20) >= 0.9
    got = found.toPandas()
    assert set(got["query_id"]) == set(range(0, 1500, 20)) | {2000, 2020}
    assert got["vec_id"].max() < 3000 and not (got["query_id"] == got["vec_id"]).any()
    tied = got[got["query_id"] == 40].sort_values("rank")
    assert tied["vec_id"].tolist() == list(range(2000, 2020)) and tied["score"].nunique() == 1
    assert not got.duplicated(["query_id", "vec_id"]).any()
    assert (got.groupby("query_id")["rank"].apply(sorted).map(tuple) == tuple(range(1, 21))).all()
    assert ann.search(df.limit(0), "vec_id", "v", F.col("id") % 20 == 0, 20).count() == 0
    few = ann.search(df.where("vec_id in (0, 1, 2)"), "vec_id", "v", F.col("id") % 20 == 0, 20)
    assert few.count() == 2


def unit_rows(rng, count=2000, width=64):
    rows = rng.normal(size=(count, width))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


SHAPES = {
    "unit": lambda r: unit_rows(r),
    "wide": lambda r: unit_rows(r) * np.exp(r.normal(size=(2000, 1))),
    "few_long": lambda r: unit_rows(r) * np.where(r.random((2000, 1)) < 0.01, 10.0, 1.0),
    "positive": lambda r: np.abs(r.normal(size=(2000, 64))),
    "shifted": lambda r: r.normal(size=(2000, 64)) + 1,
    "uneven": lambda r: r.normal(size=(2000, 64)) * 1.15 ** -np.arange(64),
    "clustered": lambda r: r.normal(size=(20, 64))[r.integers(20, size=2000)] + r.normal(size=(2000, 64)) / 3,
    "repeated": lambda r: np.concatenate([np.repeat(unit_rows(r, 1), 600, axis=0), unit_rows(r, 1400)]),
    "huge": lambda r: unit_rows(r) * 1e200,
    "tiny": lambda r: unit_rows(r) * 1e-200,
    "one_huge": lambda r: unit_rows(r) * np.where(np.arange(2000) == 777, 1e170, 1.0)[:, None],
}


@pytest.mark.parametrize("kind", SHAPES)
def test_ann_recall_by_shape(spark, kind):
    vectors = SHAPES[kind](np.random.default_rng(7))
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, v array<double>")
    found = ann.search(df, "vec_id", "v", F.col("id") % 20 == 0, 20).toPandas()
    with np.errstate(over="ignore"):
        scores = np.array([ann.inner_products(vectors, vectors[q]) for q in range(0, 2000, 20)])
    assert not np.isnan(scores).any()
    hit = 0
    for row, query in zip(scores, range(0, 2000, 20)):
        got = found[found["query_id"] == query].sort_values("rank")
        assert (got["score"].to_numpy() == row[got["vec_id"]]).all() and query not in set(got["vec_id"])
        assert len(got) == 20 and got["score"].is_monotonic_decreasing
        row[query] = -np.inf
        hit += (got["score"] >= np.sort(row)[-20]).sum()
        if kind == "one_huge" and row[777] == row.max() and query != 777:
            assert got["vec_id"].iloc[0] == 777
    assert hit >= 0.9 * 2000


def test_ann_reads_few_postings_and_can_be_exact(spark):
    vectors = unit_rows(np.random.default_rng(9), 1500, 24)
    pivots = ann.units(vectors[:128])
    order = np.argsort(-(vectors @ pivots.T), axis=1)[:, : ann.LISTED].astype(np.uint8)
    postings = ann.Postings(order, 128)
    read = [np.diff(postings.starts)[near].sum() for near in order[:100]]
    assert np.mean(read) < 0.2 * 1500 * 128
    for near in order[:5]:  # the footrule with absent pivots behind the listed ones
        place = lambda line: {p: i for i, p in enumerate(line.tolist())}
        own = place(near)
        for row, got in zip(order, postings.correlation(near)):
            other = place(row)
            apart = sum(abs(own.get(p, 40) - other.get(p, 40)) for p in {**own, **other})
            assert got == pytest.approx((40 * 41 - apart) / (40 * 41) - postings.expected)
    df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, v array<double>")
    found = ann.search(df, "vec_id", "v", F.col("id") % 50 == 0, 10, share=1.0)
    assert ann.recall(found, df, "vec_id", "v", 10) == 1.0


# ---- language model -----------------------------------------------------------------------------


def test_brown_base_scores_and_normalization(spark, docs):
    rng = random.Random(1)
    words = ["the", "of", "Cat", "DOG", "runs", "sleeps", "é", "x,"] + [f"w{i}" for i in range(40)]
    texts = EDGES + [" ".join(rng.choices(words, k=rng.randrange(1, 40))) for _ in range(120)]
    got = {r["doc_id"]: r for r in brown.score(docs(texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    tokens = [[w.lower() if w.isascii() else brute.lowered(w) for w in brute.WORD.findall(t or "")] + [""]
              for t in texts]
    counts = Counter(w for i, line in enumerate(tokens) if not held[i] for w in line)
    total, distinct = sum(counts.values()), len(counts)
    for i, line in enumerate(tokens):
        row = got[i]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in line)
        assert row["held_out"] == held[i] and row["train_tokens"] == total
        assert (row["n_tokens"], row["n_known"]) == (len(line), sum(counts[w] > 0 for w in line))
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert row["score"] < 0 and math.isfinite(row["score"])
    assert brown.score(docs([])).count() == 0
    assert brown.score(docs(["a b"], [2])).count() == 1


def test_brown_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    bigrams = rng.poisson(2.0, (60, 60)).astype(float)
    member = brown.exchange(bigrams, classes=6)
    table = 10 ** brown.transitions(bigrams, member, classes=6)
    assert np.allclose(table.sum(axis=1), 1.0)


def test_brown_scores_match_a_walk_over_the_tokens(spark, docs, monkeypatch):
    """Every score is the sum over its tokens, whether words are frequent, rare or unseen; the counts
    of neighbouring classes are those of the classes that the model ends with."""
    monkeypatch.setattr(brown, "KNOWN_WORDS", 1300)
    rng = random.Random(8)
    words = [f"{rng.choice('abcdefgh')}{i}{rng.choice(['ing', 'ed', 's', 'é'])}" for i in range(2500)]
    heavy = [1 / (i + 40) for i in range(2500)]
    texts = EDGES + [" ".join(rng.choices(words, heavy, k=rng.randrange(1, 150))) for _ in range(300)]
    rows = docs(texts)
    taught = rows.select("text").where(brown.remainder("doc_id", 7) != 2).select(brown.body("text").alias("text"))
    model, found = brown.fit(taught, brown.save(brown.word_counts(taught), "counts"))
    every = model.words | {r["word"].encode(): (r["n"], r["class"]) for r in found.collect()}
    assert 1030 < len(model.words) <= 1301 and found.where("class >= 0").count() > 100

    def own(word):
        n, c = every.get(word, (0, -1))
        return c if c >= 0 else int(model.suffix_class[brown.suffix_item(word)])

    def context(word):
        return own(word) if word in model.words else int(model.suffix_class[brown.suffix_item(word)])

    table = np.zeros((brown.CLASSES, brown.CLASSES))
    for i, text in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            line = brown.split(text or "")
            for before, word in zip([b"", *line], line):
                table[context(before), own(word)] += 1
    assert np.allclose(brown.smoothed(table), model.step)
    for row in brown.score(rows).collect():
        line, total = brown.split(texts[row["doc_id"]] or ""), 0.0
        for before, word in zip([b"", *line], line):
            n, c = every.get(word, (0, -1))
            item = np.array([brown.suffix_item(word)])
            total += model.step[context(before), own(word)]
            total += float(model.emission(np.array([n]), np.array([c]), item)[0])
        assert row["score"] == pytest.approx(total, rel=1e-9), texts[row["doc_id"]]


def test_exchange_finds_alternating_classes():
    """Words of two kinds that follow each other end up in different classes."""
    size = 21
    bigrams = np.zeros((size, size))
    left, right = range(1, 11), range(11, 21)
    rng = np.random.default_rng(4)
    for _ in range(20_000):
        a, b = rng.choice(left), rng.choice(right)
        bigrams[a, b] += 1
        bigrams[b, rng.choice(left)] += 1
    member = brown.exchange(bigrams, classes=3)
    assert len({member[i] for i in left}) == len({member[i] for i in right}) == 1
    assert member[1] != member[11] and member[0] == 0


def test_brown_every_word_gets_its_own_class(spark, docs, monkeypatch):
    """Words beyond the core items follow their own neighbours, not their last bytes, whether they
    are frequent or looked up; the model still sums to one."""
    monkeypatch.setattr(brown, "KNOWN_WORDS", 1200)
    rng = random.Random(5)
    left, right = ([f"{side}{i}ing" for i in range(1200)] for side in "ab")
    heavy = [4.0 if i < 500 else 1.0 for i in range(1200)]
    texts = []
    for _ in range(1500):
        sides = zip(rng.choices(left, heavy, k=20), rng.choices(right, heavy, k=20))
        texts.append(" ".join(f"the {a} of {b}" for a, b in sides))
    rows = docs(texts).select("doc_id", "text", F.lit(False).alias("held_out"))
    counts = brown.word_counts(rows).cache()
    model, found = brown.fit(rows, counts)
    every = {w.decode(): v for w, v in model.words.items()} | {
        r["word"]: (r["n"], r["class"]) for r in found.collect()
    }
    classes = {w: c for w, (_, c) in every.items()}
    counts_of = {r["word"]: r["n"] for r in counts.collect()}
    assert {w: n for w, (n, _) in every.items()} == counts_of
    assert set(classes) == {*left, *right, "the", "of", ""} and min(classes.values()) >= 0
    assert model.likelihoods == sorted(model.likelihoods)
    tail = sorted(classes, key=lambda w: -counts_of[w])[brown.WORD_ITEMS + 1 :]
    sides = [Counter((classes[w], w[0]) for w in tail)[c, s] for c in set(classes.values()) for s in "ab"]
    pure = sum(max(pair) for pair in zip(sides[::2], sides[1::2])) / len(tail)
    assert pure > 0.9, pure
    scored = brown.score(docs(texts)).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert scored["s"] > scored["b"]
    n, own = np.array([v[0] for v in every.values()]), np.array([v[1] for v in every.values()])
    item = np.array([brown.suffix_item(w.encode()) for w in every])
    share = 10 ** model.emission(n, own, item)
    unseen = 10**model.suffix
    sums = np.bincount(own, share, brown.CLASSES) + np.bincount(model.suffix_class, unseen, brown.CLASSES)
    assert np.allclose(sums[sums > 0], 1.0) and np.allclose((10**model.step).sum(axis=1), 1.0)


# ---- tokens and packing -------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, vocabulary, library):
    rng = random.Random(2)
    alphabet = ["a", "th", "ing", "é", "'s", "'", "!", "1", "²", " ", "\n", "İ", "ß", "Σ", "é",
                "<|endoftext|>", "<|startoftext|>", "漢", "😀", "\x1c", " ", "ﬁ", "DON'T", "​"]
    texts = EDGES + ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(400)]
    texts += ["".join(rng.choices("abcdefghinorst", k=rng.randrange(1, 60))) for _ in range(400)]
    coded = bpe.code(docs(texts), "doc_id", "text", vocabulary)
    again = bpe.decode(coded, "doc_id", "ids", vocabulary)
    decoded = {r["doc_id"]: r["decoded"] for r in again.collect()}
    for row in coded.collect():
        expected = ids_of(library, texts[row["doc_id"]])
        assert np.frombuffer(row["ids"], "<u4").tolist() == expected
        assert row["decoded"] == library.decode(expected, skip_special_tokens=False)
        assert decoded[row["doc_id"]] == row["decoded"]
    assert bpe.code(docs([]), "doc_id", "text", vocabulary).count() == 0


def test_bpe_memory_may_start_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Coder(library.to_str())
    texts = [" ".join(f"word{i * j}" for i in range(40)) for j in range(1, 12)]
    for text, ids in zip(texts, own.encode(pa.array(texts)).to_pylist()):
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)


def test_bpe_keeps_the_words_at_hand_when_its_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    own = bpe.Coder(library.to_str())
    learned = Counter()
    learn = own.learn
    own.learn = lambda new: (learned.update(new), learn(new))
    texts = ["often seen " + " ".join(f"word{i * 40 + j}," for j in range(20)) for i in range(6)]
    for text in texts:
        ids = own.encode(pa.array([text])).to_pylist()[0]
        assert np.frombuffer(ids, "<u4").tolist() == ids_of(library, text)
        assert len(own.ids) < 150
    assert learned["often"] == learned["seen"] == 1


def test_texts_are_encoded_a_few_megabytes_at_a_time():
    texts = [None, "", *["x" * (1 << 20)] * 24, "é" * (5 << 20), "last"]
    runs = list(bpe.slices(pa.array(range(len(texts))), pa.array(texts)))
    assert [k for keys, _ in runs for k in keys.to_pylist()] == list(range(len(texts)))
    for _, values in runs:  # beyond its last text, a run has 4 MB at most
        assert sum(len((t or "").encode()) for t in values.to_pylist()[:-1]) <= 4 << 20


def test_packing_gets_its_texts_in_small_batches(spark, docs, vocabulary):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    assert packing.pack(docs(["a b", None]), "doc_id", "text", vocabulary).count() == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_speculation_fails_only_where_merging_differs(library):
    """The verified cut is the exact one, and an unverified one is not taken."""
    own = bpe.Coder(library.to_str())
    rng = random.Random(9)
    words = ["".join(rng.choices("aeinorst", k=rng.randrange(1, 12))).encode() for _ in range(3000)]
    assert own.words_to_ids(words) == own.merge_exactly(words)
    assert [own.merge_long(w) for w in words[:300]] == own.merge_exactly(words[:300])


def check_packed(rows, texts, library, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array([*ids_of(library, texts[doc]), 1], "<u4").tobytes()
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * at])
        assert at == len(ids) // 4
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= window
    return by_doc, by_sequence


def test_packing(spark, docs, vocabulary, library):
    rng = random.Random(6)
    texts = EDGES + [" ".join(rng.choices(["the", "a", "of"], k=rng.randrange(200))) for _ in range(300)]
    df = docs(texts).repartition(5)
    rows = packing.pack(df, "doc_id", "text", vocabulary, window=128, open_windows=4).collect()
    by_doc, by_sequence = check_packed(rows, texts, library, 128)
    assert set(by_doc) == set(range(len(texts)))
    used = sum(r["length"] for r in rows)
    assert used / (128 * len(by_sequence)) > 0.9
    kept = packing.pack(df, "doc_id", "text", vocabulary, 128, 4, keep_ids=True).collect()
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in kept)
    assert packing.pack(docs([]), "doc_id", "text", vocabulary).count() == 0
    twice = packing.pack(docs(["a", "a", None], [7, 7, None]), "doc_id", "text", vocabulary).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in twice) == [(0, 1), (7, 2), (7, 2)]


def test_open_windows_are_bounded():
    held = packing.OpenWindows(10, 3)
    closed = []
    for n in (6, 7, 8, 9, 4, 1):
        closed += list(held.place((0, 0, n, 0, n, b"")))
        assert len(held.rooms) <= 3
    # none has room for 9: the fullest, with 8, is closed; 4 then fills the one with 6
    assert [sum(p[2] for p in pieces) for _, pieces in closed] == [8, 10, 10]


# ---- rules --------------------------------------------------------------------------------------


def test_rules_measures(spark, docs):
    rng = random.Random(8)
    texts = EDGES + [
        "".join(rng.choices(["a ", "b ", "c\n", "# ", "é", " \x0b", "A|"], k=rng.randrange(200)))
        for _ in range(200)
    ]
    rows = rules.judge(docs(texts), "text", "judged").select("doc_id", "judged.*").collect()
    for row in rows:
        expected = brute.measures(texts[row["doc_id"]])
        assert tuple(row[f] for f in rules.BASE) == expected
        letters = sum(any(c.isalpha() for c in w) for w in brute.WORD.findall(texts[row["doc_id"]] or ""))
        assert row["n_letter_words"] == letters
        bad = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert row["base_failed"] == bad and row["kept"] == (not bad and not row["failed"])
    assert rules.judge(docs([]), "text").count() == 0


def test_rules_verdicts(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    clean = " ".join(rng.choice([word(), word(), word(), "the"]) for _ in range(200)) + "."
    loud = clean.upper().replace(" ", "!! ")
    symbols = clean.replace(" ", "$$ ")
    table = " | ".join(word() for _ in range(200))
    got = rules.judge(docs([clean, loud, symbols, table]), "text", "q").orderBy("doc_id")
    assert [r["q"]["kept"] for r in got.collect()] == [True, False, False, False]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("Exchange rangepartitioning", "")


# ---- classifiers --------------------------------------------------------------------------------


def labelled(spark, n, bad):
    rng = random.Random(n)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices("aeinorst", k=rng.randrange(2, 7))) for _ in range(60)]
        mark = i % 4 == 0
        if mark:
            words = bad(words, rng)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, int(not mark), int(mark)))
    docs = spark.createDataFrame(rows, DOCS)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, parts, held_out, threshold):
    rows = scored.join(labels, "doc_id").select("doc_id", "score", label).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % parts == held_out]
    assert len(held) > 50 and all(0 <= r["score"] <= 1 for r in rows)
    return sum((r["score"] >= threshold) == bool(r[label]) for r in held) / len(held)


def test_toxicity_held_out(spark, docs):
    def insult(words, rng):
        for _ in range(2):
            words[rng.randrange(60)] = rng.choice(["grumbo", "zulkat" + rng.choice("aeio")])
        return words

    rows, labels = labelled(spark, 800, insult)
    model = toxicity.fit(rows, labels)
    scored = toxicity.score(rows, "text", model, "score")
    assert accuracy(scored, labels, "toxic", 4, 2, toxicity.THRESHOLD) > 0.97
    edges = toxicity.score(docs(EDGES), "text", model, "found").collect()
    assert all(0 <= r["found"] <= 1 for r in edges) and len(edges) == len(EDGES)
    assert edges[3]["found"] == edges[4]["found"]


def test_toxicity_model_holds_every_sequence(spark, monkeypatch):
    """Against the same formulas in plain Python, over all sequences."""
    rows, labels = labelled(spark, 200, lambda words, rng: [w + "x" for w in words])
    model = toxicity.fit(rows, labels)
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    seen = [Counter(), Counter()]
    for r in rows.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            for word in set(r["text"].split()):
                line = f"^{word}$"
                for i in range(1, len(line)):
                    seen[1 - toxic[r["doc_id"]]][line[max(0, i - 5) : i + 1]] += 1
    grams = set(seen[0]) | set(seen[1])
    kinds = Counter(tail[1:] for tail in {g[-n:] for g in grams for n in range(2, len(g) + 1)})
    total, types = Counter(), Counter()
    for g, n in kinds.items():
        total[g[:-1]] += n
        types[g[:-1]] += 1

    def lower(g):
        rest = lower(g[1:]) if len(g) > 1 else 1 / types[""]
        return (kinds[g] - 0.75 + 0.75 * types[g[:-1]] * rest) / total[g[:-1]]

    whole, distinct = [Counter(), Counter()], [Counter(), Counter()]
    for g in grams:
        for k in (0, 1):
            whole[k][g[:-1]] += seen[k][g]
            distinct[k][g[:-1]] += seen[k][g] > 0
    expected = {}
    for g in grams:
        c, p = g[:-1], []
        if max(whole[0][c], whole[1][c]) < 5:
            continue
        for k in (0, 1):
            n = whole[k][c]
            p.append((max(seen[k][g] - 0.75, 0) + 0.75 * distinct[k][c] * lower(g[1:])) / n
                     if n >= 5 else lower(g[1:]))
        expected[g] = math.log(p[0] / p[1])
    assert len(expected) > 1000 and model.grams == pytest.approx(expected)


def test_gam_held_out(spark, docs):
    rows, labels = labelled(spark, 900, lambda words, rng: [w.upper() + "!!" for w in words])
    model = gam.fit(rows, labels)
    scored = gam.score(rows, "doc_id", "text", model)
    assert accuracy(scored, labels, "quality", 3, 1, gam.THRESHOLD) > 0.97
    edges = gam.score(docs(EDGES), "doc_id", "text", model).collect()
    assert all(0 <= r["score"] <= 1 for r in edges) and len(edges) == len(EDGES)


def test_gam_learns_an_interaction():
    """Neither feature tells anything alone."""
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    label = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x[:2000], label[:2000], np.ones(2000))
    assert (0, 1) in model.pairs
    assert ((model.scores(x[2000:]) >= 0.5) == label[2000:]).mean() > 0.9


@pytest.mark.parametrize("operator", [toxicity, gam])
def test_classifiers_without_labels(spark, docs, operator):
    rows, labels = labelled(spark, 40, lambda words, rng: words)
    column = "toxic" if operator is toxicity else "quality"
    for given in (labels.limit(0), labels.where(f"{column} = 1"), labels.withColumn(column, F.lit(None))):
        model = operator.fit(rows, given.withColumn(column, F.col(column).cast("int")))
        out = (toxicity.score(rows, "text", model, "score") if operator is toxicity
               else gam.score(rows, "doc_id", "text", model))
        assert out.select("score").distinct().count() == 1
    empty = rows.limit(0)
    operator.fit(empty, labels)


# ---- shards -------------------------------------------------------------------------------------


def test_shards(spark, docs):
    ids = [0, 1, -1, -(2**63), 2**63 - 1, *range(10, 500), None, None, 7, 7]
    texts = (EDGES * 40)[: len(ids)]
    rows = shards.number(shards.assign(docs(texts, ids), "doc_id", "text", 16), "shard").collect()
    assert len(rows) == len(ids)
    for r in rows:
        key = r["doc_id"] or 0
        assert (r["shard"], r["grown_shard"]) == (brute.jump(key, 16), brute.jump(key, 17))
        assert r["grown_shard"] in (r["shard"], 16)
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == expected
    for shard in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    empty = shards.number(shards.assign(docs([]), "doc_id", "text", 16), "shard")
    assert empty.count() == 0


def test_shards_by_text_key(spark, docs):
    rows = shards.assign(docs(["a", "b", "a", None]), "text", "text", 4).collect()
    assert rows[0]["shard"] == rows[2]["shard"]


# ---- near duplicates ----------------------------------------------------------------------------


def test_simhash_components(spark, docs):
    rng = random.Random(12)
    texts = list(EDGES)
    for _ in range(12):
        words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)]
        for _ in range(6):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = "Changed"
            texts.append(" ".join(copy))
    prints = [brute.simhash(t) for t in texts]
    root = brute.groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    rows = simhash.near_duplicates(docs(texts), "doc_id", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == root[r["doc_id"]]
    assert simhash.near_duplicates(docs([]), "doc_id", "text").count() == 0
    some = simhash.near_duplicates(docs(["a b c"] * 3, [None, 5, 5]), "doc_id", "text").collect()
    assert len(some) == 3 and {r["component_id"] for r in some} == {5}


@pytest.mark.parametrize("hot", [1024, 3])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, hot):
    """Also where postings are hot and are posted again."""
    monkeypatch.setattr(simhash, "HOT_POSTING", hot)
    rng = random.Random(hot)
    centers = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
                     for c in centers for _ in range(40)})
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    found = components(simhash.links(classes, 3), "a", "b").collect()
    root = brute.groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    got = {r["node"]: r["root"] for r in found}
    expected = [signed[r] for r in root]
    assert [got.get(v, v) for v in signed] == expected


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(900, 901)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, 900: 900, 901: 900}
    assert components(edges.limit(0), "a", "b").count() == 0


def test_digest_of_spans(spark, docs):
    row = pii.find(docs(["a@b.cd 1.2.3.4"]), "text").select(pii.listed(F.col("spans")).alias("s")).first()
    assert row["s"] == "email:0:6,ip:7:14"
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_packing_keeps_large_ids_beside_null_ones(spark, vocabulary):
    ids = [2**53 + 1, 2**53 + 3, None, 2**62 + 1, None]
    given = spark.createDataFrame(
        [(i, f"text number {n}") for n, i in enumerate(ids)], "doc_id long, text string"
    )
    for keep_ids in (False, True):
        packed = packing.pack(given, "doc_id", "text", vocabulary, keep_ids=keep_ids).collect()
        assert Counter(r["doc_id"] for r in packed) == Counter(ids)
        assert len({r["sequence_id"] for r in packed}) == 1


def plain_tree(grad, curve, ridge, splits=2):
    """Leaf values by bin: the best single cut of any leaf, found by trying all, ``splits`` times."""
    edges = [0, len(grad)]

    def worth(a, b):
        return sum(grad[a:b]) ** 2 / (sum(curve[a:b]) + ridge)

    for _ in range(splits):
        tried = [
            (worth(a, c) + worth(c, b) - worth(a, b), c)
            for a, b in zip(edges, edges[1:]) for c in range(a + 1, b)
        ]
        best = max(tried, default=(0, 0), key=lambda t: t[0])
        if best[0] <= 1e-12:
            break
        edges = sorted([*edges, best[1]])
    return [
        sum(grad[a:b]) / (sum(curve[a:b]) + ridge) for a, b in zip(edges, edges[1:]) for _ in range(a, b)
    ]


def test_gam_matches_plain_boosting(monkeypatch):
    """Tables of the single features, round by round, and scores as sums of table cells."""
    monkeypatch.setattr(gam, "ROUNDS", 3)
    monkeypatch.setattr(gam, "PAIRS", 0)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(150, 3)), 1)
    label = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=150) > 0.8).astype(float)
    weight = rng.uniform(0.5, 1.5, size=150)
    model = gam.train(x, label, weight)
    share = sum(weight * label) / sum(weight)
    base = math.log(share / (1 - share))
    bins = [[sum(v >= c for c in model.cuts[f]) for f, v in enumerate(row)] for row in x.tolist()]
    tables = [[0.0] * (len(c) + 1) for c in model.cuts]

    def chance(row):
        return 1 / (1 + math.exp(-(base + sum(tables[f][b] for f, b in enumerate(row)))))

    for _ in range(3):
        for f in range(3):
            grad, curve = [0.0] * len(tables[f]), [0.0] * len(tables[f])
            for row, y, w in zip(bins, label, weight):
                p = chance(row)
                grad[row[f]] += w * (y - p)
                curve[row[f]] += w * p * (1 - p)
            step = plain_tree(grad, curve, gam.RIDGE)
            tables[f] = [t + gam.RATE * v for t, v in zip(tables[f], step)]
    for found, expected in zip(model.tables, tables):
        assert found == pytest.approx(expected, rel=1e-9, abs=1e-12)
    assert model.scores(x) == pytest.approx([chance(row) for row in bins])


def test_gam_pairs_are_the_best_quadrants():
    rng = np.random.default_rng(4)
    for _ in range(5):
        grad, curve = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, size=(4, 5))
        gain, value = gam.quadrants(grad, curve)
        best, whole = (0.0, None), grad.sum() ** 2 / (curve.sum() + gam.RIDGE)
        for i in range(1, 4):
            for j in range(1, 5):
                cells = [(slice(*r), slice(*c)) for r in ((0, i), (i, 4)) for c in ((0, j), (j, 5))]
                won = sum(grad[c].sum() ** 2 / (curve[c].sum() + gam.RIDGE) for c in cells) - whole
                if won > best[0]:
                    best = won, cells
        assert gain == pytest.approx(best[0])
        for c in best[1]:
            assert value[c] == pytest.approx(grad[c].sum() / (curve[c].sum() + gam.RIDGE))


def test_toxicity_score_is_a_curve_over_plain_features(spark):
    rows, labels = labelled(spark, 200, lambda words, rng: [w + "x" for w in words])
    model = toxicity.fit(rows, labels)
    texts = [r["text"] for r in rows.limit(40).collect()] + ["", "one", "Two two TWO", "1 2 3", "zzzx qx"]

    def features(value):
        listed = toxicity.tokens(value)
        if not listed:
            return [0.0] * 5
        each = {w: model.word(w) for w in listed}
        top = sorted(each.values(), reverse=True)[:3]
        top += [0.0] * (3 - len(top))
        out = sum(max(v - toxicity.STANDS_OUT, 0) for v in each.values())
        size = sum(len(w) + 1 for w in listed)
        total = sum(each[w] for w in listed)
        return [total / size, max(top), sum(top) / 3, math.log1p(out), math.log1p(len(listed))]

    for value in texts:
        plain = features(value)
        assert list(model.features(value)) == pytest.approx(plain)
        held = [plain[0], *[min(max(v, -20), 20) for v in plain[1:]]]
        z = [1.0, *[(v - m) / s for v, m, s in zip(held, model.shift, model.scale)]]
        line = sum(a * b for a, b in zip(z, model.weights))
        assert model.scores(np.array([plain]))[0] == pytest.approx(1 / (1 + math.exp(-min(max(line, -30), 30))))
