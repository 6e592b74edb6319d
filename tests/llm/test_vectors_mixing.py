"""Hard negatives, vector codes and mixing against brute force, and on odd rows."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestry.llm import codes, mixing, negatives
from digestry.llm.vectors import LIMIT

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [
    (None, [1.0, 2.0, 3.0, 4.0], 1),
    (901, None, 1),
    (902, [1.0, None, 3.0, 4.0], 1),
    (903, [float("nan"), 2.0, 3.0, 4.0], 1),
    (904, [float("inf"), 2.0, 3.0, 4.0], 1),
    (905, [1.0, 2.0], 1),
    (906, [], 1),
    (907, [0.5, 0.5, 0.5, 0.5], None),
    (908, [3e38, -3e38, 1.0, 0.0], 2),
]


def table(spark, rows):
    clashing = ["id", "v", "score", "codes", "error", "rows_in", "anchors_in", "anchor", "rank"]
    return spark.createDataFrame(rows, VECTORS).select(
        "*", *[F.lit("x").alias(name) for name in clashing]
    )


def some_vectors(count, width, seed, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(count, width)) * np.exp(rng.normal(size=(count, 1)) * spread) / 4
    rows[count // 2 : count // 2 + count // 5] = rows[0]  # many copies, many ties
    return [
        (i, [float(np.float32(x)) for x in row], int(rng.integers(labels))) for i, row in enumerate(rows)
    ]


def floors(vector, scale=256):
    return [max(-LIMIT, min(LIMIT, math.floor(scale * x))) for x in vector]


def whole(rows, labelled=True):
    """Rows that take part, as plain numbers."""
    width = len(min((r for r in rows if r[1] and r[0] is not None), key=lambda r: r[0])[1])
    good = [
        r for r in rows
        if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == width
    ]
    if labelled:
        good = [r for r in good if r[0] is not None and r[2] is not None]
    return [(i, floors(v), label) for i, v, label in good]


# ---- hard negatives ------------------------------------------------------------------------------


def mined(rows, every, most=5):
    """All scores in plain Python."""
    seen = {(i, tuple(v), label) for i, v, label in whole(rows)}
    out = set()
    for i, v, label in seen:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in seen if j != i]
        scored.sort()
        for positive, j, _ in [s for s in scored if s[2] == label][:most]:
            inside = [
                (n, k) for n, k, other in scored
                if other != label and 80 * -positive <= 100 * -n <= 100 * -positive
            ]
            out |= {(i, j, r + 1, k, -positive, -n) for r, (n, k) in enumerate(inside[:most])}
    return out


@pytest.mark.parametrize(
    ("rows", "every"),
    [
        (some_vectors(160, 12, 1), 10),
        (some_vectors(90, 20, 2, labels=2, spread=0.1), 7),
        (some_vectors(60, 4, 3) + ODD, 6),
        ([(i, [0.5, 0.25], i % 2) for i in range(40)], 8),  # all scores tie
        ([(i, [0.0, 0.0, 0.0], i % 2) for i in range(20)], 5),
        ([(i, [-1.0 if i % 2 else 1.0, 0.0], 0) for i in range(6)], 2),  # no other label
        ([(i, [2.0**i, -(2.0 ** (8 - i))], i % 2) for i in range(9)], 3),
    ],
)
def test_negatives_match_all_scores(spark, monkeypatch, rows, every):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 32)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 4)
    found = negatives.mine(
        table(spark, rows), "vec_id", "label", "embedding", F.col("id") % every == 0
    )
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == mined(rows, every)


def test_negatives_of_nothing(spark):
    for rows in ([], ODD[:7]):
        found = negatives.mine(table(spark, rows), "vec_id", "label", "embedding", F.col("id") % 2 == 0)
        assert found.collect() == []


@pytest.mark.parametrize("share", [0.0, 0.2, 0.5, 0.9])
def test_index_finds_all_at_a_threshold_and_posts_less(share):
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(400, 40)) * 1.4 ** -np.arange(40) * 500).astype(np.int64)
    anchors = (rng.normal(size=(7, 40)) * 1.4 ** -np.arange(40) * 500).astype(np.int64)
    norms, own = negatives.suffix_norms(rows), negatives.suffix_norms(anchors)
    level = int(share * norms[:, 0].max() * own[:, 0].min())
    reach = own.max(axis=0) / level if level else np.full(norms.shape[1], np.inf)
    index = negatives.Index(rows, norms, reach)
    if share >= 0.2:
        assert sum(index.lengths) < len(rows) * len(index.lengths)
    for a in range(len(anchors)):
        at, score = index.at_least(anchors[a], own[a], level)
        exact = rows @ anchors[a]
        assert sorted(at) == list(np.flatnonzero(exact >= level)) if level else len(at) >= 1
        assert (score == exact[at]).all()


# ---- vector codes --------------------------------------------------------------------------------


def coded(rows, parts, entries, rounds):
    """Codes, errors and codebooks in plain Python."""
    kept = whole(rows, labelled=False)
    last = 1 << 62
    first = sorted(kept, key=lambda r: (last if r[0] is None else r[0], r[1]))[:entries]
    size = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * size : (p + 1) * size]) for p in range(parts)]
    books = [list(column) for column in zip(*[cut(v) for _, v, _ in first])]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        members = [[[] for _ in book] for book in books]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                members[p][nearest(part, books[p])[1]].append(part)
        books = [
            [tuple(sum(c) // len(m) for c in zip(*m)) if m else e for m, e in zip(of, book)]
            for of, book in zip(members, books)
        ]
    out = Counter()
    for i, v, label in kept:
        near = [nearest(part, books[p]) for p, part in enumerate(cut(v))]
        out[i, label, "".join(f"{e:02x}" for _, e in near), sum(far for far, _ in near)] += 1
    return out, books


@pytest.mark.parametrize(
    ("rows", "parts", "entries"),
    [
        (some_vectors(300, 8, 4), 2, 16),
        (some_vectors(120, 12, 5, spread=0.2), 4, 7),
        (some_vectors(50, 4, 6) + ODD, 2, 64),
        ([(i, [0.5, -0.25], 1) for i in range(30)], 1, 8),
        ([(7, [0.1 * i, -0.3 * i], None) for i in range(12)], 2, 4),  # one id, one null label
    ],
)
def test_codes_match_plain_rounds(spark, monkeypatch, rows, parts, entries):
    monkeypatch.setattr(codes, "BRANCH", 4)
    monkeypatch.setattr(codes, "TRIE_ROWS", 64)
    kept = codes.kept(table(spark, rows), "vec_id", "embedding", "label", parts)
    books = codes.fit(kept, parts, entries, rounds=2)
    expected, plain = coded(rows, parts, entries, 2)
    assert books.entries.tolist() == [[list(e) for e in book] for book in plain]
    done = codes.with_label_error(codes.encode(kept, books)).toPandas()
    got = Counter(
        (None if i != i else i, None if y != y else y, c.hex(), e)
        for i, y, c, e in zip(done["id"], done["label"], done["codes"], done["error"])
    )
    assert got == expected
    for _, group in done.groupby("label", dropna=False):
        assert set(group["label_error"]) == {group["error"].sum()}


def test_walk_is_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(7)
    entries = rng.integers(-20, 20, size=(13, 4))
    leaves, place, weight = codes.distinct_parts(rng.integers(-6, 6, size=(900, 4)))
    far = ((leaves[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for branch in (1, 10, 5000):
        monkeypatch.setattr(codes, "BRANCH", branch)
        best, error = codes.walk(leaves, entries)
        assert (best == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
    assert weight.sum() == len(place) == 900


def test_codes_give_vectors_back_and_survive_odd_tables(spark):
    rows = some_vectors(40, 4, 8)
    kept = codes.kept(table(spark, rows), "vec_id", "embedding", "label", 2)
    books = codes.fit(kept, 2, 256)
    back = codes.decode(codes.encode(kept, books), books).toPandas()
    own = {i: v for i, v, _ in whole(rows, labelled=False)}
    for r in back.itertuples():
        assert sum((a - b) ** 2 for a, b in zip(own[r.id], r.v)) == r.error
    for odd in ([], ODD[1:5], [(1, [1.0, 2.0, 3.0], 1)]):
        kept = codes.kept(table(spark, odd), "vec_id", "embedding", "label", 2)
        books = codes.fit(kept, 2)
        assert codes.with_label_error(codes.encode(kept, books)).collect() == []
        assert len(books.digest()) == 64


# ---- mixing --------------------------------------------------------------------------------------


def sizes_to_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; the excess of capped sources goes to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-8")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level > most * sizes[s]}
        if not above:
            out |= {s: weight[s] * level for s in free}
            break
        out |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        free -= above
    return out


def corpus(seed, texts=120):
    rng = random.Random(seed)
    rows = []
    for i in range(texts):
        source = rng.choice(["b", "b", "b", "b", "a", "Z", "é", "\U0001f600", "￮", None])
        words = [rng.choice("abcdef") + str(i) for _ in range(rng.choice([0, 1, 3, 70, 300]))]
        rows.append((i, "\t".join(words), source))
    rows += [(5, "one two", "b")] * 70 + [(None, "x y z", "b")] * 3 + [(None, "x  y z w", "b"), (9, None, "a")]
    return rows + [(800, "", "only empty"), (801, "\x0b \r", None)]


def mix_of(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select(
        "*", *[F.lit(1).alias(n) for n in ("size", "number", "block", "row", "first", "copies", "slot")]
    )
    return docs, mixing.mix(docs, "doc_id", "text", "source", **options)


def n_words(text):
    return len((text or "").split())


@pytest.mark.parametrize("options", [{}, {"per_shard": 16, "per_stretch": 3}, {"block": 7, "per_shard": 40}])
def test_mix_meets_targets(spark, options):
    rows = corpus(1)
    docs, mixed = mix_of(spark, rows, **options)
    taken = mixed.taken().collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += n_words(text)
    goals = sizes_to_targets(sizes)
    assert Counter((r.doc_id, r.source, r["size"]) for r in taken) == Counter(
        (i, s, n_words(t)) for i, t, s in rows
    )
    by_source = Counter()
    for r in taken:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goals[r.source])
        by_source[r.source] += r.taken
    block = options.get("block", mixing.BLOCK)
    for source, target in goals.items():
        assert abs(by_source[source] - target) <= block
    again = mix_of(spark, random.Random(3).sample(rows, len(rows)), **options)[1].taken().collect()
    assert sorted(map(repr, again)) == sorted(map(repr, taken))


def test_mix_sequences_are_blocks_of_the_streams(spark):
    rows = corpus(2, 60)
    docs, mixed = mix_of(spark, rows, per_shard=8, per_stretch=2, block=10)
    listed = mixed.sequences(docs, "doc_id", "text", "source").toPandas()
    slots = mixed.slots.toPandas()
    goals = mixed.targets.toPandas().set_index("number")
    assert len(listed) == len(slots) == goals["quota"].sum()
    assert not slots.duplicated(["shard", "slot"]).any()
    assert (listed["words"].str.len() <= 10).all()
    # every pass over a source is a permutation of its blocks
    for number, group in slots.groupby("number"):
        times = Counter(group["block"])
        assert set(times) <= set(range(goals.loc[number, "blocks"]))
        assert max(times.values()) - min(times.get(b, 0) for b in range(goals.loc[number, "blocks"])) <= 1
    # the words of all slots are those that rows were charged for
    words = Counter(w for line in listed["words"] for w in line)
    charged = Counter()
    for r in mixed.taken().collect():
        charged[r.source] += r.taken
    assert sum(words.values()) == sum(charged.values())
    plan = mixed.plan().toPandas()
    for (_, _), pieces in plan.groupby(["shard", "slot"]):
        pieces = pieces.sort_values("at")
        ends = (pieces["at"] + pieces["length"]).tolist()
        assert pieces["at"].tolist() == [0, *ends[:-1]]


def test_shards_draw_by_what_is_left():
    left = np.array([4000, 1000, 0, 3000])
    rng = np.random.default_rng(0)
    draws = np.array([mixing.draw_shard(left, 800, rng) for _ in range(400)])
    assert (draws.sum(axis=1) == 800).all() and (draws[:, 2] == 0).all()
    assert np.allclose(draws.mean(axis=0), [400, 100, 0, 300], atol=4)
    # the spread of a multinomial law
    assert np.allclose(draws.std(axis=0), np.sqrt(800 * np.array([0.25, 0.109375, 0, 0.234375])), rtol=0.15)
    short = np.array([1, 0, 5000])
    assert (mixing.draw_shard(short, 4000, rng) <= short).all()
    assert mixing.draw_shard(short, 9000, rng).tolist() == short.tolist()


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_permutations(size):
    seen = {tuple(mixing.permuted(np.arange(size), size, (1, 2, p))) for p in range(3)}
    assert all(sorted(p) == list(range(size)) for p in seen)
    assert size < 4 or len(seen) > 1


def test_stretches_share_quotas_out(spark):
    quotas = [0, 1, 2, 5, 63, 64, 1000, 12345]
    goals = spark.createDataFrame([(n, 10, q) for n, q in enumerate(quotas)], "number long, blocks long, quota long")
    for count in (1, 7, 64):
        parts = mixing.stretches(goals, count).toPandas()
        assert ((parts["share"] > 0) & (parts["stretch"] >= 0) & (parts["stretch"] < count)).all()
        for number, quota in enumerate(quotas):
            own = parts[parts["number"] == number].sort_values("stretch")
            assert own["share"].sum() == quota
            if quota:
                assert own["turn"].tolist() == [0, *own["share"].cumsum().tolist()[:-1]]


def test_mix_of_nothing(spark):
    for rows in ([], [(1, None, None), (2, "", "a")]):
        taken = mix_of(spark, rows)[1].taken().collect()
        assert len(taken) == len(rows)
        assert all(r.taken == 0 and r.target == 0 for r in taken)
