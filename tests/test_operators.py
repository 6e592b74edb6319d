import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestry.operators import dedup, filters, order, profile, quantiles
from digestry.plans import corpus


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {
        "hot": [1.5] * 400 + [rng.uniform(-3, 3) for _ in range(200)],
        "ints": [float(rng.randint(-50, 5000)) for _ in range(333)],
        "one": [7.25],
        "two": [0.0, 1e-12],
        "flat": [2.0] * 5,
        "huge": [rng.random() * 10 ** rng.randint(-8, 12) for _ in range(100)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("one", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.75, 1.0)
    for closed in (True, False):
        got = quantiles.exact_quantiles(df, ["g"], {"x": F.col("x")}, probs, closed=closed).collect()
        assert len(got) == len(groups)
        for row in got:
            values = np.array(groups[row["g"]])
            assert row["n"] == len(values)
            assert (row["min_value"], row["max_value"]) == (values.min(), values.max())
            np.testing.assert_allclose(row["q"], np.quantile(values, probs), rtol=1e-12, atol=1e-15)


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 4.0, 1), ("a", 9.0, 4)], "g string, x double, w int")
    row = quantiles.exact_quantiles(df, ["g"], {"x": F.col("x")}, (0.25, 0.5, 0.9), F.col("w")).first()
    np.testing.assert_allclose(row["q"], np.quantile([1, 1, 1, 4, 9, 9, 9, 9], (0.25, 0.5, 0.9)))


def test_hard_bounds(spark):
    def kept(dw, sw):
        df = spark.createDataFrame([(" ".join(["d"] * dw), " ".join(["s"] * sw))], "document string, summary string")
        return filters.hard_filter(filters.with_lengths(df)).count() == 1

    cases = [(dw, 10) for dw in (19, 20, 10000, 10001)] + [(600, sw) for sw in (4, 5, 500, 501)]
    cases += [(20, 19), (20, 20), (20, 21)]
    expected = [20 <= d <= 10000 and 5 <= s <= 500 and s < d for d, s in cases]
    rows = [(i, " ".join(["d"] * d), " ".join(["s"] * s)) for i, (d, s) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, document string, summary string")
    got = {r["i"] for r in filters.hard_filter(filters.with_lengths(df)).collect()}
    assert got == {i for i, keep in enumerate(expected) if keep}
    assert kept(20, 5)


def test_fences_inclusive_and_flat_groups(spark):
    # Quartiles 1 and 3 give fences -2 and 6; the value 6 lies on the fence.
    edge = [0.0, 1.0, 2.0, 3.0, 6.0]
    q1, q3 = np.quantile(edge, [0.25, 0.75])
    assert q3 + 1.5 * (q3 - q1) == 6.0
    rows = [("edge", v) for v in edge] + [("flat", 1.0)] * 6 + [("flat", 99.0)] + [("single", 5.0)]
    df = spark.createDataFrame(rows, "split string, ratio double")
    kept = Counter(r["split"] for r in filters.iqr_filter(df).collect())
    assert kept == {"edge": 5, "flat": 7, "single": 1}
    masked = filters.outlier_mask(df).where("is_outlier").collect()
    assert [(r["split"], r["ratio"]) for r in masked] == [("flat", 99.0)]
    assert filters.iqr_filter(df, closed=False).count() == 13


def test_required_columns_and_nulls(spark):
    df = spark.createDataFrame([("a  b", "s"), (None, "s"), ("x", " "), ("y", None)], "d string, s string")
    assert [tuple(r) for r in filters.to_pairs(df, "d", "s").collect()] == [("a b", "s")]
    with pytest.raises(ValueError, match="article"):
        filters.to_pairs(df, "article", "s", name="news")
    assert filters.with_source(df, "x").columns == ["d", "s", "source"]
    assert filters.with_source(filters.with_source(df, "x"), "y").first()["source"] == "x"


def skewed_pairs(seed=5, n=600):
    """A third of all rows are copies of one document; others repeat now and then."""
    rng = random.Random(seed)
    hot = " ".join(f"h{i}" for i in range(40))
    rows = []
    for i in range(n):
        split = rng.choice(["train", "train", "train", "validation", "test"])
        if rng.random() < 0.33:
            document = hot if split != "test" or rng.random() < 0.5 else hot + " t"
        else:
            document = " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.choice([3, 25, 60, 61])))
            if rows and rng.random() < 0.3:
                document = rng.choice(rows)[3]
        summary = " ".join(f"s{rng.randint(0, 9)}" for _ in range(rng.choice([2, 5, 6, 9, 12, 55])))
        rows.append((i, split, "src", document, summary))
    return rows


def brute_funnel(rows):
    """A plain walk over the rows: stage counts and the kept ids."""
    train = {d for _, s, _, d, _ in rows if s == "train"}
    counts, kept = {}, set()
    for split in ("train", "validation", "test"):
        mine = [r for r in rows if r[1] == split]
        clean = [r for r in mine if split == "train" or r[3] not in train]
        hard = [
            r for r in clean
            if 20 <= len(r[3].split()) <= 10000 and 5 <= len(r[4].split()) <= 500
            and len(r[4].split()) < len(r[3].split())
        ]
        inside = hard
        if hard:
            ratio = [len(r[4].split()) / max(len(r[3].split()), 1) for r in hard]
            q1, q3 = np.quantile(ratio, [0.25, 0.75])
            if q3 != q1:
                lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
                inside = [r for r, v in zip(hard, ratio) if lo <= v <= hi]
        first = {}
        for r in inside:
            first.setdefault(hashlib.sha256(r[3].encode()).hexdigest(), r[0])
        kept |= {(split, i) for i in first.values()}
        if mine:
            counts[split] = (len(mine), len(clean), len(hard), len(inside), len(first))
    return counts, kept


PAIR_SCHEMA = "row_id long, split string, source string, document string, summary string"


@pytest.mark.parametrize("seed", [5, 6])
def test_funnel_on_skewed_copies(spark, seed):
    rows = skewed_pairs(seed)
    counts, kept = brute_funnel(rows)
    df = spark.createDataFrame(rows, PAIR_SCHEMA).repartition(6)
    stages = ("input", "after_leakage", "after_hard", "after_iqr", "after_dedup")
    got = {r["split"]: tuple(r[s] for s in stages) for r in corpus.prep_funnel(df).collect()}
    assert got == counts
    assert {tuple(r) for r in corpus.survivors(df).collect()} == kept


def test_dedup_leakage_and_overlap(spark):
    rows = skewed_pairs(9, 300)
    df = spark.createDataFrame(rows, PAIR_SCHEMA).repartition(4)
    first = {}
    for i, split, _, document, _ in rows:
        first.setdefault((split, document), i)
    once = dedup.dedup_first(df)
    assert {r["row_id"] for r in once.collect()} == set(first.values())
    assert dedup.dedup_first(once).count() == len(first)
    train = {r[3] for r in rows if r[1] == "train"}
    clean = dedup.drop_leaked(df.where("split != 'train'"), df.where("split = 'train'"))
    expected = sorted(r[0] for r in rows if r[1] != "train" and r[3] not in train)
    assert sorted(r["row_id"] for r in clean.collect()) == expected
    sets = {s: {r[3] for r in rows if r[1] == s} for s in dedup.SPLITS}
    overlap = {(r["split_a"], r["split_b"]): r["shared"] for r in dedup.split_overlap(df).collect()}
    assert overlap == {
        (a, b): len(sets[a] & sets[b])
        for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))
    }
    leaked = {r["split"]: r["leaked"] for r in dedup.leakage_counts(df).collect()}
    assert leaked == {
        s: sum(1 for r in rows if r[1] == s and r[3] in train) for s in ("validation", "test")
    }


def test_positions_and_windows(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(i, i % 3) for i in ids], "row_id long, g int").repartition(7)
    got = {r["row_id"]: r["pos"] for r in order.positions(df, ["row_id"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    grouped = order.positions(df, ["row_id"], ["g"]).collect()
    for g in range(3):
        mine = sorted(i for i in ids if i % 3 == g)
        assert {r["row_id"]: r["pos"] for r in grouped if r["g"] == g} == {v: i for i, v in enumerate(mine)}
    for offset, limit in ((0, None), (0, 5), (490, 50), (500, 3), (10, 0), (17, 100)):
        window = order.row_window(df, ["row_id"], offset, limit)
        end = None if limit is None else offset + limit
        assert sorted(r["row_id"] for r in window.collect()) == sorted(ids)[offset:end]
    composite = order.row_window(df, ["g", "row_id"], 100, 200).collect()
    expected = sorted((i % 3, i) for i in ids)[100:300]
    assert sorted((r["g"], r["row_id"]) for r in composite) == expected
    with pytest.raises(ValueError):
        order.row_window(df, ["row_id"], -1, 5)
    assert "SinglePartition" not in plan(order.row_window(df, ["row_id"], 17, 100))


def test_group_head_with_a_hot_group(spark):
    rows = [("hot", i) for i in range(400)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, row_id long").repartition(5)
    got = Counter((r["g"]) for r in order.group_head(df, ["g"], ["row_id"], 20).collect())
    assert got == {"hot": 20, "cold": 5}
    top = order.group_head(df, ["g"], ["row_id"], 20).where("g = 'hot'").agg(F.max("row_id"))
    assert top.first()[0] == 19
    assert order.group_head(df, ["g"], ["row_id"], 0).count() == 0


def test_shuffle_is_a_permutation_per_epoch(spark):
    df = spark.range(200).withColumnRenamed("id", "row_id")
    rows = order.seeded_shuffle(order.repeat_epochs(df, 2), "row_id", 42, "epoch").collect()
    first = [r["row_id"] for r in rows if r["epoch"] == 0]
    second = [r["row_id"] for r in rows if r["epoch"] == 1]
    assert sorted(first) == sorted(second) == list(range(200))
    assert first != second and first != sorted(first)
    again = order.seeded_shuffle(order.repeat_epochs(df.repartition(3), 2), "row_id", 42, "epoch")
    assert [r["row_id"] for r in again.collect()] == [r["row_id"] for r in rows]


def test_histogram_edges(spark):
    def pair(split, dw, sw):
        return (split, " ".join(["d"] * dw), " ".join(["s"] * sw))

    values = [1, 2, 2, 5, 9, 10]
    df = spark.createDataFrame(
        [pair("a", v, 3) for v in values] + [pair("b", 4, 4)], "split string, document string, summary string"
    )
    rows = profile.histogram(df, ["dw", "sw"], bins=4).collect()
    counts, edges = np.histogram(values, bins=4)
    mine = {r["bin"]: r for r in rows if r["split"] == "a" and r["feature"] == "dw"}
    assert [mine[i]["n"] if i in mine else 0 for i in range(4)] == counts.tolist()
    density, _ = np.histogram(values, bins=4, density=True)
    for i, row in mine.items():
        np.testing.assert_allclose([row["left"], row["right"]], edges[i : i + 2])
        np.testing.assert_allclose(row["density"], density[i])
    flat = [r for r in rows if r["split"] == "a" and r["feature"] == "sw"]
    assert [(r["bin"], r["n"], r["left"]) for r in flat] == [(2, 6, 3.0)]
    assert np.histogram([3] * 6, bins=4)[0].tolist() == [0, 0, 6, 0]


def test_profile(spark):
    with pytest.raises(ValueError):
        profile.profile_pairs(spark.createDataFrame([], PAIR_SCHEMA))
    rows = skewed_pairs(3, 120)
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    wide = {r["split"]: r for r in profile.profile_wide(profile.profile_pairs(df, sample_rows=30)).collect()}
    for split, row in wide.items():
        mine = [r for r in rows if r[1] == split]
        words = [len(r[3].split()) for r in mine[:30]]
        assert (row["n_rows"], row["sample_size"]) == (len(mine), min(30, len(mine)))
        block = row["document_words"]
        assert [block["min"], block["p50"], block["max"]] == [min(words), np.median(words), max(words)]
