"""The registered queries and the pipeline, on whole small tables."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from digestry.llm import pii, rules, simhash, toxicity
from check import compare
from digestry.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.conftest import EDGES
from tests.llm.test_operators import check_packed

SF = "/root/testdata/sf0.001"
RESULTS = {
    "op1_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op2_ann": {"query_id", "rank", "vec_id", "score"},
    "op3_brown": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_rules": {"doc_id", *rules.BASE, "base_failed", "kept"},
    "op6_gam": {"doc_id", "held_out", "score", "predicted"},
    "op7_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_negatives": {
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op12_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op13_mixing": {"doc_id", "size", "source_size", "target", "taken"},
}


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"]


def rows(spark, name):
    return QUERIES[name](spark, SF).toPandas()


def test_names_and_columns(spark):
    assert set(QUERIES) == set(RESULTS)
    for name in ("op1_pii", "op4_bpe", "op5_rules"):
        assert RESULTS[name] <= set(QUERIES[name](spark, SF).columns)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    outcome = compare(QUERIES[name](spark, SF), SF, ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_bpe_and_pii_digests(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in rows(spark, "op4_bpe").itertuples():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    for r in rows(spark, "op1_pii").itertuples():
        base = brute.spans(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (r.n_email, r.n_card) == tuple(sum(k == n for k, *_ in base) for n in ("email", "card"))


@pytest.mark.parametrize("name", ["op6_gam", "op10_toxicity"])
def test_verdict_rows(spark, texts, name):
    parts, held_out, threshold = (3, 1, 0.5) if name == "op6_gam" else (4, 2, 0.3)
    got = rows(spark, name)
    assert set(got.columns) == RESULTS[name] and sorted(got["doc_id"]) == sorted(texts.index)
    for r in got.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == held_out)
        assert r.predicted == int(r.score >= threshold)


def test_pipeline_stage_by_stage(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality_rules", "simhash", "pii", "packing",
    ]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    mild = stage["toxicity"](spark, docs, SF).cache()
    scored = toxicity.score(docs, "text", toxicity.fit(docs, labels), "t").toPandas()
    expected = set(scored[scored["t"] < toxicity.THRESHOLD]["doc_id"])
    assert {r["doc_id"] for r in mild.collect()} == expected and mild.columns == docs.columns
    good = stage["quality_rules"](spark, mild, SF).cache()
    judged = rules.judge(mild, "text", "q").where("q.kept").select("doc_id").toPandas()
    assert {r["doc_id"] for r in good.collect()} == set(judged["doc_id"])
    single = stage["simhash"](spark, good, SF).cache()
    left = sorted(r["doc_id"] for r in good.collect())
    root = brute.groups([brute.simhash(texts[i]) for i in left], lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(left[i] for i in set(root))
    masked = stage["pii"](spark, single, SF).cache()
    assert masked.columns == docs.columns
    for r in masked.collect():
        assert brute.spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        assert r["text"] == texts[r["doc_id"]] or brute.spans(texts[r["doc_id"]])
    packed = stage["packing"](spark, masked, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, _ = check_packed(packed, {r["doc_id"]: r["text"] for r in masked.collect()}, library, 2048)
    assert set(by_doc) == {r["doc_id"] for r in masked.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == set(by_doc)


def test_pipeline_stages_on_edge_rows(spark, docs):
    for given in (docs(EDGES), docs([])):
        assert corpus_pipeline.keep_good(spark, given, SF).columns == given.columns
        kept = corpus_pipeline.drop_near_copies(spark, given, SF)
        ids = [r["doc_id"] for r in kept.collect()]
        assert len(ids) == len(set(ids)) == simhash.near_duplicates(given, "doc_id", "text").select(
            "component_id"
        ).distinct().count()
        masked = corpus_pipeline.mask_personal(spark, given, SF).collect()
        assert sum(r["text"] is None for r in masked) == (1 if masked else 0)
        corpus_pipeline.pack(spark, given, SF).count()
        assert pii.find(given, "text", "spans_").count() == given.count()


def test_pipeline_keeps_one_row_of_each_text(spark):
    """Ids may be null and may repeat with other texts: no text is lost, none stays twice."""
    a, b, c, d = "alpha beta gamma delta", "one two three four", "red green blue white", "uno dos tres"
    rows = [(1, a), (1, b), (None, c), (2, b), (3, d), (3, d), (None, c), (4, None), (None, "")]
    given = spark.createDataFrame(
        [(i, t, "en", "s", 0) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    kept = corpus_pipeline.drop_near_copies(spark, given, SF)
    assert kept.columns == given.columns
    left = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(left, key=repr) == sorted([(1, a), (1, b), (None, c), (3, d), (4, None)], key=repr)


def test_pipeline_toxicity_on_edge_rows(spark, docs):
    for given in (docs(EDGES), docs([])):
        kept = corpus_pipeline.drop_toxic(spark, given, SF)
        assert kept.columns == given.columns
        left = [r["text"] for r in kept.collect()]
        assert len(left) == len(EDGES) * (given.count() > 0)  # none of them is toxic
