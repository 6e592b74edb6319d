"""Queries that once took a part of their rows give all of them."""

import pytest

from digestry.catalog import QUERIES

ROWS = 9_000


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with more short documents than any former limit; every ninth is blank."""
    folder = str(tmp_path_factory.mktemp("many"))
    text = "CASE WHEN id % 9 = 0 THEN ' \t' ELSE concat('head ', id, '\n', repeat('word ', CAST(id % 5 AS INT))) END"
    rows = spark.range(ROWS).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'web' AS source")
    rows.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    return folder


def inked(condition=lambda i: True):
    return {i for i in range(ROWS) if i % 9 and condition(i)}


def test_eval_sample_has_every_test_row(spark, many):
    got = QUERIES["eval_sample"](spark, many).collect()
    assert {r["row_id"] for r in got} == inked(lambda i: i % 10 == 1)
    assert len(got) > 500


def test_step_plan_counts_every_prepared_row(spark, many):
    got = QUERIES["step_plan"](spark, many).first()
    assert got["num_rows"] == len(inked()) - 100
    assert got["steps_per_epoch"] == -(-got["num_rows"] // 8)


def test_scatter_sample_has_every_row(spark, many):
    got = {r["row_id"]: (r["dw"], r["sw"]) for r in QUERIES["scatter_sample"](spark, many).collect()}
    assert got == {i: (2 + i % 5, 2) for i in inked()}


def test_rouge_per_pair_has_every_metric_of_whole_documents(spark, many):
    rows = QUERIES["rouge_per_pair"](spark, many)
    assert rows.columns[3:] == ["rouge1", "rouge2", "rougeL"]
    # Document "head 14 word word word word" against "head 14": every third word is left out.
    got = {(r["system"], r["strategy"]): r["rougeL"] for r in rows.where("row_id = 14").collect()}
    assert len(got) == 6 and got["adapter", "map-refine"] == round(2 * 0.25 * 0.5 / 0.75, 6)


def test_compare_systems_has_every_metric_of_whole_documents(spark, many):
    got = QUERIES["compare_systems"](spark, many).collect()
    assert {r["metric"] for r in got} == {"rouge1", "rouge2", "rougeL", "bleu4"} and len(got) == 12


@pytest.fixture(scope="module")
def long(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("long"))
    words = " ".join(f"w{i}" for i in range(60))
    few = spark.createDataFrame([(1, words, "en", "web")], "doc_id long, text string, lang string, source string")
    few.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_extract_abstract_gives_thirty_words(spark, long):
    (row,) = QUERIES["extract_abstract"](spark, long).collect()
    assert len(row["summary"].split()) == 30


def test_result_json_scores_thirty_and_forty_words(spark, long):
    got = {(r["strategy"], r["system"]): r["value"] for r in QUERIES["result_json"](spark, long).where("metric = 'rougeL'").collect()}
    assert len(got) == 6  # 30 or 40 of 60 words: F is 2 * 30 / 90 or 2 * 40 / 100
    assert {k[1]: v for k, v in got.items()} == {"base": 0.6667, "adapter": 0.8}
