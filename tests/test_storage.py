import json
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from digestry.catalog.feeds import frozen_references
from digestry.functions import prompts
from digestry.plans import corpus, feed, report
from digestry.session import shared_dir, work_path
from digestry.sources import ingest, pairs, results, shards
from digestry.streaming.feed import clean, start_feed
from tests.test_operators import PAIR_SCHEMA, brute_funnel, skewed_pairs

SHARD_CASES = [  # total, rows per shard, minimum, expected sizes
    (10, 100, 1, [10]),
    (10, 3, 1, [3, 3, 3, 1]),
    (5, 100, 4, [2, 2, 1, 0]),
    (0, 100, 1, [0]),
    (9, 3, 1, [3, 3, 3]),
    (0, 100, 0, []),
]


@pytest.mark.parametrize("total, per_shard, least, expected", SHARD_CASES)
def test_shard_plan(spark, total, per_shard, least, expected):
    totals = spark.createDataFrame([(total,)], "total long")
    rows = shards.shard_plan(totals, per_shard, least).orderBy("shard").collect()
    assert [r["n_rows"] for r in rows] == expected
    if rows:
        assert rows[0]["label"] == f"data-00000-of-{len(expected):05d}"


@pytest.mark.parametrize("total, per_shard, least, expected", SHARD_CASES[:5])
def test_shards_written_once_each_in_order(spark, total, per_shard, least, expected):
    df = spark.range(100, 100 + total).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("document"))
    path = work_path(spark, "t")
    shards.write_sharded(df.repartition(3), path, ["row_id"], (), per_shard, least)
    back = spark.read.parquet(path)
    if total:
        files = back.select("shard", F.input_file_name().alias("f")).distinct().collect()
        assert len(files) == len({r["shard"] for r in files}) == sum(1 for n in expected if n)
    start = 100
    for shard, n in enumerate(expected):
        got = [r["row_id"] for r in back.where(F.col("shard") == shard).collect()]
        assert got == list(range(start, start + n))
        start += n


def test_shard_choice(spark):
    path = work_path(spark, "t")
    df = spark.range(50).withColumnRenamed("id", "row_id")
    shards.write_sharded(df, path, ["row_id"], (), 10)
    listed = shards.scan_shards(spark, path, [3, 1, 99])
    assert {(r["shard_rank"], r["shard"]) for r in listed.collect()} == {(0, 3), (1, 1)}
    assert shards.scan_shards(spark, path, [1], shard_offset=4).count() == 10
    assert shards.scan_shards(spark, path, shard_offset=3).count() == 20
    assert shards.scan_shards(spark, path, shard_offset=9).count() == 0
    assert shards.scan_shards(spark, path, []).count() == 0
    text = listed._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "IN (3,1,99)" in text.replace("cast(", "")
    twice = shards.scan_shards(spark, path, [1, 3, 1]).groupBy("shard_rank", "shard").count()
    assert {tuple(r) for r in twice.collect()} == {(0, 1, 10), (1, 3, 10), (2, 1, 10)}
    for bad in ([-1],):
        with pytest.raises(ValueError):
            shards.scan_shards(spark, path, bad)


def test_process_writes_survivors(spark):
    rows = skewed_pairs(11, 400)
    df = spark.createDataFrame(rows, PAIR_SCHEMA).repartition(5)
    path = work_path(spark, "t")
    corpus.process(df, path, rows_per_shard=40)
    _, kept = brute_funnel(rows)
    back = spark.read.parquet(path).collect()
    assert {(r["split"], r["row_id"]) for r in back} == kept
    by_id = {r[0]: r for r in rows}
    for r in back:
        _, _, source, document, summary = by_id[r["row_id"]]
        assert (r["source"], r["document"], r["summary"]) == (source, document, summary)
        assert r["text"] == prompts.SUMMARIZE.text(document) + summary
    for split in {s for s, _ in kept}:
        ids = sorted(i for s, i in kept if s == split)
        n = -(-len(ids) // 40)
        size = -(-len(ids) // n)
        assert all(r["shard"] == ids.index(r["row_id"]) // size for r in back if r["split"] == split)


def test_training_feed_window_epochs_and_plan(spark):
    path = work_path(spark, "t")
    df = spark.range(60).select(
        F.col("id").alias("row_id"), F.lit("s").alias("source"), F.lit("sum").alias("summary"),
        F.concat(F.lit("doc "), F.col("id")).alias("document"),
    )
    shards.write_sharded(df, path, ["row_id"], (), 10)
    rows = feed.training_feed(spark, path, shards=[4, 0], offset=5, max_rows=8, epochs=2).collect()
    order = list(range(40, 50)) + list(range(10))
    for epoch in (0, 1):
        assert sorted(r["row_id"] for r in rows if r["epoch"] == epoch) == sorted(order[5:13])
    assert set(rows[0].asDict()) == {"row_id", "shard", "shard_rank", "epoch", "shuffle_key", "text"}
    late = feed.validation_feed(spark, path, shard_offset=5, offset=100)
    assert late.count() == 0
    cases = [((0, None, 2, 4, 1), (60, 8, 8, 1)), ((50, None, 2, 4, 3), (10, 2, 6, 1)),
             ((70, 5, 2, 4, 1), (0, 0, 0, 1)), ((10, 20, 1, 1, 10), (20, 20, 200, 6))]
    for (offset, cap, batch, accumulation, epochs), expected in cases:
        row = feed.plan_steps(df, offset, cap, batch, accumulation, epochs, 0.03).first()
        assert tuple(row) == expected


def write_source(spark, root, split, rows, columns):
    spark.createDataFrame(rows, columns).write.parquet(f"{root}/{split}")


def test_prepare_discover_and_scan(spark):
    root, out = work_path(spark, "raw"), work_path(spark, "pairs")
    news, books = f"{root}/news", f"{root}/books"
    for split, n in (("train", 5), ("validation", 2), ("test", 1)):
        write_source(spark, news, split, [(i, f"a  {i}", f"h{i} ") for i in range(n)], "id long, article string, highlights string")
        write_source(spark, books, split, [(i, f"c {i}", "" if i else "s") for i in range(n)], "id long, chapter string, summary_text string")
    specs = [
        pairs.SourceSpec("news", news, "article", "highlights", keep=("id",)),
        pairs.known_source("booksum", books, keep=("id",)),
    ]
    corpus.prepare(spark, specs, out, ["id"], limit_rows=3)
    spark.createDataFrame([("d", "s")], "document string, summary string").write.parquet(f"{out}/dataset=processed/split=train")
    found = [tuple(r) for r in pairs.discover(spark, out).collect()]
    assert found == [
        ("booksum", "test", 1), ("booksum", "train", 1), ("booksum", "validation", 1),
        ("news", "test", 1), ("news", "train", 3), ("news", "validation", 2),
    ]
    train = pairs.scan_split(spark, out, "train")
    assert {(r["source"], r["id"], r["document"]) for r in train.collect()} == {
        ("booksum", 0, "c 0"), ("news", 0, "a 0"), ("news", 1, "a 1"), ("news", 2, "a 2"),
    }
    assert pairs.scan_split(spark, out, "train", ["news"]).count() == 3
    with pytest.raises(FileNotFoundError):
        pairs.scan_split(spark, out, "train", ["absent"], required=True)
    with pytest.raises(FileNotFoundError):
        pairs.combine({})
    with pytest.raises(FileNotFoundError):
        pairs.discover(spark, news)


def docx(paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    xml = (
        '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
        f"<w:body>{body}</w:body></w:document>"
    )
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr("word/document.xml", xml)
    return held.getvalue()


def test_ingest(spark, tmp_path):
    (tmp_path / "a.txt").write_text("First line\nsame paragraph\n\n\nSecond  one\r\n\r\nThird")
    (tmp_path / "b.docx").write_bytes(docx(["Head", " ", "Body text"]))
    plain = ingest.ingest_text(spark, str(tmp_path / "*.txt")).first()
    assert plain["document"] == "First line same paragraph\n\nSecond one\n\nThird"
    assert plain["path"].endswith("a.txt")
    word = ingest.ingest_binary(spark, str(tmp_path)).collect()
    assert [r["document"] for r in word] == ["Head\n\nBody text"]


def test_result_sinks(spark):
    path, text_path, json_path = (work_path(spark, n) for n in ("scores", "text", "json"))

    def table(strategy, value):
        rows = [(strategy, s, m, value) for s in ("base", "adapter") for m in ("rouge1", "bleu4")]
        return spark.createDataFrame(rows, "strategy string, system string, metric string, value double")

    results.append_scores(table("a", 1.0), path)
    results.append_scores(table("b", 2.0), path)
    results.append_scores(table("b", 3.0), path)
    back = spark.read.parquet(path)
    assert {(r["strategy"], r["value"]) for r in back.collect()} == {("a", 1.0), ("b", 3.0)}
    got = {r["strategy"]: r["json"] for r in results.scores_json(back).collect()}
    assert got["a"] == '{"adapter":{"bleu4":1.0,"rouge1":1.0},"base":{"bleu4":1.0,"rouge1":1.0}}'
    results.write_json(back, json_path)
    (line,) = spark.read.text(json_path).collect()
    each = {"base": {"bleu4": 1.0, "rouge1": 1.0}, "adapter": {"bleu4": 1.0, "rouge1": 1.0}}
    assert json.loads(line["value"])["a"] == each and set(json.loads(line["value"])) == {"a", "b"}
    results.write_summaries(
        spark.createDataFrame([("s\n1", 1)], "summary string, n int"), text_path, ["n"]
    )
    lines = [json.loads(r["value"]) for r in spark.read.text(text_path).collect()]
    assert lines == [{"n": 1, "summary": "s\n1"}]


def test_stream_equals_batch_and_resumes(spark):
    rows = spark.createDataFrame(skewed_pairs(21, 300), PAIR_SCHEMA)
    keys, fences = frozen_references(rows)
    inbox, out, progress = (work_path(spark, n) for n in ("inbox", "out", "progress"))
    columns = ["split", "row_id", "source", "document", "summary"]
    early, late = rows.where("row_id < 200").select(columns), rows.where("row_id >= 200").select(columns)
    early.repartition(2).write.parquet(inbox)
    for _ in range(2):  # the second start finds nothing new
        start_feed(spark, inbox, out, progress, keys, fences, files_per_trigger=1).awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == clean(early, keys, fences).count()
    late.write.mode("append").parquet(inbox)
    start_feed(spark, inbox, out, progress, keys, fences).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(*columns, "text").collect())
    assert got == sorted(tuple(r) for r in clean(rows, keys, fences).select(*columns, "text").collect())
    assert len(got) > first


def test_report_tables(spark):
    tables = report.corpus_report(spark.createDataFrame(skewed_pairs(2, 80), PAIR_SCHEMA))
    assert {n for n, t in tables.items() if t.columns} == set(tables)
    assert tables["scatter"].count() == 80


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
