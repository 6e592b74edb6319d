"""Text scalars, preparation, sources and shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.registry import query
from digestry.catalog.views import (
    PAIRS,
    SOURCES,
    WORDS,
    chat_pairs,
    page_pairs,
    pairs,
    table,
)
from digestry.functions import prompts, text
from digestry.operators import dedup, filters, order, quantiles
from digestry.plans import corpus
from digestry.session import work_path
from digestry.sources import ingest
from digestry.sources import pairs as sources
from digestry.sources import shards

ROWS_PER_SHARD, MIN_SHARDS = 150, 4
SOURCE_LIMIT = 100

_TEMPLATE = tuple(part.replace("'", "''") for part in prompts.SUMMARIZE.parts)
PROMPT_SQL = f"'{_TEMPLATE[0]}' || document || '{_TEMPLATE[1]}' || summary"
HARD = "dw BETWEEN 20 AND 10000 AND sw BETWEEN 5 AND 500 AND sw < dw"
QUARTILES = "quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.75) AS q3"


@query("normalize_pairs", f"WITH {PAIRS} SELECT row_id, split, document, summary FROM pairs")
def normalize_pairs(spark, sf):
    return pairs(spark, sf).select("row_id", "split", "document", "summary")


@query(
    "word_stats",
    f"""WITH {WORDS} SELECT row_id, dw AS doc_words, sw AS sum_words, length(document) AS doc_chars,
        length(summary) AS sum_chars, round(ratio, 9) AS ratio FROM words""",
)
def word_stats(spark, sf):
    return filters.with_lengths(pairs(spark, sf), normalized=True).select(
        "row_id",
        F.col("dw").alias("doc_words"),
        F.col("sw").alias("sum_words"),
        F.char_length("document").alias("doc_chars"),
        F.char_length("summary").alias("sum_chars"),
        F.round("ratio", 9).alias("ratio"),
    )


@query("doc_hash", f"WITH {PAIRS} SELECT row_id, sha256(document) AS h FROM pairs")
def doc_hash(spark, sf):
    return pairs(spark, sf).select("row_id", text.content_hex(F.col("document")).alias("h"))


@query("hard_filter", f"WITH {WORDS} SELECT row_id, split, dw, sw FROM words WHERE {HARD}")
def hard_filter(spark, sf):
    return filters.hard_filter(filters.with_lengths(pairs(spark, sf), normalized=True)).select(
        "row_id", "split", "dw", "sw"
    )


_FENCES = f"""
fences AS (
  SELECT split, count(*) AS n, {QUARTILES} FROM words WHERE {HARD} GROUP BY split)"""


@query(
    "iqr_fences",
    f"""WITH {WORDS}, {_FENCES}
        SELECT split, n, round(q1, 9) AS q1, round(q3, 9) AS q3, round(q3 - q1, 9) AS iqr,
               round(q1 - 1.5 * (q3 - q1), 9) AS lo, round(q3 + 1.5 * (q3 - q1), 9) AS hi
        FROM fences""",
)
def iqr_fences(spark, sf):
    kept = filters.hard_filter(filters.with_lengths(pairs(spark, sf), normalized=True))
    fences = quantiles.iqr_fences(kept, ["split"], {"ratio": F.col("ratio")})
    return fences.select(
        "split", "n", *[F.round(c, 9).alias(c) for c in ("q1", "q3", "iqr", "lo", "hi")]
    )


@query(
    "iqr_filter",
    f"""WITH {WORDS}, {_FENCES}
        SELECT row_id, w.split, round(ratio, 9) AS ratio FROM words w JOIN fences f USING (split)
        WHERE {HARD} AND (q3 - q1 = 0
              OR ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
)
def iqr_filter(spark, sf):
    kept = filters.hard_filter(filters.with_lengths(pairs(spark, sf), normalized=True))
    return filters.iqr_filter(kept).select("row_id", "split", F.round("ratio", 9).alias("ratio"))


@query(
    "dedup_first",
    f"""WITH {PAIRS} SELECT split, row_id FROM pairs
        QUALIFY row_number() OVER (PARTITION BY split, document ORDER BY row_id) = 1""",
)
def dedup_first(spark, sf):
    return dedup.dedup_first(pairs(spark, sf)).select("split", "row_id")


@query(
    "first_copies",
    f"""WITH {PAIRS} SELECT split, min(row_id) AS row_id, count(*) AS copies
        FROM pairs GROUP BY split, document""",
)
def first_copies(spark, sf):
    return dedup.first_copies(pairs(spark, sf))


INDEX_BUCKETS = 16


@query(
    "leakage_anti",
    f"""WITH {PAIRS} SELECT split, row_id FROM pairs WHERE split <> 'train'
        AND document NOT IN (SELECT document FROM pairs WHERE split = 'train')""",
)
def leakage_anti(spark, sf):
    rows = pairs(spark, sf)
    evals, train = rows.where("split != 'train'"), rows.where("split = 'train'")
    return dedup.drop_leaked(evals, train).select("split", "row_id")


@query(
    "leakage_indexed",
    f"""WITH {PAIRS} SELECT split, row_id FROM pairs WHERE split <> 'train'
        AND document NOT IN (SELECT document FROM pairs WHERE split = 'train')""",
)
def leakage_indexed(spark, sf):
    """``leakage_anti`` against an index of train digests that grew by two deliveries, one of which the
    index holds in part already."""
    rows = pairs(spark, sf)
    evals, train = rows.where("split != 'train'"), rows.where("split = 'train'")
    path = work_path(spark, "digests")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    dedup.index_keys(train.where("row_id % 3 != 0"), name, path, INDEX_BUCKETS)
    index = dedup.index_keys(train.where("row_id % 3 != 1"), name, path, INDEX_BUCKETS)
    return dedup.drop_known(evals, index).select("split", "row_id")


@query(
    "leakage_counts",
    f"""WITH {PAIRS} SELECT split, count(*) FILTER (WHERE document IN
          (SELECT document FROM pairs WHERE split = 'train')) AS leaked
        FROM pairs WHERE split <> 'train' GROUP BY split""",
)
def leakage_counts(spark, sf):
    return dedup.leakage_counts(pairs(spark, sf))


_STAGES = f"""{WORDS},
clean AS (
  SELECT * FROM words WHERE split = 'train'
     OR h NOT IN (SELECT h FROM words WHERE split = 'train')),
hard AS (SELECT * FROM clean WHERE {HARD}),
quart AS (SELECT split, {QUARTILES} FROM hard GROUP BY split),
inside AS (
  SELECT hard.* FROM hard JOIN quart USING (split)
  WHERE q3 - q1 = 0 OR ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
final AS (
  SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY split, h ORDER BY row_id) = 1)"""


@query(
    "prep_funnel",
    f"""WITH {_STAGES}
        SELECT split, count(*) AS input,
               (SELECT count(*) FROM clean c WHERE c.split = w.split) AS after_leakage,
               (SELECT count(*) FROM hard c WHERE c.split = w.split) AS after_hard,
               (SELECT count(*) FROM inside c WHERE c.split = w.split) AS after_iqr,
               (SELECT count(*) FROM final c WHERE c.split = w.split) AS after_dedup
        FROM words w GROUP BY split""",
)
def prep_funnel(spark, sf):
    return corpus.prep_funnel(pairs(spark, sf), normalized=True)


_SHARDED = f"""{_STAGES},
placed AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS pos,
         count(*) OVER (PARTITION BY split) AS total FROM final),
sized AS (
  SELECT *, CAST(ceil(total / greatest(ceil(total / {ROWS_PER_SHARD}.0), {MIN_SHARDS})) AS BIGINT)
           AS shard_size FROM placed),
sharded AS (
  SELECT *, CAST(pos // shard_size AS INTEGER) AS shard, {PROMPT_SQL} AS text FROM sized)"""


def processed(spark, sf):
    """The cleaned corpus, written as shards and read back."""
    out = work_path(spark, "corpus")
    corpus.process(pairs(spark, sf), out, ROWS_PER_SHARD, MIN_SHARDS, normalized=True)
    return out


@query(
    "process_corpus",
    f"""WITH {_SHARDED} SELECT split, shard, row_id, source, document, summary, text FROM sharded""",
)
def process_corpus(spark, sf):
    return spark.read.parquet(processed(spark, sf)).select(
        "split", "shard", "row_id", "source", "document", "summary", "text"
    )


@query("prompt_text", f"WITH {PAIRS} SELECT row_id, {PROMPT_SQL} AS text FROM pairs")
def prompt_text(spark, sf):
    return pairs(spark, sf).select(
        "row_id", prompts.training_text(F.col("document"), F.col("summary")).alias("text")
    )


def all_sources(spark, sf):
    parts = {
        "documents": pairs(spark, sf).select(
            "row_id", F.lit(0).cast("long").alias("part"), "document", "summary"
        ),
        "conversations": chat_pairs(spark, sf),
        "pages": page_pairs(spark, sf).withColumn("part", F.lit(0).cast("long")),
    }
    return sources.combine(parts).select("dataset", "row_id", "part", "document", "summary")


@query(
    "combine_sources",
    f"WITH {SOURCES} SELECT dataset, row_id, part, document, summary FROM all_sources",
)
def combine_sources(spark, sf):
    return all_sources(spark, sf)


@query(
    "limit_per_source",
    f"""WITH {SOURCES} SELECT dataset, row_id, part FROM all_sources
        QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY row_id, part) <= {SOURCE_LIMIT}""",
)
def limit_per_source(spark, sf):
    rows = all_sources(spark, sf)
    return order.group_head(rows, ["dataset"], ["row_id", "part"], SOURCE_LIMIT).select(
        "dataset", "row_id", "part"
    )


_PLAN = f"""
totals AS (SELECT split, count(*) AS total FROM pairs GROUP BY split),
counted AS (
  SELECT *, CAST(greatest(ceil(total / {ROWS_PER_SHARD}.0), {MIN_SHARDS}) AS INTEGER) AS shards
  FROM totals),
planned AS (
  SELECT *, CAST(ceil(total / shards) AS BIGINT) AS shard_size,
         unnest(range(0, shards)) AS shard FROM counted)"""


@query(
    "shard_plan",
    f"""WITH {PAIRS}, {_PLAN}
        SELECT split, total, CAST(shard AS INTEGER) AS shard,
               printf('data-%05d-of-%05d', shard, shards) AS label,
               least(shard * shard_size, total) AS first_row,
               least((shard + 1) * shard_size, total) - least(shard * shard_size, total) AS n_rows
        FROM planned""",
)
def shard_plan(spark, sf):
    totals = pairs(spark, sf).groupBy("split").agg(F.count(F.lit(1)).alias("total"))
    return shards.shard_plan(totals, ROWS_PER_SHARD, MIN_SHARDS)


@query(
    "row_positions",
    f"""WITH {PAIRS} SELECT split, row_id,
          row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS pos FROM pairs""",
)
def row_positions(spark, sf):
    return order.positions(pairs(spark, sf), ["row_id"], ["split"])


def written_shards(spark, sf):
    """All pairs as one shard sequence."""
    out = work_path(spark, "shards")
    rows = pairs(spark, sf).select("row_id", "source", "document", "summary")
    shards.write_sharded(rows, out, ["row_id"], (), ROWS_PER_SHARD, MIN_SHARDS)
    return out


ALL_SHARDS = f"""{PAIRS},
numbered AS (
  SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos, count(*) OVER () AS total FROM pairs),
sharded AS (
  SELECT *, CAST(pos // CAST(ceil(total / greatest(ceil(total / {ROWS_PER_SHARD}.0), {MIN_SHARDS}))
           AS BIGINT) AS INTEGER) AS shard FROM numbered)"""


@query(
    "shard_roundtrip",
    f"""WITH {ALL_SHARDS} SELECT shard, count(*) AS n_rows, min(row_id) AS first_id,
          max(row_id) AS last_id FROM sharded GROUP BY shard""",
)
def shard_roundtrip(spark, sf):
    return (
        spark.read.parquet(written_shards(spark, sf))
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.min("row_id").alias("first_id"),
            F.max("row_id").alias("last_id"),
        )
    )


@query(
    "scan_shards",
    f"""WITH {ALL_SHARDS} SELECT CAST(r.rank AS INTEGER) AS shard_rank, shard, row_id, document
        FROM sharded JOIN (VALUES (1, 0), (3, 1), (2, 2)) r(s, rank) ON shard = r.s""",
)
def scan_shards(spark, sf):
    picked = shards.scan_shards(spark, written_shards(spark, sf), [1, 3, 2, 1_000_000])
    return picked.select("shard_rank", "shard", "row_id", "document")


def pair_table(spark, sf):
    """Every source as a ``dataset=/split=`` pair table."""
    out = work_path(spark, "pairs")
    split = F.when(F.col("row_id") % 10 == 0, "validation").when(F.col("row_id") % 10 == 1, "test")
    sources.write_pairs(
        all_sources(spark, sf).withColumn("split", split.otherwise("train")), out
    )
    return out


_SPLIT_OF = "CASE row_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END"


@query(
    "discover",
    f"""WITH {SOURCES} SELECT dataset, {_SPLIT_OF} AS split, count(*) AS n_rows
        FROM all_sources GROUP BY ALL""",
)
def discover(spark, sf):
    return sources.discover(spark, pair_table(spark, sf))


@query(
    "scan_split",
    f"""WITH {SOURCES} SELECT dataset AS source, row_id, part, document, summary
        FROM all_sources WHERE {_SPLIT_OF} = 'test'""",
)
def scan_split(spark, sf):
    rows = sources.scan_split(spark, pair_table(spark, sf), "test", required=True)
    return rows.select("source", "row_id", "part", "document", "summary")


@query(
    "ingest_join",
    r"""SELECT doc_id, array_to_string(list_filter(
          list_transform(string_split(text, chr(10)), lambda e: trim(regexp_replace(e,
            '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'))),
          lambda e: e <> ''), chr(10) || chr(10)) AS document FROM documents""",
)
def ingest_join(spark, sf):
    elements = F.transform(F.split("text", "\n"), text.squash)
    return table(spark, sf, "documents").select(
        "doc_id", ingest.join_elements(elements).alias("document")
    )
