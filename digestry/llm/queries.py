"""The registered queries of this subpackage, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm import (
    ann, bpe, brown, codes, gam, mixing, negatives, packing, pii, rules, shards, simhash, toxicity,
)
from digestry.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir).select("doc_id", "text"), "text")
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return found.select(
        "doc_id",
        *[pii.count(F.col("spans"), kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(base).cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


NEAREST = 20


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.search(vectors, "vec_id", "embedding", F.col("id") % 20 == 0, NEAREST)


@query
def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(documents(spark, sf_dir))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.share_vocabulary(spark, VOCABULARY)
    coded = bpe.code(documents(spark, sf_dir), "doc_id", "text", shared)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(documents(spark, sf_dir).select("doc_id", "text"), "text")
    fields = (*rules.BASE, "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"quality.{field}").alias(field) for field in fields])


def verdicts(scored: DataFrame, parts: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id",
        (remainder("doc_id", parts) == held_out).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


@query
def op6_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = gam.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = gam.score(docs, "doc_id", "text", model)
    return verdicts(scored, gam.PARTS, gam.HELD_OUT, gam.THRESHOLD)


SHARDS = 16


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shards.assign(documents(spark, sf_dir), "doc_id", "text", SHARDS)
    return shards.number(rows, "shard").withColumn("law", F.lit("key"))


@query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), "doc_id", "text", 3, 3)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = bpe.share_vocabulary(spark, VOCABULARY)
    return packing.pack(documents(spark, sf_dir), "doc_id", "text", shared)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs.select("doc_id", "text"), "text", model, "score")
    return verdicts(scored, toxicity.PARTS, toxicity.HELD_OUT, toxicity.THRESHOLD)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@query
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = embeddings(spark, sf_dir).withColumn("label", label)
    return negatives.mine(rows, "vec_id", "label", "embedding", F.col("id") % 100 == 0)


@query
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.kept(embeddings(spark, sf_dir), "vec_id", "embedding", "label")
    books = codes.fit(rows)
    return codes.with_label_error(codes.encode(rows, books)).select(
        F.col("id").alias("vec_id"),
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


@query
def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir), "doc_id", "text", "source")
    return mixed.taken().select("doc_id", "size", "source_size", "target", "taken")


# ---- the same in SQL ------------------------------------------------------------------------------

_STOP = (
    "'the','of','and','to','a','in','is','it','that','for','as','was','with','be','by','on','this',"
    "'from','at','or','an','le','la','les','de','des','du','un','une','et','en','que','qui','dans',"
    "'pour','par','sur','au','est','avec','der','die','das','und','zu','den','von','mit','ist','im',"
    "'auf','ein','eine','nicht','dem','es','sich','el','los','las','del','y','una','por','con',"
    "'para','se','al','su'"
)


def _between(part: str, whole: str, least: float, most: float) -> str:
    return f"coalesce({part} / nullif({whole}, 0), 0.0) BETWEEN {least} AND {most}"


ORACLES["op5_rules"] = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parted AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l
  FROM texts),
token AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM parted),
gram AS (
  SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g
  FROM token WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gram WHERE g IS NOT NULL)
  WHERE c > 1),
again AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT p.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         length(regexp_replace(t, '[ \t-\r]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
         length(regexp_replace(t, '\P{{L}}', '', 'g')) AS n_letters,
         length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_capitals,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_exclamations,
         len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) AS n_open_lines
  FROM parted p LEFT JOIN again USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_between("word_chars", "n_words", 2.5, 12.0)}
       AND {_between("n_symbols", "n_words", 0.0, 0.1)}
       AND {_between("n_stop_words", "n_words", 0.03, 1.0)}
       AND {_between("n_letter_words", "n_words", 0.7, 1.0)}
       AND {_between("n_capitals", "n_letters", 0.0, 0.4)}
       AND {_between("n_exclamations", "n_words", 0.0, 0.3)}
       AND {_between("n_dup_lines", "n_lines", 0.0, 0.5)}
       AND {_between("n_bullet_lines", "n_lines", 0.0, 0.9)}
       AND {_between("n_open_lines", "n_lines", 0.0, 0.3)} AS kept
FROM judged"""


#: The first five of a kind, by score and then by id.
ORACLES["op11_negatives"] = """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM kept),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS other_id, a.label = b.label AS same,
         CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM flat a JOIN flat b ON a.d = b.d AND a.id <> b.id
  WHERE a.id % 100 = 0 GROUP BY a.id, b.id, a.label, b.label),
positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (
         PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5"""


def _floored(total: str, number: str) -> str:
    """The floor of an exact quotient, also below zero."""
    return f"(({total}) - ((({total}) % {number}) + {number}) % {number}) // {number}"


def _round(of: int) -> str:
    """SQL of one round: ``near`` has the nearest entry of each part, ``book`` the entries after it."""
    moved = _floored("sum(x)", "count(*)")
    return f"""
apart{of} AS (
  SELECT f.id, f.part, b.entry, CAST(sum((f.x - b.x) * (f.x - b.x)) AS BIGINT) AS far
  FROM flat f JOIN book{of} b USING (part, place) GROUP BY f.id, f.part, b.entry),
near{of} AS (
  SELECT id, part, entry, far FROM apart{of}
  QUALIFY row_number() OVER (PARTITION BY id, part ORDER BY far, entry) = 1),
moved{of} AS (
  SELECT part, entry, place, CAST({moved} AS BIGINT) AS x
  FROM near{of} JOIN flat USING (id, part) GROUP BY part, entry, place),
book{of + 1} AS (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x
  FROM book{of} b LEFT JOIN moved{of} m USING (part, entry, place))"""


ORACLES["op12_codes"] = f"""
WITH kept AS (
  SELECT vec_id AS id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (
  SELECT id, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS place, x FROM (
    SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i, len(v) AS n FROM kept)),
first AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS entry FROM kept QUALIFY entry < 64),
book0 AS (SELECT part, entry, place, x FROM first JOIN flat USING (id)),
{_round(0)},{_round(1)},{_round(2)},
coded AS (
  SELECT id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code,
         CAST(sum(far) AS BIGINT) AS error
  FROM near2 GROUP BY id)
SELECT k.id AS vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM book2)
         AS codebooks_sha256
FROM coded JOIN kept k USING (id)"""
