"""Row windows, shuffles, epochs, budgets, step plans and the incremental feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.corpus import ALL_SHARDS, HARD, PROMPT_SQL, QUARTILES, written_shards
from digestry.catalog.registry import query
from digestry.catalog.views import PAIRS, WORDS, dealt_pairs, pairs, word_list
from digestry.functions import prompts, tokens
from digestry.operators import dedup, filters, order, quantiles, sketches
from digestry.plans import evaluate, feed
from digestry.session import stored, work_path
from digestry.streaming.feed import clean, sketched_fences, start_feed

OFFSET, LIMIT, EPOCHS, SEED, MAX_LENGTH = 37, 250, 3, 42, 128
OVERHEAD = tokens.WORDS.count_text(prompts.SUMMARIZE.text("")) + 2


@query(
    "row_window",
    f"""WITH {PAIRS} SELECT row_id, split, document FROM pairs
        ORDER BY row_id LIMIT {LIMIT} OFFSET {OFFSET}""",
)
def row_window(spark, sf):
    rows = order.row_window(pairs(spark, sf), ["row_id"], OFFSET, LIMIT)
    return rows.select("row_id", "split", "document")


@query(
    "eval_sample",
    f"WITH {PAIRS} SELECT row_id, summary FROM pairs WHERE split = 'test'",
)
def eval_sample(spark, sf):
    tests = pairs(spark, sf).where("split = 'test'")
    return evaluate.test_sample(tests, ["row_id"], None).select("row_id", "summary")


@query(
    "seeded_shuffle",
    f"""WITH {PAIRS}, keyed AS (SELECT row_id, md5('{SEED}:0:' || row_id) AS shuffle_key FROM pairs)
        SELECT row_id, shuffle_key, row_number() OVER (ORDER BY shuffle_key, row_id) - 1 AS pos
        FROM keyed""",
)
def seeded_shuffle(spark, sf):
    shuffled = order.seeded_shuffle(pairs(spark, sf).select("row_id"), "row_id", SEED)
    return order.positions(shuffled, ["shuffle_key", "row_id"]).select(
        "row_id", "shuffle_key", "pos"
    )


@query(
    "epoch_repeat",
    f"""WITH {PAIRS} SELECT row_id, CAST(e AS INTEGER) AS epoch, md5('{SEED}:' || e || ':' || row_id)
          AS shuffle_key FROM pairs, range({EPOCHS}) t(e)""",
)
def epoch_repeat(spark, sf):
    repeated = order.repeat_epochs(pairs(spark, sf).select("row_id"), EPOCHS)
    return order.seeded_shuffle(repeated, "row_id", SEED, "epoch")


def _budgeted(src: str, keep: str) -> str:
    words = word_list("document")
    room = f"({MAX_LENGTH - OVERHEAD} - len({word_list('summary')}))"
    cut = f"array_to_string(list_slice({words}, 1, {room}), ' ')"
    return f"""SELECT {keep}, {PROMPT_SQL} AS text FROM (
        SELECT * REPLACE (CASE WHEN {room} > 0 AND {room} < len({words}) THEN {cut}
                          ELSE document END AS document) FROM {src})"""


@query("truncate_prompt", f"WITH {PAIRS} {_budgeted('pairs', 'row_id, split')}")
def truncate_prompt(spark, sf):
    return feed.render(pairs(spark, sf), MAX_LENGTH).select("row_id", "split", "text")


_PICKED = f"""{ALL_SHARDS},
ranked AS (
  SELECT s.*, CAST(r.rank AS INTEGER) AS shard_rank
  FROM sharded s JOIN (VALUES (1, 0), (3, 1), (2, 2)) r(s, rank) ON shard = r.s),
windowed AS (SELECT * FROM ranked ORDER BY shard_rank, row_id LIMIT {LIMIT} OFFSET {OFFSET})"""


@query(
    "training_feed",
    f"""WITH {_PICKED}, repeated AS (
          SELECT windowed.*, CAST(e AS INTEGER) AS epoch,
                 md5('{SEED}:' || e || ':' || row_id) AS shuffle_key
          FROM windowed, range({EPOCHS}) t(e))
        {_budgeted('repeated', 'shard, shard_rank, row_id, epoch, shuffle_key')}""",
)
def training_feed(spark, sf):
    return feed.training_feed(
        spark, written_shards(spark, sf), MAX_LENGTH, [1, 3, 2], 0, OFFSET, LIMIT, EPOCHS, SEED
    ).select("shard", "shard_rank", "row_id", "epoch", "shuffle_key", "text")


BUFFER = 64


@query("buffer_feed")  # a walk with a buffer has no SQL form; tested against a plain one
def buffer_feed(spark, sf):
    rows = feed.scan_shards(spark, written_shards(spark, sf), [1, 3, 2])
    return order.buffer_shuffle(rows, "shard", "row_id", BUFFER, SEED).select(
        "shard", "shard_rank", "row_id", "pos", "document"
    )


@query(
    "validation_feed",
    f"""WITH {ALL_SHARDS}, late AS (SELECT *, shard - 1 AS shard_rank FROM sharded WHERE shard >= 1)
        {_budgeted('late', 'shard_rank, row_id')}""",
)
def validation_feed(spark, sf):
    rows = feed.validation_feed(spark, written_shards(spark, sf), MAX_LENGTH, shard_offset=1)
    return rows.select("shard_rank", "row_id", "text")


@query("stored_row_count", "SELECT count(*) AS n_rows FROM documents")
def stored_row_count(spark, sf):
    return feed.stored_row_count(spark, f"{sf}/documents.parquet")


#: Rows that an earlier run has trained on.
SKIPPED = 100


@query(
    "step_plan",
    f"""WITH {PAIRS}, n AS (SELECT greatest(count(*) - {SKIPPED}, 0) AS num_rows FROM pairs),
        s AS (SELECT num_rows, CAST(ceil(num_rows / 8.0) AS BIGINT) AS steps_per_epoch FROM n)
        SELECT num_rows, steps_per_epoch, steps_per_epoch * {EPOCHS} AS max_steps,
               CAST(greatest(1, floor(0.03::DOUBLE * (steps_per_epoch * {EPOCHS}))) AS BIGINT)
                 AS warmup_steps FROM s""",
)
def step_plan(spark, sf):
    return feed.plan_steps(pairs(spark, sf), SKIPPED, None, 2, 4, EPOCHS, 0.03)


_CLEAN = f"""WITH {WORDS}, fences AS (
  SELECT split, {QUARTILES} FROM words WHERE {HARD} GROUP BY split),
fed AS (
  SELECT w.* FROM words w JOIN fences USING (split)
  WHERE {HARD} AND (q3 - q1 = 0 OR ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
    AND (split = 'train' OR h NOT IN (SELECT h FROM words WHERE split = 'train')))
SELECT split, row_id, source, document, summary, {PROMPT_SQL} AS text FROM fed"""


def frozen_references(rows):
    """The train digests and the fences that a feed is started with."""
    keys = stored(dedup.document_keys(rows.where("split = 'train'")))
    kept = filters.hard_filter(filters.with_lengths(rows, normalized=True))
    fences = quantiles.iqr_fences(kept, ["split"], {"ratio": F.col("ratio")})
    return keys, stored(fences.select("split", "lo", "hi", "iqr"))


#: Files of a micro-batch: as many tasks can work on one.
FILES = 8


@query("stream_feed", _CLEAN)
def stream_feed(spark, sf):
    rows = pairs(spark, sf)
    keys, fences = frozen_references(rows)
    inbox, out = work_path(spark, "inbox"), work_path(spark, "fed")
    raw = rows.select("split", "row_id", "source", "document", "summary")
    raw.repartition(2 * FILES).write.parquet(inbox)
    start_feed(
        spark, inbox, out, work_path(spark, "progress"), keys, fences, files_per_trigger=FILES
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "split", "row_id", "source", "document", "summary", "text"
    )


@query("batch_feed", _CLEAN)
def batch_feed(spark, sf):
    rows = stored(dealt_pairs(spark, sf), "pairs")  # texts are normalized once, for three readings
    keys, fences = frozen_references(rows)
    return clean(rows, keys, fences)


# 64 buckets for each factor of e, magnitudes of 1e-9 and below with zero.
_SKETCHED = f"""{WORDS},
valued AS (
  SELECT split, source, 'ratio' AS feature, CAST(ratio AS DOUBLE) AS x FROM words WHERE {HARD}
  UNION ALL SELECT split, source, 'document_words', dw FROM words WHERE {HARD}),
sketched AS (
  SELECT split, feature, sign(x) * floor(ln(greatest(abs(x), 1e-9::DOUBLE) / 1e-9::DOUBLE) * 64) AS bucket,
         count(*) AS held, min(x) AS low, max(x) AS high
  FROM valued GROUP BY ALL),
placed AS (
  SELECT *, sum(held) OVER (PARTITION BY split, feature) AS n,
         sum(held) OVER (PARTITION BY split, feature ORDER BY bucket) - held AS before FROM sketched),
ranked AS (
  SELECT p.*, prob, (n - 1) * prob AS rank, place - before AS inner_place, side
  FROM placed p, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) t(prob),
       LATERAL (VALUES (floor((n - 1) * prob), 'f'), (ceil((n - 1) * prob), 'c')) s(place, side)
  WHERE place >= before AND place < before + held),
found AS (
  SELECT split, feature, n, prob, max(rank) - floor(max(rank)) AS part,
    max(low + (high - low) / greatest(held - 1, 1) * inner_place) FILTER (WHERE side = 'f') AS qf,
    max(low + (high - low) / greatest(held - 1, 1) * inner_place) FILTER (WHERE side = 'c') AS qc,
    max(low) FILTER (WHERE side = 'f') AS lf, max(low) FILTER (WHERE side = 'c') AS lc,
    max(high) FILTER (WHERE side = 'f') AS hf, max(high) FILTER (WHERE side = 'c') AS hc
  FROM ranked GROUP BY ALL),
sketch_quantiles AS (
  SELECT split, feature, n, prob, qf + (qc - qf) * part AS q, lf + (lc - lf) * part AS at_least,
         hf + (hc - hf) * part AS at_most FROM found)"""


def measured_pairs(rows):
    """The measures of the pairs within bounds, without their texts."""
    kept = filters.hard_filter(filters.with_lengths(rows, normalized=True))
    return kept.select("source", "split", "ratio", "dw")


def delivered_sketches(spark, measured) -> str:
    """A folder with the sketches of each source, stored as one delivery after the other arrives."""
    path = work_path(spark, "sketches")
    features = {"ratio": F.col("ratio"), "document_words": F.col("dw")}
    by_source = stored(sketches.sketch(measured, ["source", "split"], features))
    for half in (0, 1):  # two deliveries, by source
        part = by_source.where(F.pmod(F.xxhash64("source"), F.lit(2)) == half)
        sketches.store(part, path, str(half))
    return path


@query(
    "sketched_quantiles",
    f"""WITH {_SKETCHED}, exact AS (
          SELECT split, feature, quantile_cont(x, [0.25, 0.5, 0.75]) AS e FROM valued GROUP BY ALL)
        SELECT s.split, s.feature, CAST(n AS BIGINT) AS n, prob, round(q, 9) AS q,
               round(at_least, 9) AS at_least, round(at_most, 9) AS at_most,
               at_least <= v + 1e-12 AND v <= at_most + 1e-12 AS holds
        FROM sketch_quantiles s JOIN (
          SELECT split, feature, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS prob, unnest(e) AS v
          FROM exact) USING (split, feature, prob)""",
)
def sketched_quantiles(spark, sf):
    """Quartiles from merged deliveries; ``holds`` is the exact quantile of all rows within the bounds."""
    measured = stored(measured_pairs(pairs(spark, sf)))  # texts are measured once for both
    held = sketches.stored_sketches(spark, delivered_sketches(spark, measured))
    probs = (0.25, 0.5, 0.75)
    features = {"ratio": F.col("ratio"), "document_words": F.col("dw")}
    exact = quantiles.exact_quantiles(measured, ["split"], features, probs)
    both = sketches.quantiles(held, ["split"], probs).join(
        exact.select("split", "feature", F.col("q").alias("e")), ["split", "feature"]
    )
    probed = F.arrays_zip(
        F.array(*[F.lit(p) for p in probs]).alias("prob"), "q", "at_least", "at_most", "e"
    )
    rows = both.select("split", "feature", "n", F.explode_outer(probed).alias("z")).select(
        "split", "feature", "n", "z.*"
    )
    holds = (F.col("at_least") <= F.col("e") + 1e-12) & (F.col("e") <= F.col("at_most") + 1e-12)
    rounded = [F.round(c, 9).alias(c) for c in ("q", "at_least", "at_most")]
    return rows.select("split", "feature", "n", "prob", *rounded, holds.alias("holds"))


@query(
    "sketched_feed",
    f"""WITH {_SKETCHED}, fences AS (
          SELECT split, max(q) FILTER (WHERE prob = 0.25) AS q1, max(q) FILTER (WHERE prob = 0.75) AS q3
          FROM sketch_quantiles WHERE feature = 'ratio' GROUP BY split)
        SELECT w.split, row_id, source, document, summary, {PROMPT_SQL} AS text
        FROM words w JOIN fences USING (split)
        WHERE {HARD} AND (q3 - q1 = 0 OR ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))
          AND (split = 'train' OR h NOT IN (SELECT h FROM words WHERE split = 'train'))""",
)
def sketched_feed(spark, sf):
    """The feed with fences from merged sketches instead of a pass over all rows."""
    rows = stored(dealt_pairs(spark, sf), "pairs")  # texts are normalized once, for three readings
    keys = stored(dedup.document_keys(rows.where("split = 'train'")))
    return clean(rows, keys, stored(sketched_fences(spark, delivered_sketches(spark, measured_pairs(rows)))))
