"""Learned sentence boundaries over whole documents, prepared sources and the figures of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.documents import LEADS, LEADS_SQL, OPTIONS, SECTION, STRATEGY_CTES
from digestry.catalog.registry import query
from digestry.catalog.views import PAIRS, SOURCES, dealt_pairs, norm, table, wc, word_list
from digestry.operators import boundaries, summarize
from digestry.plans import corpus, evaluate
from digestry.session import stored, work_path
from digestry.sources.pairs import SourceSpec, known_source

DIGITS = 6


def raw_documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("document"))


_TYPES = rf"""
listed AS (SELECT doc_id AS row_id, coalesce(text, '') AS body, {word_list("coalesce(text, '')")} AS w
           FROM documents),
token AS (
  SELECT unnest(w) AS t, unnest(list_append(list_slice(w, 2, len(w)), '')) AS following
  FROM listed WHERE len(w) > 0),
counted AS (
  SELECT lower(rtrim(t, '.')) AS word, count(*) FILTER (WHERE t LIKE '%.') AS n_period,
         count(*) FILTER (WHERE t NOT LIKE '%.') AS n_plain,
         count(*) FILTER (WHERE t LIKE '%.' AND regexp_matches(following, '^[\p{{Ll}}\p{{Nd}}]')) AS n_lower
  FROM token WHERE regexp_matches(t, '^([\p{{L}}.]*\p{{L}})\.?$') GROUP BY ALL)"""


@query("abbreviation_counts", f"WITH {_TYPES} SELECT * FROM counted")
def abbreviation_counts(spark, sf):
    return boundaries.word_types(raw_documents(spark, sf))


_SCORED = f"""{_TYPES},
usual AS (SELECT (sum(n_period) + 1) / (sum(n_period) + sum(n_plain) + 2) AS p FROM counted),
scored AS (
  SELECT word, n_period, n_plain, n_lower,
         2 * ((n_period * ln(0.99) + n_plain * ln(1 - 0.99)) - (n_period * ln(p) + n_plain * ln(1 - p)))
           * n_lower / n_period / length(word) AS score
  FROM counted, usual WHERE n_period > 0)"""


@query(
    "abbreviation_scores",
    f"WITH {_SCORED} SELECT word, n_period, n_plain, n_lower, round(score, {DIGITS}) AS score FROM scored",
)
def abbreviation_scores(spark, sf):
    scored = boundaries.abbreviation_scores(boundaries.word_types(raw_documents(spark, sf)))
    return scored.withColumn("score", F.round("score", DIGITS))


@query(
    "sentences",
    rf"""WITH {_SCORED},
        known AS (SELECT word FROM scored WHERE n_period >= 3 AND score >= 10.0),
        line AS (
          SELECT row_id, unnest(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10))) AS l,
                 generate_subscripts(string_split(regexp_replace(body, '\r\n?', chr(10), 'g'), chr(10)), 1) AS li
          FROM listed),
        piece AS (
          SELECT row_id, li, unnest(ps) AS s, generate_subscripts(ps, 1) AS i FROM (
            SELECT row_id, li, list_filter(string_split(regexp_replace({norm("l")}, '([.!?]) ',
                     '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '') AS ps FROM line)),
        ended AS (
          SELECT *, lag(s) OVER (PARTITION BY row_id, li ORDER BY i) AS before,
                 string_split(lag(s) OVER (PARTITION BY row_id, li ORDER BY i), ' ')[-1] AS last
          FROM piece),
        begun AS (
          SELECT *, CASE WHEN regexp_matches(s, '^[\p{{Ll}}\p{{Nd}}]') AND last LIKE '%.'
                     AND regexp_matches(last, '^([\p{{L}}.]*\p{{L}})\.?$')
                     AND lower(rtrim(last, '.')) IN (SELECT word FROM known)
                    THEN 0 ELSE 1 END AS opens FROM ended),
        grouped AS (
          SELECT *, sum(opens) OVER (PARTITION BY row_id ORDER BY li, i) AS g FROM begun)
        SELECT row_id, CAST(g - 1 AS INTEGER) AS pos, string_agg(s, ' ' ORDER BY li, i) AS sentence
        FROM grouped GROUP BY row_id, g""",
)
def sentences(spark, sf):
    docs = raw_documents(spark, sf)
    known = boundaries.abbreviations(boundaries.abbreviation_scores(boundaries.word_types(docs)))
    listed = boundaries.sentences(F.col("document"), known)
    rows = docs.select("row_id", F.posexplode_outer(listed).alias("pos", "sentence"))
    return rows.where("sentence IS NOT NULL").select("row_id", "pos", "sentence")


# ---- prepared sources ----------------------------------------------------------------------------

KEPT_ROWS = 60


@query(
    "prepare_pairs",
    f"""WITH {SOURCES}, split AS (
          SELECT CASE dataset WHEN 'documents' THEN 'cnn' ELSE 'talks' END AS dataset, row_id, part,
                 document, summary,
                 CASE row_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split
          FROM all_sources WHERE dataset <> 'pages')
        SELECT dataset, split, row_id, part, document, summary FROM split
        QUALIFY row_number() OVER (PARTITION BY dataset, split ORDER BY row_id, part) <= {KEPT_ROWS}""",
)
def prepare_pairs(spark, sf):
    """Sources as they are delivered, a folder a split and with column names of their own, made into one
    pair table."""
    root, out = work_path(spark, "sources"), work_path(spark, "prepared")
    documents, turns = table(spark, sf, "documents"), table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").select(
        F.col("conv_id").alias("row_id"), (F.col("turn") + 1).alias("part"), F.col("text").alias("question")
    )
    delivered = {
        "cnn": documents.select(
            F.col("doc_id").alias("row_id"), F.lit(0).cast("long").alias("part"),
            F.col("text").alias("article"), F.substring_index("text", "\n", 1).alias("highlights"),
        ),
        "talks": turns.where("role = 'assistant'")
        .select(F.col("conv_id").alias("row_id"), F.col("turn").alias("part"), F.col("text").alias("answer"))
        .join(asked, ["row_id", "part"], "left"),
    }
    names = {0: "validation", 1: "test"}
    for name, rows in delivered.items():
        for split in ("train", "validation", "test"):
            tenth = F.col("row_id") % 10
            own = tenth.isin(*[k for k, v in names.items() if v == split])
            chosen = rows.where(~tenth.isin(*names) if split == "train" else own)
            chosen.write.json(f"{root}/{name}/{split}")
    keep = ("row_id", "part")
    specs = [
        known_source("cnn", f"{root}/cnn", format="json", keep=keep),
        SourceSpec("talks", f"{root}/talks", "answer", "question", "json", keep),
    ]
    corpus.prepare(spark, specs, out, ["row_id", "part"], limit_rows=KEPT_ROWS)
    return spark.read.parquet(out).select("dataset", "split", *keep, "document", "summary")


# ---- figures of runs -----------------------------------------------------------------------------


@query(
    "run_metrics",
    f"""WITH RECURSIVE {PAIRS}, {LEADS_SQL}, {STRATEGY_CTES},
        sums AS (
          SELECT strategy, system, CAST(count(*) AS DOUBLE) AS n_rows,
                 CAST(sum({wc("document")}) AS DOUBLE) AS tokens_in,
                 CAST(sum({wc("prediction")}) AS DOUBLE) AS tokens_out
          FROM generated GROUP BY strategy, system)
        UNPIVOT sums ON n_rows, tokens_in, tokens_out INTO NAME metric VALUE value""",
)
def run_metrics(spark, sf):
    """Rows and tokens as they were observed while summaries were written; run times differ from run to
    run and are left out here."""
    out = work_path(spark, "runs")
    found = evaluate.timed_predictions(
        stored(dealt_pairs(spark, sf), "pairs"), {s: summarize.gathered(n, SECTION) for s, n in LEADS.items()}, out,
        **OPTIONS,
    )
    return found.where("metric != 'duration_sec'").select("strategy", "system", "metric", "value")
