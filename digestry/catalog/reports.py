"""Corpus profile, validation and duplicate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from digestry.catalog.registry import query
from digestry.catalog.views import PAIRS, WORDS, norm, pairs, raw_pairs
from digestry.operators import dedup, filters, profile, quantiles

SAMPLE_ROWS = 300

_MEASURED = f"""{WORDS},
measured AS (
  SELECT *, length(document) AS dc, length(summary) AS sc,
         row_number() OVER (PARTITION BY split ORDER BY row_id) AS rn FROM words)"""


def _five_sql(where: str) -> str:
    blocks = [
        f"""SELECT split, '{name}' AS feature, CAST(min({c}) AS DOUBLE) AS min,
            round(quantile_cont({c}, 0.25), 9) AS p25, round(quantile_cont({c}, 0.5), 9) AS p50,
            round(quantile_cont({c}, 0.75), 9) AS p75, CAST(max({c}) AS DOUBLE) AS max
            FROM measured WHERE {where} GROUP BY split"""
        for name, c in profile.FEATURES.items()
    ]
    return " UNION ALL ".join(blocks).replace("AS min,", "AS lowest,").replace("AS max\n", "AS highest\n")


def _rounded_five(df, *extra):
    return df.select(
        "split",
        *extra,
        "feature",
        F.col("min").alias("lowest"),
        *[F.round(c, 9).alias(c) for c in ("p25", "p50", "p75")],
        F.col("max").alias("highest"),
    )


@query("five_number", f"WITH {_MEASURED} {_five_sql('true')}")
def five_number(spark, sf):
    rows = profile.measures(pairs(spark, sf))
    features = {name: F.col(c) for name, c in profile.FEATURES.items()}
    return _rounded_five(quantiles.five_number(rows, ["split"], features))


@query(
    "profile_split",
    f"""WITH {_MEASURED}, five AS ({_five_sql(f"rn <= {SAMPLE_ROWS}")}),
        heads AS (SELECT split, count(*) AS n_rows,
            count(*) FILTER (WHERE rn <= {SAMPLE_ROWS}) AS sample_size,
            avg(CASE WHEN dw = 0 THEN 1.0 ELSE 0.0 END) AS empty_document_ratio,
            avg(CASE WHEN sw = 0 THEN 1.0 ELSE 0.0 END) AS empty_summary_ratio
          FROM measured GROUP BY split)
        SELECT five.*, n_rows, sample_size, empty_document_ratio, empty_summary_ratio
        FROM five JOIN heads USING (split)""",
)
def profile_split(spark, sf):
    profiled = profile.profile_pairs(pairs(spark, sf), sample_rows=SAMPLE_ROWS)
    return _rounded_five(
        profiled, "n_rows", "sample_size", "empty_document_ratio", "empty_summary_ratio"
    )


@query(
    "blank_rates",
    f"""WITH raw AS (
          SELECT lang AS split, split_part(text, chr(10), 1) AS summary,
                 CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1)
                      ELSE '' END AS document
          FROM documents
          UNION ALL
          SELECT t.role, u.text, t.text FROM conversations t LEFT JOIN conversations u
            ON u.conv_id = t.conv_id AND u.turn + 1 = t.turn AND u.role = 'user')
        SELECT split, round(avg(CASE WHEN {norm("coalesce(document, '')")} = '' THEN 1.0 ELSE 0.0 END), 9)
                 AS blank_document,
               round(avg(CASE WHEN {norm("coalesce(summary, '')")} = '' THEN 1.0 ELSE 0.0 END), 9)
                 AS blank_summary
        FROM raw GROUP BY split""",
)
def blank_rates(spark, sf):
    rates = profile.blank_rates(raw_pairs(spark, sf))
    return rates.select("split", *[F.round(c, 9).alias(c) for c in ("blank_document", "blank_summary")])


_CHECK_SQL = [rule for _, rule in profile.CHECKS]


@query(
    "violations",
    f"""WITH {WORDS} SELECT split, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (WHERE {r}) AS v{i}" for i, r in enumerate(_CHECK_SQL))
    + " FROM words GROUP BY split",
)
def violations(spark, sf):
    return profile.violations(pairs(spark, sf))


def _report_sql() -> str:
    rows = [
        f"SELECT split, n, '{name}' AS \"check\", count(*) FILTER (WHERE {rule}) AS c, 1.0 AS cap"
        " FROM masked GROUP BY split, n"
        for name, rule in profile.CHECKS
    ] + [
        f"SELECT split, n, 'IQR outlier on {label}', count(*) FILTER (WHERE {c} < {c}1 - 1.5 * "
        f"({c}3 - {c}1) OR {c} > {c}3 + 1.5 * ({c}3 - {c}1)), 5.0 FROM masked GROUP BY split, n"
        for label, c in (("ratio", "ratio"), ("doc_words", "dw"))
    ]
    return " UNION ALL ".join(rows)


_QUARTS = """
quart AS (
  SELECT split, count(*) AS n,
         quantile_cont(ratio, 0.25) AS ratio1, quantile_cont(ratio, 0.75) AS ratio3,
         quantile_cont(dw, 0.25) AS dw1, quantile_cont(dw, 0.75) AS dw3
  FROM words GROUP BY split),
masked AS (SELECT * FROM words JOIN quart USING (split))"""


@query(
    "validation_report",
    f"""WITH {WORDS}, {_QUARTS}, report AS ({_report_sql()})
        SELECT split, "check", c AS "count", round(c / n * 100, 6) AS pct, c / n * 100 > cap AS flagged
        FROM report""",
)
def validation_report(spark, sf):
    return profile.validation_report(pairs(spark, sf)).withColumn("pct", F.round("pct", 6))


_OUT = "(ratio < ratio1 - 1.5 * (ratio3 - ratio1) OR ratio > ratio3 + 1.5 * (ratio3 - ratio1))"


@query(
    "outlier_mask",
    f"WITH {WORDS}, {_QUARTS} SELECT row_id, split, {_OUT} AS is_outlier FROM masked",
)
def outlier_mask(spark, sf):
    rows = filters.with_lengths(pairs(spark, sf), normalized=True)
    return filters.outlier_mask(rows).select("row_id", "split", "is_outlier")


@query(
    "outlier_counts",
    f"""WITH {WORDS}, {_QUARTS} SELECT split, {_OUT} AS is_outlier, count(*) AS n
        FROM masked GROUP BY ALL""",
)
def outlier_counts(spark, sf):
    return profile.outlier_counts(pairs(spark, sf))


def _histogram_sql(bins: int, value: str) -> str:
    return f"""WITH {WORDS},
    long AS (
      SELECT split, 'dw' AS feature, CAST(dw AS DOUBLE) AS x FROM words UNION ALL
      SELECT split, 'sw', sw FROM words UNION ALL SELECT split, 'ratio', ratio FROM words),
    edge AS (
      SELECT split, feature, count(*) AS total,
             min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
             max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi
      FROM long GROUP BY split, feature),
    binned AS (
      SELECT split, feature, total, lo, (hi - lo) / {bins} AS width,
             CAST(least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INTEGER) AS bin
      FROM long JOIN edge USING (split, feature))
    SELECT split, feature, bin, {value} FROM binned GROUP BY split, feature, bin, total, lo, width"""


@query(
    "histogram",
    _histogram_sql(
        50,
        'round(lo + bin * width, 9) AS "left", round(lo + (bin + 1) * width, 9) AS "right",'
        " count(*) AS n",
    ),
)
def histogram(spark, sf):
    return profile.histogram(pairs(spark, sf), bins=50).select(
        "split", "feature", "bin", F.round("left", 9).alias("left"),
        F.round("right", 9).alias("right"), "n",
    )


@query(
    "histogram_density",
    _histogram_sql(60, "round(count(*) / (total * width), 6) AS density"),
)
def histogram_density(spark, sf):
    return profile.histogram(pairs(spark, sf), bins=60).select(
        "split", "feature", "bin", F.round("density", 6).alias("density")
    )


@query(
    "dup_report",
    f"""WITH {PAIRS} SELECT split, count(*) AS n_rows, count(*) - count(DISTINCT document)
          AS duplicates, count(*) > count(DISTINCT document) AS flagged FROM pairs GROUP BY split""",
)
def dup_report(spark, sf):
    return dedup.duplicate_report(pairs(spark, sf))


@query(
    "split_overlap",
    f"""WITH {PAIRS}, duo(split_a, split_b) AS (
          VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test'))
        SELECT split_a, split_b, count(DISTINCT a.document) AS shared,
               count(DISTINCT a.document) > 0 AS leaking
        FROM duo LEFT JOIN (pairs a JOIN pairs b ON a.document = b.document)
          ON a.split = split_a AND b.split = split_b
        GROUP BY split_a, split_b""",
)
def split_overlap(spark, sf):
    return dedup.split_overlap(pairs(spark, sf))


@query(
    "shared_documents",
    f"""WITH {PAIRS} SELECT sha256(document) AS h FROM pairs WHERE split = 'train' INTERSECT
        SELECT sha256(document) FROM pairs WHERE split = 'test'""",
)
def shared_documents(spark, sf):
    rows = pairs(spark, sf)
    return dedup.shared_keys(rows.where("split = 'train'"), rows.where("split = 'test'"))


@query(
    "scatter_sample",
    f"WITH {WORDS} SELECT row_id, dw, sw FROM words",
)
def scatter_sample(spark, sf):
    return profile.scatter_sample(pairs(spark, sf), n=None)
