"""The views that the registered queries share, in Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.functions import text
from digestry.operators.filters import to_pairs
from digestry.operators.summarize import STRATEGIES
from digestry.session import dealt

SYSTEMS = ("base", "adapter")
#: The strategy of rank r leaves out every (DROPPED + r)-th word of the document.
DROPPED = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id, source, split, document, summary``: the first line stands in for the summary."""
    return _pairs_of(table(spark, sf_dir, "documents"))


def dealt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs`` for costly work on each text: rows are dealt to all tasks first, as a file of one row
    group is one task's, however many rows it has."""
    return _pairs_of(dealt(table(spark, sf_dir, "documents"), "doc_id", "text"))


def _pairs_of(documents: DataFrame) -> DataFrame:
    tenth = F.col("doc_id") % 10
    raw = documents.select(
        F.col("doc_id").alias("row_id"),
        "source",
        F.when(tenth == 0, "validation").when(tenth == 1, "test").otherwise("train").alias("split"),
        "text",
        F.substring_index("text", "\n", 1).alias("first_line"),
    )
    return to_pairs(raw, "text", "first_line", ("row_id", "source", "split"), "documents")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, document, summary`` before any preparation, blanks and nulls included: the rest of each
    document beside its first line, and every turn beside the user turn just before, if there is one."""
    documents, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    first_break = F.instr("text", "\n")
    rest = F.when(first_break > 0, F.substr("text", first_break + 1)).otherwise("")
    asked = turns.where("role = 'user'").select(
        F.col("conv_id").alias("asked_in"), (F.col("turn") + 1).alias("answered_at"),
        F.col("text").alias("summary"),
    )
    before = (F.col("conv_id") == F.col("asked_in")) & (F.col("turn") == F.col("answered_at"))
    return documents.select(
        F.col("lang").alias("split"), rest.alias("document"),
        F.substring_index("text", "\n", 1).alias("summary"),
    ).unionByName(
        turns.join(asked, before, "left").select(
            F.col("role").alias("split"), F.col("text").alias("document"), "summary"
        )
    )


def chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer with the user turn just before it; keyed by turn, so a long talk is no hot key."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("row_id"), F.col("turn").alias("part"), F.col("text").alias("answer")
    )
    asked = turns.where("role = 'user'").select(
        F.col("conv_id").alias("row_id"),
        (F.col("turn") + 1).alias("part"),
        F.col("text").alias("question"),
    )
    met = answers.join(asked, ["row_id", "part"])
    return to_pairs(met, "answer", "question", ("row_id", "part"), "conversations")


def page_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    bare = F.regexp_replace(
        html, r"(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "
    )
    raw = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("row_id"),
        F.regexp_replace(bare, r"<[^>]+>", " ").alias("body"),
        F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"),
    )
    return to_pairs(raw, "body", "title", ("row_id",), "pages")


def talk_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chat_pairs`` with one id for a turn: short whole texts, for the metrics with slow SQL."""
    turn_id = (F.col("row_id") * 10_000 + F.col("part")).alias("row_id")
    return chat_pairs(spark, sf_dir).select(turn_id, "document", "summary")


def prediction_rows(
    spark: SparkSession,
    sf_dir: str,
    source: Callable[[SparkSession, str], DataFrame] = dealt_pairs,
    systems: tuple[str, ...] = SYSTEMS,
) -> DataFrame:
    """``row_id, reference, entries``: the whole document without some of its words stands in for model
    output; every few words, by strategy and system, one is left out."""

    def entry(words: Column, system: str, rank: int, strategy: str) -> Column:
        shift = 1 if system == "base" else 0
        kept_words = F.filter(words, lambda _, i: (i + shift) % (DROPPED + rank) != 0)
        return F.struct(
            F.lit(system).alias("system"), F.lit(strategy).alias("strategy"),
            F.lit(rank).alias("strategy_rank"), F.array_join(kept_words, " ").alias("prediction"),
        )

    entries = text.bind(
        lambda v: F.array(
            *[entry(v["w"], s, rank, name) for s in systems for rank, name in enumerate(STRATEGIES)]
        ),
        w=text.words(F.col("document"), normalized=True),
    )
    return source(spark, sf_dir).select(
        "row_id", F.col("summary").alias("reference"), entries.alias("entries")
    )


def predictions(
    spark: SparkSession, sf_dir: str, source: Callable[[SparkSession, str], DataFrame] = dealt_pairs
) -> DataFrame:
    """``prediction_rows``, one row a system and strategy."""
    rows = prediction_rows(spark, sf_dir, source)
    # The outer form keeps Spark from making all predictions twice, once to test their number.
    return rows.select("row_id", "reference", F.explode_outer("entries").alias("e")).select(
        "row_id", "e.system", "e.strategy", "e.strategy_rank", "e.prediction", "reference"
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 20").alias("pair_id"),
        F.when(F.col("vec_id") % 2 == 0, "pred").otherwise("ref").alias("side"),
        F.expr("(vec_id % 20) div 2").alias("pos"),
        "embedding",
    )


# ---- the same in SQL --------------------------------------------------------------------------


def norm(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def wc(c: str) -> str:
    """Words of already normalized text."""
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def kept(expr: str) -> str:
    """A token list without empty strings."""
    return f"list_filter({expr}, lambda t: t <> '')"


def word_list(c: str) -> str:
    return kept(f"string_split({norm(c)}, ' ')")


PAIRS = f"""
pairs AS (
  SELECT * FROM (
    SELECT doc_id AS row_id, source,
           CASE doc_id % 10 WHEN 0 THEN 'validation' WHEN 1 THEN 'test' ELSE 'train' END AS split,
           {norm("text")} AS document, {norm("split_part(text, chr(10), 1)")} AS summary
    FROM documents)
  WHERE document <> '' AND summary <> '')"""

WORDS = f"""{PAIRS},
words AS (
  SELECT *, sw / greatest(dw, 1) AS ratio FROM (
    SELECT *, {wc("document")} AS dw, {wc("summary")} AS sw, sha256(document) AS h FROM pairs))"""

_BARE = (
    r"regexp_replace(regexp_replace(html, "
    r"'(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '<[^>]+>', ' ', 'g')"
)
SOURCES = f"""{PAIRS},
all_sources AS (
  SELECT * FROM (
    SELECT 'documents' AS dataset, row_id, CAST(0 AS BIGINT) AS part, document, summary FROM pairs
    UNION ALL
    SELECT 'conversations', a.conv_id, a.turn, {norm("a.text")}, {norm("u.text")}
    FROM conversations a JOIN conversations u
      ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' AND a.role = 'assistant'
    UNION ALL
    SELECT 'pages', page_id, 0, {norm(_BARE)},
           {norm("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}
    FROM pages)
  WHERE document <> '' AND summary <> '')"""

_OPTIONS = ", ".join(
    f"('{system}', '{strategy}', {rank}, {1 if system == 'base' else 0}, {3 + rank})"
    for system in SYSTEMS
    for rank, strategy in enumerate(STRATEGIES)
)
TALKS = f"""
talks AS (
  SELECT * FROM (
    SELECT a.conv_id * 10000 + a.turn AS row_id, {norm("a.text")} AS document,
           {norm("u.text")} AS summary
    FROM conversations a JOIN conversations u
      ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' AND a.role = 'assistant')
  WHERE document <> '' AND summary <> '')"""
_PREDICTED = f"""
predictions AS MATERIALIZED (
  SELECT row_id, system, strategy, strategy_rank,
         array_to_string(list_filter({word_list("document")},
                                     lambda w, i: (i - 1 + shift) % every <> 0), ' ')
           AS prediction, summary AS reference
  FROM SOURCE, (VALUES {_OPTIONS}) o(system, strategy, strategy_rank, shift, every))"""
PREDICTIONS = f"{PAIRS},{_PREDICTED.replace('SOURCE', 'pairs')}"
TALK_PREDICTIONS = f"{TALKS},{_PREDICTED.replace('SOURCE', 'talks')}"
