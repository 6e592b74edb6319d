"""Sentence boundaries learned from the corpus, inside paragraphs.

A period ends a sentence unless the word before it is an abbreviation. Abbreviations are word types that
stand before a period far more often than words do in general, are short, and go on in lower case. Their
counts are a Spark aggregate over all documents; a split then consults a list of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text

#: A word: letters, with periods between them or behind.
TOKEN = r"^([\p{L}.]*\p{L})\.?$"
LOWER = r"^[\p{Ll}\p{Nd}]"
#: How sure an abbreviation is to have its period, in the likelihood of its counts.
SURE = 0.99
#: Least times before a period, least score, and the most abbreviations that a split consults.
LEAST_SEEN, LEAST_SCORE, MOST = 3, 10.0, 1000


def word_types(documents: DataFrame, column: str = "document") -> DataFrame:
    """``word, n_period, n_plain, n_lower``: how often each lower-cased word stands before a period,
    without one, and before a period that lower case or a digit follows.

    Counts are added up in the tasks before words are shuffled, so a frequent word is one row a task.
    """

    def placed(v: Column) -> Column:
        listed = F.transform(
            v["w"],
            lambda t, i: F.struct(t.alias("t"), F.get(v["w"], i + 1).alias("next")),
        )
        return F.filter(listed, lambda e: F.regexp_like(e["t"], F.lit(TOKEN)))

    tokens = text.bind(placed, w=text.words(F.col(column)))
    rows = documents.select(F.explode(tokens).alias("e")).select("e.*")
    period = F.col("t").endswith(".")
    lower = period & F.regexp_like(F.coalesce("next", F.lit("")), F.lit(LOWER))
    return (
        rows.select(
            F.lower(F.rtrim(F.col("t"), F.lit("."))).alias("word"),
            period.alias("period"), lower.alias("lower"),
        )
        .groupBy("word")
        .agg(
            F.count_if("period").alias("n_period"),
            F.count_if(~F.col("period")).alias("n_plain"),
            F.count_if("lower").alias("n_lower"),
        )
    )


def abbreviation_scores(types: DataFrame) -> DataFrame:
    """Adds ``score`` to the word types that stand before a period.

    Twice the log-likelihood ratio of "nearly always has its period" to "has one as often as any word",
    by the share of its periods that go on in lower case and by its length.
    """
    total = types.agg(F.sum("n_period").alias("p"), F.sum("n_plain").alias("q")).first()
    period, plain = total["p"] or 0, total["q"] or 0
    usual = (period + 1) / (period + plain + 2)
    n, m = F.col("n_period"), F.col("n_plain")
    null = n * F.log(F.lit(usual)) + m * F.log(F.lit(1 - usual))
    sure = n * F.log(F.lit(SURE)) + m * F.log(F.lit(1 - SURE))
    score = 2 * (sure - null) * F.col("n_lower") / n / F.char_length("word")
    return types.where(n > 0).withColumn("score", score)


def abbreviations(
    scored: DataFrame,
    least_seen: int = LEAST_SEEN,
    least_score: float = LEAST_SCORE,
    most: int = MOST,
) -> list[str]:
    """The surest abbreviations; at most ``most`` words reach the driver."""
    sure = scored.where((F.col("n_period") >= least_seen) & (F.col("score") >= least_score))
    return [r["word"] for r in sure.orderBy(F.desc("score"), "word").select("word").limit(most).collect()]


def paragraph_sentences(value: Column, known: list[str]) -> Column:
    """The sentences of one paragraph: pieces that end in ``.``, ``!`` or ``?`` before white space, put
    together again behind an abbreviation that lower case or a digit follows."""
    listed = F.array(*[F.lit(w) for w in known]).cast("array<string>")

    def goes_on(piece: Column, following: Column) -> Column:
        last = F.element_at(F.split(piece, " "), -1)
        word = F.when(F.regexp_like(last, F.lit(TOKEN)), F.lower(F.rtrim(last, F.lit("."))))
        ends = last.endswith(".") & F.coalesce(F.array_contains(listed, word), F.lit(False))
        return ends & F.regexp_like(following, F.lit(LOWER))

    def put(held: Column, piece: Column) -> Column:
        last = F.element_at(held, -1)
        merged = F.concat(
            F.slice(held, F.lit(1), F.size(held) - 1), F.array(F.concat_ws(" ", last, piece))
        )
        fresh = F.concat(held, F.array(piece))
        return F.when((F.size(held) > 0) & goes_on(last, piece), merged).otherwise(fresh)

    pieces = F.array_remove(F.split(text.squash(value), r"(?<=[.!?]) "), "")
    if not known:
        return pieces
    return F.aggregate(pieces, F.array().cast("array<string>"), put)


def sentences(document: Column, known: list[str]) -> Column:
    """Sentences of all paragraphs in order: a line break always ends one, so headings and list items
    stand by themselves."""
    lines = F.filter(F.split(document, r"\r\n?|\n"), text.has_ink)
    return F.flatten(F.transform(lines, lambda line: paragraph_sentences(line, known)))
