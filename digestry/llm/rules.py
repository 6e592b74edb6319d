"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

Each rule bounds a ratio of two measures of the text. A text is kept if it passes the base rule and
every row of the table.

Results for edge cases: a null or empty text has no words, fails the base rule and is not kept. A
ratio with denominator zero counts as zero. Equal rows are judged alike; other columns of the input
stay as they are, also where they have the name of a measure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import SPACES, body, fresh, let, words


@dataclass(frozen=True)
class Rule:
    name: str
    part: str
    whole: str
    least: float
    most: float


#: Thresholds on ``part / whole``.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.5, 12.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.03, 1.0),
    Rule("words_with_letters", "n_letter_words", "n_words", 0.7, 1.0),
    Rule("capitals", "n_capitals", "n_letters", 0.0, 0.4),
    Rule("exclamations", "n_exclamations", "n_words", 0.0, 0.3),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0.0, 0.9),
    Rule("open_lines", "n_open_lines", "n_lines", 0.0, 0.3),
)
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
#: Frequent function words of the languages at hand.
STOP_WORDS = {
    "en": "the of and to a in is it that for as was with be by on are this from at or an",
    "fr": "le la les de des du un une et en que qui dans pour par sur au est avec",
    "de": "der die das und zu den von mit ist im auf ein eine nicht des dem es sich",
    "es": "el la los las de del y en que un una por con para se al es su",
}
ALL_STOP_WORDS = sorted({w for line in STOP_WORDS.values() for w in line.split()})
#: A whole word without a letter, found at word starts only.
NO_LETTER_WORD = r"(?<![^ \t-\r])[^ \t-\r\p{L}]++(?![^ \t-\r])"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _long(column: Column) -> Column:
    return column.cast("long")


def repeated_words(held: Column) -> Column:
    """Words inside 3-word windows that the text has twice or more, each word once."""
    count = F.size(held)
    grams = F.when(
        count >= 3,
        F.transform(
            F.sequence(F.lit(0), F.greatest(count - 3, F.lit(0))),
            lambda i: F.concat_ws(" ", F.get(held, i), F.get(held, i + 1), F.get(held, i + 2)),
        ),
    ).otherwise(F.array().cast("array<string>"))

    def ordered(v: Column) -> Column:
        pairs = F.transform(v["g"], lambda g, i: F.struct(g.alias("g"), i.alias("i")))
        return let(covered, s=F.sort_array(pairs))

    def covered(v: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(v["s"], k)["g"] == x["g"], F.lit(False))
        found = F.filter(v["s"], lambda x, k: ((k > 0) & same(x, k - 1)) | same(x, k + 1))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            F.sort_array(F.transform(found, lambda x: x["i"])),
            start,
            lambda s, at: F.struct(
                (s["n"] + at + 3 - F.greatest(at, s["end"])).alias("n"), (at + 3).alias("end")
            ),
            lambda s: s["n"],
        )

    return let(
        lambda v: F.when(F.size(F.array_distinct(v["g"])) == F.size(v["g"]), F.lit(0)).otherwise(
            ordered(v)
        ),
        g=grams,
    )


def measures(text: Column) -> Column:
    """A struct with every measure that the table names, and the base ones."""

    def lines_with_words(line: Column) -> Column:
        return F.length(F.translate(line, SPACES, "")) > 0

    def build(v: Column) -> Column:
        t, w, lines = v["t"], v["w"], v["lines"]
        stop = lambda x: F.lower(x).isin(ALL_STOP_WORDS)
        values = {
            "n_words": F.size(w),
            "word_chars": F.length(F.translate(t, SPACES, "")),
            "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeated_words(w),
            "n_lines": F.size(lines),
            "n_stop_words": F.size(F.filter(w, stop)),
            "n_letter_words": F.size(w) - F.regexp_count(t, F.lit(NO_LETTER_WORD)),
            "n_letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
            "n_capitals": F.length(F.regexp_replace(t, r"\P{Lu}+", "")),
            "n_exclamations": F.length(t) - F.length(F.translate(t, "!?", "")),
            "n_bullet_lines": F.size(F.filter(lines, lambda x: x.rlike(r"^[ \t]*[-*•]"))),
            "n_open_lines": F.size(
                F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))
            ),
        }
        return F.struct(*[_long(value).alias(name) for name, value in values.items()])

    return let(
        build, t=text, w=words(text), lines=F.filter(F.split(text, "\n"), lines_with_words)
    )


def passes(rule: Rule, m: str) -> Column:
    part, whole = F.col(f"{m}.{rule.part}"), F.col(f"{m}.{rule.whole}")
    ratio = F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    return ratio.between(rule.least, rule.most)


def judge(docs: DataFrame, text: str, out: str = "quality") -> DataFrame:
    """Adds the struct ``out`` with the measures, ``base_failed``, ``failed`` (names of the rules
    that the text breaks) and ``kept``."""
    m = fresh(docs, "_measures")
    base = (F.col(f"{m}.n_words") < LEAST_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MOST_REPEATED * F.col(f"{m}.n_words")
    )
    failed = F.array_compact(
        F.array(*[F.when(~passes(rule, m), F.lit(rule.name)) for rule in RULES])
    )
    kept = ~base
    for rule in RULES:
        kept = kept & passes(rule, m)
    whole = F.struct(f"{m}.*", base.alias("base_failed"), failed.alias("failed"), kept.alias("kept"))
    return docs.withColumn(m, measures(body(text))).withColumn(out, whole).drop(m)
