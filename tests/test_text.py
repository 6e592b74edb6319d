import re
import sys

import pytest
from pyspark.sql import functions as F

from digestry.functions import prompts, text, tokens
from digestry.functions.stem import stem

SPACES = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    return [r[0] for r in df.orderBy("id").select(expression(F.col("v"))).collect()]


def test_whitespace_class_is_complete(spark):
    assert len(SPACES) == 29
    values = [f"{s}a{s}{s}b{s}" for s in SPACES] + ["", "".join(SPACES), None, "a  b", "​a"]
    expected = [" ".join((v or "").split()) for v in values]
    assert column(spark, values, text.squash) == expected
    assert column(spark, expected, text.squash) == expected
    counts = [len((v or "").split()) for v in values]
    assert column(spark, values, text.word_count) == counts
    assert column(spark, expected, lambda c: text.word_count(c, normalized=True)) == counts
    assert column(spark, values, text.has_ink) == [n > 0 for n in counts]


def test_prompts_keep_data_inert(spark):
    values = ["{document}", "{", "$1", "\\1", "a\nb", ""]
    got = column(spark, values, lambda c: prompts.training_text(c, c))
    assert got == [prompts.SUMMARIZE.text(v) + v for v in values]
    assert prompts.SUMMARIZE.text("X").endswith("Document:\nX\n\nSummary:\n")
    with pytest.raises(ValueError):
        prompts.REFINE.render(F.lit("only one"))


def brute_13a(line):
    line = line.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, plain in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        line = line.replace(entity, plain)
    line = f" {line} "
    line = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", line)
    line = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", line)
    line = re.sub(r"([\.,])([^0-9])", r" \1 \2", line)
    line = re.sub(r"([0-9])(-)", r"\1 \2 ", line)
    return line.split()


LINES = [
    "Hello, world! It's 1,000.5 (or 3-4) & more...",
    "a &quot;quoted&quot; &lt;tag&gt; a&amp;b",
    "trail-\ning line\nbreak <skipped> é ü 你好。",
    "x=[y]{z}~`^ a/b:c;d?e@f",
    "",
    "2-3-4 .5 5. ,,",
]


def test_13a_tokens(spark):
    assert column(spark, LINES, text.bleu_tokens) == [brute_13a(v) for v in LINES]


def test_rouge_tokens_and_sentences(spark):
    expected = [re.findall(r"[a-z0-9]+", v.lower()) for v in LINES]
    assert column(spark, LINES, text.rouge_tokens) == expected
    got = column(spark, ["One. Two!  Three? four", "a.b c. ", "", "no end"], text.sentences)
    assert got == [["One.", "Two!", "Three?", "four"], ["a.b c."], [], ["no end"]]


def test_ngrams_guard_short_arrays(spark):
    got = column(spark, ["a b c", "a", ""], lambda c: text.ngrams(text.words(c), 2))
    assert got == [["a b", "b c"], [], []]


@pytest.mark.parametrize(
    "word, expected",
    [
        # Examples printed with the published algorithm.
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"),
        ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"),
        ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"),
        ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"),
        ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"),
        ("vileli", "vile"), ("vietnamization", "vietnam"), ("operator", "oper"),
        ("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"),
        ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"),
        ("revival", "reviv"), ("allowance", "allow"), ("adjustment", "adjust"),
        ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"),
        ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
        # Extensions.
        ("dying", "die"), ("skies", "sky"), ("died", "die"), ("spied", "spi"), ("flies", "fli"),
        ("enjoy", "enjoy"), ("by", "by"), ("geology", "geolog"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_truncation_budget(spark):
    overhead = tokens.WORDS.count_text(prompts.SUMMARIZE.text("")) + 2
    cases = [  # document, summary, max length, expected
        ("a b c d", "s", overhead + 1 + 4, "a b c d"),
        ("a b c d", "s", overhead + 1 + 3, "a b c"),
        ("a b c d", "s", overhead + 1, "a b c d"),
        ("a b c d", "s", overhead - 5, "a b c d"),
        ("", "s", overhead + 9, ""),
    ]
    for document, summary, limit, expected in cases:
        df = spark.createDataFrame([(document, summary)], "d string, s string")
        cut = tokens.truncate_to_budget(F.col("d"), F.col("s"), limit)
        assert df.select(cut).first()[0] == expected


def test_tokenizer_plugin(spark):
    by_char = tokens.EncoderTokenizer(list, "".join)
    df = spark.createDataFrame([("abcdef", "xy")], "d string, s string")
    overhead = by_char.count_text(prompts.SUMMARIZE.text("")) + 2
    cut = tokens.truncate_to_budget(F.col("d"), F.col("s"), overhead + 2 + 3, by_char)
    row = df.select(cut.alias("c"), by_char.count(F.col("d")).alias("n")).first()
    assert (row["c"], row["n"]) == ("abc", 6)


def test_chars_per_token(spark):
    got = column(spark, ["aaa bbb", "", "a b"], lambda c: tokens.chars_per_token(c))
    assert got == [3.5, 4.0, 1.5]
