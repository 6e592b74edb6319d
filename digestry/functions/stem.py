"""Suffix stripping for English words after Porter (1980), with the customary small extensions.

Applied to words inside a pandas UDF with a per-worker memo, so each distinct word of a worker's
data is stemmed about once and nothing is shuffled for it.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Irregular forms, and the suffix tables of steps 2 to 4 of the published algorithm.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
    ("fulli", "ful"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism",
    "ate", "iti", "ous", "ive", "ize",
)

MEMO_WORDS = 1 << 19
MIN_STEMMED = 4


def _shape(stem: str) -> str:
    """The stem as a string of ``v`` and ``c``; ``y`` is a vowel after a consonant."""
    out: list[str] = []
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1] == "c")
        out.append("v" if vowel else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    shape = _shape(word)
    return (shape.endswith("cvc") and word[-1] not in "wxy") or shape == "vc"


def _plural(word: str) -> str:
    if word.endswith("ies") and len(word) == 4:
        return word[:-1]
    for suffix, into in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: -len(suffix)] + into
    return word


def _past(word: str) -> str:
    if word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        stem = word[: -len(suffix)]
        if word.endswith(suffix) and "v" in _shape(stem):
            break
    else:
        return word
    if stem.endswith(("at", "bl", "iz")):
        return stem + "e"
    if _double(stem):
        return stem if stem[-1] in "lsz" else stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _short(stem) else stem


def _final_y(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and _shape(word[:-1])[-1] == "c":
        return word[:-1] + "i"
    return word


def _derivation(word: str) -> str:
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _derivation(word[:-2])
    if word.endswith("logi"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _replace(word, STEP2)


def _replace(word: str, table: tuple[tuple[str, str], ...]) -> str:
    """Apply the first suffix that matches, on condition of a positive measure before it."""
    for suffix, into in table:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + into if _measure(stem) > 0 else word
    return word


def _residual(word: str) -> str:
    for suffix in STEP4:
        if word.endswith(suffix):
            break
    else:
        if not word.endswith("ion"):
            return word
        stem = word[:-3]
        return stem if stem and stem[-1] in "st" and _measure(stem) > 1 else word
    stem = word[: -len(suffix)]
    return stem if _measure(stem) > 1 else word


def _final_e(word: str) -> str:
    if not word.endswith("e"):
        return word
    stem = word[:-1]
    m = _measure(stem)
    return stem if m > 1 or (m == 1 and not _short(stem)) else word


def _final_ll(word: str) -> str:
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


@lru_cache(maxsize=MEMO_WORDS)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    for step in (_plural, _past, _final_y, _derivation):
        word = step(word)
    word = _replace(word, STEP3)
    for step in (_residual, _final_e, _final_ll):
        word = step(word)
    return word


def stemmed(line: str) -> str:
    return " ".join(stem(w) if len(w) >= MIN_STEMMED else w for w in line.split())


@F.pandas_udf(T.StringType())
def stem_line(lines: pd.Series) -> pd.Series:
    """Stem the words of space-joined lines; words of up to three letters stay as they are."""
    return lines.map(stemmed)
