"""Tokens and shared n-grams of a batch of text pairs, over whole Arrow columns.

Words become numbers and are cut into tokens once per batch, however often they occur, and n-grams grow from the (n-1)-grams that both texts of a pair have,
so a longer order only looks at what is left of the shorter one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from digestry.functions.stem import stemmed
from digestry.functions.text import ENTITY_UNESCAPES, RULES_13A

#: Bytes of text that are coded together; a longer pair is coded alone.
BLOCK_BYTES = 4 << 20
# Fixed values: ``text.BLANK_RUN`` and ``text.ROUGE_BREAK`` for RE2.
BLANK_RUN = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
ROUGE_BREAK = r"[^a-z0-9]+"


@dataclass(frozen=True)
class Cut:
    """How texts become tokens: ``prepare`` works on whole texts, ``lines`` on their distinct words between
    spaces, which it turns into space-parted tokens."""

    prepare: Callable[[pa.Array], pa.Array] = lambda texts: texts
    lines: Callable[[pa.Array], pa.Array] = lambda words: words


def _rouge_lines(words: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(words, ROUGE_BREAK, " ")


def _stemmed_lines(words: pa.Array) -> pa.Array:
    return pa.array([stemmed(line) for line in _rouge_lines(words).to_pylist()], pa.string())


def _bleu_texts(texts: pa.Array) -> pa.Array:
    line = pc.replace_substring(texts, "<skipped>", "")
    line = pc.replace_substring(line, "-\n", "")
    return pc.replace_substring(line, "\n", " ")


def _bleu_lines(words: pa.Array) -> pa.Array:
    # No rule reaches over a space, so a word between spaces is cut as it is in its text.
    line = words
    for entity, plain in ENTITY_UNESCAPES:
        line = pc.replace_substring(line, entity, plain)
    line = pc.binary_join_element_wise(" ", line, " ", "")
    for pattern, replacement in RULES_13A:
        line = pc.replace_substring_regex(line, pattern, replacement.replace("$", "\\"))
    return pc.replace_substring_regex(line, BLANK_RUN, " ")


#: Texts that are space-parted tokens already; ROUGE tokens of lower-cased texts, plain and stemmed; "13a".
PLAIN, ROUGE, STEMMED, BLEU = Cut(), Cut(lines=_rouge_lines), Cut(lines=_stemmed_lines), Cut(_bleu_texts, _bleu_lines)


def _split(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Parts between spaces, empty ones left out, and the position of the line of each."""
    listed = pc.split_pattern(lines, " ")
    values, row = listed.flatten(), pc.list_parent_indices(listed)
    inked = pc.not_equal(values, "")
    return values.filter(inked), row.filter(inked).to_numpy().astype(np.int64)


def _coded(texts: pa.Array, cut: Cut) -> tuple[np.ndarray, np.ndarray, int]:
    """The tokens as numbers, the position of the text of each, and how many numbers there are."""
    words, row = _split(cut.prepare(texts))
    encoded = words.dictionary_encode()
    tokens, of_word = _split(cut.lines(encoded.dictionary))
    tokens = tokens.dictionary_encode()
    size = np.bincount(of_word, minlength=len(encoded.dictionary))
    first = np.cumsum(size) - size
    at = encoded.indices.to_numpy()
    fan = size[at]
    inner = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    codes = tokens.indices.to_numpy()[np.repeat(first[at], fan) + inner]
    return codes.astype(np.int64), np.repeat(row, fan), len(tokens.dictionary)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, int]:
    codes, found = pd.factorize(keys)
    return codes, len(found)


def lcs_of_codes(a: Sequence[int], b: Sequence[int]) -> int:
    """Longest common subsequence with one bit per position of ``a``, which is the shorter one."""
    where: dict[int, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where[token]
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _common(codes: np.ndarray, rows: np.ndarray, left: int, n: int) -> np.ndarray:
    """Common subsequences of the pairs from the tokens that both texts have."""
    bounds = np.arange(n + 1)
    a, b = np.searchsorted(rows[:left], bounds), left + np.searchsorted(rows[left:], bounds)
    length = np.zeros(n, np.int64)
    for i in np.flatnonzero((np.diff(a) > 0) & (np.diff(b) > 0)):
        sides = codes[a[i] : a[i + 1]].tolist(), codes[b[i] : b[i + 1]].tolist()
        length[i] = lcs_of_codes(*sorted(sides, key=len))
    return length


def _block(left: pa.Array, right: pa.Array, orders: Sequence[int], lcs: bool, cut: Cut) -> np.ndarray:
    n = len(left)
    tokens, text_of, kinds = _coded(pa.concat_arrays([left, right]), cut)
    second = text_of >= n
    rows = np.where(second, text_of - n, text_of)
    out = [np.bincount(rows[side], minlength=n) for side in (~second, second)]
    codes, kinds = _runs(rows * kinds + tokens)
    place, shared = np.arange(len(rows)), {}
    for order in range(1, max(orders) + 1):
        if order > 1:
            # An n-gram is the (n-1)-gram at its place and the one at the next, both found on both sides.
            follows = np.flatnonzero(
                (place[1:] == place[:-1] + 1) & (rows[1:] == rows[:-1]) & (second[1:] == second[:-1])
            )
            keys = codes[follows] * kinds + codes[follows + 1]
            place, rows, second = place[follows], rows[follows], second[follows]
            codes, kinds = _runs(keys)
        counts = [np.bincount(codes[side], minlength=kinds) for side in (~second, second)]
        least = np.minimum(*counts)
        owner = np.zeros(kinds, np.int64)
        owner[codes] = rows
        shared[order] = np.bincount(owner, weights=least, minlength=n)[:n]
        kept = least[codes] > 0
        place, rows, second, codes = place[kept], rows[kept], second[kept], codes[kept]
        if order == 1 and lcs:
            common = _common(codes, rows, int(np.count_nonzero(~second)), n)
    out += [shared[order] for order in orders] + ([common] if lcs else [])
    return np.stack(out, axis=1).astype(np.int32)


def _blocks(left: pa.Array, right: pa.Array) -> Iterator[slice]:
    size = pc.add(pc.binary_length(left), pc.binary_length(right)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, more in enumerate(size):
        if held + more > BLOCK_BYTES and i > start:
            yield slice(start, i)
            start, held = i, 0
        held += more
    yield slice(start, len(size))


def overlaps(
    left: pa.Array, right: pa.Array, orders: Sequence[int], lcs: bool = False, cut: Cut = PLAIN
) -> pa.Array:
    """Per pair of texts: the tokens of each, the size of the multiset intersection of their n-grams for
    each of ``orders``, and on request the length of their longest common subsequence."""
    parts = [
        _block(left[part], right[part], orders, lcs, cut) for part in _blocks(left, right)
        if part.stop > part.start
    ]
    width = 2 + len(orders) + lcs
    found = np.concatenate(parts) if parts else np.zeros((0, width), np.int32)
    offsets = np.arange(len(found) + 1, dtype=np.int32) * width
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
