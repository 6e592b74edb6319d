"""Byte-level BPE with word ends: speculate with longest matches, verify pairs, merge the rest.

A word is first cut greedily into the longest known tokens. The cut is what merging would give if
every token is what its own bytes merge to, and no neighbouring pair would have met earlier: while
the merges run in order of rank, the border between two tokens is touched by the nodes on the right
edge of the one and on the left edge of the other, each of them between its own rank and its
parent's. A merge across the border of lower rank than both parents breaks the cut. All distinct
pairs of a batch are tested at once with arrays; only words that fail are merged exactly.

Results for edge cases: null and empty texts have no ids and decode to the empty text. Texts with
characters beyond the first two Latin blocks go through the vocabulary's own normalizer and
splitter, and then through the same speculation. The strings of special tokens in a text give their
ids, as the tokenizer's default does.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from digestry.llm.common import body, ready, remembered

NEVER = np.int64(1) << 40
#: Distinct words whose ids a Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
#: Texts are encoded together up to so many bytes.
CHUNK = 4 << 20
#: Texts come in Arrow batches of so many bytes, on the JVM's side and on the worker's.
BATCH = 8 << 20
#: Words of up to so many bytes are merged side by side in one array.
SIDE_BY_SIDE = 32
WORD_END = "</w>"
#: Stands for a word end where words are joined; bytes are characters below it.
END = "\u0100"


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in names)
    return [c for _, c in sorted((names | {b: chr(256 + n) for n, b in enumerate(rest)}).items())]


def split_pattern(limit: int) -> re.Pattern:
    """The vocabulary's split rule for lower-cased characters below ``limit``."""
    kinds: dict[str, list[str]] = {"L": [], "N": []}
    for c in map(chr, range(limit)):
        kinds.get(unicodedata.category(c)[0], []).append(c)
    letters, digits = (re.escape("".join(kinds[k])) for k in "LN")
    space = re.escape("\t\n\x0b\x0c\r \x85\xa0")
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+"
    )


class Coder:
    """Encoder and decoder of one vocabulary, held once by each Python worker."""

    PLAIN = 0x250

    def __init__(self, definition: str):
        self.library = Tokenizer.from_str(definition)
        known = json.loads(definition)
        model = known["model"]
        vocab, merges = model["vocab"], model["merges"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in known["added_tokens"])])
        byte_of = self.byte_of = {c: b for b, c in enumerate(byte_names())}
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for name, token in vocab.items():
            ends = name.endswith(WORD_END)
            raw = bytes(byte_of[c] for c in (name[: -len(WORD_END)] if ends else name))
            (self.final if ends else self.inner)[raw] = token
        self.matcher = ahocorasick.Automaton()
        for known_tokens, end in ((self.inner, ""), (self.final, END)):
            for raw, token in known_tokens.items():
                self.matcher.add_word(raw.decode("latin-1") + end, token)
        self.matcher.make_automaton()
        self.length = np.zeros(self.size, dtype=np.int64)  # in bytes, with one for a word end
        for known_tokens, end in ((self.inner, 0), (self.final, 1)):
            for raw, token in known_tokens.items():
                self.length[token] = len(raw) + end
        alphabet = [bytes([b]) for b in range(256)]
        self.base_inner = np.array([self.inner[b] for b in alphabet])
        self.base_final = np.array([self.final[b] for b in alphabet])
        names = [""] * self.size
        self.specials = {t["content"]: t["id"] for t in known["added_tokens"]}
        for name, token in {**vocab, **self.specials}.items():
            names[token] = name
        self.token_names = pa.array(names, pa.large_string())
        self.rank = np.full(self.size, -1, dtype=np.int64)
        self.left = np.zeros(self.size, dtype=np.int64)
        self.right = np.zeros(self.size, dtype=np.int64)
        keys = np.empty(len(merges), dtype=np.int64)
        made = np.empty(len(merges), dtype=np.int64)
        for at, (a, b) in enumerate(merges):
            token = vocab[a + b]
            if self.rank[token] >= 0:
                raise ValueError("two merges give the same token")
            self.rank[token], self.left[token], self.right[token] = at, vocab[a], vocab[b]
            keys[at], made[at] = vocab[a] * self.size + vocab[b], token
        if np.any(self.rank[self.left[made]] >= self.rank[made]) or np.any(
            self.rank[self.right[made]] >= self.rank[made]
        ):
            raise ValueError("a merge stands before the merges of its parts")
        order = np.argsort(keys)
        self.keys, self.key_ranks, self.made = keys[order], order.astype(np.int64), made
        self.stable = np.ones(self.size, dtype=bool)
        own = self.rank[made]
        self.stable[made] = self.compatible(self.left[made], self.right[made], own)
        for token in made:  # parts come before what they make
            self.stable[token] &= self.stable[self.left[token]] & self.stable[self.right[token]]
        self.plain = split_pattern(self.PLAIN)
        self.unusual = re.compile(f"[\x1c-\x1f\u0130]|<\\||[^\x00-{chr(self.PLAIN - 1)}]")
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.forget()

    def forget(self) -> None:
        """Know only the packed ids of special tokens, which stand for themselves."""
        packed = (token.to_bytes(4, "little") for token in self.specials.values())
        self.ids: dict[str | tuple[str, ...] | bytes, bytes] = {p: p for p in packed}

    # ---- verification ---------------------------------------------------------------------

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None):
        """Whether merging leaves the border of each pair alone (before rank ``until``)."""
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_ends = np.full(len(a), NEVER) if until is None else until.copy()
        y_ends = x_ends - 1 if until is not None else x_ends.copy()
        while len(at):
            meets = self.merge_rank(x, y)
            broken = (meets < x_ends) & (meets <= y_ends) & (meets < NEVER)
            good[at[broken]] = False
            x_born, y_born = self.rank[x], self.rank[y]
            back_x = x_born > y_born
            x_ends = np.where(back_x, x_born, x_ends)
            y_ends = np.where(back_x, y_ends, y_born)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
            on = ~broken & ((x_born >= 0) | (y_born >= 0))
            at, x, y, x_ends, y_ends = at[on], x[on], y[on], x_ends[on], y_ends[on]
        return good

    # ---- encoding of distinct words ---------------------------------------------------------

    def learn(self, new: list[str]) -> None:
        """Remember the ids of space-parted words that are not known yet."""
        findall = self.plain.findall
        whole = [w for w in new if isinstance(w, str) and w.isalpha()]
        parted = [w for w in new if not isinstance(w, str) or not w.isalpha()]
        split = [w if isinstance(w, tuple) else findall(w) for w in parted]
        bare = list({*whole, *(p for pieces in split for p in pieces if p not in self.ids)})
        self.ids.update(zip(bare, self.words_to_ids([w.encode() for w in bare])))
        for word, pieces in zip(parted, split):
            if len(pieces) != 1 or pieces[0] != word:
                self.ids[word] = b"".join([self.ids[p] for p in pieces])

    def words_to_ids(self, raw: list[bytes]) -> list[bytes]:
        """Ids of words as they are after the split: speculate, verify, merge what fails."""
        if not raw:
            return []
        line = END.join([w.decode("latin-1") for w in raw]) + END
        found = np.fromiter(chain.from_iterable(self.matcher.iter_long(line)), dtype=np.int64)
        tokens, stops = found[1::2], found[::2] + 1
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        owner = np.searchsorted(np.cumsum(sizes), stops, side="left")
        failed = np.bincount(owner, self.length[tokens], len(raw)) != sizes  # not covered
        failed[owner[~self.stable[tokens]]] = True
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(
            tokens[inside] * self.size + tokens[inside + 1], return_inverse=True
        )
        good = self.compatible(pairs // self.size, pairs % self.size)
        failed[owner[inside[~good[which]]]] = True
        flat = tokens.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(raw))) * 4
        out = [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]
        wrong = np.flatnonzero(failed).tolist()
        for at, ids in zip(wrong, self.merge_exactly([raw[i] for i in wrong])):
            out[at] = ids
        return out

    def merge_exactly(self, raw: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(raw)
        by_size = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        short = [i for i in by_size if len(raw[i]) <= SIDE_BY_SIDE]
        for first in range(0, len(short), 8192):
            group = short[first : first + 8192]
            for i, ids in zip(group, self.merge_side_by_side([raw[i] for i in group])):
                out[i] = ids
        for i in by_size[len(short) :]:
            out[i] = self.merge_long(raw[i])
        return out

    def merge_side_by_side(self, raw: list[bytes]) -> Iterator[bytes]:
        """One merge of each word at a time, the lowest rank first, then the leftmost."""
        sizes = np.array([len(w) for w in raw])
        width = sizes.max()
        held = np.zeros((len(raw), width), dtype=np.int64)
        letters = np.frombuffer(b"".join(raw), dtype=np.uint8)
        held[np.arange(width) < sizes[:, None]] = self.base_inner[letters]
        held[np.arange(len(raw)), sizes - 1] = self.base_final[letters[np.cumsum(sizes) - 1]]
        column = np.arange(max(width - 1, 1))
        ranks = np.full((len(raw), len(column)), NEVER)
        if width > 1:
            ranks[:] = self.merge_rank(held[:, :-1], held[:, 1:])
        ranks[column >= sizes[:, None] - 1] = NEVER
        live = np.arange(len(raw))
        while len(live):
            best = ranks[live].argmin(axis=1)
            lowest = ranks[live, best]
            go = lowest < NEVER
            live, best, lowest = live[go], best[go], lowest[go]
            if not len(live):
                break
            rows = held[live]
            rows[:, :-1] = np.where(np.arange(width - 1) > best[:, None], rows[:, 1:], rows[:, :-1])
            rows[np.arange(len(live)), best] = self.made[lowest]
            held[live] = rows
            sizes[live] -= 1
            own = ranks[live]
            own[:, :-1] = np.where(column[:-1] > best[:, None], own[:, 1:], own[:, :-1])
            own[column >= sizes[live][:, None] - 1] = NEVER
            for side in (best - 1, best):  # only the two pairs beside the new token changed
                some = np.flatnonzero((side >= 0) & (side < sizes[live] - 1))
                c = side[some]
                own[some, c] = self.merge_rank(rows[some, c], rows[some, c + 1])
            ranks[live] = own
        for row, n in zip(held.astype("<u4"), sizes):
            yield row[:n].tobytes()

    def merge_long(self, word: bytes) -> bytes:
        """The same merges for one long word, with a heap over linked symbols."""
        letters = np.frombuffer(word, dtype=np.uint8)
        held = [*self.base_inner[letters[:-1]].tolist(), int(self.base_final[letters[-1]])]
        after = [*range(1, len(held)), -1]
        before = list(range(-1, len(held) - 1))
        first = self.merge_rank(np.array(held[:-1]), np.array(held[1:])).tolist()
        heap = [(r, i, held[i], held[i + 1]) for i, r in enumerate(first) if r < NEVER]
        heapq.heapify(heap)
        lookup = self.pair_ranks()
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if held[i] != a or j < 0 or held[j] != b:
                continue
            held[i], held[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                y = after[x] if x >= 0 else -1
                if y >= 0:
                    found = lookup.get(held[x] * self.size + held[y])
                    if found is not None:
                        heapq.heappush(heap, (found, x, held[x], held[y]))
        return np.array([t for t in held if t >= 0], dtype="<u4").tobytes()

    def pair_ranks(self) -> dict[int, int]:
        if not hasattr(self, "_pair_ranks"):
            self._pair_ranks = dict(zip(self.keys.tolist(), self.key_ranks.tolist()))
        return self._pair_ranks

    # ---- texts --------------------------------------------------------------------------------

    def is_usual(self, text: str) -> bool:
        """Whether lower-casing and parting at spaces is all that comes before the split."""
        if text.isascii():
            return not any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", "<|"))
        return self.unusual.search(text) is None

    def pieces(self, text: str) -> Iterator[tuple[str, ...] | bytes]:
        """Of an unusual text: what the library's own normalizer and splitter make of it, and the
        packed ids of special tokens that stand in it."""
        for part in self.special.split(text):
            if part in self.specials:
                yield self.specials[part].to_bytes(4, "little")
                continue
            usual = self.library.normalizer.normalize_str(part)
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(usual):
                yield (bytes(self.byte_of[c] for c in piece).decode("utf-8"),)

    def known(self, keys: list) -> list[bytes]:
        """Ids of words or pieces, each given once."""
        found = list(map(self.ids.get, keys))
        if None in found:
            new = [p for p, ids in zip(keys, found) if ids is None]
            if len(self.ids) + len(new) > REMEMBERED:
                self.forget()  # but for what stands in these texts, as frequent words do
                self.ids.update((p, ids) for p, ids in zip(keys, found) if ids is not None)
            self.learn(new)
            found = [self.ids[p] if ids is None else ids for p, ids in zip(keys, found)]
        return found

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts, "")
        odd = {i: t for i, t in enumerate(texts.to_pylist()) if not self.is_usual(t)}
        if odd:
            texts = pc.if_else(np.isin(np.arange(len(texts)), list(odd)), "", texts)
        lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = pa.array([b"", *self.known([w for w in distinct if w])], pa.large_binary())
        place = np.cumsum([bool(w) for w in distinct], dtype=np.int64)
        place[[i for i, w in enumerate(distinct) if not w]] = 0
        taken = ids.take(pa.array(place[words.indices.to_numpy()]))
        joined = pc.binary_join(
            pa.LargeListArray.from_arrays(pc.cast(lists.offsets, pa.int64()), taken),
            pa.scalar(b"", pa.large_binary()),
        ).cast(pa.binary())
        if not odd:
            return joined
        own = {i: list(self.pieces(t)) for i, t in odd.items()}
        unique = list({p for pieces in own.values() for p in pieces})
        known = dict(zip(unique, self.known(unique)))
        rows = joined.to_pylist()
        for i, pieces in own.items():
            rows[i] = b"".join([known[p] for p in pieces])
        return pa.array(rows, pa.binary())

    def decode(self, packed: pa.Array) -> pa.Array:
        """The text of each packed list of ids: their tokens, with spaces between."""
        packed = pc.fill_null(packed, b"")
        ends = np.cumsum([0, *pc.binary_length(packed).to_pylist()]) // 4
        ids = np.frombuffer(b"".join(packed.to_pylist()), dtype="<u4")
        tokens = self.token_names.take(pa.array(ids))
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def coder(definition: str) -> Coder:
    coders: dict[str, Coder] = remembered("bpe")
    if definition not in coders:
        coders.clear()
        coders[definition] = Coder(definition)
    return coders[definition]


def share_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """Read a vocabulary file on the driver and hand it to the workers: under 2 MB, fixed."""
    return ready(spark, BATCH).sparkContext.broadcast(Path(path).read_text())


def code(
    docs: DataFrame, key: str, text: str, vocabulary: Broadcast, decoded: bool = True
) -> DataFrame:
    """``key, ids`` and with ``decoded`` also ``decoded``: the token ids of each text as packed
    little-endian unsigned 32-bit integers, and the text that these ids stand for."""
    bare = docs.select(F.col(key), body(text).alias("ids"))
    kind = bare.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary.value)
        for batch in batches:
            for keys, texts in slices(*batch.columns):
                ids = own.encode(texts)
                columns = [keys, ids, own.decode(ids)] if decoded else [keys, ids]
                names = [key, "ids", "decoded"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return bare.mapInArrow(run, f"`{key}` {kind}, ids binary" + ", decoded string" * decoded)


def decode(coded: DataFrame, key: str, ids: str, vocabulary: Broadcast) -> DataFrame:
    """``key, decoded``: the text that packed token ids stand for; null ids stand for none."""
    bare = coded.select(F.col(key), F.col(ids).alias("decoded"))
    kind = bare.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, packed in slices(*batch.columns):
                text = coder(vocabulary.value).decode(packed)
                yield pa.RecordBatch.from_arrays([keys, text], names=[key, "decoded"])

    return bare.mapInArrow(run, f"`{key}` {kind}, decoded string")


def slices(keys: pa.Array, values: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of rows with about ``CHUNK`` bytes of values each."""
    first, size = 0, 0
    for at, n in enumerate(pc.fill_null(pc.binary_length(values), 0).to_pylist()):
        size += n
        if size > CHUNK:
            yield keys.slice(first, at + 1 - first), values.slice(first, at + 1 - first)
            first, size = at + 1, 0
    if first < len(values):
        yield keys.slice(first), values.slice(first)
