"""Language-model scores from Brown word classes.

Exchange clustering finds the classes on a core: an item moves to the class that raises the
likelihood of the class bigrams most, until no item moves. The most frequent words are items of their
own; the others belong to an item by their last bytes. Then every word of at least ``LEAST`` training
tokens moves to the class that suits its own neighbours best: frequent words in sweeps, each of which
is kept only if it raises the likelihood of all training tokens, and the other words once, under the
classes of the last sweep. Words of fewer tokens and unseen ones have the class of their last bytes. A
text's probability multiplies, for each token, the smoothed transition from the class before to its
class, and the emission of the word from the class. As the word before, a word that is not frequent
stands for the class of its last bytes, which a task can tell by itself.

Counts cover all training texts. These are coded once, four bytes a token; counts of frequent words with
the classes beside them are added up in the tasks and cross the network as one row a task and word. Rare
words, none of which is a hot key, are shuffled: in training as one row a task and word, in scoring to
their counts and classes.

Results for edge cases: a null or empty text is its end token alone. Equal and repeated rows are
scored each for itself, rows with a null id are training rows. Without training texts counts and
base score are zero. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import body, ready, remainder, save
from digestry.session import drop_stored

PARTS, HELD_OUT = 7, 2
#: Words that are items of their own, and items for the other words by their last bytes.
WORD_ITEMS, SUFFIX_ITEMS, SUFFIX = 1024, 512, 3
CLASSES = 128
#: A word has a class of its own from so many training tokens on; sweeps over the frequent ones.
LEAST, WORD_SWEEPS = 2, 2
#: At most so many frequent words have their counts sent to every task.
KNOWN_WORDS = 100_000
SWEEPS = 12
#: Weight of the class frequencies in a transition, and of an unseen item in an emission.
PRIOR, UNSEEN = 20.0, 0.5
#: A task hands on its word counts at so many different words, or at so many tokens of rare ones.
FLUSH, RARE_FLUSH = 300_000, 1_000_000
#: Training texts are coded in rows of about so many tokens, and read so many by one task.
ROW_TOKENS, TASK_TOKENS = 1 << 18, 1 << 23
#: Whole texts reach a task in batches of so many bytes.
BATCH_BYTES = 8 << 20
END = ""  # the end token; no word is empty


def split(text: str) -> list[bytes]:
    """Words with A-Z lowered, as bytes; then the end token."""
    words = text.encode("utf-8").lower().split()
    words.append(b"")
    return words


def suffix_item(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % SUFFIX_ITEMS


def word_counts(training: DataFrame) -> DataFrame:
    """``word, n`` of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array(held.keys(), pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays(
                [words, pa.array(held.values(), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column("text").to_pylist():
                held.update(split(text))
                if len(held) > FLUSH:
                    yield flush()
                    held.clear()
        yield flush()

    return (
        training.select("text")
        .mapInArrow(run, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """The words above the least count that at most ``most`` words reach, most frequent first.

    Only the table of how many words have each count, and these words, come to the driver.
    """
    words = counts.where(F.col("word") != END)
    by_count = words.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()
    least, total = None, 0
    for row in by_count:
        total += row["count"]
        if total > most:
            break
        least = row["n"]
    if least is None:
        return []
    rows = words.where(F.col("n") >= least).select("word", "n").toArrow()
    pairs = zip(rows.column("word").to_pylist(), rows.column("n").to_pylist())
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


#: Items: 0 is the end token, then the word items, then the suffix items.
ITEMS = 1 + WORD_ITEMS + SUFFIX_ITEMS


def items_of(ids: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Item of each id: the rank of a frequent word, or -1 - suffix item of another one. ``suffix``
    has the suffix item of each rank."""
    known = np.where(ids <= WORD_ITEMS, ids, 1 + WORD_ITEMS + suffix[np.maximum(ids, 0)])
    return np.where(ids >= 0, known, WORD_ITEMS - ids)


def coded_texts(training: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``ids, rare, tokens``: rows of whole texts, each from an end token to an end token, as 32-bit
    ids, and the 64-bit hashes of their rare words in order."""
    shared = training.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        ids, rare = [0], []

        def flush() -> pa.RecordBatch:
            row = [
                pa.array([np.array(ids, dtype=np.int32).tobytes()], pa.binary()),
                pa.array([np.array(rare, dtype=np.uint64).tobytes()], pa.binary()),
                pa.array([len(ids) - 1], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(row, names=["ids", "rare", "tokens"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = split(text)
                found = list(map(ranks.get, words))
                if None in found:
                    for at, rank in enumerate(found):
                        if rank is None:
                            word = words[at]
                            found[at] = -1 - suffix_item(word)
                            rare.append(xxhash.xxh64_intdigest(word, HASH_SEED))
                ids.extend(found)
                if len(ids) > ROW_TOKENS:
                    yield flush()
                    ids, rare = [0], []
        if len(ids) > 1:
            yield flush()

    return training.select("text").mapInArrow(run, "ids binary, rare binary, tokens long")


def coded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for ids, rare in zip(batch.column("ids"), batch.column("rare")):
            yield (
                np.frombuffer(ids.as_buffer(), dtype=np.int32),
                np.frombuffer(rare.as_buffer(), dtype=np.int64),
            )


def _small_table(rows: DataFrame, height: int, width: int) -> np.ndarray:
    """``code, n`` added up into a table of fixed size."""
    found = rows.groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(height * width)
    table[found.column("code").to_numpy()] = found.column("n").to_numpy()
    return table.reshape(height, width)


def _cells(table: np.ndarray) -> Iterator[pa.RecordBatch]:
    found = np.flatnonzero(table)
    for at in range(0, len(found), 1 << 18):
        part = found[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(table.ravel()[part].astype(np.int64))], names=["code", "n"]
        )


def item_bigrams(coded: DataFrame, suffix: np.ndarray) -> np.ndarray:
    """Counts of neighbouring items, from an end token on; a table of fixed size."""
    shared = coded.sparkSession.sparkContext.broadcast(suffix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(ITEMS * ITEMS, dtype=np.int64)
        for ids, _ in coded_rows(batches):
            items = items_of(ids, shared.value)
            np.add.at(table, items[:-1] * ITEMS + items[1:], 1)
        yield from _cells(table)

    return _small_table(coded.mapInArrow(run, "code long, n long"), ITEMS, ITEMS)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item. Class 0 is the end token's alone.

    One item after the other, the most frequent first, leaves its class and enters the one with the
    greatest likelihood of the class bigrams. Items that never occur stay where they start.
    """
    size = len(bigrams)
    out, into = bigrams.sum(axis=1), bigrams.sum(axis=0)
    order = np.argsort(-into, kind="stable")
    order = order[(order != 0) & (into[order] > 0)]
    member = 1 + np.arange(size) % (classes - 1)
    member[order] = 1 + np.arange(len(order)) % (classes - 1)
    member[0] = 0
    one_hot = np.zeros((size, classes))
    one_hot[np.arange(size), member] = 1
    to_class, from_class = bigrams @ one_hot, bigrams.T @ one_hot  # by item: next, before
    table = one_hot.T @ to_class
    rows, columns = table.sum(axis=1), table.sum(axis=0)
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moves = 0
        for w in order:
            old, own = member[w], bigrams[w, w]
            right, left = to_class[w].copy(), from_class[w].copy()
            right[old] -= own
            left[old] -= own
            table[old] -= right
            table[:, old] -= left
            table[old, old] -= own
            rows[old] -= out[w]
            columns[old] -= into[w]
            by_row = _xlogx(table + right[None, :]) - _xlogx(table)
            by_column = _xlogx(table + left[:, None]) - _xlogx(table)
            both = table[diagonal, diagonal]
            gain = (
                by_row.sum(axis=1) - by_row[diagonal, diagonal]
                + by_column.sum(axis=0) - by_column[diagonal, diagonal]
                + _xlogx(both + left + right + own) - _xlogx(both)
                - _xlogx(rows + out[w]) + _xlogx(rows)
                - _xlogx(columns + into[w]) + _xlogx(columns)
            )
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9 * abs(gain[old]):
                new = old
            table[new] += right
            table[:, new] += left
            table[new, new] += own
            rows[new] += out[w]
            columns[new] += into[w]
            if new != old:
                moves += 1
                member[w] = new
                to_class[:, old] -= bigrams[:, w]
                to_class[:, new] += bigrams[:, w]
                from_class[:, old] -= bigrams[w]
                from_class[:, new] += bigrams[w]
        if not moves:
            break
    return member


def smoothed(table: np.ndarray) -> np.ndarray:
    """log10 of the probability of a class after a class."""
    frequency = (table.sum(axis=0) + 1) / (table.sum() + len(table))
    return np.log10((table + PRIOR * frequency) / (table.sum(axis=1, keepdims=True) + PRIOR))


def transitions(bigrams: np.ndarray, member: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """log10 of the probability of an item after a class, by class and item."""
    one_hot = np.zeros((len(bigrams), classes))
    one_hot[np.arange(len(bigrams)), member] = 1
    item = bigrams.sum(axis=0) + UNSEEN
    emission = item / (one_hot.T @ item)[member]
    return smoothed(one_hot.T @ bigrams @ one_hot)[:, member] + np.log10(emission)


# ---- classes of all words -----------------------------------------------------------------------

HASH_SEED = 42  # that of F.xxhash64


@dataclass
class Classes:
    """The class of each frequent word by rank, and of each suffix item."""

    words: np.ndarray
    suffix: np.ndarray

    def __post_init__(self):
        self.all = np.concatenate([self.suffix[::-1], self.words]).astype(np.int32)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.all[ids + len(self.suffix)]


def likelihood(table: np.ndarray) -> float:
    """What the classes decide of the log-likelihood of the tokens that ``table`` counts."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def class_table(coded: DataFrame, classes: Classes) -> np.ndarray:
    """Counts of neighbouring classes, rare words standing for their suffix."""
    shared = coded.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for ids, _ in coded_rows(batches):
            own = shared.value.of(ids)
            table += np.bincount(own[:-1] * CLASSES + own[1:], minlength=len(table))
        yield from _cells(table)

    return _small_table(coded.mapInArrow(run, "code long, n long"), CLASSES, CLASSES)


#: One row a task and word: how often the word stands beside each class. Cells below ``CLASSES`` are for
#: the class before it, the others for the class after it.
BESIDE = "id long, item int, cells binary, counts binary"


def _beside_rows(id_: np.ndarray, item: np.ndarray, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of ``BESIDE`` from cells in the order of their words."""
    first = np.flatnonzero(np.append(True, id_[1:] != id_[:-1])) if len(id_) else np.empty(0, np.int64)
    starts = np.append(first, len(id_))

    def lists(values: np.ndarray) -> pa.Array:
        offsets = (starts * values.itemsize).astype(np.int32)
        buffers = [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]
        return pa.Array.from_buffers(pa.binary(), len(first), buffers)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(id_[first].astype(np.int64)), pa.array(item[first].astype(np.int32)),
            lists(cell.astype(np.uint8)), lists(n.astype(np.int32)),
        ],
        names=["id", "item", "cells", "counts"],
    )


def beside_frequent(coded: DataFrame, classes: Classes, free: np.ndarray) -> DataFrame:
    """``BESIDE`` of the frequent words that are free to move, by rank."""
    shared = coded.sparkSession.sparkContext.broadcast((classes, free))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, may_move = shared.value
        flat = np.zeros(len(may_move) * 2 * CLASSES, dtype=np.int32)
        table = flat.reshape(-1, 2 * CLASSES)
        for ids, _ in coded_rows(batches):
            own = held.of(ids)
            at = np.flatnonzero((ids > 0) & may_move[np.maximum(ids, 0)])  # never the last token
            cell = ids[at].astype(np.int64) * (2 * CLASSES)
            np.add.at(flat, cell + own[at - 1], 1)
            np.add.at(flat, cell + CLASSES + own[at + 1], 1)
        for first in range(0, len(table), 4096):
            words, cells = np.nonzero(table[first : first + 4096])
            words += first
            yield _beside_rows(words, np.zeros_like(words), cells, table[words, cells])

    return coded.select("ids", "rare").mapInArrow(run, BESIDE)


def before_rare(coded: DataFrame, classes: Classes) -> DataFrame:
    """``BESIDE`` of the rare words, by hash, with the classes before them only."""
    shared = coded.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            id_, item, cell = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((cell, id_))
            id_, item, cell = id_[order], item[order], cell[order]
            new = np.append(True, (id_[1:] != id_[:-1]) | (cell[1:] != cell[:-1]))
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(id_)))
            return _beside_rows(id_[first], item[first], cell[first], n)

        for ids, rare in coded_rows(batches):
            at = np.flatnonzero(ids < 0)
            if len(at):
                held.append((rare, -1 - ids[at], shared.value.of(ids[at - 1])))
            if sum(len(h[0]) for h in held) > RARE_FLUSH:
                yield flush()
                held = []
        if held:
            yield flush()

    return coded.mapInArrow(run, BESIDE)


def by_word(
    batches: Iterator[pa.RecordBatch],
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, items and counts by cell of the words of one task, whose rows come sorted by id."""
    last: tuple[int, int, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, counts = batch.column("cells"), batch.column("counts")
        id_, item = batch.column("id").to_numpy(), batch.column("item").to_numpy()
        each = np.diff(np.frombuffer(cells.buffers()[1], dtype=np.int32)[cells.offset :][: len(cells) + 1])
        new = np.append(True, id_[1:] != id_[:-1])
        word = np.cumsum(new) - 1
        sums = np.zeros((word[-1] + 1, 2 * CLASSES), dtype=np.int64)
        flat = np.frombuffer(b"".join(cells.to_pylist()), dtype=np.uint8)
        number = np.frombuffer(b"".join(counts.to_pylist()), dtype=np.int32)
        np.add.at(sums, (np.repeat(word, each), flat), number)
        ids, items = id_[new], item[new]
        if last is not None:
            if last[0] == ids[0]:
                sums[0] += last[2]
            else:
                yield np.array([last[0]]), np.array([last[1]]), last[2][None, :]
        last = (int(ids[-1]), int(items[-1]), sums[-1].copy())  # may go on in the next batch
        yield ids[:-1], items[:-1], sums[:-1]
    if last is not None:
        yield np.array([last[0]]), np.array([last[1]]), last[2][None, :]


def best_classes(beside: np.ndarray, table: np.ndarray, both: bool) -> np.ndarray:
    """The likeliest class of each row of counts by the class before, and with ``both`` by the class
    after; never the end's."""
    held = np.log(table + 0.1)
    left, right = beside[:, :CLASSES], beside[:, CLASSES:]
    total = left.sum(axis=1, keepdims=True)
    gain = left @ held - total * np.log(table.sum(axis=0) + 1.0)[None, :]
    if both:
        gain = gain + right @ held.T - total * np.log(table.sum(axis=1) + 1.0)[None, :]
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def together(beside: DataFrame) -> DataFrame:
    """All rows of a word in one task, one after the other."""
    return beside.repartition("id").sortWithinPartitions("id")


def moved(coded: DataFrame, classes: Classes, free: np.ndarray, table: np.ndarray) -> Classes:
    """Every free frequent word in its best class; at most one row a frequent word reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, sums in by_word(batches):
            best = best_classes(sums, table, both=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids.astype(np.int32)), pa.array(best.astype(np.int32))], names=["id", "class"]
            )

    rows = together(beside_frequent(coded, classes, free)).mapInArrow(run, "id int, class int").toArrow()
    words = classes.words.copy()
    words[rows.column("id").to_numpy()] = rows.column("class").to_numpy()
    return Classes(words, classes.suffix)


def rare_classes(coded: DataFrame, classes: Classes, table: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``id, class`` of the rare words with classes of their own, and by how much the counts of
    neighbouring classes change when they take these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((CLASSES, CLASSES), dtype=np.int64)
        for ids, items, sums in by_word(batches):
            left = sums[:, :CLASSES]
            own = left.sum(axis=1) >= LEAST
            ids, items, left = ids[own], items[own], left[own]
            best = best_classes(sums[own], table, both=False)
            np.add.at(change.T, best, left)
            np.add.at(change.T, classes.suffix[items], -left)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(best.astype(np.int64)), pa.nulls(len(ids), pa.int64())],
                names=["id", "code", "n"],
            )
        code = np.flatnonzero(change)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(code), pa.int64()), pa.array(code), pa.array(change.ravel()[code])],
            names=["id", "code", "n"],
        )

    rows = save(
        together(before_rare(coded, classes)).mapInArrow(run, "id long, code long, n long"),
        "rare-classes",
    )
    change = _small_table(rows.where("id IS NULL").select("code", "n"), CLASSES, CLASSES)
    return rows.where("id IS NOT NULL").select("id", F.col("code").cast("int").alias("class")), change


def frequent_classes(
    coded: DataFrame, start: Classes, free: np.ndarray, table: np.ndarray
) -> tuple[Classes, np.ndarray, list[float]]:
    """The classes after the sweeps, their counts of neighbours, and the likelihood after each sweep;
    a sweep that does not raise it is undone and the last one."""
    classes, rising = start, [likelihood(table)]
    for _ in range(WORD_SWEEPS if free.any() else 0):
        tried = moved(coded, classes, free, table)
        after = class_table(coded, tried)
        if likelihood(after) <= rising[-1]:
            break
        classes, table = tried, after
        rising.append(likelihood(table))
    return classes, table, rising


@dataclass
class Model:
    step: np.ndarray  # log10 of a class after a class
    mass: np.ndarray  # log10 of the tokens of each class, with UNSEEN for each word and suffix item
    words: dict[bytes, tuple[int, int]]  # count and class of frequent words; class -1: of its suffix
    suffix_class: np.ndarray
    suffix: np.ndarray  # log10 of the probability of an unseen word from its class, by suffix item
    tokens: int
    distinct: int
    least: int  # the least count of a frequent word
    likelihoods: list[float]  # of the class bigrams, before the first sweep and after each

    def emission(self, n: np.ndarray, own: np.ndarray, item: np.ndarray) -> np.ndarray:
        """log10 of a word from its class; ``own`` is -1 where the class is that of the suffix."""
        return np.where(
            own >= 0, np.log10(n + UNSEEN) - self.mass[own], self.suffix[item] + np.log10(n + 1)
        )


def build(
    table: np.ndarray, own: np.ndarray, suffix_class: np.ndarray, left: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``step, mass, suffix`` of a model: ``own`` is the mass of the words with classes of their own
    by class, ``left`` the tokens of the other words by suffix item, ``inside`` their counts with one
    for each and one for the unseen."""
    mass = own + np.bincount(suffix_class, left + UNSEEN, CLASSES)
    mass = np.log10(np.maximum(mass, UNSEEN))
    suffix = np.log10(left + UNSEEN) - mass[suffix_class] - np.log10(inside)
    return smoothed(table), mass, suffix


def item_column() -> Column:
    """``suffix_item`` of the column ``word``."""
    return (F.crc32(F.substring(F.col("word").cast("binary"), -SUFFIX, SUFFIX)) % SUFFIX_ITEMS).cast("int")


def fit(training: DataFrame, counts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and ``word, n, class`` of the other training words (-1: the class of the suffix)."""
    frequent_words = frequent(counts, KNOWN_WORDS)
    least = frequent_words[-1][1] if frequent_words else 1
    listed = [b"", *(w.encode() for w, _ in frequent_words)]
    known = {w: i for i, w in enumerate(listed)}
    number = np.array([0, *(n for _, n in frequent_words)])
    item = np.array([suffix_item(w) for w in listed])

    written = save(coded_texts(training, known), "coded")
    tokens = written.agg(F.sum("tokens").alias("n")).first()["n"] or 0
    coded = written.coalesce(max(1, -(-tokens // TASK_TOKENS)))
    bigrams = item_bigrams(coded, item)
    member = exchange(bigrams)
    one_hot = np.eye(CLASSES)[member]
    ranks = np.arange(len(listed))
    start = Classes(member[items_of(ranks, item)], member[1 + WORD_ITEMS :])
    free = (ranks > WORD_ITEMS) & (number >= LEAST)
    classes, table, rising = frequent_classes(coded, start, free, one_hot.T @ bigrams @ one_hot)
    rare, change = rare_classes(coded, classes, table)
    final = save(
        counts.where((F.col("n") < least) & (F.col("word") != END))
        .withColumn("id", F.xxhash64("word"))
        .join(rare, "id", "left")
        .select("word", "n", F.coalesce("class", F.lit(-1)).alias("class")),
        "word-classes",
    )
    drop_stored(written)

    own_class = np.where((ranks <= WORD_ITEMS) | free, classes.words, -1)
    total = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")
    ).first()
    ends = total["n"] - int(number.sum())
    own, left, inside = np.zeros(CLASSES), np.zeros(SUFFIX_ITEMS), np.ones(SUFFIX_ITEMS)
    has = own_class >= 0
    np.add.at(own, own_class[has], number[has] + UNSEEN)
    np.add.at(left, item[~has], number[~has])
    np.add.at(inside, item[~has], number[~has] + 1)
    others = final.groupBy("class", F.when(F.col("class") < 0, item_column()).alias("item")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")
    )
    for row in others.collect():  # at most CLASSES + SUFFIX_ITEMS rows
        ends -= row["n"]
        if row["class"] >= 0:
            own[row["class"]] += row["n"] + UNSEEN * row["v"]
        else:
            left[row["item"]] += row["n"]
            inside[row["item"]] += row["n"] + row["v"]
    own[0] += ends  # what is left of the tokens are end tokens
    suffix_class = member[1 + WORD_ITEMS :]
    step, mass, suffix = build(table + change, own, suffix_class, left, inside)
    words = dict(zip(listed, zip(number.tolist(), own_class.tolist())))
    words[b""] = (ends, 0)
    model = Model(
        step, mass, words, suffix_class, suffix, total["n"], total["v"], least, rising
    )
    return model, final


LOCAL = "row long, doc_id {}, held_out boolean, n_tokens long, known long, base double, score double"
#: The rare words of a text: word, class before it, and how often it stands so.
RARE = "array<struct<word:string,before:int,times:int>>"


def local_scores(docs: DataFrame, model: Model) -> DataFrame:
    """What a task can tell of each text by itself, and the rare words that it still has to look up."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = {w: i for i, w in enumerate(m.words)}
        number = np.array([n for n, _ in m.words.values()], dtype=float)
        own = np.array([c for _, c in m.words.values()], dtype=np.int64)
        item = np.array([suffix_item(w) for w in m.words], dtype=np.int64)
        classes = Classes(np.where(own >= 0, own, m.suffix_class[item]), m.suffix_class)
        emitted, basic = m.emission(number, own, item), np.log10(number + 1)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            local, sizes = [], []
            rare: tuple[list, list, list] = ([], [], [])
            for text in batch.column("text").to_pylist():
                words = split(text)
                found = [names.get(w, -1) for w in words]
                ids = np.array(found)
                places = np.flatnonzero(ids < 0)
                others = [words[i] for i in places]
                ids[places] = [-1 - suffix_item(w) for w in others]
                context = classes.of(ids)
                before = np.append(0, context[:-1])
                seen = ids >= 0
                score = m.step[before[seen], context[seen]].sum() + emitted[ids[seen]].sum()
                together = Counter(zip(others, before[places].tolist()))
                rare[0].extend(w for w, _ in together)
                rare[1].extend(c for _, c in together)
                rare[2].extend(together.values())
                sizes.append(len(together))
                known = int((number[ids[seen]] > 0).sum())
                local.append((row, len(words), known, basic[ids[seen]].sum(), score))
                row += 1
            columns = list(zip(*local)) or [[]] * 5
            looked_up = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [
                        pa.array(rare[0], pa.binary()).cast(pa.string()),
                        pa.array(rare[1], pa.int32()),
                        pa.array(rare[2], pa.int32()),
                    ],
                    names=["word", "before", "times"],
                ),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()), batch.column("doc_id"),
                    batch.column("held_out"), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.float64()),
                    pa.array(columns[4], pa.float64()), looked_up,
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"{LOCAL.format(kind)}, rare {RARE}")


def _listed(values: np.ndarray) -> Column:
    mark = "D" if values.dtype.kind == "f" else ""
    return F.expr(f"array({','.join(f'{v!r}{mark}' for v in values.ravel().tolist())})")


def rare_scores(local: DataFrame, classes: DataFrame, model: Model) -> DataFrame:
    """``row, rare_known, rare_base, rare_score`` of the texts with rare words; columns only.

    No rare word has more than a ``KNOWN_WORDS``-th of the training tokens, so none is a hot key, and
    unseen ones have no counterpart that a hot one could be joined to in one task only.
    """
    item, own = item_column(), F.coalesce(F.col("class"), F.lit(-1))
    n = F.coalesce(F.col("n"), F.lit(0))
    of_suffix = F.get(_listed(model.suffix_class), item)
    emitted = F.when(
        own >= 0, F.log10(n + F.lit(UNSEEN)) - F.get(_listed(model.mass), own)
    ).otherwise(F.get(_listed(model.suffix), item) + F.log10(n + F.lit(1.0)))
    looked_up = (
        local.select("row", F.explode("rare").alias("r")).select("row", "r.*")
        .join(classes, "word", "left")
        .select(
            "row", "times", n.alias("n"), emitted.alias("emitted"),
            (F.col("before") * CLASSES + F.when(own >= 0, own).otherwise(of_suffix)).alias("cell"),
        )
    )
    value = F.col("emitted") + F.get(_listed(model.step), F.col("cell").cast("int"))
    return looked_up.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("rare_base"),
        F.sum(F.col("times") * value).alias("rare_score"),
    )


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``."""
    ready(docs.sparkSession, BATCH_BYTES)
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (remainder(key, PARTS) == HELD_OUT).alias("held_out"),
        body(text).alias("text"),
    )
    training = rows.where(~F.col("held_out"))
    counts = save(word_counts(training), "words")
    model, classes = fit(training, counts)
    drop_stored(counts)
    local = save(local_scores(rows, model), "local")
    none = F.lit(0.0)
    all_mass = float(np.log10(model.tokens + model.distinct + 1))
    total = F.col("score") + F.coalesce("rare_score", none)
    base = F.col("base") + F.coalesce("rare_base", none)
    return local.drop("rare").join(rare_scores(local, classes, model), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (base - F.col("n_tokens") * F.lit(all_mass)).alias("base_score"),
        total.alias("score"),
        F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
