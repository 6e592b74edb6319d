"""Subword tokens: each text is encoded once, everything else is columns over its token ends or their number."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry.functions import text

#: Rows are encoded together up to so many bytes of text: what a Python worker holds beside its Arrow batch.
CHUNK_BYTES = 512 << 10

#: Texts to the ends of their tokens: offsets in characters, in order.
Encode = Callable[[list[str]], list[list[int]]]


def chars_per_token(text: Column, n: Column) -> Column:
    """Of a text with ``n`` tokens; 4 where it has none."""
    long = F.char_length(text) / F.greatest(n, F.lit(1))
    return F.when(n > 0, F.greatest(F.lit(1.0), long)).otherwise(F.lit(4.0))


@dataclass(frozen=True)
class Measured:
    """A text and the ends of its tokens, both columns."""

    text: Column
    ends: Column

    def count(self) -> Column:
        return F.size(self.ends)

    def head(self, n: Column) -> Column:
        """The text up to the end of its ``n``-th token."""
        last = F.get(self.ends, F.greatest(n, F.lit(1)) - 1)
        return (
            F.when(n >= self.count(), self.text)
            .when(n <= 0, F.lit(""))
            .otherwise(F.substring(self.text, F.lit(1), last))
        )

    def chars_per_token(self) -> Column:
        return chars_per_token(self.text, self.count())

    def windows(self, size: int, overlap: int) -> Column:
        """Overlapping windows of whole tokens, stepping until the tokens run out. A window starts
        where the token before it ends, less the white space there; blank ones drop out."""
        step = max(1, size - overlap)

        def cut(v: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.size(v["ends"]) - 1, F.lit(0)), F.lit(step))

            def window(i: Column) -> Column:
                first = F.when(i > 0, F.get(v["ends"], i - 1)).otherwise(F.lit(0))
                last = F.get(v["ends"], F.least(i + size, F.size(v["ends"])) - 1)
                return F.btrim(F.substring(v["text"], first + 1, F.coalesce(last, F.lit(0)) - first))

            return F.filter(F.transform(starts, window), text.has_ink)

        return text.bind(cut, ends=self.ends, text=self.text)


@lru_cache(maxsize=1)
def _library(definition: str):
    """The library's tokenizer, held by a Python worker for all its tasks: one a task adds up."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class SubwordTokenizer:
    """A plug-in tokenizer. ``load`` gives an ``Encode``; a Python worker calls it once a task."""

    def __init__(self, load: Callable[[], Encode]):
        self._load = load
        self._held: Encode | None = None

        @F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
        def ends(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return (_nested(rows, _flat(held)) for rows, held in _encoded(batches, load()))

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for rows, held in _encoded(batches, load()):
                yield _nested(rows, pa.array([len(e) for e in held], pa.int32()))

        self._ends, self._counts = ends, counts

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> SubwordTokenizer:
        """A vocabulary in the JSON format of the ``tokenizers`` library; the file goes to the workers."""
        definition = spark.sparkContext.broadcast(Path(path).read_text())

        def load() -> Encode:
            tokenizer = _library(definition.value)

            def encode(texts: list[str]) -> list[list[int]]:
                # one by one: the library's threads keep memory of their own, and tasks share the cores
                coded = (tokenizer.encode(t, add_special_tokens=False) for t in texts)
                # tokens that share a character end with it
                return [np.maximum.accumulate([e for _, e in c.offsets] or [0])[: len(c)] for c in coded]

            return encode

        return cls(load)

    def measure(self, df: DataFrame, **columns: str) -> DataFrame:
        """Adds, under each name, the token ends of a text column. All columns of a row are encoded in
        one pass over the rows."""
        return self._added(df, self._ends, columns)

    def counted(self, df: DataFrame, **columns: str) -> DataFrame:
        """``measure`` for the number of tokens alone, so that no ends come back from Python."""
        return self._added(df, self._counts, columns)

    def _added(self, df: DataFrame, found: Callable[[Column], Column], columns: dict[str, str]) -> DataFrame:
        names = list(columns)
        held = df.withColumn("_found", found(F.array(*[F.col(columns[n]) for n in names])))
        return held.withColumns({n: F.get("_found", F.lit(i)) for i, n in enumerate(names)}).drop("_found")

    def count_text(self, value: str) -> int:
        """Tokens of one short text, on the driver: a prompt around documents."""
        if self._held is None:
            self._held = self._load()
        return len(self._held([value])[0])


def _encoded(
    batches: Iterator[pa.ListArray], encode: Encode
) -> Iterator[tuple[pa.ListArray, list[list[int]]]]:
    """Some rows at a time and what their texts are encoded to."""
    for batch in batches:
        for rows in _parts(batch):
            yield rows, encode([t or "" for t in rows.flatten().to_pylist()])


def _parts(batch: pa.ListArray) -> Iterator[pa.ListArray]:
    """The rows of ``batch`` in runs that end with the row that fills ``CHUNK_BYTES``."""
    sizes = pc.fill_null(pc.binary_length(batch.flatten()), 0).to_numpy()
    filled = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    rows = batch.offsets.to_numpy().astype(np.int64)
    done = filled[rows - rows[0]]
    first = 0
    while first < len(batch):
        last = min(int(np.searchsorted(done, done[first] + CHUNK_BYTES)), len(batch))
        yield batch.slice(first, last - first)
        first = last


def _flat(ends: list) -> pa.Array:
    offsets = np.cumsum([0, *map(len, ends)]).astype(np.int32)
    flat = np.concatenate([*ends, np.empty(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _nested(rows: pa.ListArray, values: pa.Array) -> pa.Array:
    """What the texts of each row of ``rows`` gave."""
    offsets = rows.offsets.to_numpy().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), values)
