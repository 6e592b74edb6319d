"""Packing of token sequences into windows of a fixed length.

Online and in bounded space: each partition keeps a fixed number of open windows. A document is cut
into full windows and a rest; the rest goes into the open window that it fills best; where none has
room, the fullest one is closed and a new one opened. What is still open at the end of a partition
is packed once more, largest pieces first, over groups of partitions. Texts never cross the network:
only piece rows do, and only those of open windows.

Results for edge cases: a null or empty text is a document of its end token alone. Equal documents
and repeated ids are packed each for itself. An empty table gives no rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.bpe import BATCH, coder, slices
from digestry.llm.common import body, ready, save

WINDOW = 2048
OPEN_WINDOWS = 256
END_TOKEN = 1
#: So many partitions' open windows are merged together.
MERGED_PARTITIONS = 16
#: Merged sequences are numbered from here, per group.
MERGED = 1 << 62

Piece = tuple[object, int, int, int, int, bytes]


class OpenWindows:
    """At most ``most`` open windows (any number for None), by the room that they have left."""

    def __init__(self, window: int, most: int | None):
        self.window, self.most = window, most
        self.rooms: list[tuple[int, int]] = []
        self.pieces: dict[int, list[Piece]] = {}
        self.made = 0

    def open(self) -> int:
        self.made += 1
        return self.made - 1

    def place(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        """Put a piece where it fits best; gives the windows that this closes."""
        length = piece[2]
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, name = self.rooms.pop(at)
        else:
            if self.most is not None and len(self.rooms) >= self.most:
                yield self.close(0)
            room, name = self.window, self.open()
        self.pieces.setdefault(name, []).append(piece)
        if room > length:
            insort(self.rooms, (room - length, name))
        else:
            yield name, self.pieces.pop(name)

    def close(self, at: int) -> tuple[int, list[Piece]]:
        _, name = self.rooms.pop(at)
        return name, self.pieces.pop(name)

    def rest(self) -> Iterator[tuple[int, list[Piece]]]:
        while self.rooms:
            yield self.close(0)


def cut(key: object, ids: bytes, window: int) -> Iterator[Piece]:
    """The pieces of one document: key, start, length, crc32, tokens of the document, ids."""
    total = len(ids) // 4
    for start in range(0, total, window):
        part = ids[4 * start : 4 * (start + window)]
        yield key, start, len(part) // 4, zlib.crc32(part), total, part


def schema(df: DataFrame, key: str, keep_ids: bool) -> str:
    kind = df.schema[key].dataType.simpleString()
    return (
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, part long" + (", ids binary" if keep_ids else "")
    )


def rows(windows: Iterable[tuple[int | None, list[Piece]]], part: int, keep_ids: bool):
    for name, pieces in windows:
        offset = 0
        for key, start, length, crc, total, ids in pieces:
            row = (key, start, length, crc, total, name, offset, part)
            yield (*row, ids) if keep_ids else row
            offset += length


def pack(
    docs: DataFrame,
    key: str,
    text: str,
    vocabulary: Broadcast,
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``,
    and with ``keep_ids`` the piece's packed ids."""
    spark = ready(docs.sparkSession, BATCH)
    bare = docs.select(F.col(key).alias("doc_id"), body(text).alias("text"))
    columns = schema(bare, "doc_id", keep_ids)
    names = [c.split()[0] for c in columns.split(", ")]
    end = END_TOKEN.to_bytes(4, "little")

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = OpenWindows(window, open_windows)
        kinds: pa.Schema | None = None

        def batch(windows: Iterable[tuple[int | None, list[Piece]]]) -> pa.RecordBatch:
            lists = list(zip(*rows(windows, part, keep_ids))) or [[]] * len(names)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(lists, kinds.types)], schema=kinds
            )

        for got in batches:
            if kinds is None:
                kinds = pa.schema(
                    [("doc_id", got.schema.field("doc_id").type)]
                    + [(n, pa.binary() if n == "ids" else pa.int64()) for n in names[1:]]
                )
            for keys, texts in slices(got.column("doc_id"), got.column("text")):
                encoded = coder(vocabulary.value).encode(texts)
                closed: list[tuple[int, list[Piece]]] = []
                for name, ids in zip(keys.to_pylist(), encoded.to_pylist()):
                    for piece in cut(name, ids + end, window):
                        lean = piece if keep_ids else (*piece[:5], b"")
                        closed.extend(held.place(lean))
                yield batch([((part << 32) + n, pieces) for n, pieces in closed])
        if kinds is not None:
            yield batch((None, pieces) for _, pieces in held.rest())

    def merge(group: tuple, pieces: pa.Table) -> pa.Table:
        held = OpenWindows(window, None)
        whole: list[tuple[int, list[Piece]]] = []
        fields = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else []))
        listed = list(zip(*(pieces.column(f).to_pylist() for f in fields)))
        listed.sort(key=lambda p: (-p[2], p[0] is None, 0 if p[0] is None else p[0], p[1]))
        for piece in listed:
            whole.extend(held.place(piece if keep_ids else (*piece, b"")))
        whole.extend(held.rest())
        part = group[0].as_py()
        first = MERGED + (part << 32)
        lists = zip(*rows(((first + n, p) for n, p in whole), part, keep_ids))
        kinds = pa.schema([pieces.schema.field(n) for n in names])
        return pa.table([pa.array(c, t) for c, t in zip(lists, kinds.types)], schema=kinds)

    placed = save(bare.mapInArrow(online, columns), "packed")
    still_open = placed.where(F.col("sequence_id").isNull())
    merged = still_open.groupBy(
        F.expr(f"part div {MERGED_PARTITIONS}").alias("group")
    ).applyInArrow(merge, columns)
    return placed.where(F.col("sequence_id").isNotNull()).unionByName(merged).drop("part")
