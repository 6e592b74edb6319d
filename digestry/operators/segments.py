"""Chunks along a hierarchy of separators, with line breaks kept.

A document falls into sections, these into paragraphs, lines, sentences, words and characters. A segment
is split only where it does not fit by itself, and neighbours are packed greedily, so a chunk ends at the
highest boundary near its size. Separators stay with the segment before them (headings open theirs), so
the segments of a document are the document. The packing is a fold over segment lengths; texts are cut
once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestry.functions import text

#: Where segments of each level end: after blank lines or before a heading, after an empty line, after a
#: line, after a sentence mark before white space, and after white space.
LEVELS = (
    r"(?<=\n\n\n)(?!\n)|(?<=\n)(?=#{1,6} )",
    r"(?<=\n\n)(?!\n)",
    r"(?<=\n)(?!\n)",
    r"(?<=[.!?])(?=[ \t\n])",
    r"(?<=[ \t])(?![ \t])",
)
SPACE = " \t\n\r"


def segment_lengths(document: Column, room: Column) -> Column:
    """The lengths of the highest segments that fit in ``room`` characters, in order."""

    def split(piece: Column, limit: Column, level: int) -> Column:
        if level == len(LEVELS):
            last = F.floor((F.char_length(piece) - 1) / limit).cast("int")
            return F.transform(
                F.sequence(F.lit(0), last),
                lambda i: F.least(limit, F.char_length(piece) - i * limit),
            )
        return F.flatten(
            F.transform(
                F.split(piece, LEVELS[level], -1),
                lambda p: F.when(F.char_length(p) <= limit, F.array(F.char_length(p))).otherwise(
                    split(p, limit, level + 1)
                ),
            )
        )

    lengths = text.bind(
        lambda v: split(v["document"], v["room"], 0), document=document, room=room
    )
    return F.filter(lengths, lambda n: n > 0)


def packed_ends(lengths: Column, room: Column) -> Column:
    """Where chunks end: each takes the following segments as long as they fit."""

    def put(held: Column, n: Column) -> Column:
        full = held["at"] + n - held["start"] > held["room"]
        return F.struct(
            F.when(full, F.concat(held["ends"], F.array(held["at"]))).otherwise(held["ends"]).alias("ends"),
            F.when(full, held["at"]).otherwise(held["start"]).alias("start"),
            (held["at"] + n).alias("at"),
            held["room"].alias("room"),
        )

    opened = F.struct(
        F.array().cast("array<int>").alias("ends"),
        F.lit(0).alias("start"),
        F.lit(0).alias("at"),
        room.cast("int").alias("room"),
    )
    return F.aggregate(
        lengths, opened, put, lambda held: F.concat(held["ends"], F.array(held["at"]))
    )


def segment_chunks(document: Column, size: Column, overlap: Column) -> Column:
    """Chunks of at most ``size`` characters. Each but the first opens with the ``overlap`` characters
    before it; white space around a chunk is dropped, and so are blank chunks."""

    def cut(v: Column) -> Column:
        def chunk(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(F.get(v["ends"], i - 1))
            first = F.greatest(start - v["overlap"], F.lit(0))
            return F.btrim(F.substring(v["document"], first + 1, end - first), F.lit(SPACE))

        return F.transform(v["ends"], chunk)

    room = F.greatest(size - overlap, F.lit(1)).cast("int")
    lengths = segment_lengths(document, room)
    chunks = text.bind(
        cut, document=document, overlap=overlap.cast("int"), ends=packed_ends(lengths, room)
    )
    return F.filter(chunks, text.has_ink)
