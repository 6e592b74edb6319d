"""Long-document strategies around a pluggable summarizer.

A document and its chunks stay in one row, so folding and tree merging are narrow: no shuffle and
no driver loop. ``merge_by_rounds`` is the alternative that spreads the chunks of one document.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text, tokens
from digestry.functions.prompts import MERGE, REFINE, SUMMARIZE, Template
from digestry.operators.chunks import with_chunks
from digestry.operators.rank import textrank
from digestry.session import drop_stored, stored

STRATEGIES = ("map-refine", "hierarchical", "extract-abstract")
DIRECT = "direct"


class Summarizer(Protocol):
    """A Column-to-Column summarizer. ``existing`` is the summary so far when refining; ``merging`` says
    that the document is summaries to be merged, for which a model has a prompt of its own."""

    def __call__(
        self,
        document: Column,
        existing: Column | None,
        min_tokens: Column,
        max_tokens: int,
        merging: bool = False,
    ) -> Column: ...


def lead(n: int) -> Summarizer:
    """The first words: ``n``, raised to the minimum and cut at the maximum.

    When refining, half of them open the summary so far and the rest come from the new section.
    """

    def first(value: Column, count: Column) -> Column:
        return F.slice(text.words(value), F.lit(1), F.greatest(count, F.lit(0)))

    def summarize(document, existing, min_tokens, max_tokens, merging=False):
        count = F.least(F.greatest(F.lit(n), min_tokens), F.lit(max_tokens)).cast("int")
        if existing is None:
            return F.array_join(first(document, count), " ")
        half = F.floor(count / 2).cast("int")
        return F.array_join(F.concat(first(existing, half), first(document, count - half)), " ")

    return summarize


def evenly(value: Column, count: Column) -> Column:
    """``count`` words that lie evenly over a text, in order."""

    def pick(v: Column) -> Column:
        size = F.size(v["w"])
        taken = F.least(v["k"], size)
        places = F.slice(F.sequence(F.lit(0), F.greatest(taken, F.lit(1))), F.lit(1), taken)
        return F.transform(places, lambda i: F.get(v["w"], F.floor(i * size / taken).cast("int")))

    return text.bind(pick, w=text.words(value), k=F.greatest(count, F.lit(0)))


def spaced(n: int) -> Summarizer:
    """Words that lie evenly over the whole input, in order; ``n`` as in ``lead``.

    When refining, the input is the summary so far and a quarter as many words of the new section,
    so that every section keeps a share of the result.
    """

    def summarize(document, existing, min_tokens, max_tokens, merging=False):
        count = F.least(F.greatest(F.lit(n), min_tokens), F.lit(max_tokens)).cast("int")
        if existing is None:
            return F.array_join(evenly(document, count), " ")
        section = F.array_join(evenly(document, F.floor(count / 4).cast("int")), " ")
        return F.array_join(evenly(F.concat_ws(" ", existing, section), count), " ")

    return summarize


def gathered(n: int, section: int = 4) -> Summarizer:
    """Shows every part of its input, for checks of the strategies: ``n`` words that lie evenly over a
    document or first chunk; the summary so far with ``section`` more words of a later chunk (more, where
    the minimum asks for it); and summaries to be merged whole, in brackets. The result grows with the
    number of chunks, so the maximum holds for the first case only.
    """
    even = spaced(n)

    def summarize(document, existing, min_tokens, max_tokens, merging=False):
        if merging:
            return F.array_join(
                F.concat(F.array(F.lit("[")), text.words(document), F.array(F.lit("]"))), " "
            )
        if existing is None:
            return even(document, None, min_tokens, max_tokens)
        missing = min_tokens - F.size(text.words(existing))
        count = F.greatest(F.lit(section), missing).cast("int")
        return F.concat_ws(" ", existing, F.array_join(evenly(document, count), " "))

    return summarize


def route(
    document_tokens: Column, strategy: Column, context: int, reserve: int, tokenizer=tokens.WORDS
) -> Column:
    """Documents that fit go direct, whatever the strategy."""
    return F.when(tokens.fits(document_tokens, context, reserve, tokenizer), DIRECT).otherwise(
        strategy
    )


def refine(chunks: Column, summarizer: Summarizer, min_tokens: int, max_tokens: int) -> Column:
    """Ordered fold over the chunks; the minimum applies to the last refinement only."""
    n = F.size(chunks)
    opening = summarizer(F.get(chunks, F.lit(0)), None, F.lit(0), max_tokens)
    later = F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(2), F.greatest(n - 1, F.lit(0)))

    def fold(so_far: Column, i: Column) -> Column:
        floor = F.when(i == n, F.lit(min_tokens)).otherwise(F.lit(0))
        return summarizer(F.get(chunks, i - 1), so_far, floor, max_tokens)

    return F.when(n > 0, F.aggregate(later, opening, fold)).otherwise("")


def merge_tree(chunks: Column, summarizer: Summarizer, min_tokens: int, max_tokens: int) -> Column:
    """Summaries of neighbours are joined and summarized again until one is left."""
    n = F.size(chunks)
    leaves = F.transform(chunks, lambda c: summarizer(c, None, F.lit(0), max_tokens))
    rounds = F.ceil(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")
    levels = F.slice(F.sequence(F.lit(1), F.greatest(rounds, F.lit(1))), F.lit(1), rounds)

    def level(held: Column, _: Column) -> Column:
        count = F.size(held)
        floor = F.when(count <= 2, F.lit(min_tokens)).otherwise(F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), F.floor((count - 1) / 2).cast("int")),
            lambda i: summarizer(
                F.array_join(F.slice(held, 2 * i + 1, F.lit(2)), "\n\n"), None, floor, max_tokens,
                merging=True,
            ),
        )

    return F.when(n > 0, F.get(F.aggregate(levels, leaves, level), F.lit(0))).otherwise("")


def merge_by_rounds(
    chunk_rows: DataFrame,
    key: str,
    summarizer: Summarizer,
    min_tokens: int,
    max_tokens: int,
) -> DataFrame:
    """``key, summary`` from ``explode_chunks`` rows, one driver round per tree level.

    A group holds at most two rows and the part count travels with the rows, so the chunks of a
    huge document stay spread over the cluster. Positions are dense from 0 within a document.
    """
    leaf = summarizer(F.col("chunk"), None, F.lit(0), max_tokens)
    state = stored(chunk_rows.select(key, "pos", F.col("parts").cast("long"), leaf.alias("summary")))
    done = stored(state.where("parts = 1").select(key, "summary"), "merged")
    floor = F.when(F.col("parts") <= 2, F.lit(min_tokens)).otherwise(F.lit(0))
    while not state.where("parts > 1").isEmpty():
        joined = (
            state.where("parts > 1").groupBy(key, "parts", F.floor(F.col("pos") / 2).alias("pos"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "summary"))).alias("_two"))
            .withColumn("_joined", F.array_join(F.col("_two.summary"), "\n\n"))
        )
        merged = stored(
            joined.select(
                key,
                "pos",
                F.ceil(F.col("parts") / 2).alias("parts"),
                summarizer(F.col("_joined"), None, floor, max_tokens, merging=True).alias("summary"),
            )
        )
        done = done.unionByName(
            stored(merged.where("parts = 1").select(key, "summary"), "merged")
        )
        drop_stored(state)
        state = merged
    return done


def with_extract_chunks(
    df: DataFrame, key: str, size: int, boundary: str, tokenizer=tokens.WORDS
) -> DataFrame:
    ranked = textrank(df, key)
    return with_chunks(
        ranked, size, boundary=boundary, column="extracted", out="extract_chunks", tokenizer=tokenizer
    )


def summarize(
    df: DataFrame,
    key: str,
    summarizer: Summarizer,
    strategies: tuple[str, ...] = STRATEGIES,
    context: int = 32_768,
    max_sequence: int = 1024,
    min_summary: int = 64,
    max_summary: int = 1024,
    boundary: str = "word",
    tokenizer=tokens.WORDS,
    label: str | None = None,
) -> DataFrame:
    """``df`` columns plus ``strategy, strategy_rank, route, summary``: one row per strategy.

    ``label`` names a system column when several summarizers run one after another.
    """
    staged = stage(df, key, strategies, context, max_sequence, max_summary, boundary, tokenizer)
    entries = strategy_entries(summarizer, strategies, context, min_summary, max_summary, tokenizer)
    out = staged.select(*df.columns, "document_tokens", F.explode(entries).alias("e")).select(
        *df.columns, "document_tokens", "e.*"
    )
    return out.withColumn("system", F.lit(label)) if label else out


def stage(
    df: DataFrame,
    key: str,
    strategies: tuple[str, ...] = STRATEGIES,
    context: int = 32_768,
    max_sequence: int = 1024,
    max_summary: int = 1024,
    boundary: str = "word",
    tokenizer=tokens.WORDS,
) -> DataFrame:
    """Adds what the strategies need: token counts, chunks, and the extract with its chunks."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    size, _ = tokens.chunk_budget(context, max_sequence, max_summary, tokenizer)
    staged = df.withColumn("document_tokens", tokenizer.count(F.col("document")))
    if {"map-refine", "hierarchical"} & set(strategies):
        staged = with_chunks(staged, size, boundary=boundary, tokenizer=tokenizer)
    if "extract-abstract" in strategies:
        staged = with_extract_chunks(staged, key, size, boundary, tokenizer)
    return staged


def strategy_entries(
    summarizer: Summarizer,
    strategies: tuple[str, ...],
    context: int,
    min_summary: int,
    max_summary: int,
    tokenizer=tokens.WORDS,
) -> Column:
    """An array of ``strategy, strategy_rank, route, summary`` over the columns of ``stage``."""
    document = F.col("document")
    least = F.lit(min_summary)
    direct = summarizer(document, None, least, max_summary)
    entries = []
    for rank, name in enumerate(strategies):
        if name == "map-refine":
            long_form = refine(F.col("chunks"), summarizer, min_summary, max_summary)
        elif name == "hierarchical":
            long_form = merge_tree(F.col("chunks"), summarizer, min_summary, max_summary)
        else:
            extracted = F.col("extracted")
            fitting = tokens.fits(tokenizer.count(extracted), context, max_summary, tokenizer)
            long_form = F.when(fitting, summarizer(extracted, None, least, max_summary)).otherwise(
                refine(F.col("extract_chunks"), summarizer, min_summary, max_summary)
            )
        way = route(F.col("document_tokens"), F.lit(name), context, max_summary, tokenizer)
        entries.append(
            F.struct(
                F.lit(name).alias("strategy"),
                F.lit(rank).alias("strategy_rank"),
                way.alias("route"),
                F.when(way == DIRECT, direct).otherwise(long_form).alias("summary"),
            )
        )
    return F.array(*entries)


Generate = Callable[[list[str], int, int], list[str]]


def summarize_batches(
    staged: DataFrame,
    key: str,
    generate: Generate,
    strategy: str,
    context: int,
    min_summary: int,
    max_summary: int,
    tokenizer=tokens.WORDS,
    live: int = 64,
) -> DataFrame:
    """``key, summary`` with a Python model: ``generate(prompts, min_tokens, max_tokens)``.

    Takes the output of ``stage``. Each task keeps documents under way from one Arrow batch into the next, and
    takes up another as soon as one is done. So the model sees lists of ``live`` prompts until the rows run
    out, however long single documents are. Rows come out as they end, not in the order of the input; null and blank ones, and
    documents without chunks, have an empty summary. A task that runs again asks the model again.
    """
    fits_extract = F.lit(True)
    parts = F.col("chunks") if strategy != "extract-abstract" else F.col("extract_chunks")
    document = F.col("document")
    if strategy == "extract-abstract":
        fits_extract = tokens.fits(
            tokenizer.count(F.col("extracted")), context, max_summary, tokenizer
        )
    goes_direct = tokens.fits(F.col("document_tokens"), context, max_summary, tokenizer)
    if strategy == "extract-abstract":
        document = F.when(goes_direct, document).otherwise(F.col("extracted"))
        goes_direct = goes_direct | fits_extract
    # A document goes one way: the other form need not travel to Python.
    work = staged.select(
        key, F.when(goes_direct, document).alias("document"), F.when(~goes_direct, parts).alias("parts")
    )
    steps = _tree_steps if strategy == "hierarchical" else _fold_steps

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    chunked = batch.column(2)[i].as_py()
                    whole = batch.column(1)[i].as_py()
                    given = [c or "" for c in chunked] if chunked else []
                    if whole:
                        yield batch.column(0)[i], _direct_steps(whole, min_summary, max_summary)
                    else:
                        yield batch.column(0)[i], steps(given, min_summary, max_summary)

        done: list[tuple[pa.Scalar, str]] = []
        for ended in _refilled(rows(), generate, live):
            done.append(ended)
            if len(done) >= SUMMARIES_HELD:
                yield _summary_batch(key, done)
                done = []
        if done:
            yield _summary_batch(key, done)

    key_type = staged.schema[key].dataType.simpleString()
    return work.mapInArrow(run, f"{key} {key_type}, summary string")


#: Summaries that go back to the JVM together.
SUMMARIES_HELD = 256
#: A prompt with its least and most tokens.
Ask = tuple[str, int, int]
#: Yields the prompts of a step, is sent their answers, and returns the summary.
Steps = Generator[list[Ask], list[str], str]


def _summary_batch(key: str, done: list[tuple[pa.Scalar, str]]) -> pa.RecordBatch:
    keys = pa.array([k.as_py() for k, _ in done], type=done[0][0].type)
    return pa.RecordBatch.from_arrays(
        [keys, pa.array([s for _, s in done], type=pa.string())], names=[key, "summary"]
    )


@dataclass
class _UnderWay:
    """A document whose prompts of the present step wait for answers."""

    key: pa.Scalar
    steps: Steps
    answers: list[str]
    missing: int = 0


def _refilled(
    rows: Iterator[tuple[pa.Scalar, Steps]], generate: Generate, live: int
) -> Iterator[tuple[pa.Scalar, str]]:
    """Answer ``live`` prompts of equal limits together, always those that most prompts wait for.

    Rows are taken up until one limit has ``live`` prompts waiting. A strategy has two limits, so fewer than
    ``2 * live`` documents are under way, and lists are full until the rows run out.
    """
    if live < 1:
        raise ValueError("a list holds at least one prompt")
    waiting: dict[tuple[int, int], deque[tuple[_UnderWay, int, str]]] = {}

    def ask(document: _UnderWay, asked: list[Ask]) -> None:
        document.answers, document.missing = [""] * len(asked), len(asked)
        for place, (prompt, least, most) in enumerate(asked):
            waiting.setdefault((least, most), deque()).append((document, place, prompt))

    left = True
    while True:
        while left and max(map(len, waiting.values()), default=0) < live:
            row = next(rows, None)
            if row is None:
                left = False
                break
            document = _UnderWay(row[0], row[1], [])
            try:
                ask(document, next(document.steps))
            except StopIteration as end:
                yield document.key, end.value
        limits = max(waiting, key=lambda name: len(waiting[name]), default=None)
        if limits is None or not waiting[limits]:
            return
        queue = waiting[limits]
        taken = [queue.popleft() for _ in range(min(live, len(queue)))]
        replies = generate([prompt for _, _, prompt in taken], *limits)
        if len(replies) != len(taken):
            raise ValueError(f"{len(taken)} prompts got {len(replies)} answers")
        for (document, place, _), reply in zip(taken, replies):
            document.answers[place] = reply
            document.missing -= 1
            if not document.missing:
                try:
                    ask(document, document.steps.send(document.answers))
                except StopIteration as end:
                    yield document.key, end.value


def _direct_steps(document: str, least: int, most: int) -> Steps:
    (summary,) = yield [(SUMMARIZE.text(document), least, most)]
    return summary


def _fold_steps(parts: list[str], least: int, most: int) -> Steps:
    if not parts:
        return ""
    (held,) = yield [(SUMMARIZE.text(parts[0]), 0, most)]
    for at in range(1, len(parts)):
        closing = at == len(parts) - 1
        (held,) = yield [(REFINE.text(held, parts[at]), least if closing else 0, most)]
    return held


def _tree_steps(parts: list[str], least: int, most: int) -> Steps:
    if not parts:
        return ""
    held = yield [(SUMMARIZE.text(part), 0, most) for part in parts]
    while len(held) > 1:
        floor = least if len(held) == 2 else 0
        joined = ["\n\n".join(held[j : j + 2]) for j in range(0, len(held), 2)]
        held = yield [(MERGE.text(part), floor, most) for part in joined]
    return held[0]


def generation_record(
    rows: DataFrame, model: str, adapter: str | None = None, tokenizer=tokens.WORDS
) -> DataFrame:
    """Adds ``metadata``; wall time belongs to the job, not to a row."""
    return rows.withColumn(
        "metadata",
        F.struct(
            F.col("strategy"),
            F.lit(model).alias("model"),
            F.lit(adapter).cast("string").alias("adapter"),
            tokenizer.count(F.col("document")).alias("tokens_in"),
            tokenizer.count(F.col("summary")).alias("tokens_out"),
        ),
    )
