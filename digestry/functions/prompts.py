"""Prompt templates. Data is concatenated, never substituted, so braces and ``$`` stay inert."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Literal text around the slots: ``parts[0] slot parts[1] slot ... parts[-1]``."""

    parts: tuple[str, ...]

    def render(self, *values: Column) -> Column:
        if len(values) != len(self.parts) - 1:
            raise ValueError(f"template has {len(self.parts) - 1} slots, got {len(values)} values")
        pieces = [F.lit(self.parts[0])]
        for value, literal in zip(values, self.parts[1:]):
            pieces += [value, F.lit(literal)]
        return F.concat(*pieces)

    def text(self, *values: str) -> str:
        out = self.parts[0]
        for value, literal in zip(values, self.parts[1:]):
            out += value + literal
        return out

    def blank(self) -> str:
        return "".join(self.parts)


# The prompt wording.
SUMMARIZE = Template(
    (
        "Summarize the following document concisely.\n\nDocument:\n",
        "\n\nSummary:\n",
    )
)
REFINE = Template(
    (
        "You have the following summary so far:\n",
        "\n\nNew section:\n",
        "\n\nUpdate the summary to incorporate any new information from this section. "
        "Keep all previously captured facts. Add new entities, events, and discoveries. "
        "Avoid repeating information already in the summary.\n\nUpdated summary:\n",
    )
)
MERGE = Template(
    (
        "Merge the following summaries into one coherent summary. "
        "Keep all key facts and remove redundancy.\n\n",
        "\n\nMerged summary:\n",
    )
)


def training_text(document: Column, summary: Column) -> Column:
    return F.concat(SUMMARIZE.render(document), summary)
