"""Personal data in texts, found with column expressions only.

Patterns propose spans; Luhn, mod-97 and range checks confirm them; words near a span raise its
score; a span is reported from ``THRESHOLD`` on. Each pattern starts only where no earlier start
could give a longer match, and repeats without backtracking, so that long runs stay linear.

Results for edge cases: null and empty texts have no spans. Positions are code points, ends
exclusive. Equal rows give equal spans. Other columns of the input stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm.common import body, fresh, let

THRESHOLD = 0.5
#: Context words may end so many characters before the span, or start so many after it.
NEAR = 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits of a match end in the right check digit."""
    figures = F.split(F.reverse(digits(match)), "")
    total = F.aggregate(
        F.transform(
            F.filter(figures, lambda d: d != ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def octets(match: Column) -> Column:
    """Whether all four parts are at most 255; leading zeros do not count."""
    return match.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
                       r"(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")  # fmt: skip


def mod97(match: Column) -> Column:
    """Whether an account number leaves remainder 1 after moving its first four signs back."""
    bare = F.translate(match, " ", "")
    moved = F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4))
    figures = F.transform(
        F.filter(F.split(moved, ""), lambda c: c != ""),
        lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1,
    )
    left = F.aggregate(
        figures,
        F.lit(0),
        lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97,
    )
    return left == 1


def between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits(match)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """A pattern, what must hold for its matches, and how they are scored."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column]
    score: float
    context: str = ""
    bonus: float = 0.0
    has: str = "[0-9]"


_PARTS = r"[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_PARTS})){_PARTS}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda m: F.lit(True), 0.9, has="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         octets, 0.6, "ip|host|server|address|adresse", 0.2),
    # 16 to 19 digits that no further digit could extend
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
         luhn, 0.8, "card|visa|credit|karte|carte|tarjeta", 0.2),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]",
         between(8, 15), 0.7, "phone|tel|call|mobile|fax", 0.2, r"\+"),
    Kind("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
         mod97, 0.7, "iban|account|bank|konto|compte|cuenta", 0.2),
    Kind("short_card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,14}+(?![ -]?[0-9])",
         luhn, 0.3, "card|visa|credit|amex|karte|carte|tarjeta", 0.3),
    Kind("social", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda m: F.lit(True), 0.3, "ssn|social security|taxpayer", 0.4),
    Kind("local_phone", r"(?<![0-9+.(-])(?<!\+[0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
         lambda m: F.lit(True), 0.3, "phone|tel|call|mobile|fax|contact", 0.3),
)
BASE = ("email", "ip", "card", "phone")


def sums_before(
    lengths: Column, join: Callable[[Column, Column], Column] = lambda a, x: a + x
) -> Column:
    """For each element, the sum (or ``join``, from 0 on) of those before it: in blocks of about
    sqrt(n), as an array that grows inside a fold is copied at every step."""

    def fold(values: Column, first: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            values,
            F.struct(none.alias("out"), first.cast("long").alias("sum")),
            lambda s, x: F.struct(
                F.concat(s["out"], F.array(s["sum"])).alias("out"), join(s["sum"], x).alias("sum")
            ),
            lambda s: s["out"],
        )

    def blocks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v["n"]), v["k"])
        return let(
            lambda u: F.flatten(
                F.zip_with(u["block"], fold(u["total"], F.lit(0)), lambda b, first: fold(b, first))
            ),
            block=u_blocks(v, starts),
            total=F.transform(
                u_blocks(v, starts),
                lambda b: F.aggregate(b, F.lit(0).cast("long"), join),
            ),
        )

    def u_blocks(v: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at: F.slice(v["n"], at, v["k"]))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(
        let(
            blocks,
            n=lengths,
            k=F.greatest(F.ceil(F.sqrt(F.size(lengths).cast("double"))).cast("int"), F.lit(1)),
        )
    )


SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,text:string>"


def _matches(text: Column, kind: Kind) -> Column:
    """``struct(m, p)``: the matches, and the pieces around them; null where there can be none."""
    found = F.struct(
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"),
        F.split(text, kind.pattern, -1).alias("p"),
    )
    return F.when(text.rlike(kind.has) & text.rlike(kind.pattern), found)


def _score(kind: Kind, match: Column, before: Column, after: Column) -> Column:
    value = F.lit(kind.score)
    if kind.context:
        near = F.concat_ws(
            " ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))
        ).rlike(rf"(?i)(?<!\p{{L}})(?:{kind.context})(?!\p{{L}})")
        value = value + F.when(near, kind.bonus).otherwise(0.0)
    return F.when(kind.confirm(match), value).otherwise(0.0)


def spans_of(text: Column, kind: Kind) -> Column:
    """All confirmed spans of one kind, in order."""

    def located(v: Column) -> Column:
        m, p = v["f"]["m"], v["f"]["p"]
        ends = F.transform(m, lambda x, i: F.length(F.get(p, i)) + F.length(x))
        return let(scored, m=m, p=p, at=sums_before(ends))

    def scored(v: Column) -> Column:
        each = F.transform(
            v["m"],
            lambda x, i: let(
                lambda s: F.struct(
                    F.lit(kind.name).alias("kind"),
                    s["start"].alias("start"),
                    (s["start"] + F.length(x)).alias("end"),
                    _score(kind, x, F.get(v["p"], i), F.get(v["p"], i + 1)).alias("score"),
                    x.alias("text"),
                ),
                start=F.get(v["at"], i) + F.length(F.get(v["p"], i)),
            ),
        )
        return F.filter(each, lambda s: s["score"] >= THRESHOLD)

    return let(
        lambda v: F.when(v["f"].isNull(), F.array().cast(f"array<{SPAN}>")).otherwise(located(v)),
        f=_matches(text, kind),
    )


def find(docs: DataFrame, text: str, out: str = "spans") -> DataFrame:
    """Adds ``out``: an array of ``kind, start, end, score, text`` by kind and start."""
    held = fresh(docs, "_text")
    found = docs.withColumn(held, body(text))
    every = F.concat(*[spans_of(F.col(held), kind) for kind in KINDS])
    return found.withColumn(out, every).drop(held)


def redact(docs: DataFrame, text: str) -> DataFrame:
    """Replaces every span that ``find`` reports; null texts stay null.

    Spans that overlap are masked as one, by the kind of highest score and then of greatest length,
    in angle brackets.
    """

    def reached(v: Column) -> Column:
        ends = F.transform(v["s"], lambda x: x["end"])
        return let(opened, t=v["t"], s=v["s"], reach=sums_before(ends, lambda a, x: F.greatest(a, x)))

    def opened(v: Column) -> Column:
        heads = F.filter(
            F.sequence(F.lit(0), F.size(v["s"]) - 1),
            lambda i: F.get(v["s"], i)["start"] >= F.get(v["reach"], i),
        )
        return let(merged, t=v["t"], s=v["s"], reach=v["reach"], heads=heads)

    def merged(v: Column) -> Column:
        def one(h: Column, j: Column) -> Column:
            following = F.get(v["heads"], j + 1)
            inside = F.slice(v["s"], h + 1, F.coalesce(following, F.size(v["s"])) - h)
            best = F.array_max(
                F.transform(
                    inside,
                    lambda x: F.struct(
                        x["score"], (x["end"] - x["start"]).alias("size"), (-x["start"]).alias("at"), x["kind"]
                    ),
                )
            )
            last = F.array_max(F.transform(v["s"], lambda x: x["end"]))
            return F.struct(
                F.get(v["s"], h)["start"].cast("int").alias("start"),
                F.coalesce(F.get(v["reach"], following), last).cast("int").alias("end"),
                best["kind"].alias("kind"),
            )

        return let(joined, c=F.transform(v["heads"], one), signs=F.split(v["t"], ""))

    def joined(v: Column) -> Column:
        def piece(x: Column, j: Column) -> Column:
            at = F.coalesce(F.get(v["c"], j - 1)["end"], F.lit(0))
            before = F.array_join(F.slice(v["signs"], at + 1, x["start"] - at), "")
            return F.concat(before, F.lit("<"), F.upper(x["kind"]), F.lit(">"))

        at = F.element_at(v["c"], -1)["end"]
        rest = F.array_join(F.slice(v["signs"], at + 1, F.size(v["signs"])), "")
        return F.concat(F.array_join(F.transform(v["c"], piece), ""), rest)

    held = fresh(docs, "_spans")
    ordered = F.sort_array(
        F.transform(held, lambda s: F.struct(s["start"], s["end"], s["score"], s["kind"]))
    )
    masked = F.when(F.size(held) == 0, F.col(text)).otherwise(
        let(reached, t=F.col(text), s=ordered)
    )
    return find(docs, text, held).withColumn(text, masked).drop(held)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
