"""Spans of patterns in texts on built-in functions: (start, kind, end, value) in code points from 0, the end exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a fold over a text's matches that copy what they gather; so many of them are folded apart and then put together, so that the time grows with the matches and not with their square.
BLOCK = 256

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def once(value: Column, use) -> Column:
    """use(value) with the value computed once, and not at every mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; the array must not be empty."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def running(lengths: Column) -> Column:
    """The running sums of an array of int that is not empty."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    own = lambda block: F.aggregate(block, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out")), lambda acc: acc["out"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    shift = lambda acc, block: F.struct((acc["at"] + F.element_at(block, -1)).alias("at"), F.concat(acc["out"], F.array(F.transform(block, lambda n: n + acc["at"]))).alias("out"))
    return F.aggregate(F.transform(blocks(lengths), own), start, shift, lambda acc: F.flatten(acc["out"]))


def located(text: Column, pattern: str | Column, kind: int) -> Column:
    """All matches as (start, kind, end, value), in code points."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def spans(x: Column) -> Column:
        return F.transform(x["m"], lambda v, i: F.struct((x["ends"][i] - F.length(v)).alias("start"), F.lit(kind).alias("kind"), x["ends"][i].alias("end"), v.alias("value")))

    def walk(x: Column) -> Column:
        lengths = F.transform(x["m"], lambda v, i: F.length(x["p"][i]) + F.length(v))
        ends = once(lengths, running)
        return F.when(F.size(x["m"]) > 0, once(F.struct(x["m"].alias("m"), ends.alias("ends")), spans)).otherwise(F.array().cast(SPAN))

    return once(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("m")), walk)


def replaced(text: Column, spans: Column, label) -> Column:
    """The text with label(span) for each of its spans, which stand by start; one that begins inside another goes with it."""

    def fill(b: Column) -> Column:
        """One block of spans over its own piece of the text: places are looked up by counting from the piece's start."""
        start = F.struct(b["from"].alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(b["piece"], acc["at"] - b["from"] + 1, s["start"] - acc["at"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, label(s))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(b["spans"], start, step)

    def block(acc: Column, part: Column) -> Column:
        to = F.array_max(F.transform(part, lambda s: s["end"]))
        b = F.struct(acc["at"].alias("from"), F.substring(text, acc["at"] + 1, F.greatest(to - acc["at"], F.lit(0))).alias("piece"), part.alias("spans"))
        return once(once(b, fill), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(blocks(spans), start, block, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def names_of(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, kinds)), s["kind"] + 1), s["start"], s["end"])), ",")


def count_in(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
