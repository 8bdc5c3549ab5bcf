"""Columns over arrays and strings whose cost grows in proportion to their length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that one step of a scan goes over, and code points of a block of text.
STEP, BLOCK = 64, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` refers to it."""
    return F.transform(F.array(value), body)[0]


def upto(n: Column) -> Column:
    """0 .. n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def scanned(values: Column, zero: Column, merge: Callable[[Column, Column], Column], depth: int = 2) -> Column:
    """For each element the merge of all before it.

    Steps of `STEP` elements are merged, these scanned in the same way, and the rest is added
    inside a step: an accumulator that grew by one element at a time would be copied each time.
    """

    def steps(v: Column) -> Column:
        if depth == 1:
            start = F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("out"))
            return F.aggregate(v, start, lambda a, x: F.struct(merge(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        whole = F.transform(upto(F.ceil(F.size(v) / STEP)), lambda c: F.aggregate(F.slice(v, c * STEP + 1, F.lit(STEP)), zero, merge))
        part = lambda k: F.floor(k / STEP).cast("int")
        return let(scanned(whole, zero, merge, depth - 1), lambda bases: F.transform(upto(F.size(v)), lambda k: F.aggregate(F.slice(v, part(k) * STEP + 1, k % STEP), bases[part(k)], merge)))

    return let(values, steps)


def starts(lengths: Column) -> Column:
    """Sums of the lengths before each."""
    return scanned(lengths, F.lit(0), lambda a, x: a + x)


def pieces(text: Column, bounds: Column) -> Column:
    """array<string> of the text between code points `a` and `b` of array<struct<a, b>>; empty where b <= a."""

    def cut(blocks: Column, s: Column) -> Column:
        def part(j: Column) -> Column:
            first = F.greatest(s["a"] - j * BLOCK, F.lit(0))
            return F.substring(blocks[j], first + 1, F.least(s["b"] - j * BLOCK, F.lit(BLOCK)) - first)

        own = F.sequence(F.floor(s["a"] / BLOCK).cast("int"), F.floor((s["b"] - 1) / BLOCK).cast("int"))
        return F.when(s["b"] > s["a"], F.array_join(F.transform(own, part), "")).otherwise("")

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}+"), F.lit(0))
    return let(blocks, lambda b: F.transform(bounds, lambda s: cut(b, s)))


def replaced(text: Column, spans: Column, new: Callable[[Column], Column]) -> Column:
    """The text with the spans (struct<start, end, ...>, by start) replaced by `new` of each.

    Of spans that overlap, the first is replaced, and what later ones reach beyond it goes.
    """

    def build(s: Column) -> Column:
        def place(reach: Column) -> Column:
            bounds = F.transform(s, lambda x, k: F.struct(reach[k].alias("a"), x["start"].alias("b")))
            names = F.transform(s, lambda x, k: F.when(x["start"] >= reach[k], new(x)).otherwise(""))
            last = F.greatest(F.element_at(reach, -1), F.element_at(s, -1)["end"])
            rest = F.array(F.struct(last.alias("a"), F.char_length(text).alias("b")))
            return F.concat(F.array_join(F.zip_with(pieces(text, bounds), names, lambda p, n: F.concat(p, n)), ""), pieces(text, rest)[0])

        return let(scanned(F.transform(s, lambda x: x["end"]), F.lit(0), lambda a, x: F.greatest(a, x)), place)

    return F.when(F.size(spans) > 0, let(spans, build)).otherwise(text)
