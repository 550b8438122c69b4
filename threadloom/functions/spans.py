"""Spans of characters in a text: their union, and the text with each replaced once.

All of it is built-in expressions, in time linear in the text (and n log n in the spans):
nothing is appended to an array span by span, and no text is searched from its start again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def characters(text: Column) -> Column:
    """The characters (code points) of a text as an array."""
    return F.split(text, F.lit(""))


def union(spans: Column, length: Column) -> Column:
    """Stretches that spans cover, in order: ``start_index`` and ``end_index`` (exclusive).

    Spans are cut to the text; null, empty and reversed ones count for nothing. Spans that
    overlap or lie in each other are one stretch, spans that only touch are two. Starts and
    ends are sorted apart: after the k-th end nothing is open exactly if the next start isn't
    before it, so no running value is needed.
    """
    def cut(s: Column) -> Column:
        return F.struct(F.greatest(s["start_index"], F.lit(0)).cast("int").alias("s"),
                        F.least(s["end_index"], length).cast("int").alias("e"),
                        (s["start_index"].isNotNull() & s["end_index"].isNotNull()).alias("given"))

    real = F.filter(F.transform(F.filter(spans, lambda s: s.isNotNull()), cut),
                    lambda s: s["given"] & (s["s"] < s["e"]))

    def joined(sorted_: Column) -> Column:
        starts, ends, n = sorted_["starts"], sorted_["ends"], F.size(sorted_["starts"])
        gaps = F.filter(F.zip_with(
            F.slice(starts, F.lit(2), n - 1), F.slice(ends, F.lit(1), n - 1),
            lambda s, e: F.when(s >= e, F.struct(s.alias("s"), e.alias("e")))),
            lambda g: g.isNotNull())
        whole = let(gaps, lambda g: F.arrays_zip(
            F.concat(F.slice(starts, 1, 1), g["s"]).alias("start_index"),
            F.concat(g["e"], F.slice(ends, n, F.lit(1))).alias("end_index")))
        kind = "array<struct<start_index:int,end_index:int>>"
        return F.when(n > 0, whole).otherwise(F.array()).cast(kind)

    return let(real, lambda r: let(F.struct(F.array_sort(r["s"]).alias("starts"),
                                            F.array_sort(r["e"]).alias("ends")), joined))


def replaced(chars: Column, stretches: Column, marker: str) -> Column:
    """A text, given as its characters, with each stretch replaced by ``marker``."""
    def text_of(start: Column, end: Column) -> Column:
        return F.array_join(F.slice(chars, start + 1, F.greatest(end - start, F.lit(0))), "")

    def before(s: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(stretches, i - 1)["end_index"])
        return F.concat(text_of(begin, s["start_index"]), F.lit(marker))

    last = F.coalesce(F.try_element_at(stretches, F.lit(-1))["end_index"], F.lit(0))
    return F.concat(F.array_join(F.transform(stretches, before), ""),
                    text_of(last, F.size(chars)))


def redact_spans(text: Column, spans: Column, marker: str) -> Column:
    """The text with everything under a span replaced, each stretch once.

    ``spans`` are structs with ``start_index`` and ``end_index`` (exclusive) in characters, in
    any order. A null text gives null, null spans leave the text as it is.
    """
    def rebuilt(chars: Column) -> Column:
        return let(union(spans, F.size(chars)), lambda u: replaced(chars, u, marker))

    none = text.isNull() | spans.isNull() | (F.size(spans) < 1) | (F.length(text) == 0)
    return F.when(none, text).otherwise(let(characters(text), rebuilt))
