"""Spans of regex matches as Column expressions: where every match starts and ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,gap:string,text:string>>"
#: Values that one inner fold takes.
_BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often and wherever body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def running(values: Column, op: Callable[[Column, Column], Column] = _plus, start: int = 0) -> Column:
    """For each value of an array<bigint> what op makes of start and all values before it.

    A fold copies its list at every step.  So blocks are folded on their own, then
    their totals, and each block is moved by what came before it: the copies are
    _BLOCK / 2 a value, and one more for every 2 * _BLOCK ** 2 values.
    """

    def fold(part: Column) -> Column:
        zero = F.struct(F.lit(start).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("items"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["items"], acc["at"]).alias("items")))

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / _BLOCK).cast("int")), lambda b: fold(F.slice(v, b * _BLOCK + 1, _BLOCK)))

    def moved(parts: Column) -> Column:
        offsets = fold(F.transform(parts, lambda p: p["at"]))["items"]
        return F.flatten(F.zip_with(parts, offsets, lambda p, o: F.transform(p["items"], lambda x: op(x, o))))

    return let(let(values, blocks), moved)


def match_spans(text: Column, pattern: Column | str) -> Column:
    """Array of (start, end, gap before, text) of the leftmost non-overlapping matches, in code points.

    The text between matches comes from split, the matches from
    regexp_extract_all; their lengths in turn give the places.  Matches must
    have a length of 1 at least.  Each text is matched twice, whatever the number of matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    zipped = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("text"), F.split(text, pattern, -1).alias("gap"))

    def placed(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda p: (F.char_length(p["gap"]) + F.char_length(p["text"])).cast("bigint"))

        def span(p: Column, at: Column) -> Column:
            start = at + F.char_length(p["gap"])
            return F.struct(start.alias("start"), (start + F.char_length(p["text"])).alias("end"), p["gap"].alias("gap"), p["text"].alias("text"))

        return F.zip_with(pairs, running(steps), span)

    # there is one more gap than matches
    return let(F.filter(zipped, lambda p: p["text"].isNotNull()), placed)
