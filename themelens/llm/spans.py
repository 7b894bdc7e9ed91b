"""Regex matches with their positions, as Spark columns.

Spark returns matches (``regexp_extract_all``) but not where they start. The text between the matches
comes from ``split`` with the same pattern, so the start of match ``i`` is the length of everything
before it. All lengths are code points. Patterns must be linear on long runs: quantifiers are
possessive, and a look-behind stops a failed run from being tried again at each of its characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches per block of the two-level prefix sum, so that n matches cost about 32 n steps, not n * n.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def _positions(found: Column) -> Column:
    """Spans of ``found`` = struct(m: matches, g: the texts between them)."""
    taken = F.transform(found["m"], lambda m, i: F.length(found["g"][i]) + F.length(m))

    def with_starts(v: Column) -> Column:
        n_blocks = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_blocks), lambda b: _sum(F.slice(v, b * BLOCK + 1, BLOCK)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return let(starts, lambda s: F.transform(found["m"], lambda m, i: F.struct(
            (s[F.floor(i / BLOCK).cast("int")]
             + _sum(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
             + F.length(found["g"][i])).alias("start"),
            m.alias("match"),
            F.right(found["g"][i], F.lit(48)).alias("before"),
            F.left(found["g"][i + 1], F.lit(48)).alias("after"))))

    return let(taken, with_starts)


EMPTY = "array<struct<start:int,match:string,before:string,after:string>>"


def find(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: ``array<struct<start, match, before, after>>`` (null text: empty).

    ``before`` and ``after`` are up to 48 code points of the unmatched text on either side. The second
    pass over the text (``split``) runs only for texts that have a match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(F.coalesce(matches, F.array().cast("array<string>")), lambda m: F.when(
        F.size(m) == 0, F.array().cast(EMPTY)).otherwise(
        let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), _positions)))


def label(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of each span (end exclusive)."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["start"] + F.length(s["match"])))


def replace_matches(text: Column, pattern: str, valid: Callable[[Column], Column], tag: str,
                    other: Callable[[Column], Column] = lambda m: m) -> Column:
    """``text`` with each match that passes ``valid`` replaced by ``tag``; other matches become ``other(match)``."""
    def one(t: Column) -> Column:
        def rebuilt(g: Column) -> Column:
            m = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
            put = F.transform(m, lambda x: F.when(valid(x), F.lit(tag)).otherwise(other(x)))
            return F.array_join(F.flatten(F.zip_with(g, put, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")

        return F.when(t.rlike(pattern), let(F.split(t, pattern, -1), rebuilt)).otherwise(t)

    return let(text, one)   # computed once: the next kind reads the rebuilt text several times
