"""Spans of regular expression matches as native columns.

Spark extracts matches without their places. ``split`` gives the gaps between
the same leftmost non-overlapping matches, so running sums of the lengths of
gaps and matches give every start and end, in code points. An array that a fold
grows is copied at each step, so the sums are taken in blocks of about the root
of their number: n matches cost n * sqrt(n) copies of one number.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SPAN = "array<struct<start:int,end:int,kind:string,match:string,value:string>>"
#: Least length of a block of running sums; code points in a piece of a text for ``before``, matches from which pieces are cut.
BLOCK = 32
PIECE = 64
MANY = 64


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def running_sums(numbers: Column) -> Column:
    """``[0, x1, x1 + x2, ...]`` of an array of integers."""
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))

    def blocks(xs: Column) -> Column:
        def run(size: Column) -> Column:
            def block(acc: Column, b: Column) -> Column:
                last = F.array(F.element_at(acc, -1))
                return F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.aggregate(F.slice(xs, b * size + 1, size), last, add))

            return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(xs) / size).cast("int")), F.array(F.lit(0)), block)

        return let(F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(xs))).cast("int")), run)

    return let(numbers, blocks)


def find(text: Column, kind: str, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` in ``text`` in order; ``value`` is the given group, as found in the match alone."""

    def placed(x: Column) -> Column:
        """x: gaps (one more than matches) and matches."""
        gap = lambda i: F.length(F.get(x["gaps"], i))
        sums = running_sums(F.transform(x["matches"], lambda m, i: gap(i) + F.length(m)))

        def span(m: Column, i: Column, sums: Column) -> Column:
            value = F.regexp_extract(m, pattern, group) if group else m
            begin = F.get(sums, i) + gap(i)
            return F.struct(begin.alias("start"), F.get(sums, i + 1).alias("end"), F.lit(kind).alias("kind"), m.alias("match"), value.alias("value"))

        return let(sums, lambda s: F.transform(x["matches"], lambda m, i: span(m, i, s)))

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")), placed)


def before(text: Column, width: int, spans: Column, f) -> Column:
    """``f(span, context)`` of each span, ``context`` being up to ``width`` (at most ``PIECE``) code points before it.

    A substring is counted from a text's start; where spans are many the text
    is cut into pieces once, so that each context costs two pieces.
    """
    direct = lambda s: F.substring(text, F.greatest(s["start"] - width + 1, F.lit(1)), F.least(s["start"], F.lit(width)))

    def cut(pieces: Column, s: Column) -> Column:
        at = F.floor(s["start"] / PIECE).cast("int")
        here = F.substring(F.coalesce(F.get(pieces, at), F.lit("")), F.lit(1), s["start"] % PIECE)
        both = F.concat(F.when(at > 0, F.get(pieces, at - 1)).otherwise(F.lit("")), here)
        return F.right(both, F.least(s["start"], F.lit(width)))

    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))
    few = F.transform(spans, lambda s: f(s, direct(s)))
    return F.when(F.size(spans) <= MANY, few).otherwise(let(pieces, lambda p: F.transform(spans, lambda s: f(s, cut(p, s)))))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def by_start(spans: Column, kinds: tuple[str, ...]) -> Column:
    """Spans ordered by start, then by the order of ``kinds``."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)
