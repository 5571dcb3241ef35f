"""Spans of regular-expression matches, as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One found span; end is exclusive, places are code points.
SPAN = "array<struct<kind:string,start:int,end:int,hit:string>>"


#: Running sums go by blocks of so many elements.
BLOCK = 32
#: Up to so many spans are tried one by one.
FEW = 16


def none() -> Column:
    return F.array().cast(SPAN)


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def before(xs: Column, fold: Callable[[Column, Column], Column], zero: Column, levels: int = 3) -> Column:
    """For each element the fold of all elements before it.

    Blocks are folded, and the same is done for the blocks' results: n elements cost about BLOCK * n / 2 steps up to
    BLOCK^levels * 1000 of them, and no array is copied per element.
    """
    inner = lambda ys: F.transform(ys, lambda _, i: F.aggregate(F.slice(ys, 1, i), zero, fold))
    if not levels:
        return inner(xs)

    def by_blocks(blocks: Column) -> Column:
        starts = before(F.transform(blocks, lambda y: F.aggregate(y, zero, fold)), fold, zero, levels - 1)
        return bind(starts, lambda st: F.flatten(F.transform(blocks, lambda y, b: F.transform(y, lambda _, i: F.aggregate(F.slice(y, 1, i), F.get(st, b), fold)))))

    def cut(ys: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ys) - 1) / BLOCK).cast("int")), lambda b: F.slice(ys, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(ys) <= BLOCK, inner(ys)).otherwise(bind(blocks, by_blocks))

    return bind(xs, cut)


def matches(text: Column, pattern: str, kind: str, when: Column) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` (Java, never empty) with their places, in order; none unless ``when``.

    The pieces between matches give the places, so no match is looked for twice; the time is linear in text and matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(hs: Column) -> Column:
        starts = before(F.transform(hs, lambda x: x["gap"] + F.length(x["hit"])), lambda a, x: a + x, F.lit(0))
        span = lambda at, x: F.struct(F.lit(kind).alias("kind"), (at + x["gap"]).alias("start"), (at + x["gap"] + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"))
        return bind(starts, lambda st: F.transform(hs, lambda x, i: span(F.get(st, i), x)))

    return F.when(when, bind(F.filter(hits, lambda x: x["hit"].isNotNull()), placed).cast(SPAN)).otherwise(none())


def pieces(text: Column, size: int) -> Column:
    """The text in pieces of ``size`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def part_of(pieces: Column, size: int, start: Column, length: Column) -> Column:
    """At most ``size`` code points of a text in pieces, without a walk from the text's begin for each."""
    k = F.floor(start / size).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
    return F.substring(both, start - k * size + 1, length)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ordered(spans: Column, kinds: tuple[str, ...], by_start: bool) -> Column:
    """Spans by start then kind, or by kind then start."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"])
    key = (lambda x: (x["start"], rank(x))) if by_start else (lambda x: (rank(x), x["start"]))

    def keyed(x: Column) -> Column:
        a, b = key(x)
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), x["end"].alias("c"), x.alias("x"))

    return F.transform(F.sort_array(F.transform(spans, keyed)), lambda y: y["x"])


def overlaps(x: Column, spans: Column) -> Column:
    """Whether x meets one of some spans; for few of them."""
    return F.exists(spans, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))


def meets(x: Column, spans: Column) -> Column:
    """Whether x meets one of any number of spans that are in order and don't overlap each other: a binary search beyond FEW."""
    step = lambda at, k: F.when((at + k <= F.size(spans)) & (F.get(spans, at + k - 1)["start"] < x["end"]), at + k).otherwise(at)
    # how many begin before x ends; the last of them ends last
    n = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(26))]), F.lit(0), step)
    last = F.coalesce(bind(n, lambda k: F.when(k > 0, F.get(spans, k - 1)["end"])) > x["start"], F.lit(False))
    return F.when(F.size(spans) <= FEW, overlaps(x, spans)).otherwise(last)


def groups(spans: Column) -> Column:
    """Spans in order of start, as an array of arrays: spans of different arrays don't meet."""

    def cut(xs: Column, reach: Column) -> Column:
        places = F.filter(F.transform(xs, lambda x, i: F.when(x["start"] >= F.get(reach, i), i)), lambda i: i.isNotNull())
        return bind(places, lambda ps: F.transform(ps, lambda p, j: F.slice(xs, p + 1, F.coalesce(F.get(ps, j + 1), F.size(xs)) - p)))

    ends = lambda xs: before(F.transform(xs, lambda x: x["end"]), lambda a, e: F.greatest(a, e), F.lit(0))
    return bind(spans, lambda xs: F.when(F.size(xs) == 0, F.array(xs)).otherwise(bind(ends(xs), lambda reach: cut(xs, reach))))
