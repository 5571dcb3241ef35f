"""Column builders for boxes, boundaries, cells and curves."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Space:
    """An axis-aligned box: coordinate columns, bounds, and which axes are periodic."""

    dims: tuple[str, ...]
    lo: tuple
    hi: tuple
    periodic: tuple[bool, ...]

    def axes(self):
        return zip(self.dims, self.lo, self.hi, self.periodic, strict=True)

    def wrapped(self, df: DataFrame) -> DataFrame:
        """Coordinates of periodic axes brought into [lo, hi); others stay."""
        return df.withColumns({d: wrap(F.col(d), lo, hi) for d, lo, hi, p in self.axes() if p})

    def inside(self) -> Column:
        """Whether a row is in the box: closed below; above, closed on non-periodic axes only."""
        return every((F.col(d) >= lo) & ((F.col(d) < hi) if p else (F.col(d) <= hi)) for d, lo, hi, p in self.axes())


def every(conds) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def wrap(x: Column, lo, hi) -> Column:
    """Half-open periodic wrap; a result that rounds up to hi becomes lo."""
    y = F.pmod(x - lo, F.lit(hi - lo)) + lo
    return F.when(y >= hi, F.lit(lo)).otherwise(y)


def cell(x: Column, lo, side) -> Column:
    return F.floor((x - lo) / side).cast("long")


def dist2(pairs) -> Column:
    """Sum of squared differences of column pairs."""
    first, *rest = [(a - b) * (a - b) for a, b in pairs]
    return sum(rest, first)


def offsets(d: int, reach: int = 1) -> list[tuple[int, ...]]:
    return list(itertools.product(range(-reach, reach + 1), repeat=d))


def cross_offsets(d: int, reach: int = 1) -> list[tuple[int, ...]]:
    """The centre and ``reach`` nodes up and down every axis."""
    star = [tuple(s if a == ax else 0 for a in range(d)) for ax in range(d) for s in range(-reach, reach + 1) if s]
    return [(0,) * d, *star]


def offset_rows(offs, names: tuple[str, ...], weights=None) -> Column:
    """An array of structs of integers (and a weight w), to explode."""
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(names, o, strict=True)], *([F.lit(float(weights[i])).alias("w")] if weights else [])) for i, o in enumerate(offs)])


def morton(cols: list[Column], bits: int) -> Column:
    """Interleaved bits; the first axis is the lowest bit of each group."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for a, c in enumerate(cols):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * len(cols) + a))
    return out


def with_hilbert(df: DataFrame, cols: list[str], bits: int, name: str) -> DataFrame:
    """Adds the Hilbert curve's index of integer cells of ``bits`` bits an axis; columns step by step, so that expressions stay small."""
    d = len(cols)
    t = [f"__h{i}" for i in range(d)]
    df = df.withColumns({t[i]: F.col(c).cast("long") for i, c in enumerate(cols)})
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns, from the coarsest level
        for i in range(d):
            x0, xi = F.col(t[0]), F.col(t[i])
            on = xi.bitwiseAND(F.lit(q).cast("long")) != 0
            swap = x0.bitwiseXOR(xi).bitwiseAND(F.lit(q - 1).cast("long"))
            new = {t[0]: F.when(on, x0.bitwiseXOR(F.lit(q - 1).cast("long"))).otherwise(x0.bitwiseXOR(swap))}
            if i:
                new[t[i]] = F.when(on, xi).otherwise(xi.bitwiseXOR(swap))
            df = df.withColumns(new)
        q >>= 1
    for i in range(1, d):  # Gray code over axes
        df = df.withColumn(t[i], F.col(t[i]).bitwiseXOR(F.col(t[i - 1])))
    fix = F.lit(0).cast("long")
    q = 1 << (bits - 1)
    while q > 1:
        fix = fix.bitwiseXOR(F.when(F.col(t[-1]).bitwiseAND(F.lit(q).cast("long")) != 0, F.lit(q - 1)).otherwise(F.lit(0)).cast("long"))
        q >>= 1
    df = df.withColumn("__fix", fix).withColumns({c: F.col(c).bitwiseXOR(F.col("__fix")) for c in t})
    return df.withColumn(name, morton([F.col(c) for c in reversed(t)], bits)).drop(*t, "__fix")


def hat(x: Column) -> Column:
    """Linear (cloud-in-cell) weight of a distance in cells."""
    return F.greatest(1 - F.abs(x), F.lit(0.0))


def m4_prime(x: Column) -> Column:
    """Third-order interpolation weight of a distance in cells (support 2)."""
    a = F.abs(x)
    return F.when(a < 1, 1 - 2.5 * a * a + 1.5 * a * a * a).when(a < 2, 0.5 * (2 - a) * (2 - a) * (1 - a)).otherwise(0.0)


#: Load models: cost of a cell with count c.
LINEAR = lambda c: c
SQUARE = lambda c: c * c


def good_divisions(procs: int, d: int, granularity: int = 64) -> tuple[int, ...]:
    """Cells an axis for about ``granularity`` cells a processor: a power of two an axis.

    Above three axes, while that gives no more than three quarters of the granularity, fewer axes are cut,
    each into the whole part of the root.
    """
    n = procs * granularity
    div = [1 << max(0, math.ceil(math.log2(n ** (1 / d)) - 1e-9))] * d
    for cut in range(d - 1, 0, -1):
        if d <= 3 or math.prod(div) // procs > int(0.75 * granularity):
            break
        div = [math.floor(n ** (1 / cut) + 1e-9)] * cut + [1] * (d - cut)
    return tuple(div)


def cells_an_axis(procs: Column, d: int, granularity: int = 64) -> Column:
    """Cells an axis for a column of numbers of processors: the power of two that ``good_divisions`` takes up to three axes."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(0), F.ceil(F.log2(F.pow(procs * granularity, F.lit(1 / d))) - 1e-9))).cast("long")


def axis_factors(procs: int, d: int) -> tuple[int, ...]:
    """Prime factors of the number of processors, dealt to the axes in turn."""
    out, f, k = [1] * d, 2, 0
    while procs > 1:
        while procs % f == 0:
            out[k % d] *= f
            k, procs = k + 1, procs // f
        f += 1
    return tuple(out)
