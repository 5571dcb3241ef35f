"""Sparse grids as tiles of SIDE^3 nodes: a row a tile, with its values in an array; nulls tell which nodes aren't there.

Stencils work on whole tiles; between tiles only faces move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

SIDE = 8
VALUES = ArrayType(DoubleType())
TILE = ("ti", "tj", "tk")
#: The faces of a tile by the direction that they lie in: axis and sign.
FACES = tuple((ax, s) for ax in range(3) for s in (-1, 1))


def _place(axes: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for a in axes:
        out = out * SIDE + F.pmod(F.col(a), F.lit(SIDE)).cast("int")
    return out


@F.arrow_udf(VALUES)
def _laid(places: pa.Array, values: pa.Array) -> pa.Array:
    """Arrays of places and values as whole tiles."""
    size = SIDE**3
    n = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(n)) * size, n) + places.flatten().to_numpy()
    flat = values.flatten()
    dense, there = np.zeros(len(n) * size), np.zeros(len(n) * size, bool)
    dense[at] = flat.to_numpy(zero_copy_only=False)
    there[at] = flat.is_valid().to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * size, pa.int32()), pa.array(dense, mask=~there))


def to_tiles(grid: DataFrame, axes: tuple[str, ...], field: str) -> DataFrame:
    """ti, tj, tk and v of a grid's nodes (at most one row a node).  Tiles without nodes aren't there."""
    keyed = grid.select(*[F.floor(F.col(a) / SIDE).cast("long").alias(t) for t, a in zip(TILE, axes, strict=True)], F.struct(_place(axes).alias("p"), F.col(field).cast("double").alias("x")).alias("e"))
    tiles = keyed.groupBy(*TILE).agg(F.collect_list("e").alias("e"))
    return tiles.select(*TILE, _laid(F.col("e")["p"], F.col("e")["x"]).alias("v"))


def from_tiles(tiles: DataFrame, axes: tuple[str, ...], field: str) -> DataFrame:
    """A row a node that is there."""
    each = tiles.select(*TILE, F.posexplode("v").alias("p", field)).where(F.col(field).isNotNull())
    inner = [F.floor(F.col("p") / SIDE**2), F.floor(F.col("p") / SIDE) % SIDE, F.col("p") % SIDE]
    return each.select(*[(F.col(t) * SIDE + i).cast("long").alias(a) for t, i, a in zip(TILE, inner, axes, strict=True)], field)


def faces(tiles: DataFrame, counts: tuple[int, ...] | None) -> DataFrame:
    """What tiles send to their neighbours: the receiver's ti, tj, tk, at (which of its sides it comes to) and SIDE^2 values.

    ``counts`` are the tiles an axis of a periodic grid; without, the grid is open.
    """
    inner = np.arange(SIDE**3).reshape((SIDE,) * 3)
    sent = []
    for n, (ax, s) in enumerate(FACES):
        places = inner.take(0 if s < 0 else SIDE - 1, axis=ax).ravel().tolist()
        to = [F.col(t) + (s if i == ax else 0) for i, t in enumerate(TILE)]
        if counts:
            to = [F.pmod(c, F.lit(k)) for c, k in zip(to, counts, strict=True)]
        # what leaves through the upper side comes to the receiver's lower side
        sent.append(F.struct(*[c.alias(t) for c, t in zip(to, TILE, strict=True)], F.lit(n ^ 1).alias("at"), F.transform(F.array(*map(F.lit, places)), lambda i: F.get("v", i)).alias("f")))
    return tiles.select(F.explode(F.array(*sent)).alias("s")).select("s.*")


def cross(tiles: DataFrame, weights: dict[tuple[int, int, int], float], counts: tuple[int, ...] | None, background: float = 0.0) -> DataFrame:
    """The tiles after a stencil of the node and its six neighbours: weighted sums, missing neighbours count as the background.

    Tiles stay where they are; 6 * SIDE^2 values of each move, in 6 rows, instead of 7 rows a node.  Periodic with ``counts``.
    """
    own, sides = float(weights.get((0, 0, 0), 0.0)), [float(weights.get(tuple(s if i == ax else 0 for i in range(3)), 0.0)) for ax, s in FACES]

    def filled(x: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Values (the background where there are none) and which are there; null lists have none."""
        n, out = len(x), np.full((len(x), size), background)
        there = np.zeros((n, size), bool)
        rows, flat = np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)), x.flatten()
        there[rows] = flat.is_valid().to_numpy(zero_copy_only=False).reshape(-1, size)
        out[there] = flat.drop_null().to_numpy(zero_copy_only=False)
        return out, there

    @F.arrow_udf(VALUES)
    def summed(v: pa.Array, f0: pa.Array, f1: pa.Array, f2: pa.Array, f3: pa.Array, f4: pa.Array, f5: pa.Array) -> pa.Array:
        shape = (len(v), SIDE, SIDE, SIDE)
        x, there = filled(v, SIDE**3)
        x = x.reshape(shape)
        wide = np.pad(x, [(0, 0)] + [(1, 1)] * 3, constant_values=background)
        for (ax, s), f in zip(FACES, (f0, f1, f2, f3, f4, f5), strict=True):
            at = [slice(None), *[slice(1, -1)] * 3]
            at[ax + 1] = 0 if s < 0 else -1
            wide[tuple(at)] = filled(f, SIDE**2)[0].reshape(len(v), SIDE, SIDE)
        out = own * x
        for (ax, s), w in zip(FACES, sides, strict=True):
            at = [slice(None), *[slice(1, -1)] * 3]
            at[ax + 1] = slice(1 + s, 1 + s + SIDE)
            out = out + w * wide[tuple(at)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * SIDE**3, pa.int32()), pa.array(out.ravel(), mask=~there.ravel()))

    arrive = [F.first(F.when(F.col("at") == n, F.col("f")), ignorenulls=True).alias(f"f{n}") for n in range(6)]
    got = tiles.join(faces(tiles, counts).groupBy(*TILE).agg(*arrive), list(TILE), "left")
    return got.select(*TILE, summed("v", *[f"f{n}" for n in range(6)]).alias("v"))
