"""Dense and sparse grids, stencils, refinement levels and staggered fields; one row a node."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.space import Space, every, offset_rows
from . import blocks
from .particles import ghosts

IJK = ("i", "j", "k")


def nodes(spark: SparkSession, sizes: tuple[int, ...], parts: int | None = None) -> DataFrame:
    """All nodes of a dense grid; the first axis runs fastest, id is the linear index."""
    df, stride, cols = spark.range(0, math.prod(sizes), numPartitions=parts), 1, []
    for a, n in zip(IJK, sizes, strict=False):
        cols.append(F.pmod(F.floor(F.col("id") / stride), F.lit(n)).cast("long").alias(a))
        stride *= n
    return df.select("id", *cols)


def nodes_in(spark: SparkSession, lo: tuple[int, ...], hi: tuple[int, ...], parts: int | None = None) -> DataFrame:
    """All nodes of an index box, both ends included; indexes may be negative."""
    grid = nodes(spark, tuple(h - x + 1 for x, h in zip(lo, hi, strict=True)), parts)
    return grid.select(*[(F.col(a) + x).alias(a) for a, x in zip(IJK, lo, strict=False)])


def extended(spark: SparkSession, sizes: tuple[int, ...], below: tuple[int, ...], above: tuple[int, ...], parts: int | None = None) -> DataFrame:
    """The nodes of a grid with more nodes below and above on each axis; old nodes keep their indexes."""
    return nodes_in(spark, tuple(-x for x in below), tuple(n - 1 + x for n, x in zip(sizes, above, strict=True)), parts)


def set_points(grid: DataFrame, pred: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the predicate of index and fields holds; other nodes stay."""
    return grid.withColumns({c: F.when(pred, v).otherwise(F.col(c)) for c, v in values.items()})


def add_points(grid: DataFrame, candidates: DataFrame, pred: Column, values: dict[str, Column], axes: tuple[str, ...]) -> DataFrame:
    """Inserts those candidate nodes for which the predicate holds, with values by index; nodes that were there get the new values."""
    new = candidates.where(pred).select(*axes, *[v.alias(c) for c, v in values.items()])
    return upsert(grid, new, axes)


def in_box(lo: tuple[int, ...], hi: tuple[int, ...]) -> Column:
    """Whether a node is in the box, both ends included; a plain range predicate, which Parquet can skip by."""
    return every(F.col(a).between(x, y) for a, x, y in zip(IJK, lo, hi, strict=False))


def skin(lo: tuple, hi: tuple, inner_lo: tuple, inner_hi: tuple, sizes: tuple[int, ...], periodic: tuple[bool, ...]) -> Column:
    """Whether a node, or an image of it on periodic axes, is in the outer box and not in the inner one; ends included."""
    axes, out = IJK[: len(sizes)], F.lit(False)
    for steps in itertools.product(*[(-1, 0, 1) if p else (0,) for p in periodic]):
        at = [F.col(a) + s * n for a, s, n in zip(axes, steps, sizes, strict=True)]
        between = lambda x, y, at=at: every(c.between(l, h) for c, l, h in zip(at, x, y, strict=True))  # noqa: E731,E741
        out = out | (between(lo, hi) & ~between(inner_lo, inner_hi))
    return out


def in_boxes(grid: DataFrame, boxes: list[tuple[tuple, tuple]]) -> DataFrame:
    """Nodes in any of a few given boxes, once."""
    cond = F.lit(False)
    for lo, hi in boxes:
        cond = cond | in_box(lo, hi)
    return grid.where(cond)


def position(spacing: tuple, low: tuple) -> list[Column]:
    return [(F.col(a) * s + lo).alias(x) for a, s, lo, x in zip(IJK, spacing, low, "xyz", strict=False)]


def upsert(grid: DataFrame, new: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Inserts nodes, the new values first; of several new rows of a node the one with the greatest values counts.  Both sides are dealt once by node."""
    vals = [c for c in grid.columns if c not in axes]
    both = grid.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    top = both.groupBy(*axes).agg(F.max(F.struct("__new", *vals)).alias("__t"))
    return top.select(*axes, *[F.col(f"__t.{c}").alias(c) for c in vals])


def flush(inserted: DataFrame, axes: tuple[str, ...], merge: dict[str, Column]) -> DataFrame:
    """Merges inserts of the same node by aggregates."""
    return inserted.groupBy(*axes).agg(*[a.alias(c) for c, a in merge.items()])


def with_background(all_nodes: DataFrame, sparse: DataFrame, axes: tuple[str, ...], background: dict) -> DataFrame:
    out = all_nodes.join(sparse, list(axes), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in background.items()})


def gather(grid: DataFrame, axes: tuple[str, ...], sizes: tuple[int, ...] | None, offs: list[tuple], fields: dict[str, tuple[str, list[float]]], background: dict | None = None) -> DataFrame:
    """Weighted neighbour sums of each node: ``fields`` maps an output to its source and a weight for each offset.

    Scatter form: every node sends its value to the nodes whose stencil holds it; sums combine before the
    one shuffle.  Periodic with ``sizes``; without, the grid is open.  Missing neighbours count as the
    background.  Only nodes of the grid come out; any number of fields goes in one pass.
    """
    keyed = {c: {o: w for o, w in zip(offs, ws, strict=True)} for c, (_, ws) in fields.items()}
    sends = F.array(
        *[
            F.struct(*[F.lit(-v).cast("long").alias(f"d{a}") for a, v in zip(axes, o, strict=True)], *[F.lit(float(keyed[c][o])).alias(f"w_{c}") for c in fields], F.lit(int(not any(o))).alias("own"))
            for o in offs if any(o)
        ],
        F.struct(*[F.lit(0).cast("long").alias(f"d{a}") for a in axes], *[F.lit(float(keyed[c].get((0,) * len(axes), 0.0))).alias(f"w_{c}") for c in fields], F.lit(1).alias("own")),
    )
    s = grid.withColumn("__s", F.explode(sends))
    to = {a: F.col(a) + F.col(f"__s.d{a}") for a in axes}
    if sizes:
        to = {a: F.pmod(c, F.lit(n)) for (a, c), n in zip(to.items(), sizes, strict=True)}
    sent = s.select(*[c.alias(a) for a, c in to.items()], F.col("__s.own").alias("own"), *[(F.col(f"__s.w_{c}") * F.col(src)).alias(c) for c, (src, _) in fields.items()], *[F.col(f"__s.w_{c}").alias(f"w_{c}") for c in fields])
    sums = sent.groupBy(*axes).agg(F.max("own").alias("own"), *[F.sum(c).alias(c) for c in fields], *[F.sum(f"w_{c}").alias(f"w_{c}") for c in fields])
    out = sums.where("own = 1")
    for c, (src, ws) in fields.items():
        bg = float((background or {}).get(src, 0.0))
        out = out.withColumn(c, F.col(c) + (F.lit(float(sum(ws))) - F.col(f"w_{c}")) * bg)
    return out.select(*axes, *fields)


def conv(grid: DataFrame, axes: tuple[str, ...], sizes: tuple[int, ...] | None, offs: list[tuple], sources: tuple[str, ...], fn: Callable, start: tuple | None = None, stop: tuple | None = None, background: dict | None = None) -> DataFrame:
    """A stencil with any function: ``fn`` gets for each source the list of its values at the offsets, in their order, and gives the outputs by name.

    Outputs come for the grid's nodes from ``start`` to ``stop`` (both included; all if not given).  Every
    node sends its values to the nodes whose stencil holds it, where one grouping lays them side by side;
    nodes out of the range get none.  Periodic with ``sizes``.  Missing neighbours have the background (null if there is none).
    """
    steps = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(-v).cast("long").alias(f"d{a}") for a, v in zip(axes, o, strict=True)]) for k, o in enumerate(offs)])
    s = grid.select(*axes, *sources, F.explode(steps).alias("__s"))
    to = {a: F.col(a) + F.col(f"__s.d{a}") for a in axes}
    if sizes:
        to = {a: F.pmod(c, F.lit(n)) for (a, c), n in zip(to.items(), sizes, strict=True)}
    sent = s.select(*[c.alias(a) for a, c in to.items()], F.col("__s.k").alias("__k"), *sources)
    own = offs.index((0,) * len(axes)) if (0,) * len(axes) in offs else None
    if own is None:
        sent = sent.unionByName(grid.select(*axes, F.lit(-1).alias("__k"), *sources))
    if start is not None:
        sent = sent.where(every(F.col(a).between(x, y) for a, x, y in zip(axes, start, stop, strict=True)))
    at = lambda k, c: F.max(F.when(F.col("__k") == k, F.col(c)))
    got = sent.groupBy(*axes).agg(F.bool_or(F.col("__k") == (-1 if own is None else own)).alias("__own"), *[at(k, c).alias(f"__{c}_{k}") for c in sources for k in range(len(offs))])
    value = lambda c, k: F.coalesce(F.col(f"__{c}_{k}"), F.lit((background or {}).get(c)))
    outs = fn(*[[value(c, k) for k in range(len(offs))] for c in sources])
    return got.where("__own").select(*axes, *[v.alias(c) for c, v in outs.items()])


def halo(grid: DataFrame, axes: tuple[str, ...], sizes: tuple[int, ...], div: tuple[int, ...], width: int, periodic: tuple[bool, ...]) -> DataFrame:
    """Grid ghosts: each node once for every processor of the grid ``div`` whose box, ``width`` nodes wider, holds it or an image of it.

    The columns are the node's own with its index as the receiver sees it (images lie out of the grid),
    proc_id (the owner), dst, s_<axis>.  Found by arithmetic on the index, without a join.
    """
    return ghosts(grid, Space(axes, (0,) * len(axes), sizes, periodic), div, width)


def local_boxes(spark: SparkSession, sizes: tuple[int, ...], div: tuple[int, ...], width: int) -> DataFrame:
    """A row a processor: its domain box lo<i>, hi<i>, its box with ghosts glo<i>, ghi<i> (nodes, ends included) and how many nodes it owns."""
    p, n = nodes(spark, tuple(reversed(div)), 1).withColumnRenamed("id", "proc_id"), F.lit(1).cast("long")
    cols = []
    for i, (size, k) in enumerate(zip(sizes, div, strict=True)):
        at = F.col(IJK[len(div) - 1 - i])  # the last axis of the processor grid runs fastest
        lo, hi = F.ceil(at * size / k).cast("long"), F.ceil((at + 1) * size / k).cast("long") - 1
        cols += [lo.alias(f"lo{i}"), hi.alias(f"hi{i}"), (lo - width).alias(f"glo{i}"), (hi + width).alias(f"ghi{i}")]
        n = n * (hi - lo + 1)
    return p.select("proc_id", *cols, n.alias("n"))


def remap(grid: DataFrame, axes: tuple[str, ...], lo: tuple[int, ...], hi: tuple[int, ...], old: Column, new: Column, background: dict) -> DataFrame:
    """A grid's nodes after its box and owners change: nodes in both boxes keep their values (src: where they were), new ones get the background.

    ``old`` and ``new`` are the owners by index; only values of the intersection move.
    """
    kept = grid.where(every(F.col(a).between(x, y) for a, x, y in zip(axes, lo, hi, strict=True))).withColumn("src", old)
    out = with_background(nodes_in(grid.sparkSession, lo, hi), kept, axes, background)
    return out.withColumn("proc_id", new)


def level_sizes(sizes: tuple[int, ...], levels: int, periodic: tuple[bool, ...]) -> list[tuple[int, ...]]:
    """Nodes an axis of each refinement level: doubled on periodic axes, 2 (n - 1) + 1 on others."""
    out = [tuple(sizes)]
    for _ in range(levels - 1):
        out.append(tuple(2 * n if p else 2 * (n - 1) + 1 for n, p in zip(out[-1], periodic, strict=True)))
    return out


def amr_nodes(spark: SparkSession, sizes: tuple[int, ...], levels: int, periodic: tuple[bool, ...], parts: int | None = None) -> DataFrame:
    """The nodes of all levels: lvl, the axes and id, the linear index within the level."""
    out = None
    for lv, n in enumerate(level_sizes(sizes, levels, periodic)):
        g = nodes(spark, n, parts)
        g = g.select(F.lit(lv).cast("long").alias("lvl"), *[c for c in g.columns if c != "id"], "id")
        out = g if out is None else out.unionByName(g)
    return out


def children(nodes: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """The nodes of the next level below the given ones, 2^d each: lvl and axes.  Give the nodes that are to be refined."""
    out = nodes.select((F.col("lvl") + 1).alias("lvl"), *axes)
    for a in axes:
        out = out.withColumn(a, F.explode(F.array(F.col(a) * 2, F.col(a) * 2 + 1)))
    return out


def _level(sizes: list[tuple[int, ...]], i: int) -> Column:
    return F.element_at(F.array(*[F.lit(n[i]).cast("long") for n in sizes]), F.col("lvl").cast("int") + 1)


def amr_cells(amr: DataFrame, axes: tuple[str, ...], sizes: list[tuple[int, ...]]) -> DataFrame:
    """Nodes that have a cell: all but the last along each axis of their level."""
    return amr.where(every(F.col(a) < _level(sizes, i) - 1 for i, a in enumerate(axes)))


def amr_owner(axes: tuple[str, ...], sizes: list[tuple[int, ...]], div: tuple[int, ...]) -> Column:
    """The owner of a node of any level on a processor grid: the same part of space on all levels."""
    out = F.lit(0).cast("long")
    for i, (a, k) in enumerate(zip(axes, div, strict=True)):
        out = out * k + F.least(F.floor(F.col(a) * k / _level(sizes, i)), F.lit(k - 1)).cast("long")
    return out


def amr_halo(amr: DataFrame, axes: tuple[str, ...], sizes: list[tuple[int, ...]], div: tuple[int, ...], width: int, periodic: tuple[bool, ...]) -> DataFrame:
    """Ghosts of all levels, ``width`` nodes of each level: lvl is in the key."""
    out = None
    for lv, n in enumerate(sizes):
        g = halo(amr.where(F.col("lvl") == lv), axes, n, div, width, periodic)
        out = g if out is None else out.unionByName(g)
    return out


def amr_links(amr: DataFrame, axes: tuple[str, ...]) -> DataFrame:
    """Links between levels: lvl and axes of a node, and c<axis> of each child (lvl + 1, index >> 1) that is there."""
    child = amr.where("lvl > 0").select((F.col("lvl") - 1).alias("lvl"), *[F.shiftright(a, 1).alias(a) for a in axes], *[F.col(a).alias(f"c{a}") for a in axes])
    return amr.select("lvl", *axes).join(child, ["lvl", *axes])


def restrict_levels(amr: DataFrame, axes: tuple[str, ...], value: str) -> DataFrame:
    """Mean of each node's children, at the parent's key (lvl - 1, index // 2)."""
    return amr.where("lvl > 0").groupBy((F.col("lvl") - 1).alias("lvl"), *[F.shiftright(a, 1).alias(a) for a in axes]).agg(F.avg(value).alias(value))


def with_parent(amr: DataFrame, axes: tuple[str, ...], value: str) -> DataFrame:
    """Each node with its parent's value (null if there is none)."""
    up = amr.select((F.col("lvl") + 1).alias("lvl"), *[F.col(a).alias(f"p{a}") for a in axes], F.col(value).alias("parent"))
    return amr.withColumns({f"p{a}": F.shiftright(a, 1) for a in axes}).join(up, ["lvl", *[f"p{a}" for a in axes]], "left").drop(*[f"p{a}" for a in axes])


def boundary(amr: DataFrame, axes: tuple[str, ...], offs: list[tuple]) -> DataFrame:
    """Nodes that lack a neighbour of the stencil; counts arriving messages instead of joining each offset."""
    n = sum(any(o) for o in offs)
    sent = amr.select("lvl", *axes, F.explode(offset_rows(offs, tuple(f"d{a}" for a in axes))).alias("o"))
    sent = sent.select("lvl", *[(F.col(a) + F.col("o")[f"d{a}"]).alias(a) for a in axes], F.expr(" AND ".join(f"o.d{a} = 0" for a in axes)).alias("own"))
    got = sent.groupBy("lvl", *axes).agg(F.bool_or("own").alias("own"), F.count_if(~F.col("own")).alias("n"))
    return got.where(F.col("own") & (F.col("n") < n)).select("lvl", *axes)


def to_normal(faces: DataFrame, sizes: tuple[int, ...], axes: tuple[str, ...], places: dict[str, list[tuple]]) -> DataFrame:
    """Staggered components brought to cell corners: the mean of the listed staggered points (index offsets) of each."""
    offs = sorted({o for ps in places.values() for o in ps} | {(0,) * len(axes)})
    fields = {c: (c, [1.0 / len(ps) if o in ps else 0.0 for o in offs]) for c, ps in places.items()}
    return gather(faces, axes, sizes, offs, fields)


def default_staggering(rank: int, d: int) -> list[tuple[int, ...]]:
    """Where components live: a scalar at the centre, a vector's on the lower face of its axis, a tensor's on both axes' (diagonal: centre)."""
    if rank == 0:
        return [(0,) * d]
    if rank == 1:
        return [tuple(-1 if a == c else 0 for a in range(d)) for c in range(d)]
    if rank == 2:
        return [tuple(-1 if r != c and a in (r, c) else 0 for a in range(d)) for r in range(d) for c in range(d)]
    raise ValueError("no placement for ranks above 2")


def is_staggered(places: dict[str, list[tuple]]) -> dict[str, bool]:
    """Whether each property lives off the cell's centre."""
    return {p: any(any(o) for o in offs) for p, offs in places.items()}


def particle_nodes(particles: DataFrame, coords: tuple[str, ...], spacing, sizes: tuple[int, ...], weight, reach: int) -> DataFrame:
    """Each particle with the periodic nodes that its weight function touches: axes and w; axis by axis."""
    out = particles.withColumn("w", F.lit(1.0))
    for x, a, n in zip(coords, IJK, sizes, strict=False):
        base = F.floor(F.col(x) / spacing).cast("long")
        out = out.withColumn(a, F.explode(F.array(*[base + o for o in range(1 - reach, reach + 1)])))
        out = out.withColumn("w", F.col("w") * weight(F.col(x) / spacing - F.col(a))).where("w <> 0").withColumn(a, F.pmod(a, F.lit(n)))
    return out


def _axis_weights(df: DataFrame, coords: tuple[str, ...], spacing, weight, reach: int) -> DataFrame:
    """Adds along each axis the first node that a particle touches and the weights of 2 * reach nodes from there on."""
    cols = {}
    for i, x in enumerate(coords):
        base = F.floor(F.col(x) / spacing).cast("long")
        cols[f"__n{i}"] = base + (1 - reach)
        cols[f"__w{i}"] = F.array(*[weight(F.col(x) / spacing - (base + o)).cast("double") for o in range(1 - reach, reach + 1)])
    return df.withColumns(cols)


def _touched(t: pa.Table | pa.RecordBatch, sizes: tuple[int, ...], reach: int, low: list[int] | None = None, strides: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and weights (rows x nodes) of particles with their weights along the axes; the numbers are of the whole mesh unless low and strides are given."""
    n, width = t.num_rows, 2 * reach
    at, w = np.zeros((n, 1), np.int64), np.ones((n, 1))
    for i, size in enumerate(sizes):
        first = t.column(f"__n{i}").to_numpy()[:, None] + np.arange(width)
        nodes = first % size if low is None else (first - low[i]) % size
        column = t.column(f"__w{i}")
        ws = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(n, width)
        at = (at[:, :, None] * (size if strides is None else strides[i]) + nodes[:, None, :]).reshape(n, width ** (i + 1))
        w = (w[:, :, None] * ws[:, None, :]).reshape(n, width ** (i + 1))
    return at, w


def to_mesh(particles: DataFrame, coords: tuple[str, ...], spacing, sizes: tuple[int, ...], weight, reach: int, fields: tuple[str, ...], block: int = 8) -> DataFrame:
    """Sums of the particles' fields on the periodic nodes that their weights touch: axes and fields; nodes of weight 0 aren't touched.

    Particles are dealt by blocks of nodes; there whole batches are summed by node at once, so that what moves is about a row a node
    and block instead of (2 reach)^d rows a particle.
    """
    axes = IJK[: len(coords)]
    b = F.lit(0).cast("long")
    for x, n in zip(coords, sizes, strict=True):
        b = b * n + F.floor(F.pmod(F.floor(F.col(x) / spacing), F.lit(n)) / block).cast("long")
    rows = blocks.spread(particles.select("pid", *coords, *fields, b.alias("__b")), "pid").sortWithinPartitions("__b")
    rows = _axis_weights(rows, coords, spacing, weight, reach)
    rows = rows.select(*[f"__{e}{i}" for i in range(len(axes)) for e in "nw"], *[F.col(f).cast("double").alias(f) for f in fields])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            at, w = _touched(t, sizes, reach)
            on = w != 0
            number, place = np.unique(at[on], return_inverse=True)
            sums = []
            for f in fields:
                v = np.broadcast_to(t.column(f).to_numpy(zero_copy_only=False)[:, None], w.shape)[on]
                sums.append(np.bincount(place, weights=w[on] * v, minlength=len(number)))
            yield pa.RecordBatch.from_arrays([pa.array(number), *map(pa.array, sums)], ["__node", *fields])

    out = rows.mapInArrow(summed, ", ".join(["__node long", *(f"{f} double" for f in fields)])).groupBy("__node").agg(*[F.sum(f).alias(f) for f in fields])
    stride, cols = math.prod(sizes), []
    for a, n in zip(axes, sizes, strict=True):
        stride //= n
        cols.append((F.floor(F.col("__node") / stride) % n).cast("long").alias(a))
    return out.select(*cols, *fields)


def from_mesh(particles: DataFrame, mesh: DataFrame, coords: tuple[str, ...], spacing, sizes: tuple[int, ...], weight, reach: int, fields: tuple[str, ...], block: int = 8) -> DataFrame:
    """Mesh values at the particles: pid and the weighted sums of the fields over the nodes that a particle's weight touches.

    Particles and nodes are dealt by blocks of nodes, a node also to the blocks whose particles touch it.  A block's nodes
    become one array, in which its particles look theirs up; crowded blocks are cut.  Missing nodes count as 0; a particle whose
    weight touches no node that is there has no row.
    """
    axes = IJK[: len(coords)]
    b, to = F.lit(0).cast("long"), mesh.select(*axes, *[F.col(f).cast("double").alias(f) for f in fields])
    for x, a, n in zip(coords, axes, sizes, strict=True):
        b = b * n + F.floor(F.pmod(F.floor(F.col(x) / spacing), F.lit(n)) / block).cast("long")
        near = [F.floor(F.pmod(F.col(a) + o, F.lit(n)) / block).cast("long") for o in range(-reach, reach)]
        to = to.withColumn(f"__b{a}", F.explode(F.array_distinct(F.array(*near))))
    at = F.lit(0).cast("long")
    for a, n in zip(axes, sizes, strict=True):
        at = at * n + F.col(f"__b{a}")
    p, m, by = blocks.dealt(particles.select("pid", *coords, b.alias("__b")), to.select(at.alias("__b"), *axes, *fields), "pid", cut_build=False)
    p = _axis_weights(p, coords, spacing, weight, reach).drop(*coords)
    d, wide = len(axes), block + 2 * reach

    def looked_up(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        number, low = key[0].as_py(), []
        for n in reversed(sizes):
            low.insert(0, number % n * block - reach + 1)
            number //= n
        size, strides = wide**d, [wide] * d
        place = np.zeros(nodes.num_rows, np.int64)
        for i, a in enumerate(axes):
            place = place * wide + (nodes.column(a).to_numpy() - low[i]) % sizes[i]
        at, w = _touched(rows, sizes, reach, low, strides)
        there = np.zeros(size, bool)
        there[place] = True
        hit = (there[at] & (w != 0)).any(axis=1)
        out = [pa.array(rows.column("pid").to_numpy()[hit])]
        for f in fields:
            dense = np.zeros(size)
            dense[place] = nodes.column(f).to_numpy()
            out.append(pa.array((dense[at] * w).sum(axis=1)[hit]))
        return pa.table(out, names=["pid", *fields])

    return p.groupBy(*by).cogroup(m.groupBy(*by)).applyInArrow(looked_up, ", ".join(["pid long", *(f"{f} double" for f in fields)]))
