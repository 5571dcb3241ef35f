"""Spatial decomposition: costs by cell, owners of cells, balance.

Cells number a few dozen a processor whatever the rows, so tables of cells are small; rows are only ever
counted into them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.space import Space, axis_factors, cell, every, offset_rows, offsets, with_hilbert
from ..sources.files import written
from .particles import images


def with_cell(df: DataFrame, space: Space, div: tuple[int, ...]) -> DataFrame:
    """Adds each row's cell index along every axis and its linear number."""
    out, lin = df, F.lit(0).cast("long")
    for (d, lo, hi, _), n in zip(space.axes(), div, strict=True):
        out = out.withColumn(f"c_{d}", F.least(F.greatest(cell(F.col(d), lo, (hi - lo) / n), F.lit(0)), F.lit(n - 1)).cast("long"))
        lin = lin * n + F.col(f"c_{d}")
    return out.withColumn("cell", lin)


def costs(df: DataFrame, model: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Cost of each cell that has rows; counts combine before the shuffle."""
    return df.groupBy("cell").agg(F.count("*").alias("n")).select("cell", model(F.col("n")).alias("cost"))


def by_curve(cells: DataFrame, key: str, procs: int) -> DataFrame:
    """Equal numbers of cells along a curve."""
    rank = F.row_number().over(Window.orderBy(key)) - 1
    total = F.count("*").over(Window.partitionBy())
    return cells.withColumn("proc_id", F.floor(rank * procs / total).cast("long"))


def by_weighted_curve(cells: DataFrame, key: str, weight: str, procs: int) -> DataFrame:
    """Equal weights along a curve: a cell goes where the middle of its weight falls."""
    up = F.sum(weight).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(Window.partitionBy())
    return cells.withColumn("proc_id", F.least(F.floor((2 * up - F.col(weight)) * procs / (2 * total)), F.lit(procs - 1)).cast("long"))


def bisect(df: DataFrame, dims: tuple[str, ...], levels: int) -> DataFrame:
    """Orthogonal recursive bisection at the mean, axes in turn; adds node, 0 to 2^levels - 1.

    Each level is one grouped mean, of which the driver gets a row a node (2^levels in all, as many as the
    result has processors); rows find their node by looking the means up, so plans grow by one step a level.
    Rows are written once before, so that the source isn't read anew a level.
    """
    out = (written(df) if levels > 1 else df).withColumn("node", F.lit(0).cast("long"))
    for lv in range(levels):
        x = dims[lv % len(dims)]
        means = {r["node"]: r["mean"] for r in out.groupBy("node").agg(F.avg(x).alias("mean")).collect()}
        table = F.create_map(*[F.lit(v) for n, m in sorted(means.items()) if m is not None for v in (n, float(m))]) if means else None
        mean = F.lit(None).cast("double") if table is None else F.try_element_at(table, F.col("node"))
        out = out.withColumn("node", F.col("node") * 2 + F.when(F.col(x) < mean, 0).otherwise(1))
    return out


def loads(cells: DataFrame, weight: str) -> DataFrame:
    return cells.groupBy("proc_id").agg(F.sum(weight).alias("load"))


def unbalance(load: DataFrame) -> DataFrame:
    """Largest load over the mean, less one; and the spread in percent of the mean."""
    return load.agg((F.max("load") / F.avg("load") - 1).alias("over"), (100 * (F.max("load") - F.min("load")) / F.avg("load")).alias("spread"))


def saved_by_waiting(idle: DataFrame, step: str, value: str, cost: float) -> DataFrame:
    """Mean loss a step since the last rebalance, (sum of idle time + cost) / n, and whether it has begun to rise."""
    w = Window.orderBy(step)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = idle.withColumn("w_n", (F.sum(value).over(run) + cost) / F.count("*").over(run))
    return out.withColumn("rebalance", F.coalesce(F.col("w_n") > F.lag("w_n").over(w), F.lit(False)))


class Balancer:
    """Decides on the driver whether to rebalance, by a threshold in percent or by the rise of the mean loss."""

    def __init__(self, threshold: float | None = 5.0, cost: float = 0.0):
        self.threshold, self.cost, self.total, self.n, self.last = threshold, cost, 0.0, 0, None

    def due(self, spread: float) -> bool:
        if self.threshold is not None:
            return spread > self.threshold
        self.total, self.n = self.total + spread, self.n + 1
        now = (self.total + self.cost) / self.n
        rising = self.last is not None and now > self.last
        self.last = now
        if rising:
            self.total, self.n, self.last = 0.0, 0, None
        return rising


def all_cells(spark: SparkSession, div: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """Every cell of the decomposition grid: cell (last axis fastest) and its index along each axis."""
    out, stride, cols = spark.range(math.prod(div)), math.prod(div), []
    for n, size in zip(names, div, strict=True):
        stride //= size
        cols.append((F.floor(F.col("id") / stride) % size).cast("long").alias(n))
    return out.select(F.col("id").alias("cell"), *cols)


def decompose(spark: SparkSession, div: tuple[int, ...], procs: int, how: str = "hilbert", cost: DataFrame | None = None, names: tuple[str, ...] = ("a", "b", "c")) -> DataFrame:
    """The table cell -> proc: cell, its indexes, cost and proc_id.

    ``how``: box (prime factors dealt to axes), hilbert (equal numbers of cells along the curve) or weighted
    (equal costs along it).  ``cost`` has cell and cost; cells that it lacks cost 0.  To refine or redo a
    decomposition, give new costs and compare with ``moved``.
    """
    names = names[: len(div)]
    cells = all_cells(spark, div, names)
    cells = cells.join(cost.select("cell", "cost"), "cell", "left") if cost is not None else cells.withColumn("cost", F.lit(1).cast("long"))
    cells = cells.withColumn("cost", F.coalesce("cost", F.lit(0)))
    if how == "box":
        out = F.lit(0).cast("long")
        for n, size, k in zip(names, div, axis_factors(procs, len(div)), strict=True):
            out = out * k + F.floor(F.col(n) * k / size).cast("long")
        return cells.withColumn("proc_id", out)
    keyed = with_hilbert(cells, list(names), max(1, max(n - 1 for n in div).bit_length()), "__key")
    dealt = by_weighted_curve(keyed, "__key", "cost", procs) if how == "weighted" else by_curve(keyed, "__key", procs)
    return dealt.drop("__key")


def on_finer_cells(owners: DataFrame, coarse: tuple[int, ...], div: tuple[int, ...], names: tuple[str, ...]) -> DataFrame:
    """The table cell -> proc of a grid ``div``, dealt by a coarser distribution grid: each cell has the owner of the coarse cell that holds it.

    ``div`` must be a multiple of ``coarse`` on every axis; a smaller distribution problem is solved, finer cells are kept.
    """
    if any(n % k for n, k in zip(div, coarse, strict=True)):
        raise ValueError(f"{div} is no multiple of {coarse}")
    cells, lin = all_cells(owners.sparkSession, div, names), F.lit(0).cast("long")
    for n, size, k in zip(names, div, coarse, strict=True):
        lin = lin * k + F.floor(F.col(n) * k / size)
    held = owners.select(F.col("cell").alias("__coarse"), "proc_id")
    return cells.withColumn("__coarse", lin.cast("long")).join(held, "__coarse").drop("__coarse")


def ghost_cells(space: Space, div: tuple[int, ...], ghost: float) -> tuple[int, ...]:
    """How many cells the ghost's width spans along each axis."""
    return tuple(math.ceil(ghost * n / (hi - lo)) for (_, lo, hi, _), n in zip(space.axes(), div, strict=True))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells whose owner differs: cell, src, dst."""
    return before.select("cell", F.col("proc_id").alias("src")).join(after.select("cell", F.col("proc_id").alias("dst")), "cell").where("src <> dst")


def owner_by_cells(df: DataFrame, space: Space, div: tuple[int, ...], owners: DataFrame, broadcast_cells: int = 1_000_000) -> DataFrame:
    """Adds cell and proc_id by the table cell -> proc; the table is broadcast while the grid has at most ``broadcast_cells`` cells."""
    table = owners.select("cell", "proc_id")
    rows = with_cell(df, space, div).drop(*[f"c_{d}" for d in space.dims])
    return rows.join(F.broadcast(table) if math.prod(div) <= broadcast_cells else table, "cell")


def ghosts_by_cells(df: DataFrame, space: Space, div: tuple[int, ...], owners: DataFrame, width, broadcast_cells: int = 1_000_000) -> DataFrame:
    """Ghosts for any owners: a row (or an image of it) for each other processor that owns a cell within ``width`` of it, cell by cell.

    The columns are those of ``ghosts``: the row's own (moved), proc_id, dst, s_<dim>.
    """
    out = images(owner_by_cells(df, space, div, owners, broadcast_cells).drop("cell"), space, width)
    lin, image = F.lit(0).cast("long"), F.lit(False)
    for (d, lo, hi, _), n in zip(space.axes(), div, strict=True):
        side = (hi - lo) / n
        at = lambda x, lo=lo, side=side, n=n: F.least(F.greatest(F.floor((x - lo) / side), F.lit(0)), F.lit(n - 1)).cast("long")
        out = out.withColumn(f"__n_{d}", F.explode(F.sequence(at(F.col(d) - width), at(F.col(d) + width))))
        low = lo + F.col(f"__n_{d}") * side
        out = out.where((F.col(d) >= low - width) & (F.col(d) < low + side + width))
        lin, image = lin * n + F.col(f"__n_{d}"), image | (F.col(f"s_{d}") != 0)
    out = out.withColumn("cell", lin).drop(*[f"__n_{d}" for d in space.dims])
    table = owners.select("cell", F.col("proc_id").alias("dst"))
    out = out.join(F.broadcast(table) if math.prod(div) <= broadcast_cells else table, "cell").drop("cell")
    return out.where(image | (F.col("dst") != F.col("proc_id"))).dropDuplicates(["pid", "dst", *[f"s_{d}" for d in space.dims]])


def merged_boxes(owners: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Boxes of cells of one owner each that cover all cells once: proc_id, lo<i>, hi<i> (cells, both ends included).

    Axis by axis, boxes of an owner that agree on all other axes and follow each other become one.  The
    windows run over cells of an owner that share a line, not over all cells.
    """
    out = owners.select("proc_id", *[F.col(n).alias(f"{e}{i}") for i, n in enumerate(names) for e in ("lo", "hi")])
    for ax in reversed(range(len(names))):
        same = ["proc_id", *[f"{e}{i}" for i in range(len(names)) for e in ("lo", "hi") if i != ax]]
        w = Window.partitionBy(*same).orderBy(f"lo{ax}")
        first = F.coalesce(F.lag(f"hi{ax}").over(w) + 1 != F.col(f"lo{ax}"), F.lit(True)).cast("int")
        run = out.withColumn("__f", first).withColumn("__run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = run.groupBy(*same, "__run").agg(F.min(f"lo{ax}").alias(f"lo{ax}"), F.max(f"hi{ax}").alias(f"hi{ax}")).drop("__run")
    return out.select("proc_id", *[f"{e}{i}" for e in ("lo", "hi") for i in range(len(names))])


def grown_boxes(owners: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Boxes of cells of one owner each that cover all cells once, by a wave front: proc_id, lo<i>, hi<i> (cells, both ends included).

    An owner's boxes start one after another at its first free cell (by the indexes in order).  A box's faces move outward in turn, each by
    a layer, up before down, axis by axis, as long as the whole layer is the owner's and free; a summed-area table of
    the free cells tells.  Owners are worked on side by side; one has a few dozen cells, whatever the rows, so a
    group is small.
    """
    d = len(names)
    out = [f"{e}{i}" for e in ("lo", "hi") for i in range(d)]

    def grow(cells: pd.DataFrame) -> pd.DataFrame:
        at = np.unique(cells[list(names)].to_numpy(np.int64), axis=0)
        low, size = at.min(axis=0), np.ptp(at, axis=0) + 1
        free = np.zeros(size, np.int64)
        free[tuple((at - low).T)] = 1
        boxes = []
        for start in map(tuple, at - low):
            if not free[start]:
                continue
            table = np.pad(free, [(1, 0)] * d)
            for ax in range(d):
                table = table.cumsum(axis=ax)

            def held(lo: list, hi: list, table: np.ndarray = table) -> int:
                """Free cells from lo up to before hi."""
                return sum((-1) ** (d - sum(c)) * int(table[tuple(h if k else x for k, x, h in zip(c, lo, hi, strict=True))]) for c in itertools.product((0, 1), repeat=d))

            lo, hi, grew = list(start), [x + 1 for x in start], True
            while grew:
                grew = False
                for ax, up in itertools.product(range(d), (True, False)):
                    a, b = lo[:], hi[:]
                    a[ax], b[ax] = (hi[ax], hi[ax] + 1) if up else (lo[ax] - 1, lo[ax])
                    if a[ax] >= 0 and b[ax] <= size[ax] and held(a, b) == math.prod(y - x for x, y in zip(a, b, strict=True)):
                        lo[ax], hi[ax], grew = min(a[ax], lo[ax]), max(b[ax], hi[ax]), True
            free[tuple(slice(x, y) for x, y in zip(lo, hi, strict=True))] = 0
            boxes.append([*(x + m for x, m in zip(lo, low, strict=True)), *(y - 1 + m for y, m in zip(hi, low, strict=True))])
        return pd.DataFrame(boxes, columns=out, dtype=np.int64).assign(proc_id=cells["proc_id"].iloc[0])[["proc_id", *out]]

    return owners.select("proc_id", *names).groupBy("proc_id").applyInPandas(grow, ", ".join(f"{c} long" for c in ("proc_id", *out)))


def sub_domains(boxes: DataFrame, space: Space, div: tuple[int, ...]) -> DataFrame:
    """The boxes in real coordinates: proc_id, lo<i>, hi<i>; the last cell's upper side is the domain's, exactly."""
    cols = []
    for i, ((_, lo, hi, _), n) in enumerate(zip(space.axes(), div, strict=True)):
        side = (hi - lo) / n
        cols += [(F.col(f"lo{i}") * side + lo).cast("double").alias(f"lo{i}"), F.when(F.col(f"hi{i}") == n - 1, F.lit(float(hi))).otherwise((F.col(f"hi{i}") + 1) * side + lo).cast("double").alias(f"hi{i}")]
    return boxes.select("proc_id", *cols)


def _binned(boxes: DataFrame, dims: int, side: list, side_name: str) -> DataFrame:
    for i in range(dims):
        ends = [F.floor(F.col(f"{side_name}_{e}{i}") / F.lit(side[i])).cast("long") for e in ("lo", "hi")]
        boxes = boxes.withColumn(f"__b{i}", F.explode(F.sequence(*ends)))
    return boxes


def _box_pairs(boxes: DataFrame, dims: int, width: float, period: tuple | None) -> DataFrame:
    """Boxes a and images b (with shifts s<i>) that overlap when one of them is enlarged: an equi-join on bins as wide as the widest enlarged box."""
    a = boxes.select("proc_id", *[(F.col(f"{e}{i}") + d).alias(f"a_{e}{i}") for e, d in (("lo", -width), ("hi", width)) for i in range(dims)])
    b = boxes.select(F.col("proc_id").alias("near"), *[F.col(f"{e}{i}").alias(f"b_{e}{i}") for e in ("lo", "hi") for i in range(dims)])
    for i in range(dims):
        b = b.withColumn(f"s{i}", F.explode(F.array(*[F.lit(s).cast("long") for s in ((-1, 0, 1) if period else (0,))])))
        if period:
            b = b.withColumns({f"b_{e}{i}": F.col(f"b_{e}{i}") + F.col(f"s{i}") * period[i] for e in ("lo", "hi")})
    widest = boxes.agg(*[F.max(F.col(f"hi{i}") - F.col(f"lo{i}") + 2 * width).alias(f"w{i}") for i in range(dims)]).first()
    side = [float(widest[f"w{i}"] or 1.0) for i in range(dims)]
    meet = every((F.col(f"a_lo{i}") <= F.col(f"b_hi{i}")) & (F.col(f"b_lo{i}") <= F.col(f"a_hi{i}")) for i in range(dims))
    # the bin of the overlap's lower corner gives the pair, so that it comes once
    once = every(F.floor(F.greatest(f"a_lo{i}", f"b_lo{i}") / F.lit(side[i])) == F.col(f"__b{i}") for i in range(dims))
    return _binned(a, dims, side, "a").join(_binned(b, dims, side, "b"), [f"__b{i}" for i in range(dims)]).where(meet & once).drop(*[f"__b{i}" for i in range(dims)])


def touching(boxes: DataFrame, dims: int, width: float, period: tuple | None = None) -> DataFrame:
    """Pairs of processors whose boxes, one of them enlarged, overlap or touch (also through periodic borders): proc_id, near."""
    return _box_pairs(boxes, dims, width, period).where("proc_id <> near").select("proc_id", "near").distinct()


def ghost_boxes(boxes: DataFrame, dims: int, width: float, period: tuple | None = None) -> DataFrame:
    """External ghost boxes: the parts of other processors' boxes (or of images of any) within ``width`` of a processor's: proc_id, near, s<i>, lo<i>, hi<i>.

    The internal ghost boxes of ``near`` are the same rows, moved back by the shift.
    """
    at = [f"s{i}" for i in range(dims)]
    pairs = _box_pairs(boxes, dims, width, period).where((F.col("proc_id") != F.col("near")) | ~every(F.col(c) == 0 for c in at))
    cut = [F.greatest(f"a_lo{i}", f"b_lo{i}").alias(f"lo{i}") for i in range(dims)] + [F.least(f"a_hi{i}", f"b_hi{i}").alias(f"hi{i}") for i in range(dims)]
    return pairs.select("proc_id", "near", *at, *cut).where(every(F.col(f"lo{i}") < F.col(f"hi{i}") for i in range(dims)))


def cell_kinds(owners: DataFrame, div: tuple[int, ...], names: tuple[str, ...], periodic: tuple[bool, ...]) -> DataFrame:
    """cell, proc_id, interior: whether all cells around (3^d, through periodic borders) have the same owner.

    Each cell sends its owner to the cells around it; what arrives is compared by its least and greatest, so one grouping does it.
    """
    o = owners.select("proc_id", *names, F.explode(offset_rows(offsets(len(names)), names)).alias("o"))
    to = {n: F.col(n) + F.col(f"o.{n}") for n in names}
    to = {n: F.pmod(c, F.lit(k)) if p else c for (n, c), k, p in zip(to.items(), div, periodic, strict=True)}
    own = every(F.col(f"o.{n}") == 0 for n in names)
    sent = o.select(F.col("proc_id").alias("p"), own.alias("own"), *[c.alias(n) for n, c in to.items()]).where(every(F.col(n).between(0, k - 1) for n, k in zip(names, div, strict=True)))
    got = sent.groupBy(*names).agg(F.max(F.when(F.col("own"), F.col("p"))).alias("proc_id"), F.min("p").alias("least"), F.max("p").alias("most"))
    cell = F.lit(0).cast("long")
    for n, k in zip(names, div, strict=True):
        cell = cell * k + F.col(n)
    return got.select(cell.alias("cell"), "proc_id", (F.col("least") == F.col("most")).alias("interior"))


def cell_costs(owners: DataFrame, div: tuple[int, ...], space: Space, ghost: float, names: tuple[str, ...], steps: int = 1) -> DataFrame:
    """cell, computation, migration, communication: the sum over the cell's axis neighbours of the cost of an edge, ``steps`` each.

    Migration is the cell's volume times the whole part of one over the volume of its ghost layer.
    """
    side = [(hi - lo) / n for (_, lo, hi, _), n in zip(space.axes(), div, strict=True)]
    migration = float(int(1.0 / (ghost * side[0] ** (len(div) - 1))) * side[0] ** len(div))
    edges = F.lit(0)
    for n, k, (_, _, _, p) in zip(names, div, space.axes(), strict=True):
        both = F.lit(2 if k > 1 else 0)
        edges = edges + (both if p else (F.col(n) > 0).cast("int") + (F.col(n) < k - 1).cast("int"))
    return owners.select("cell", F.col("cost").alias("computation"), F.lit(migration).alias("migration"), (edges * steps).cast("long").alias("communication"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two decompositions has (cell and proc_id, or boxes); none if they are equal."""
    cols = a.columns
    return a.exceptAll(b.select(*cols)).withColumn("only", F.lit("a")).unionByName(b.select(*cols).exceptAll(a).withColumn("only", F.lit("b")))


def inconsistencies(owners: DataFrame, n_cells: int, procs: int) -> DataFrame:
    """What is wrong with a table cell -> proc, by kind: cells that are missing, there twice, or out of range; owners that don't exist."""
    one = owners.agg(
        (F.lit(n_cells) - F.count_distinct(F.when(F.col("cell").between(0, n_cells - 1), F.col("cell")))).alias("missing"),
        (F.count("cell") - F.count_distinct("cell")).alias("repeated"),
        F.count_if(~F.coalesce(F.col("cell").between(0, n_cells - 1), F.lit(False))).alias("outside"),
        F.count_if(~F.coalesce(F.col("proc_id").between(0, procs - 1), F.lit(False))).alias("unowned"),
    )
    return one.selectExpr("stack(4, 'missing', missing, 'repeated', repeated, 'outside', outside, 'unowned', unowned) AS (kind, n)").where("n <> 0")


def extended(boxes: DataFrame, dims: int, lo: tuple, hi: tuple, new_lo: tuple, new_hi: tuple) -> DataFrame:
    """Border sub-domains stretched to a larger domain; inner borders stay."""
    for i in range(dims):
        boxes = boxes.withColumns({f"lo{i}": F.when(F.col(f"lo{i}") == lo[i], new_lo[i]).otherwise(F.col(f"lo{i}")), f"hi{i}": F.when(F.col(f"hi{i}") == hi[i], new_hi[i]).otherwise(F.col(f"hi{i}"))})
    return boxes
