"""Particle sets: placement, ghosts, subsets, order and reductions.

A set is a DataFrame with an id, coordinates and properties; a processor is a column, a ghost is a row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.space import Space, cell, every, morton, with_hilbert


def lattice(spark: SparkSession, sizes: tuple[int, ...], space: Space, parts: int | None = None) -> DataFrame:
    """Nodes of a regular lattice over the box: pid and coordinates; spacing L/n on periodic axes, L/(n-1) on others."""
    df, stride, cols = spark.range(0, math.prod(sizes), numPartitions=parts), 1, {}
    for (d, lo, hi, p), n in zip(space.axes(), sizes, strict=True):
        step = (hi - lo) / (n if p else max(n - 1, 1))
        cols[d] = F.pmod(F.floor(F.col("id") / stride), F.lit(n)) * step + lo
        stride *= n
    return df.select(F.col("id").alias("pid"), *[c.alias(d) for d, c in cols.items()])


def box_owner(space: Space, div: tuple[int, ...]) -> Column:
    """Owner by integer arithmetic: the processor grid's cell, last axis fastest, clamped to the grid."""
    out = F.lit(0).cast("long")
    for (d, lo, hi, _), n in zip(space.axes(), div, strict=True):
        c = F.least(F.greatest(F.floor((F.col(d) - lo) * n / (hi - lo)), F.lit(0)), F.lit(n - 1))
        out = out * n + c.cast("long")
    return out


def new_set(spark: SparkSession, n: int, procs: int, parts: int | None = None) -> DataFrame:
    """pid and proc_id of n rows dealt evenly: the first n % procs processors have one row more; ids are contiguous a processor."""
    q, more = divmod(n, procs)
    pid = F.col("id")
    owner = F.when(pid < more * (q + 1), F.floor(pid / (q + 1))).otherwise(more + F.floor((pid - more * (q + 1)) / max(q, 1)))
    return spark.range(0, n, numPartitions=parts).select(pid.alias("pid"), owner.cast("long").alias("proc_id"))


def random_set(spark: SparkSession, n: int, space: Space, seed: int = 0, parts: int | None = None) -> DataFrame:
    """n rows at uniform random places; a place depends on seed and pid only, so reruns and lost tasks give the same."""
    unit = lambda i: F.shiftrightunsigned(F.xxhash64("id", F.lit(i), F.lit(seed)), 11).cast("double") * 2.0**-53
    cols = [(unit(i) * (hi - lo) + lo).alias(d) for i, (d, lo, hi, _) in enumerate(space.axes())]
    return spark.range(0, n, numPartitions=parts).select(F.col("id").alias("pid"), *cols)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    """The set and more rows; columns that only one side has are null on the other."""
    return df.unionByName(rows, allowMissingColumns=True)


def resize(df: DataFrame, n: int, key: str = "pid") -> DataFrame:
    """Rows with ids below n; ids that the set lacks come with nulls.  Ids number the rows from 0."""
    kept = df.where(F.col(key) < n)
    missing = df.sparkSession.range(n).withColumnRenamed("id", key).join(kept.select(key), key, "left_anti")
    return append(kept, missing)


def clear(df: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return df.where(F.lit(False))


def kill(df: DataFrame, inside: Column) -> DataFrame:
    """Out-of-bound policy: rows that are out go.  The policy named Nothing does the same: its rows have no owner."""
    return df.where(inside)


def kill_with_warning(seen: Observation) -> Callable[[DataFrame, Column], DataFrame]:
    """Out-of-bound policy: rows that are out go, and ``seen`` holds their number as ``lost`` once an action has run."""
    return lambda df, inside: df.observe(seen, F.count_if(~F.coalesce(inside, F.lit(False))).alias("lost")).where(inside)


def fail(df: DataFrame, inside: Column) -> DataFrame:
    """Out-of-bound policy: a row that is out ends the job."""
    return df.where(F.when(inside, True).otherwise(F.raise_error(F.lit("a row is out of bounds")).isNull()))


def keep(df: DataFrame, inside: Column) -> DataFrame:
    """Out-of-bound policy: rows that are out stay, with the nearest owner."""
    return df


POLICIES = {"kill": kill, "nothing": kill, "error": fail, "keep": keep}


def map_rows(df: DataFrame, space: Space, owner: Column, policy: str | Callable[[DataFrame, Column], DataFrame] = "kill", deal: bool = False) -> DataFrame:
    """Wraps, applies the out-of-bound policy (a name of POLICIES or a function of the set and the inside test) and names each row's owner.

    ``deal`` also sends rows to their owner's partition; leave it out where a join or grouping follows,
    which deals by its own keys.
    """
    out = (POLICIES[policy] if isinstance(policy, str) else policy)(space.wrapped(df), space.inside()).withColumn("proc_id", owner)
    return out.repartition("proc_id") if deal else out


def map_list(df: DataFrame, space: Space, owner: Column, props: tuple[str, ...], policy="kill", deal: bool = False) -> DataFrame:
    """As map_rows, with the id, the coordinates and the listed properties only; other columns are neither read nor moved."""
    return map_rows(df.select("pid", *space.dims, *props), space, owner, policy, deal)


def images(df: DataFrame, space: Space, width, keep: Column | None = None) -> DataFrame:
    """Rows and their periodic images within ``width`` of the box; s_<dim> counts the box lengths moved.

    Axis by axis, so that few rows are made: an image is dropped before the next axis multiplies it.
    """
    for d, lo, hi, p in space.axes():
        if not p:
            df = df.withColumn(f"s_{d}", F.lit(0).cast("long"))
            continue
        n = max(1, math.ceil(width / (hi - lo)))
        df = df.withColumn(f"s_{d}", F.explode(F.array(*[F.lit(i).cast("long") for i in range(-n, n + 1)])))
        df = df.withColumn(d, F.col(d) + F.col(f"s_{d}") * (hi - lo)).where((F.col(d) >= lo - width) & (F.col(d) < hi + width))
    return df


def ghosts(df: DataFrame, space: Space, div: tuple[int, ...], width) -> DataFrame:
    """A row for every ghost: the set's columns (moved), dst, s_<dim>.

    A row is a ghost at each processor whose box, enlarged by ``width``, holds it or an image of it,
    other than the row itself at its owner.  Boxes are a grid, so the processors are found by arithmetic
    on each axis, not by a join.
    """
    own = df.withColumn("proc_id", box_owner(space, div))
    out, dst = images(own, space, width), F.lit(0).cast("long")
    for (d, lo, hi, _), n in zip(space.axes(), div, strict=True):
        side = (hi - lo) / n
        first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(d) - lo - width) / side - 1 + 1e-12).cast("long"))
        last = F.least(F.lit(n - 1).cast("long"), F.floor((F.col(d) - lo + width) / side).cast("long"))
        out = out.where(first <= last).withColumn(f"__b_{d}", F.explode(F.sequence(first, last)))
        out = out.where((F.col(d) >= lo + F.col(f"__b_{d}") * side - width) & (F.col(d) < lo + (F.col(f"__b_{d}") + 1) * side + width))
        dst = dst * n + F.col(f"__b_{d}")
    moved = every(F.col(f"s_{d}") == 0 for d in space.dims)
    return out.withColumn("dst", dst).where(~(moved & (F.col("dst") == F.col("proc_id")))).drop(*[f"__b_{d}" for d in space.dims])


def keep_labels(ghost: DataFrame, space: Space, name: str, path: str, buckets: int) -> None:
    """Keeps who gets which ghost as a table, laid out by pid: pid, proc_id, dst, s_<dim>.  Later exchanges of the same rows need no labelling."""
    labels = ghost.select("pid", "proc_id", "dst", *[f"s_{d}" for d in space.dims])
    labels.repartition(buckets, "pid").write.mode("overwrite").option("path", path).bucketBy(buckets, "pid").sortBy("pid").saveAsTable(name)


def ghosts_by_labels(df: DataFrame, space: Space, name: str) -> DataFrame:
    """The ghosts of ``ghosts`` by a kept table of labels, with df's values of now: only df's rows move, once, to where their labels are.

    Rows whose owner or neighbourhood changed since keep their old labels; label anew after rows are moved to other owners.
    """
    out = df.join(df.sparkSession.table(name).hint("merge"), "pid")
    return out.withColumns({d: F.col(d) + F.col(f"s_{d}") * (hi - lo) for d, lo, hi, _ in space.axes()})


def with_ghosts(df: DataFrame, ghost: DataFrame) -> DataFrame:
    """Owned rows and ghosts in one set: is_ghost tells them apart; a ghost's proc_id is the processor that holds it."""
    shifts = [c for c in ghost.columns if c.startswith("s_")]
    own = df.withColumn("is_ghost", F.lit(False)).withColumns({c: F.lit(0).cast("long") for c in shifts})
    held = ghost.withColumn("proc_id", F.col("dst")).drop("dst").withColumn("is_ghost", F.lit(True))
    return own.unionByName(held)


def ghost_owners(ghost: DataFrame, unique: bool = False) -> DataFrame:
    """pid and dst of each ghost; with ``unique`` a row's processor counts once, however many images it gets."""
    labels = ghost.select("pid", "dst")
    return labels.distinct() if unique else labels


def ghost_put(owned: DataFrame, ghost: DataFrame, key: str, merge: dict[str, Column]) -> DataFrame:
    """Merges ghost values into their owners' rows; ``merge`` maps columns to aggregates over owner and ghosts.

    Only the key and the merged columns move, and sums combine before the shuffle.
    """
    cols = [key, *merge]
    return owned.select(*cols).unionByName(ghost.select(*cols)).groupBy(key).agg(*[a.alias(c) for c, a in merge.items()])


def subset(df: DataFrame, k: int, flag: str = "subset") -> DataFrame:
    return df.where(F.col(flag) == k)


def remove_ids(df: DataFrame, ids: DataFrame, key: str = "pid") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def remove_marked(df: DataFrame, flag: Column) -> DataFrame:
    return df.where(F.coalesce(flag, F.lit(0)) == 0)


def ids_by(df: DataFrame, pred: Column, key: str = "pid") -> DataFrame:
    return df.where(pred).select(key)


def reorder(df: DataFrame, space: Space, bits: int, curve: str = "hilbert", deal: bool = True) -> DataFrame:
    """Adds sfc_key over 2^bits cells an axis and, with ``deal``, lays rows out in its order by range partitions.

    Neighbouring rows then share files and row groups, whose statistics skip by coordinates.
    """
    n = 1 << bits
    cells = [F.least(F.greatest(cell(F.col(d), lo, (hi - lo) / n), F.lit(0)), F.lit(n - 1)).cast("long") for d, lo, hi, _ in space.axes()]
    if curve == "linear":
        key = F.lit(0).cast("long")
        for c in reversed(cells):
            key = key * n + c
        out = df.withColumn("sfc_key", key)
    elif curve == "morton":
        out = df.withColumn("sfc_key", morton(cells, bits))
    else:
        names = [f"__c_{d}" for d in space.dims]
        out = with_hilbert(df.withColumns(dict(zip(names, cells, strict=True))), names, bits, "sfc_key").drop(*names)
    return out.repartitionByRange("sfc_key").sortWithinPartitions("sfc_key") if deal else out


def reorder_rcut(df: DataFrame, space: Space, r, deal: bool = True) -> DataFrame:
    """Adds sfc_key, the linear number of the row's cell of side ``r`` (first axis fastest), and with ``deal`` lays rows out by it."""
    key, stride = F.lit(0).cast("long"), 1
    for d, lo, hi, _ in space.axes():
        n = max(1, math.ceil((hi - lo) / r))
        key = key + F.least(F.greatest(cell(F.col(d), lo, r), F.lit(0)), F.lit(n - 1)).cast("long") * stride
        stride *= n
    out = df.withColumn("sfc_key", key)
    return out.repartitionByRange("sfc_key").sortWithinPartitions("sfc_key") if deal else out


def sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("proc_id").agg(F.count("*").alias("n"))


def prefix(counts: DataFrame) -> DataFrame:
    """First global row number of each processor; the window runs over one row a processor."""
    w = Window.orderBy("proc_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long"))


def row_class(df: DataFrame, space: Space, div: tuple[int, ...], width) -> DataFrame:
    """INSIDE, HALO (within ``width`` of the owner's border) or GHOST (out of the box of the processor that holds it; proc_id, if there is one, names that)."""
    near, out = F.lit(False), F.lit(False)
    for (d, lo, hi, _), n in zip(space.axes(), div, strict=True):
        side = (hi - lo) / n
        at = (F.col(d) - lo) - F.least(F.greatest(F.floor((F.col(d) - lo) / side), F.lit(0)), F.lit(n - 1)) * side
        near = near | (at < width) | (at >= side - width)
        out = out | (F.col(d) < lo) | (F.col(d) >= hi)
    if "proc_id" in df.columns:
        out = out | (box_owner(space, div) != F.col("proc_id"))
    return df.withColumn("row_class", F.when(out, "GHOST").when(near, "HALO").otherwise("INSIDE"))


def bad_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """How many NaN and infinite values each column has; one pass, one row a column."""
    inf = F.lit(float("inf"))
    aggs = [a for c in cols for a in (F.count_if(F.isnan(c)).alias(f"{c}__nan"), F.count_if(F.abs(F.col(c)) == inf).alias(f"{c}__inf"))]
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}__nan").alias("n_nan"), F.col(f"{c}__inf").alias("n_inf")) for c in cols])).alias("r")).select("r.*")


def differ(a: DataFrame, b: DataFrame, key: str, cols: list[str], tolerance: float) -> DataFrame:
    """Rows of two sets that differ by more than the tolerance, or that only one has."""
    j = a.select(key, *[F.col(c).alias(f"a_{c}") for c in cols]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in cols]), key, "full")
    return j.where(~every(F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tolerance, F.lit(False)) for c in cols))
