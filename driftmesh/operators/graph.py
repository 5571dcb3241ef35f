"""Distributed graphs: vertices(gid, proc_id, ...) and edges(src, dst, ...)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.space import every, offset_rows, offsets
from ..sources.files import written
from .grid import IJK, nodes


def cartesian(spark: SparkSession, sizes: tuple[int, ...], procs: int, parts: int | None = None, spans: int = 1) -> tuple[DataFrame, DataFrame]:
    """A grid's graph: vertices in blocks of equal size a processor; an edge each way between nodes that differ by one on at most ``spans`` axes."""
    n, d = math.prod(sizes), len(sizes)
    axes = IJK[:d]
    v = nodes(spark, sizes, parts).withColumn("proc_id", F.floor(F.col("id") * procs / n).cast("long")).withColumnRenamed("id", "gid")
    star = [o for o in offsets(d) if 0 < sum(map(abs, o)) <= spans]
    e = v.select("gid", *axes, F.explode(offset_rows(star, tuple(f"d{a}" for a in axes))).alias("o"))
    e = e.select("gid", *[(F.col(a) + F.col("o")[f"d{a}"]).alias(a) for a in axes]).where(every(F.col(a).between(0, s - 1) for a, s in zip(axes, sizes, strict=True)))
    dst, stride = F.lit(0).cast("long"), 1
    for a, s in zip(axes, sizes, strict=True):
        dst, stride = dst + F.col(a) * stride, stride * s
    return v, e.select(F.col("gid").alias("src"), dst.alias("dst"))


def with_weights(edges: DataFrame, vertices: DataFrame, axes: tuple[str, ...], sizes: tuple[float, ...]) -> DataFrame:
    """Edges of a grid's graph with their weight: the sum of the cell sizes along the axes that the edge spans."""
    ends = vertices.select("gid", *axes)
    for c in ("src", "dst"):
        edges = edges.join(ends.select(F.col("gid").alias(c), *[F.col(a).alias(f"__{c}_{a}") for a in axes]), c)
    weight = sum((F.when(F.col(f"__src_{a}") != F.col(f"__dst_{a}"), float(x)).otherwise(0.0) for a, x in zip(axes, sizes, strict=True)), F.lit(0.0))
    return edges.select("src", "dst", weight.alias("weight"))


def add_vertices(vertices: DataFrame, new: DataFrame) -> DataFrame:
    """More vertices, each with the processor that adds it; a gid that is there already stays as it was."""
    return vertices.unionByName(new.dropDuplicates(["gid"]).join(vertices.select("gid"), "gid", "left_anti"), allowMissingColumns=True)


def distribution(vertices: DataFrame) -> DataFrame:
    """The distribution vector: proc_id, start, n.  Processor p has the ids from start to start + n - 1; one row a processor."""
    counts = vertices.groupBy("proc_id").agg(F.count("*").alias("n"))
    w = Window.orderBy("proc_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("proc_id", F.coalesce(F.sum("n").over(w), F.lit(0)).cast("long").alias("start"), "n")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree")).withColumnRenamed("src", "gid")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("children")).withColumnRenamed("src", "gid")


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges whose both ends exist."""
    ids = vertices.select("gid")
    return edges.join(ids.withColumnRenamed("gid", "src"), "src", "left_semi").join(ids.withColumnRenamed("gid", "dst"), "dst", "left_semi")


def redistribute(vertices: DataFrame, moves: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Vertices after queued moves (gid, target), with new ids rid that are contiguous a processor and in the order of gid.

    Ranks are taken within slices of ``width`` gids of a processor; slices' counts are summed up before, so
    no task orders the whole graph or a whole processor.  Moved vertices are written once, as counts and ranks both read them.
    """
    v = vertices.join(moves, "gid", "left").withColumn("proc_id", F.coalesce("target", "proc_id")).drop("target")
    v = written(v.withColumn("__slice", F.floor(F.col("gid") / width)))
    counts = v.groupBy("proc_id", "__slice").agg(F.count("*").alias("n"))
    up = Window.partitionBy("proc_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("n").over(up), F.lit(0))).join(F.broadcast(distribution(v).drop("n")), "proc_id")
    starts = starts.select("proc_id", "__slice", (F.col("start") + F.col("__before")).alias("__start"))
    rank = F.row_number().over(Window.partitionBy("proc_id", "__slice").orderBy("gid")) - 1
    out = v.withColumn("__rank", rank).join(starts.hint("merge"), ["proc_id", "__slice"])
    return out.withColumn("rid", (F.col("__start") + F.col("__rank")).cast("long")).drop("__start", "__rank", "__slice")


def renamed_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    ids = vertices.select("gid", "rid")
    for c in ("src", "dst"):
        edges = edges.join(ids.select(F.col("gid").alias(c), F.col("rid").alias(f"r{c}")), c)
    return edges


def with_owners(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    own = vertices.select("gid", "proc_id")
    return edges.join(own.select(F.col("gid").alias("src"), F.col("proc_id").alias("src_proc")), "src").join(own.select(F.col("gid").alias("dst"), F.col("proc_id").alias("dst_proc")), "dst")


def ghost_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each processor the vertices of others that its edges lead to."""
    return with_owners(edges, vertices).where("src_proc <> dst_proc").select(F.col("src_proc").alias("proc_id"), F.col("dst").alias("gid")).distinct()


def requested(want: DataFrame, vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that processors ask for (proc_id, gid), with all their data and edges, as ghosts.

    The three steps of a directory: what is asked for, once a processor; who holds it (home); the vertex and its edges back to who asked.
    The first table has the vertices' columns, home and is_ghost (false for what a processor holds itself); the second proc_id, src, dst and
    what else edges have.  Unknown ids give nothing.
    """
    held = vertices.withColumnRenamed("proc_id", "home")
    found = want.select("proc_id", "gid").distinct().join(held, "gid").withColumn("is_ghost", F.col("proc_id") != F.col("home"))
    return found, found.where("is_ghost").select("proc_id", F.col("gid").alias("src")).join(edges, "src")


def border(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """What each processor has to ask for: the far ends of the edges that it holds, (proc_id, gid)."""
    return ghost_vertices(edges, vertices)


def edge_cut(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return with_owners(edges, vertices).agg(F.count_if(F.col("src_proc") != F.col("dst_proc")).alias("cut"), F.count("*").alias("edges"))
