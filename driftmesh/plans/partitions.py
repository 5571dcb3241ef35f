"""Queries of k-way partitions: of a graph of customers and orders, and of cells that cost what their particles cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.space import with_hilbert
from ..operators import decomposition as dc
from ..operators import graph as gr
from ..operators import partition as pn
from ..sources.files import written
from .catalogue import BOX, particles, query

PARTS, SLACK, DIV16, ABC, PERIODIC = 8, 0.05, (16, 16, 16), ("a", "b", "c"), (True, True, True)


def trade(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers (odd ids) and orders (even ids); an edge an order, and one between orders that follow each other in a customer's book."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * 2).alias("o"), (F.col("o_custkey") * 2 + 1).alias("c"))
    v = o.select(F.col("o").alias("gid")).unionByName(spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") * 2 + 1).alias("gid")))
    follows = o.select(F.col("o").alias("src"), F.lead("o").over(Window.partitionBy("c").orderBy("o")).alias("dst")).where("dst IS NOT NULL")
    return v, o.select(F.col("o").alias("src"), F.col("c").alias("dst")).unionByName(follows)


def costly_cells(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells with the weighted curve's owners, the same as vertices (a cell costs 1 and its particles), and faces as edges."""
    p = particles(spark, sf) if rows is None else rows
    cells = written(with_hilbert(dc.decompose(spark, DIV16, PARTS, "weighted", dc.costs(dc.with_cell(p, BOX, DIV16), lambda n: n + 1)), list(ABC), 4, "key"))
    v = cells.select(F.col("cell").alias("gid"), F.greatest("cost", F.lit(1)).cast("long").alias("w"), "key", "proc_id")
    return cells, v, pn.cell_edges(cells, DIV16, ABC, PERIODIC)


def by_id(v: DataFrame, parts: int) -> DataFrame:
    """Equal numbers of vertices along the curve of ids: shares of ids by their rank, in slices, so that no task ranks all."""
    lo, hi = v.agg(F.min("gid"), F.max("gid")).first()
    return v.withColumn("proc_id", F.least(F.floor((F.col("gid") - lo) * parts / (hi - lo + 1)), F.lit(parts - 1)).cast("long"))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS vertices, 8::BIGINT AS procs, true AS balanced, true AS cut_no_larger")
def graph_kway(spark, sf):
    """All vertices once, on 8 processors, loads within 5 % of the mean, and a cut no larger than that of the curve of ids."""
    v, e = trade(spark, sf)
    v, e = v.withColumn("w", F.lit(1).cast("long")), written(e)
    found = pn.partition(v, e, PARTS, SLACK)
    both = by_id(found.withColumnRenamed("proc_id", "cut"), PARTS).withColumnRenamed("proc_id", "curve")
    cuts = pn.cuts(both, e, ("cut", "curve"))
    once = v.select("gid").join(found, "gid").groupBy("gid").agg(F.min("proc_id").alias("proc_id"))
    cover = once.groupBy("proc_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("vertices"), F.count("*").alias("procs"))
    rows = cover.crossJoin(pn.balance(found, PARTS)).crossJoin(cuts)  # one row each
    return rows.select("vertices", "procs", (F.col("balance") <= 1 + SLACK).alias("balanced"), (F.col("cut") <= F.col("curve")).alias("cut_no_larger"))


@query("SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS vertices, (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) - 1 AS last, 8::BIGINT AS procs, true AS contiguous")
def graph_kway_redistribute(spark, sf):
    """The partition as moves of a distributed graph: vertices start by ids, move, and get ids that are contiguous a processor."""
    v, e = trade(spark, sf)
    found = pn.partition(v, e, PARTS, SLACK).select("gid", F.col("proc_id").alias("target"))
    after = written(gr.redistribute(by_id(v, PARTS), found))
    ranges = after.groupBy("proc_id").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n"))
    return ranges.agg(F.sum("n").alias("vertices"), F.max("hi").alias("last"), F.count("*").alias("procs"), F.bool_and(F.col("hi") - F.col("lo") + 1 == F.col("n")).alias("contiguous"))


@query("SELECT 4096::BIGINT AS cells, sum(n)::BIGINT AS particles, true AS balanced, true AS cut_no_larger FROM (SELECT count(*) AS n FROM orders)")
def dist_kway(spark, sf):
    """Cells partitioned as a graph, by their particles' cost: no worse than the weighted curve in faces cut."""
    cells, v, e = costly_cells(spark, sf)
    found = written(pn.partition(v.drop("proc_id"), e, PARTS, SLACK))
    owned = found.select(F.col("gid").alias("cell"), "proc_id")
    rows = dc.owner_by_cells(particles(spark, sf), BOX, DIV16, owned).agg(F.count("*").alias("particles"))
    curve = pn.quality(v, e, PARTS).select(F.col("cut").alias("curve"))
    size = owned.agg(F.count_distinct("cell").alias("cells"))
    both = size.crossJoin(rows).crossJoin(pn.quality(found, e, PARTS)).crossJoin(curve)  # one row each
    return both.select("cells", "particles", (F.col("balance") <= 1 + SLACK).alias("balanced"), (F.col("cut") <= F.col("curve")).alias("cut_no_larger"))


@query("SELECT 4096::BIGINT AS cells, true AS balanced, true AS cut_smaller")
def kway_refine(spark, sf):
    """The weighted curve's owners, refined: fewer faces cut, still balanced."""
    _, v, e = costly_cells(spark, sf)
    after = written(pn.refined(v, e, PARTS, SLACK, 4))
    before = pn.quality(v, e, PARTS).select(F.col("cut").alias("before"))
    size = after.agg(F.count_distinct("gid").alias("cells"))
    both = size.crossJoin(pn.quality(after, e, PARTS)).crossJoin(before)  # one row each
    return both.select("cells", (F.col("balance") <= 1 + SLACK).alias("balanced"), (F.col("cut") < F.col("before")).alias("cut_smaller"))


@query("SELECT 4096::BIGINT AS cells, true AS balanced, true AS moves_less")
def kway_adaptive(spark, sf):
    """Half of space gets three times the particles: owners adapt, and less moves than with a partition made anew."""
    _, old, _ = costly_cells(spark, sf)
    p = particles(spark, sf)
    more = p.unionByName(p.where("x < 500")).unionByName(p.where("x < 500"))
    cells, v, e = costly_cells(spark, sf, more)
    v = v.drop("proc_id").join(old.select("gid", "proc_id", F.col("proc_id").alias("home")), "gid")
    adapted = written(pn.refined(v, e, PARTS, SLACK, 6, F.col("w"), 10))
    anew = written(pn.partition(v.select("gid", "w", "key"), e, PARTS, SLACK)).join(v.select("gid", "home"), "gid")
    moved = pn.quality(anew, e, PARTS).select(F.col("migration").alias("anew"))
    both = adapted.agg(F.count("*").alias("cells")).crossJoin(pn.quality(adapted, e, PARTS)).crossJoin(moved)  # one row each
    return both.select("cells", (F.col("balance") <= 1 + SLACK).alias("balanced"), (F.col("migration") < F.col("anew")).alias("moves_less"))
