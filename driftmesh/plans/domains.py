"""Queries of decompositions, owners by cell, and the life of a particle set."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.space import Space, cells_an_axis
from ..operators import decomposition as dc
from ..operators import particles as pt
from ..sources import files
from .catalogue import BOX, CELL, CELLS, DIV, GHOSTS, L, OPEN, OWNERS, P, R, XYZ, longs, owners, particles, query, shared

ABC = ("a", "b", "c")
DIV8 = (8, 8, 8)
PERIODIC = (True, True, True)
S3 = "(VALUES (-1), (0), (1))"


# sets


@query("""WITH n AS (SELECT count(*) AS n, count(*) // 7 AS q, count(*) % 7 AS more FROM customer)
SELECT r AS pid, CASE WHEN r < more * (q + 1) THEN r // (q + 1) ELSE more + (r - more * (q + 1)) // q END AS proc_id FROM n, range((SELECT n FROM n)) t(r)""")
def new_set(spark, sf):
    """As many rows as there are customers over 7 processors, at most one more on one than on another."""
    return longs(pt.new_set(spark, spark.read.parquet(f"{sf}/customer.parquet").count(), 7), "pid", "proc_id")


@query("SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS inside, 8::BIGINT AS octants FROM orders")
def random_set(spark, sf):
    n = particles(spark, sf).count()
    r = pt.random_set(spark, n, BOX, 3)
    return r.agg(F.count("*").alias("n"), F.count_if(BOX.inside()).alias("inside"), F.count_distinct(pt.box_owner(BOX, DIV)).alias("octants"))


@query(f"WITH {P} SELECT pid, x, q FROM p UNION ALL SELECT c_custkey + 100000000, c_custkey % 1000, NULL FROM customer")
def append_rows(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    new = c.select((F.col("c_custkey") + 100000000).alias("pid"), (F.col("c_custkey") % L).alias("x"))
    return longs(pt.append(particles(spark, sf).select("pid", "x", "q"), new), "pid", "x", "q")


@query(f"WITH {P} SELECT r AS pid, x FROM range(2000) t(r) LEFT JOIN p ON pid = r")
def resize_set(spark, sf):
    return longs(pt.resize(particles(spark, sf).select("pid", "x"), 2000), "pid", "x")


@query(f"WITH {P} SELECT pid, x FROM p WHERE false")
def clear_set(spark, sf):
    return longs(pt.clear(particles(spark, sf).select("pid", "x")), "pid", "x")


@query(f"WITH {P} SELECT pid, x, y, z, q, (x // 500) * 4 + (y // 500) * 2 + z // 500 AS proc_id FROM p")
def map_list(spark, sf):
    p = particles(spark, sf).withColumn("other", F.col("q") * 2)
    return longs(pt.map_list(p, BOX, pt.box_owner(BOX, DIV), ("q",), deal=True), "pid", *XYZ, "q", "proc_id")


@query(f"WITH {P} SELECT count(*) FILTER (x + 137 <= 1000)::BIGINT AS kept, count(*) FILTER (x + 137 > 1000)::BIGINT AS lost FROM p")
def oob_warning(spark, sf):
    """Rows out of bounds go, and their number is observed on the way."""
    seen = Observation()
    kept = pt.map_rows(particles(spark, sf).withColumn("x", F.col("x") + 137), OPEN, pt.box_owner(OPEN, DIV), pt.kill_with_warning(seen)).count()
    return spark.createDataFrame([(kept, seen.get["lost"])], "kept long, lost long")


@query(f"WITH {P} SELECT count(*) FILTER (x + 137 <= 1000)::BIGINT AS nothing, count(*)::BIGINT AS keep, count(*) FILTER (x + 137 <= 900)::BIGINT AS own FROM p")
def oob_policies(spark, sf):
    p = particles(spark, sf).withColumn("x", F.col("x") + 137)
    counts = [pt.map_rows(p, OPEN, pt.box_owner(OPEN, DIV), how).agg(F.count("*").alias(n)) for n, how in (("nothing", "nothing"), ("keep", "keep"), ("own", lambda df, inside: df.where(inside & (F.col("x") <= 900))))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


@query(f"WITH {GHOSTS}, u AS (SELECT {CELL.replace('125', '500').replace('64', '4').replace('* 8', '* 2')} AS proc_id, false AS is_ghost FROM p UNION ALL SELECT dst, true FROM g) SELECT proc_id::BIGINT AS proc_id, is_ghost, count(*)::BIGINT AS n FROM u GROUP BY ALL")
def domain_and_ghosts(spark, sf):
    """Owned rows and ghosts in one set."""
    p = particles(spark, sf)
    both = pt.with_ghosts(p.withColumn("proc_id", pt.box_owner(BOX, DIV)), pt.ghosts(p, BOX, DIV, R))
    return both.groupBy("proc_id", "is_ghost").agg(F.count("*").alias("n"))


@query(f"WITH {GHOSTS} SELECT DISTINCT pid, dst::BIGINT AS dst FROM g")
def ghost_owners_unique(spark, sf):
    return longs(pt.ghost_owners(pt.ghosts(particles(spark, sf), BOX, DIV, R), unique=True), "pid", "dst")


@query(f"WITH {P} SELECT pid, x // 40 + y // 40 * 25 + z // 40 * 625 AS sfc_key FROM p")
def reorder_rcut(spark, sf):
    return longs(pt.reorder_rcut(particles(spark, sf), BOX, R), "pid", "sfc_key")


# decompositions


@query("SELECT s_suppkey AS procs, pow(2, greatest(0, ceil(log2(pow(s_suppkey * 64, 1 / 3.0::DOUBLE)) - 1e-9)))::BIGINT AS per_axis FROM supplier")
def granularity(spark, sf):
    """Cells an axis for as many processors as a supplier's number says."""
    procs = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("procs"))
    return longs(procs.withColumn("per_axis", cells_an_axis(F.col("procs"), 3)), "procs", "per_axis")


@query(f"WITH {OWNERS}, r AS (SELECT cell, proc_id FROM o) SELECT r.cell, (h.h * 6 // 512) AS src, r.proc_id AS dst FROM r JOIN h USING (cell) WHERE h.h * 6 // 512 <> r.proc_id")
def redecompose(spark, sf):
    """Cells that move when costs replace equal numbers."""
    return longs(dc.moved(dc.decompose(spark, DIV8, 6), owners(spark, sf)), "cell", "src", "dst")


@query(f"WITH {OWNERS} SELECT proc_id, count(*)::BIGINT AS n FROM p JOIN o ON o.cell = {CELL} GROUP BY proc_id")
def owner_by_curve(spark, sf):
    return longs(pt.sizes(dc.owner_by_cells(particles(spark, sf), BOX, DIV8, owners(spark, sf))), "proc_id", "n")


@query(
    f"""WITH {OWNERS}, w AS (SELECT pid, x, y, z, o.proc_id FROM p JOIN o ON o.cell = {CELL}),
i AS (SELECT pid, proc_id, sx, sy, sz, x + sx * 1000 AS x, y + sy * 1000 AS y, z + sz * 1000 AS z FROM w, {S3} a(sx), {S3} b(sy), {S3} c(sz)
  WHERE {" AND ".join(f"{c} + s{c} * 1000 >= -40 AND {c} + s{c} * 1000 < 1040" for c in XYZ)}),
n AS (SELECT i.*, greatest(least((x + dx) // 125, 7), 0) AS a, greatest(least((y + dy) // 125, 7), 0) AS b, greatest(least((z + dz) // 125, 7), 0) AS c FROM (SELECT * FROM i) i, (VALUES (-40), (40)) u(dx), (VALUES (-40), (40)) v(dy), (VALUES (-40), (40)) t(dz)),
m AS (SELECT DISTINCT pid, o.proc_id AS dst, sx, sy, sz FROM n JOIN o ON o.cell = a * 64 + b * 8 + c
  WHERE x >= a * 125 - 40 AND x < a * 125 + 165 AND y >= b * 125 - 40 AND y < b * 125 + 165 AND z >= c * 125 - 40 AND z < c * 125 + 165 AND (sx <> 0 OR sy <> 0 OR sz <> 0 OR o.proc_id <> n.proc_id))
SELECT dst, count(*)::BIGINT AS n FROM m GROUP BY dst"""
)
def ghosts_by_curve(spark, sf):
    """Ghosts of processors whose cells follow the curve."""
    g = dc.ghosts_by_cells(particles(spark, sf), BOX, DIV8, owners(spark, sf), R)
    return longs(g.groupBy("dst").agg(F.count("*").alias("n")), "dst", "n")


RUNS = """WITH {src}, r2 AS (SELECT proc_id, a, b, min(c) AS lc, max(c) AS hc FROM (SELECT *, c - row_number() OVER (PARTITION BY proc_id, a, b ORDER BY c) AS g FROM k) GROUP BY proc_id, a, b, g),
r1 AS (SELECT proc_id, a, lc, hc, min(b) AS lb, max(b) AS hb FROM (SELECT *, b - row_number() OVER (PARTITION BY proc_id, a, lc, hc ORDER BY b) AS g FROM r2) GROUP BY proc_id, a, lc, hc, g),
r0 AS (SELECT proc_id, lb, hb, lc, hc, min(a) AS la, max(a) AS ha FROM (SELECT *, a - row_number() OVER (PARTITION BY proc_id, lb, hb, lc, hc ORDER BY a) AS g FROM r1) GROUP BY proc_id, lb, hb, lc, hc, g)"""
MERGED = RUNS.format(src=f"{OWNERS}, k AS (SELECT proc_id, cell // 64 AS a, cell // 8 % 8 AS b, cell % 8 AS c FROM o)")


@query(f"{MERGED} SELECT proc_id, la AS lo0, lb AS lo1, lc AS lo2, ha AS hi0, hb AS hi1, hc AS hi2 FROM r0")
def box_merge(spark, sf):
    """Boxes of cells that the weighted curve gives to one processor."""
    return longs(dc.merged_boxes(owners(spark, sf), ABC), "proc_id", *[f"{e}{i}" for e in ("lo", "hi") for i in range(3)])


@query(f"{MERGED} SELECT proc_id, (la * 125)::DOUBLE AS lo0, ((ha + 1) * 125)::DOUBLE AS hi0, (lb * 125)::DOUBLE AS lo1, ((hb + 1) * 125)::DOUBLE AS hi1, (lc * 125)::DOUBLE AS lo2, ((hc + 1) * 125)::DOUBLE AS hi2 FROM r0")
def sub_domains(spark, sf):
    return dc.sub_domains(dc.merged_boxes(owners(spark, sf), ABC), BOX, DIV8)


@query(
    f"{MERGED}, d AS (SELECT proc_id, la * 125 AS x0, (ha + 1) * 125 AS x1, lb * 125 AS y0, (hb + 1) * 125 AS y1, lc * 125 AS z0, (hc + 1) * 125 AS z1 FROM r0), "
    f"g AS (SELECT a.proc_id, b.proc_id AS near, sx, sy, sz, "
    + ", ".join(f"greatest(a.{c}0 - 40, b.{c}0 + s{c} * 1000) AS l{c}, least(a.{c}1 + 40, b.{c}1 + s{c} * 1000) AS h{c}" for c in XYZ)
    + f" FROM d a, d b, {S3} u(sx), {S3} v(sy), {S3} w(sz) WHERE a.proc_id <> b.proc_id OR sx <> 0 OR sy <> 0 OR sz <> 0) "
    "SELECT proc_id, near, count(*)::BIGINT AS n, sum((hx - lx) * (hy - ly) * (hz - lz))::DOUBLE AS volume FROM g WHERE lx < hx AND ly < hy AND lz < hz GROUP BY ALL"
)
def ghost_boxes(spark, sf):
    """Number and volume of the ghost boxes between processors."""
    boxes = dc.sub_domains(dc.merged_boxes(owners(spark, sf), ABC), BOX, DIV8)
    g = dc.ghost_boxes(boxes, 3, R, (L, L, L))
    volume = F.sum((F.col("hi0") - F.col("lo0")) * (F.col("hi1") - F.col("lo1")) * (F.col("hi2") - F.col("lo2")))
    return g.groupBy("proc_id", "near").agg(F.count("*").alias("n"), volume.alias("volume"))


@query(
    f"WITH {OWNERS}, k AS (SELECT o.*, cell // 64 AS a, cell // 8 % 8 AS b, cell % 8 AS c FROM o), t AS (SELECT k.*, da, db, dc FROM k, {S3} u(da), {S3} v(db), {S3} w(dc)), "
    "m AS (SELECT t.cell, t.proc_id, n.proc_id AS p FROM t JOIN k n ON n.a = (t.a + da + 8) % 8 AND n.b = (t.b + db + 8) % 8 AND n.c = (t.c + dc + 8) % 8) "
    "SELECT cell, proc_id, min(p) = max(p) AS interior FROM m GROUP BY cell, proc_id"
)
def icells(spark, sf):
    """Interior and border cells."""
    return dc.cell_kinds(owners(spark, sf), DIV8, ABC, PERIODIC)


UNIT = Space(XYZ, (0.0,) * 3, (1.0,) * 3, PERIODIC)


@query(f"WITH {CELLS} SELECT cell, n AS computation, floor(1.0::DOUBLE / (0.05::DOUBLE * 0.125::DOUBLE * 0.125::DOUBLE)) * 0.125::DOUBLE * 0.125::DOUBLE * 0.125::DOUBLE AS migration, (6 * 3)::BIGINT AS communication FROM c")
def cost_comm(spark, sf):
    """Costs of cells in a unit box with a ghost layer of 0.05."""
    return dc.cell_costs(owners(spark, sf), DIV8, UNIT, 0.05, ABC, 3).withColumn("computation", F.col("computation").cast("long"))


@query(f"WITH {OWNERS} SELECT o.proc_id, 8 * count(DISTINCT o.cell)::BIGINT AS cells, count(pid)::BIGINT AS particles, 1::BIGINT AS ghost_cells FROM o LEFT JOIN p ON {CELL} = o.cell GROUP BY o.proc_id")
def explicit_parameters(spark, sf):
    """16^3 cells by choice, dealt by a coarser distribution grid of 8^3; how many cells the ghost's width spans."""
    fine = dc.on_finer_cells(owners(spark, sf), DIV8, (16, 16, 16), ABC)
    rows = dc.owner_by_cells(particles(spark, sf), BOX, (16, 16, 16), fine).groupBy("proc_id").agg(F.count("*").alias("particles"))
    sizes = fine.groupBy("proc_id").agg(F.count("*").alias("cells")).join(rows, "proc_id", "left").withColumn("ghost_cells", F.lit(max(dc.ghost_cells(BOX, (16, 16, 16), R))))
    return longs(sizes.na.fill(0), "proc_id", "cells", "particles", "ghost_cells")


@query(
    f"WITH {OWNERS}, b AS (SELECT count(*) FILTER (n % 5 = 1) AS moved, count(*) FILTER (n % 7 = 0) AS bad FROM h) "
    "SELECT kind, n::BIGINT AS n FROM (SELECT 'missing' AS kind, moved AS n FROM b UNION ALL SELECT 'outside', moved FROM b UNION ALL SELECT 'unowned', bad FROM b) WHERE n > 0"
)
def check_consistency(spark, sf):
    """Cells whose number of particles is 1 above a multiple of 5 get a number out of range; those with a multiple of 7 an owner that doesn't exist."""
    o = owners(spark, sf)
    bad = o.select(F.when(F.col("cost") % 5 == 1, F.col("cell") + 512).otherwise(F.col("cell")).alias("cell"), F.when(F.col("cost") % 7 == 0, 6).otherwise(F.col("proc_id")).alias("proc_id"))
    return dc.inconsistencies(bad, 512, 6)


@query(f"WITH {OWNERS}, b AS (SELECT cell, CASE WHEN cell % 100 = 0 THEN proc_id + 1 ELSE proc_id END AS proc_id FROM o) SELECT * FROM (SELECT cell, proc_id, 'a' AS only FROM o WHERE cell % 100 = 0 UNION ALL SELECT cell, proc_id, 'b' FROM b WHERE cell % 100 = 0)")
def is_equal(spark, sf):
    """What two decompositions don't share."""
    a = owners(spark, sf).select("cell", "proc_id")
    return dc.differences(a, a.withColumn("proc_id", F.col("proc_id") + (F.col("cell") % 100 == 0).cast("long")))


# exports


@query(f"WITH {P} SELECT (q % 3)::BIGINT AS subset, count(*)::BIGINT AS n FROM p GROUP BY 1")
def subset_write(spark, sf):
    folder = shared(spark)
    files.write_subset(particles(spark, sf).withColumn("subset", F.col("q") % 3), folder)
    back = spark.read.option("header", True).csv(folder)
    return back.groupBy(F.col("SubsetNumber").cast("long").alias("subset")).agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT it::BIGINT AS iteration, it / 2 AS time, count(*)::BIGINT AS n, sum(x + it)::BIGINT AS x FROM p, range(3) t(it) GROUP BY it")
def frames_write(spark, sf):
    folder = shared(spark)
    for it in range(3):
        files.write_frame(particles(spark, sf).select("pid", (F.col("x") + it).alias("x")), folder, it, it / 2)
    return files.load(spark, folder).groupBy(F.col("iteration").cast("long").alias("iteration"), "time").agg(F.count("*").alias("n"), F.sum("x").alias("x"))


@query(f"{MERGED} SELECT count(*)::BIGINT AS boxes, 8 * count(*)::BIGINT AS corners FROM r0")
def decomposition_write(spark, sf):
    folder, boxes = shared(spark), files.written(dc.sub_domains(dc.merged_boxes(owners(spark, sf), ABC), BOX, DIV8))
    files.write_decomposition(boxes, dc.touching(boxes, 3, R, (L, L, L)), dc.ghost_boxes(boxes, 3, R, (L, L, L)), folder.removeprefix("file://"))
    head = spark.read.text(f"{folder}/subdomains/*.vtk")
    count = lambda word: F.sum(F.when(F.col("value").startswith(word), F.split("value", " ")[1].cast("long")))
    return head.agg(count("CELLS").alias("boxes"), count("POINTS").alias("corners"))


SUBS = f"{MERGED}, d AS (SELECT proc_id, la * 125 AS x0, (ha + 1) * 125 AS x1, lb * 125 AS y0, (hb + 1) * 125 AS y1, lc * 125 AS z0, (hc + 1) * 125 AS z1 FROM r0)"


@query(
    f"{SUBS} SELECT DISTINCT a.proc_id, b.proc_id AS near FROM d a, d b, {S3} u(sx), {S3} v(sy), {S3} w(sz) WHERE a.proc_id <> b.proc_id AND "
    + " AND ".join(f"a.{c}0 - 40 <= b.{c}1 + s{c} * 1000 AND b.{c}0 + s{c} * 1000 <= a.{c}1 + 40" for c in XYZ)
)
def near_processors(spark, sf):
    """Processors whose boxes of cells, as the particles' weights deal them, come within the ghost's width."""
    return longs(dc.touching(dc.sub_domains(dc.merged_boxes(owners(spark, sf), ABC), BOX, DIV8), 3, R, (L, L, L)), "proc_id", "near")


@query(f"{SUBS} SELECT proc_id, CASE WHEN x0 = 0 THEN -100 ELSE x0 END::DOUBLE AS lo0, CASE WHEN x1 = 1000 THEN 1200 ELSE x1 END::DOUBLE AS hi0, z0::DOUBLE + CASE WHEN z0 = 0 THEN -100 ELSE 0 END AS lo2 FROM d")
def extend_boxes(spark, sf):
    boxes = dc.sub_domains(dc.merged_boxes(owners(spark, sf), ABC), BOX, DIV8)
    wide = dc.extended(boxes, 3, (0,) * 3, (L,) * 3, (-100,) * 3, (1200,) * 3)
    return wide.select("proc_id", *[F.col(c).cast("double").alias(c) for c in ("lo0", "hi0", "lo2")])
