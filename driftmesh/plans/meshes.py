"""Queries of grids, refinement levels and graphs beyond the stencils of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.space import Space
from ..operators import graph as gr
from ..operators import grid as gd
from ..operators import particles as pt
from ..sources import files
from .catalogue import AMR, AXES, GRAPH, GRID, LAP, MOVED, N, P, amr, graph, grid, grid_sql, longs, moved, node_of, particles, query, shared

S3 = "(VALUES (-1), (0), (1))"
PERIODIC = (True, True, True)


# grids


@query(f"WITH {P}, {grid_sql(10)} SELECT a - 2 AS i, b - 1 AS j, c AS k, coalesce(v, -1) AS v FROM range(15) t(a) CROSS JOIN range(12) u(b) CROSS JOIN range(13) w(c) LEFT JOIN g ON i = a - 2 AND j = b - 1 AND k = c")
def grid_extend(spark, sf):
    """A grid of 10^3 nodes, extended below and above; new nodes have the background."""
    wide = gd.extended(spark, (10, 10, 10), (2, 1, 0), (3, 1, 3))
    return longs(gd.with_background(wide, grid(spark, sf, 10), AXES, {"v": -1}), *AXES, "v")


@query(f"WITH {GRID} SELECT i, j, k, CASE WHEN (i + j + k) % 5 = 0 THEN i * 100 + k ELSE v END AS v FROM g")
def grid_set_points(spark, sf):
    at = sum((F.col(a) for a in AXES[1:]), F.col("i"))
    return longs(gd.set_points(grid(spark, sf), at % 5 == 0, {"v": F.col("i") * 100 + F.col("k")}), *AXES, "v")


@query(f"WITH {GRID} SELECT i, j, k, CASE WHEN (i + j) % 4 = 1 THEN 1000 + k ELSE v END AS v FROM g WHERE v < 30 OR (i + j) % 4 = 1")
def grid_add_points(spark, sf):
    g = grid(spark, sf)
    return longs(gd.add_points(g.where("v < 30"), g.select(*AXES), (F.col("i") + F.col("j")) % 4 == 1, {"v": 1000 + F.col("k")}, AXES), *AXES, "v")


NEAR7 = ", ".join(f"({a}, {b}, {c})" for a, b, c in LAP)


@query(
    f"WITH {GRID}, o(di, dj, dk) AS (VALUES {NEAR7}), t AS (SELECT g.*, (i + di + 24) % 24 AS ni, (j + dj + 24) % 24 AS nj, (k + dk + 24) % 24 AS nk FROM g, o WHERE i BETWEEN 3 AND 20 AND j BETWEEN 0 AND 9 AND k BETWEEN 5 AND 23) "
    "SELECT t.i, t.j, t.k, max(n.v) * 2 - min(n.v) AS v, max(t.v * n.v) AS w FROM t JOIN g n ON n.i = ni AND n.j = nj AND n.k = nk GROUP BY ALL"
)
def grid_conv_lambda(spark, sf):
    """A stencil of any function on a part of the grid."""

    def fn(v):
        return {"v": F.greatest(*v) * 2 - F.least(*v), "w": F.greatest(*[v[0] * x for x in v])}

    return longs(gd.conv(grid(spark, sf), AXES, (N,) * 3, LAP, ("v",), fn, (3, 0, 5), (20, 9, 23)), *AXES, "v", "w")


@query(f"WITH {GRID}, sp AS (SELECT * FROM g WHERE v < 60), o(di, dj, dk) AS (VALUES {NEAR7}), t AS (SELECT sp.*, (i + di + 24) % 24 AS ni, (j + dj + 24) % 24 AS nj, (k + dk + 24) % 24 AS nk FROM sp, o) SELECT t.i, t.j, t.k, greatest(max(coalesce(n.v, 55)), 0)::BIGINT AS v FROM t LEFT JOIN sp n ON n.i = ni AND n.j = nj AND n.k = nk GROUP BY ALL")
def sparse_conv_lambda(spark, sf):
    return longs(gd.conv(grid(spark, sf).where("v < 60"), AXES, (N,) * 3, LAP, ("v",), lambda v: {"v": F.greatest(*v)}, background={"v": 55}), *AXES, "v")


HALO = f"""h AS (SELECT g.i + si * 24 AS i, g.j + sj * 24 AS j, g.k + sk * 24 AS k, v, oi * 4 + oj * 2 + ok AS dst, (g.i // 12) * 4 + (g.j // 12) * 2 + g.k // 12 AS src, si, sj, sk
FROM g, {S3} a(si), {S3} b(sj), {S3} c(sk), (VALUES (0), (1)) d(oi), (VALUES (0), (1)) e(oj), (VALUES (0), (1)) f(ok)
WHERE {" AND ".join(f"g.{a} + s{a} * 24 >= o{a} * 12 - 2 AND g.{a} + s{a} * 24 < o{a} * 12 + 14" for a in AXES)})"""


@query(f"WITH {GRID}, {HALO} SELECT i, j, k, v, src::BIGINT AS proc_id, dst::BIGINT AS dst FROM h WHERE NOT (si = 0 AND sj = 0 AND sk = 0 AND src = dst)")
def grid_ghost_get(spark, sf):
    return longs(gd.halo(grid(spark, sf), AXES, (N,) * 3, (2, 2, 2), 2, PERIODIC), *AXES, "v", "proc_id", "dst")


LOCAL = "SELECT r AS proc_id, r // 6 * 12 AS lo0, r // 6 * 12 + 11 AS hi0, r // 3 % 2 * 5 AS lo1, r // 3 % 2 * 5 + 4 AS hi1, CASE r % 3 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 5 END AS lo2, CASE r % 3 WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 6 END AS hi2, 60 * CASE r % 3 WHEN 0 THEN 3 ELSE 2 END AS n FROM range(12) t(r)"
BIN3 = "x * 24 // 1000 BETWEEN lo0 AND hi0 AND y * 10 // 1000 BETWEEN lo1 AND hi1 AND z * 7 // 1000 BETWEEN lo2 AND hi2"


@query(f"WITH {P}, b AS ({LOCAL}) SELECT b.*, count(pid)::BIGINT AS particles FROM b LEFT JOIN p ON {BIN3} GROUP BY ALL")
def grid_local_boxes(spark, sf):
    """A grid of 24 x 10 x 7 nodes on 2 x 2 x 3 processors: their boxes, and how many particles are in each."""
    sizes, div = (24, 10, 7), (2, 2, 3)
    at = [node_of(n)[i] for i, n in enumerate(sizes)]
    held = particles(spark, sf).select(*at).groupBy(pt.box_owner(Space(AXES, (0,) * 3, sizes, PERIODIC), div).alias("proc_id")).agg(F.count("*").alias("particles"))
    boxes = gd.local_boxes(spark, sizes, div, 1).join(held, "proc_id", "left").withColumn("particles", F.coalesce("particles", F.lit(0)))
    return longs(boxes, "proc_id", *[f"{e}{i}" for i in range(3) for e in ("lo", "hi")], "n", "particles")


@query(f"WITH {GRID} SELECT a - 2 AS i, b AS j, c AS k, coalesce(v, -7) AS v, (i // 12) AS src, CASE WHEN b < 10 THEN 0 ELSE 1 END::BIGINT AS proc_id FROM range(20) t(a), range(26) u(b), range(24) w(c) LEFT JOIN g ON i = a - 2 AND j = b AND k = c")
def grid_map(spark, sf):
    """The grid's box moves and other axes are cut: the intersection keeps its values."""
    new = (F.col("j") >= 10).cast("long")
    return longs(gd.remap(grid(spark, sf), AXES, (-2, 0, 0), (17, 25, 23), F.floor(F.col("i") / 12), new, {"v": -7}), *AXES, "v", "src", "proc_id")


@query(f"WITH {GRID} SELECT count(*)::BIGINT AS points, max(k * 2 - 6)::BIGINT AS highest, sum(v)::BIGINT AS total FROM g")
def grid_write(spark, sf):
    folder = shared(spark)
    files.write_grid(grid(spark, sf), folder.removeprefix("file://"), AXES, (0.5, 0.25, 2.0), (1.0, 0.0, -6.0))
    text = spark.read.text(f"{folder}/*.vtk")
    z, points = F.split("value", " ")[2].cast("double"), F.when(F.col("value").startswith("POINTS"), F.split("value", " ")[1].cast("long"))
    at, value = F.col("value").rlike("^[-0-9.]+ [-0-9.]+ [-0-9.]+$"), F.when(F.col("value").rlike("^[0-9]+[.]0$"), F.col("value").cast("double"))
    return text.agg(F.sum(points).alias("points"), F.max(F.when(at, z)).cast("long").alias("highest"), F.sum(value).cast("long").alias("total"))


@query(f"""WITH {GRID}, c(prop, axis) AS (VALUES ('scalar', -1), ('vector0', 0), ('vector1', 1), ('vector2', 2))
SELECT prop, axis >= 0 AS staggered, count(*)::BIGINT AS n, sum(i + CASE WHEN axis = 0 THEN 0 ELSE 0.5::DOUBLE END)::DOUBLE AS x, sum(v)::BIGINT AS total FROM g, c GROUP BY prop, axis""")
def staggered_props(spark, sf):
    """Where a scalar's and a vector's components of a field live, and which of them are off the cells' centres."""
    d = len(AXES)
    places = {"scalar": gd.default_staggering(0, d)} | {f"vector{c}": [o] for c, o in enumerate(gd.default_staggering(1, d))}
    off = gd.is_staggered(places)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("prop"), F.lit(off[p]).alias("staggered"), *[F.lit(0.5 + o[0][i] / 2).alias(f"d{a}") for i, a in enumerate(AXES)]) for p, o in places.items()]))
    f = grid(spark, sf).select(*AXES, "v", rows.alias("o"))
    return f.groupBy("o.prop", "o.staggered").agg(F.count("*").alias("n"), F.sum(F.col("i") + F.col("o.di")).alias("x"), F.sum("v").alias("total"))


@query(f"WITH {GRID} SELECT 'a' AS component, count(*)::BIGINT AS n, sum(v)::DOUBLE AS total, sum(i + j + k)::DOUBLE + 13824 AS place FROM g UNION ALL SELECT 'b', count(*), sum(v * 2)::DOUBLE, sum(i + j + k)::DOUBLE + 13824 FROM g")
def staggered_write(spark, sf):
    folder = shared(spark)
    f = grid(spark, sf).select(*AXES, F.col("v").alias("a"), (F.col("v") * 2).alias("b"))
    files.write_staggered(f, folder, AXES, {"a": [(-1, 0, 0)], "b": [(0, -1, 0)]})
    return files.load(spark, folder).groupBy("component").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("place"))


# refinement levels


@query(f"""WITH {P}, z(lvl, nx, ny, nz) AS (VALUES (0::BIGINT, 4::BIGINT, 5::BIGINT, 3::BIGINT), (1, 8, 9, 5), (2, 16, 17, 9)),
held AS (SELECT lvl, count(DISTINCT (x * nx // 1000, y * ny // 1000, z.nz * p.z // 1000)) AS held FROM p, z GROUP BY lvl)
SELECT lvl, nx * ny * nz AS n, nx - 1 AS last, held::BIGINT AS held FROM z JOIN held USING (lvl)""")
def amr_construct(spark, sf):
    """Three levels of a grid that is periodic along its first axis, and how many nodes of each hold particles."""
    periodic = (True, False, False)
    a, sizes = gd.amr_nodes(spark, (4, 5, 3), 3, periodic), gd.level_sizes((4, 5, 3), 3, periodic)
    at = F.explode(F.array(*[F.struct(F.lit(lv).cast("long").alias("lvl"), *[node_of(n)[i] for i, n in enumerate(size)]) for lv, size in enumerate(sizes)]))
    held = particles(spark, sf).select(at.alias("o")).select("o.*").distinct().withColumn("held", F.lit(1))
    full = gd.with_background(a, held, ("lvl", *AXES), {"held": 0})
    return longs(full.groupBy("lvl").agg(F.count("*").alias("n"), F.max("i").alias("last"), F.sum("held").alias("held")), "lvl", "n", "last", "held")


@query(f"WITH {AMR}, n AS (SELECT lvl, i, j, k, v + 500 AS v FROM a WHERE v % 10 = 3 UNION ALL SELECT 2, 24 + r, 0, 0, r FROM range(5) t(r)), m AS (SELECT a.lvl, a.i, a.j, a.k, coalesce(n.v, a.v) AS v FROM a LEFT JOIN n ON n.lvl = a.lvl AND n.i = a.i AND n.j = a.j AND n.k = a.k UNION ALL SELECT * FROM n WHERE i >= 24) SELECT lvl::BIGINT AS lvl, i, j, k, v FROM m WHERE NOT (lvl = 1 AND i < 3)")
def amr_insert_remove(spark, sf):
    """Nodes that are there get new values, others come, a box of one level goes."""
    a = amr(spark, sf)
    key = ("lvl", *AXES)
    more = spark.range(5).select(F.lit(2).cast("long").alias("lvl"), (24 + F.col("id")).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("k"), F.col("id").alias("v"))
    new = a.where("v % 10 = 3").withColumn("v", F.col("v") + 500).unionByName(more)
    return longs(gd.upsert(a, new, key).where(~((F.col("lvl") == 1) & (F.col("i") < 3))), *key, "v")


@query(f"WITH {AMR}, s AS (SELECT r // 64 AS lvl, r % 4 * 2 AS i, r // 4 % 4 AS j, r // 16 % 4 AS k FROM range(192) t(r)) SELECT s.lvl, s.i, s.j, s.k, a.v IS NOT NULL AS exists, coalesce(a.v, -9) AS v FROM s LEFT JOIN a ON a.lvl = s.lvl AND a.i = s.i AND a.j = s.j AND a.k = s.k")
def amr_exists(spark, sf):
    """Whether nodes are there, and their values or the background."""
    r = F.col("id")
    ask = spark.range(192).select(F.floor(r / 64).alias("lvl"), (r % 4 * 2).alias("i"), (F.floor(r / 4) % 4).alias("j"), (F.floor(r / 16) % 4).alias("k"))
    found = gd.with_background(ask, amr(spark, sf).withColumn("exists", F.lit(True)), ("lvl", *AXES), {"exists": False, "v": -9})
    return found.select("lvl", *AXES, "exists", "v")


@query(f"WITH {AMR} SELECT lvl::BIGINT AS lvl, (i * 2 // (6 << lvl)) * 4 + (j * 2 // (6 << lvl)) * 2 + k * 2 // (6 << lvl) AS proc_id, count(*)::BIGINT AS n FROM a GROUP BY ALL")
def amr_map(spark, sf):
    """Owners of the nodes of all levels."""
    sizes = gd.level_sizes((6, 6, 6), 3, PERIODIC)
    return longs(amr(spark, sf).withColumn("proc_id", gd.amr_owner(AXES, sizes, (2, 2, 2))).groupBy("lvl", "proc_id").agg(F.count("*").alias("n")), "lvl", "proc_id", "n")


@query(
    f"WITH {AMR}, h AS (SELECT lvl, i, j, k, (6 << lvl) AS n, (3 << lvl) AS m, oi * 4 + oj * 2 + ok AS dst, (i // (3 << lvl)) * 4 + (j // (3 << lvl)) * 2 + k // (3 << lvl) AS src, si, sj, sk "
    f"FROM a, {S3} x(si), {S3} y(sj), {S3} z(sk), (VALUES (0), (1)) d(oi), (VALUES (0), (1)) e(oj), (VALUES (0), (1)) f(ok) "
    f"WHERE {' AND '.join(f'{a} + s{a} * (6 << lvl) >= o{a} * (3 << lvl) - 1 AND {a} + s{a} * (6 << lvl) < o{a} * (3 << lvl) + (3 << lvl) + 1' for a in AXES)}) "
    "SELECT lvl::BIGINT AS lvl, dst::BIGINT AS dst, count(*)::BIGINT AS n FROM h WHERE NOT (si = 0 AND sj = 0 AND sk = 0 AND src = dst) GROUP BY ALL"
)
def amr_ghost_get(spark, sf):
    sizes = gd.level_sizes((6, 6, 6), 3, PERIODIC)
    return longs(gd.amr_halo(amr(spark, sf), AXES, sizes, (2, 2, 2), 1, PERIODIC).groupBy("lvl", "dst").agg(F.count("*").alias("n")), "lvl", "dst", "n")


@query(f"WITH {AMR} SELECT p.lvl::BIGINT AS lvl, p.i, p.j, p.k, c.i AS ci, c.j AS cj, c.k AS ck FROM a p JOIN a c ON c.lvl = p.lvl + 1 AND c.i // 2 = p.i AND c.j // 2 = p.j AND c.k // 2 = p.k")
def amr_links(spark, sf):
    return longs(gd.amr_links(amr(spark, sf), AXES), "lvl", *AXES, "ci", "cj", "ck")


@query(f"WITH {AMR} SELECT lvl::BIGINT AS lvl, count(*)::BIGINT AS n, sum(v)::BIGINT AS total FROM a GROUP BY lvl")
def amr_write(spark, sf):
    folder = shared(spark)
    files.write_levels(amr(spark, sf), folder)
    return longs(files.load(spark, folder).groupBy("lvl").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "lvl", "n", "total")


# graphs


@query(f"WITH {GRAPH}, u AS (SELECT a.gid AS src, b.gid AS dst, (a.i <> b.i)::INT * 0.5 + (a.j <> b.j)::INT * 0.25 AS w FROM (SELECT v.*, d FROM v, (VALUES (-1), (0), (1)) t(d)) a JOIN v b ON b.j = a.j + d AND abs(a.i - b.i) <= 1 AND a.gid <> b.gid) SELECT src, dst, w::DOUBLE AS weight FROM u")
def graph_weights(spark, sf):
    """A grid's graph with diagonals; an edge weighs the cell sizes that it spans."""
    v, e = graph(spark, sf, spans=2)
    return gr.with_weights(e, v, AXES[:2], (0.5, 0.25))


@query(f"WITH {GRAPH} SELECT gid, proc_id FROM v UNION ALL SELECT DISTINCT s_suppkey * 31, 3 FROM supplier WHERE s_suppkey * 31 NOT IN (SELECT gid FROM v)")
def graph_add_vertex(spark, sf):
    """Suppliers come in; those whose id a customer has are there already."""
    v = graph(spark, sf)[0]
    new = spark.read.parquet(f"{sf}/supplier.parquet").select((F.col("s_suppkey") * 31).alias("gid"), F.lit(3).cast("long").alias("proc_id"))
    return longs(gr.add_vertices(v, new), "gid", "proc_id")


@query(f"WITH {MOVED} SELECT proc_id::BIGINT AS proc_id, (sum(count(*)) OVER (ORDER BY proc_id) - count(*))::BIGINT AS start, count(*)::BIGINT AS n FROM m GROUP BY proc_id")
def graph_distribution(spark, sf):
    return longs(gr.distribution(moved(spark, sf)[0]), "proc_id", "start", "n")


@query(f"WITH {GRAPH} SELECT (SELECT count(*) FROM v)::BIGINT AS points, (SELECT count(*) FROM e)::BIGINT AS lines")
def graph_write(spark, sf):
    folder = shared(spark)
    files.write_graph(*graph(spark, sf), folder.removeprefix("file://"), AXES[:2])
    count = lambda part, word: spark.read.text(f"{folder}/{part}/*.vtk").where(F.col("value").startswith(word)).agg(F.sum(F.split("value", " ")[1].cast("long")).alias(part))
    return count("vertices", "POINTS").withColumnRenamed("vertices", "points").crossJoin(count("edges", "LINES").withColumnRenamed("edges", "lines"))  # one row each
