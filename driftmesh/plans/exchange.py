"""Queries of tiles, grown boxes, kept labels, checkpoints for other processors, asked-for vertices and half pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.space import Space
from ..operators import decomposition as dc
from ..operators import graph as gr
from ..operators import neighbors as nb
from ..operators import particles as pt
from ..operators import tiles as tl
from ..sources import files
from ..streaming import steps
from .catalogue import AXES, BOX, DIV, GHOSTS, GRID, L, LAP, LAP_W, OWNERS, P, R, XYZ, grid, longs, near_sql, owners, pairs_sql, particles, query, shared
from .partitions import trade

ABC = ("a", "b", "c")


@query(f"WITH {GRID}, {near_sql(list(zip(LAP, LAP_W, strict=True)), 'sum(w * n.v)::BIGINT AS v')} SELECT * FROM s")
def tiles_conv_cross(spark, sf):
    """The stencil of ``grid_conv_cross`` on tiles of 8^3 nodes."""
    tiles = tl.to_tiles(grid(spark, sf), AXES, "v")
    return longs(tl.from_tiles(tl.cross(tiles, dict(zip(LAP, LAP_W, strict=True)), (3, 3, 3)), AXES, "v"), *AXES, "v")


@query(
    f"WITH {P}, g AS (SELECT x // 10 AS i, y // 10 AS j, z // 10 AS k, max(q % 1000) AS v FROM p GROUP BY ALL), o(di, dj, dk, w) AS (VALUES {', '.join(f'({a}, {b}, {c}, {w})' for (a, b, c), w in zip(LAP, LAP_W, strict=True))}) "
    "SELECT g.i, g.j, g.k, sum(w * coalesce(n.v, 7))::BIGINT AS v FROM g CROSS JOIN o LEFT JOIN g n ON n.i = g.i + di AND n.j = g.j + dj AND n.k = g.k + dk GROUP BY ALL"
)
def tiles_sparse_conv(spark, sf):
    """A sparse open grid of 100^3 places, of which those with particles are there; others count as 7."""
    at = [F.floor(F.col(c) / 10).cast("long").alias(a) for a, c in zip(AXES, XYZ, strict=True)]
    g = particles(spark, sf).groupBy(*at).agg(F.max(F.col("q") % 1000).alias("v"))
    out = tl.cross(tl.to_tiles(g, AXES, "v"), dict(zip(LAP, LAP_W, strict=True)), None, 7.0)
    return longs(tl.from_tiles(out, AXES, "v"), *AXES, "v")


@query(f"WITH {OWNERS} SELECT proc_id, count(*)::BIGINT AS cells, true AS once FROM o GROUP BY proc_id")
def box_grow(spark, sf):
    """Boxes grown by a wave front: how many cells of its own each processor's boxes hold, and whether they hold each once."""
    own = files.written(owners(spark, sf))
    spread = dc.grown_boxes(own, ABC)
    for i, n in enumerate(ABC):
        spread = spread.withColumn(n, F.explode(F.sequence(f"lo{i}", f"hi{i}")))
    held = spread.groupBy("proc_id", *ABC).agg(F.count("*").alias("n"))
    both = own.select("proc_id", *ABC).join(held, ["proc_id", *ABC], "full")
    return both.groupBy("proc_id").agg(F.count("*").alias("cells"), F.bool_and(F.coalesce(F.col("n"), F.lit(0)) == 1).alias("once"))


@query(f"WITH {GHOSTS} SELECT g.dst::BIGINT AS dst, count(*)::BIGINT AS n, sum(p.x + g.sx * 1000)::BIGINT AS x, sum(g.q * 2 + 1)::BIGINT AS v FROM g JOIN p USING (pid) GROUP BY g.dst")
def ghost_by_labels(spark, sf):
    """Values that changed since the labelling go to the same ghosts by the kept table of labels."""
    p, name = particles(spark, sf), "labels_" + shared(spark)[-12:]
    pt.keep_labels(pt.ghosts(p, BOX, DIV, R), BOX, name, shared(spark), 8)
    again = pt.ghosts_by_labels(p.withColumn("v", F.col("q") * 2 + 1), BOX, name)
    return longs(again.groupBy("dst").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("v").alias("v")), "dst", "n", "x", "v")


@query(f"""WITH {P}, w AS (SELECT x // 500 * 4 + y // 500 * 2 + z // 500 AS proc_id, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1),
n AS (SELECT x * 6 // 1000 AS proc_id, count(*)::BIGINT AS n, sum(q)::BIGINT AS q FROM p GROUP BY 1)
SELECT n.proc_id, n, q, count(*)::BIGINT AS files FROM n JOIN w ON w.hi >= n.proc_id * 1000.0::DOUBLE / 6 AND w.lo < (n.proc_id + 1) * 1000.0::DOUBLE / 6 GROUP BY ALL""")
def checkpoint_remap(spark, sf):
    """8 processors write, 6 read, each the folders that meet its own box: rows, values and how many folders it reads."""
    folder = shared(spark)
    files.save_by_owner(particles(spark, sf).withColumn("proc_id", pt.box_owner(BOX, DIV)), folder, XYZ)
    slab = F.col("id") * float(L)
    boxes = spark.range(6).select(F.col("id").alias("to"), (slab / 6).alias("lo0"), ((slab + L) / 6).alias("hi0"), *[F.lit(float(x)).alias(f"{e}{i}") for i in (1, 2) for e, x in (("lo", 0), ("hi", L))])
    read = files.files_for(spark, folder, boxes).groupBy(F.col("to").alias("proc_id")).agg(F.count("*").alias("files"))
    out = None
    for k in range(6):
        part = files.load_part(spark, folder, (k * L / 6, 0.0, 0.0), ((k + 1) * L / 6, float(L), float(L)), XYZ).withColumn("proc_id", F.lit(k).cast("long"))
        out = part if out is None else out.unionByName(part)
    return longs(out.groupBy("proc_id").agg(F.count("*").alias("n"), F.sum("q").alias("q")).join(read, "proc_id"), "proc_id", "n", "q", "files")


@query(
    f"""WITH {GHOSTS}, u AS (SELECT (x // 500) * 4 + (y // 500) * 2 + z // 500 AS proc_id, CASE WHEN {" OR ".join(f"{c} % 500 < 40 OR {c} % 500 >= 460" for c in XYZ)} THEN 'HALO' ELSE 'INSIDE' END AS row_class FROM p UNION ALL SELECT dst, 'GHOST' FROM g)
SELECT proc_id::BIGINT AS proc_id, row_class, count(*)::BIGINT AS n FROM u GROUP BY ALL"""
)
def row_class_ghosts(spark, sf):
    """Classes of the rows that a processor holds, its own and ghosts."""
    p = particles(spark, sf).withColumn("proc_id", pt.box_owner(BOX, DIV))
    held = pt.row_class(pt.with_ghosts(p, pt.ghosts(p.drop("proc_id"), BOX, DIV, R)), BOX, DIV, R)
    return held.groupBy("proc_id", "row_class").agg(F.count("*").alias("n"))


FOUR = Space(("x", "y", "z", "t"), (0,) * 4, (L,) * 4, (True, True, False, True))


@query(
    f"WITH {P}, f AS (SELECT *, q // 1000 % 1000 AS t FROM p), g AS (SELECT sx, sy, 0 AS sz, st, ox * 4 + oy * 2 + ot AS dst FROM f, (VALUES (-1), (0), (1)) a(sx), (VALUES (-1), (0), (1)) b(sy), (VALUES (-1), (0), (1)) d(st), (VALUES (0), (1)) e(ox), (VALUES (0), (1)) h(oy), (VALUES (0), (1)) k(ot) "
    f"WHERE {' AND '.join(f'{c} + s{c} * 1000 >= o{c} * 500 - 40 AND {c} + s{c} * 1000 < o{c} * 500 + 540' for c in 'xyt')} AND NOT (sx = 0 AND sy = 0 AND st = 0 AND (x // 500) * 4 + (y // 500) * 2 + t // 500 = ox * 4 + oy * 2 + ot)) "
    "SELECT sx::BIGINT AS s_x, sy::BIGINT AS s_y, sz::BIGINT AS s_z, st::BIGINT AS s_t, count(*)::BIGINT AS n FROM g GROUP BY ALL"
)
def ghost_shifts(spark, sf):
    """Ghosts in four dimensions, one of them open and uncut, by the shift of their image."""
    f = particles(spark, sf).withColumn("t", F.floor(F.col("q") / 1000) % 1000)
    g = pt.ghosts(f, FOUR, (2, 2, 1, 2), R).groupBy("s_x", "s_y", "s_z", "s_t").agg(F.count("*").alias("n"))
    return longs(g, "s_x", "s_y", "s_z", "s_t", "n")


TEN = tuple(f"x{i}" for i in range(10))
WIDE = Space(TEN, (0,) * 10, (L,) * 10, (True,) * 10)
SPOT = ", ".join(f"(c_nationkey * {97 * (i + 1)} + CAST(round(c_acctbal * 100) + 1000000 AS BIGINT) // {7 ** i} % 40) % 1000 AS x{i}" for i in range(10))


@query(f"WITH c AS (SELECT c_custkey AS pid, {SPOT} FROM customer) SELECT a.pid, count(*)::BIGINT AS n FROM c a JOIN c b ON a.pid <> b.pid AND " + " + ".join(f"least(abs(a.x{i} - b.x{i}), 1000 - abs(a.x{i} - b.x{i})) ** 2" for i in range(10)) + " < 2500 GROUP BY a.pid")
def nn_ten_axes(spark, sf):
    """Neighbours in a periodic box of ten dimensions."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long") + 1000000
    spot = [((F.col("c_nationkey") * (97 * (i + 1)) + F.floor(cents / 7**i) % 40) % L).cast("long").alias(x) for i, x in enumerate(TEN)]
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("pid"), *spot)
    return longs(nb.counted(rows, rows, WIDE, 50), "pid", "n")


@query(f"WITH {P} SELECT count(*)::BIGINT AS points, sum(pid)::BIGINT AS pid, sum(x + y + z)::DOUBLE AS place, sum(q)::BIGINT AS q FROM p")
def vtp_write(spark, sf):
    """Particles as binary VTP pieces with an index, read back through it."""
    folder = shared(spark)
    files.write_vtp(particles(spark, sf), folder.removeprefix("file://"))
    back = files.read_vtp(spark, folder.removeprefix("file://"))
    return back.agg(F.count("*").alias("points"), F.sum("pid").cast("long").alias("pid"), F.sum(F.col("x") + F.col("y") + F.col("z")).alias("place"), F.sum("q").cast("long").alias("q"))


@query(f"WITH {P} SELECT it::BIGINT AS step, count(*)::BIGINT AS n, true AS balanced FROM p, range(1, 5) t(it) GROUP BY it")
def balanced_run(spark, sf):
    """Particles gather in a corner step by step; cells go to other processors whenever the loads are more than 20 % apart."""
    pull = lambda c: F.floor(F.col(c) * 4 / 5).cast("long")
    step = lambda df: df.withColumns({c: F.when(F.col("pid") % 2 == 0, pull(c)).otherwise(F.col(c)) for c in XYZ})
    start = particles(spark, sf).select("pid", *XYZ)
    _, log = steps.simulate_balanced(start, step, 4, shared(spark), BOX, (16, 16, 16), 8, dc.Balancer(20.0))
    return log.select("step", "n", (F.col("spread") <= F.greatest(F.lit(20.0), F.col("spread_before"))).alias("balanced"))


REQUEST = """o AS (SELECT o_orderkey * 2 AS o, o_custkey * 2 + 1 AS c, o_totalprice AS price FROM orders),
v AS (SELECT o AS gid, o // 2 % 5 AS proc_id, round(price * 100)::BIGINT AS data FROM o UNION ALL SELECT c_custkey * 2 + 1, c_custkey % 5, round(c_acctbal * 100)::BIGINT FROM customer),
f AS (SELECT o AS src, lead(o) OVER (PARTITION BY c ORDER BY o) AS dst FROM o),
e AS (SELECT o AS src, c AS dst FROM o UNION ALL SELECT * FROM f WHERE dst IS NOT NULL),
b AS (SELECT DISTINCT s.proc_id, e.dst AS gid FROM e JOIN v s ON s.gid = e.src JOIN v d ON d.gid = e.dst WHERE s.proc_id <> d.proc_id),
n AS (SELECT DISTINCT b.proc_id, e.dst AS gid FROM b JOIN e ON e.src = b.gid)"""


@query(f"WITH {REQUEST}, u AS (SELECT 1 AS hop, * FROM b UNION ALL SELECT 2, * FROM n) SELECT u.hop::BIGINT AS hop, u.proc_id, v.proc_id AS home, u.proc_id <> v.proc_id AS is_ghost, count(*)::BIGINT AS n, sum(data)::BIGINT AS data FROM u JOIN v USING (gid) GROUP BY ALL".replace("JOIN v USING (gid)", "JOIN v ON v.gid = u.gid"))
def graph_request(spark, sf):
    """Orders and customers: each processor asks for the far ends of its edges, then for the far ends of these vertices' edges."""
    v, e = trade(spark, sf)
    o = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_orderkey") * 2).alias("gid"), F.round(F.col("o_totalprice") * 100).cast("long").alias("data"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select((F.col("c_custkey") * 2 + 1).alias("gid"), F.round(F.col("c_acctbal") * 100).cast("long").alias("data"))
    v = o.unionByName(c).withColumn("proc_id", (F.floor(F.col("gid") / 2) % 5).cast("long"))
    near, edges = gr.requested(gr.border(e, v), v, e)
    far, _ = gr.requested(edges.select("proc_id", F.col("dst").alias("gid")), v, e)
    both = near.withColumn("hop", F.lit(1)).unionByName(far.withColumn("hop", F.lit(2)))
    out = both.groupBy("hop", "proc_id", "home", "is_ghost").agg(F.count("*").alias("n"), F.sum("data").alias("data"))
    return out.select(F.col("hop").cast("long").alias("hop"), "proc_id", "home", "is_ghost", "n", "data")


@query(f"WITH {P}, {pairs_sql()} SELECT pid, {', '.join(f'round(sum(({c} - q{c}) / d2), 6) + 0.0 AS f_{c}' for c in XYZ)} FROM pairs WHERE d2 > 0 GROUP BY pid")
def force_half(spark, sf):
    """The forces of ``force_sum`` from half of the pairs."""
    f = nb.symmetric_force(particles(spark, sf).select("pid", *XYZ), BOX, R)
    return f.select("pid", *[(F.round(f"f_{c}", 6) + 0.0).alias(f"f_{c}") for c in XYZ])
