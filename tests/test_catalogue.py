"""Every query with SQL against DuckDB; the others against brute force or closed forms."""

import itertools
import json
import random
import time
from collections import Counter

import duckdb
import pytest
from driftmesh.functions.space import Space, axis_factors, good_divisions, with_hilbert
from driftmesh.operators import blocks
from driftmesh.operators import decomposition as dc
from driftmesh.operators import grid as gd
from driftmesh.operators import neighbors as nb
from driftmesh.operators import particles as pt
from driftmesh.plans import catalogue
from driftmesh.sources import files
from driftmesh.streaming import steps
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("orders", "customer", "events", "supplier", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, sf, con, name):
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, sf).select(*want.columns)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def brute(points, r, images, radius=None):
    out = Counter()
    for (p, a), (q, b) in itertools.product(points.items(), repeat=2):
        for s in images:
            if (p, s) != (q, (0,) * len(s)) or p != q:
                d2 = sum((x - y - t) ** 2 for x, y, t in zip(a, b, s, strict=True))
                if d2 < (radius[p] if radius else r) ** 2 and not (p == q and not any(s)):
                    out[p, q] += 1
    return out


@pytest.mark.parametrize(("dims", "r", "periodic"), [(2, 9, True), (3, 30, True), (2, 90, True), (3, 25, False), (1, 5, True)])
def test_neighbours_brute_force(spark, dims, r, periodic):
    rng = random.Random(r)
    pts = {i: tuple(rng.randrange(100) for _ in range(dims)) for i in range(120)}
    names = ("x", "y", "z")[:dims]
    space = Space(names, (0,) * dims, (100,) * dims, (periodic,) * dims)
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], ["pid", *names])
    images = list(itertools.product((-100, 0, 100) if periodic else (0,), repeat=dims))
    pairs = nb.neighbours(df, df, space, r)
    assert Counter((a, b) for a, b in pairs.select("pid", "qid").collect()) == brute(pts, r, images)
    radius = {i: 1 + i % r for i in pts}
    own = nb.neighbours(df.withColumn("r", 1 + F.col("pid") % r), df, space, r, radius=F.col("r"))
    assert Counter((a, b) for a, b in own.select("pid", "qid").collect()) == brute(pts, r, images, radius)


def test_wrap_is_half_open(spark):
    df = spark.createDataFrame([(1.0, 1.0), (-0.25, -0.25), (0.0, 0.0), (-1e-18, 0.5), (2.5, 0.5)], "x double, y double")
    space = Space(("x", "y"), (0.0, 0.0), (1.0, 1.0), (True, False))
    assert [tuple(r) for r in space.wrapped(df).collect()] == [(0.0, 1.0), (0.75, -0.25), (0.0, 0.0), (0.0, 0.5), (0.5, 0.5)]
    assert pt.map_rows(df, space, F.lit(0)).count() == 4
    with pytest.raises(Exception, match="out of bounds"):
        pt.map_rows(df, space, F.lit(0), "error").collect()


def test_hilbert_visits_neighbours(spark):
    for d, bits in ((2, 3), (3, 2)):
        names = ["a", "b", "c"][:d]
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=d)), names)
        rows = sorted(with_hilbert(cells, names, bits, "h").collect(), key=lambda r: r["h"])
        assert [r["h"] for r in rows] == list(range(1 << (d * bits)))
        assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in itertools.pairwise(rows))


def test_ghosts_lie_in_enlarged_boxes_only(spark, sf):
    g = catalogue.ghost_rows(spark, sf)
    p = catalogue.particles(spark, sf)
    assert g.distinct().count() == g.count()
    assert pt.ghosts(p, catalogue.BOX, (1, 1, 1), 10).where("s_x = 0 AND s_y = 0 AND s_z = 0").count() == 0


def test_laplacian_of_a_parabola(spark):
    g = gd.nodes(spark, (8, 8)).select("i", "j", (F.col("i") * F.col("i") + F.col("j") * F.col("j")).alias("v"))
    lap = gd.gather(g, ("i", "j"), None, [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)], {"v": ("v", [-4.0, 1.0, 1.0, 1.0, 1.0])})
    inner = lap.where("i BETWEEN 1 AND 6 AND j BETWEEN 1 AND 6").collect()
    assert len(inner) == 36 and {r["v"] for r in inner} == {4.0}


def test_mesh_weights_keep_mass(spark, sf):
    p = catalogue.particles(spark, sf)
    total = p.agg(F.sum("q")).first()[0] / 1e6
    for q in ("p2m_cic", "p2m_mp4"):
        assert catalogue.queries()[q](spark, sf).agg(F.sum("v")).first()[0] == pytest.approx(total, rel=1e-4)


def test_boxes_cover_cells_once(spark):
    rng = random.Random(1)
    owner = {(a, b): rng.randrange(2) for a in range(6) for b in range(5)}
    table = lambda o: spark.createDataFrame([(p, a, b) for (a, b), p in o.items()], "proc_id long, a long, b long")
    boxes = dc.merged_boxes(table(owner), ("a", "b")).collect()
    seen = Counter((a, b) for r in boxes for a in range(r["lo0"], r["hi0"] + 1) for b in range(r["lo1"], r["hi1"] + 1) if owner[a, b] == r["proc_id"])
    assert set(seen) == set(owner) and set(seen.values()) == {1} and len(boxes) < 30
    assert dc.merged_boxes(table({(a, b): 0 for a in range(4) for b in range(4)}), ("a", "b")).count() == 1


def test_symmetric_pairs_and_crowded_blocks(spark, monkeypatch):
    """Half of the cells give each unordered pair once; blocks that are cut give the same pairs."""
    rng = random.Random(5)
    for dims, r, periodic, crowd in ((3, 30, True, False), (2, 90, True, False), (2, 9, False, True), (1, 150, True, False)):
        pts = {i: tuple(rng.randrange(20 if crowd and i % 3 else 100) for _ in range(dims)) for i in range(150)}
        names = ("x", "y", "z")[:dims]
        space = Space(names, (0,) * dims, (100,) * dims, (periodic,) * dims)
        df = spark.createDataFrame([(i, *p) for i, p in pts.items()], ["pid", *names])
        images = list(itertools.product((-200, -100, 0, 100, 200) if periodic else (0,), repeat=dims))
        want = brute(pts, r, images)
        for rows in (20_000, 7):
            monkeypatch.setattr(blocks, "BLOCK_ROWS", rows)
            monkeypatch.setattr(blocks, "BUILD_ROWS", 3 * rows)
            assert Counter((a, b) for a, b in nb.neighbours(df, df, space, r).select("pid", "qid").collect()) == want
            assert Counter((a, b) for a, b in nb.symmetric(df, space, r).collect()) == Counter({k: n for k, n in want.items() if k[0] < k[1]})


def test_curve_owners_ghosts_are_the_box_owners_where_both_agree(spark, sf):
    """Through a table cell -> proc the processor grid has the same ghosts as by arithmetic."""
    p = catalogue.particles(spark, sf)
    cells = dc.all_cells(spark, (4, 4, 4), ("a", "b", "c"))
    owners = cells.select("cell", (F.floor(F.col("a") / 2) * 4 + F.floor(F.col("b") / 2) * 2 + F.floor(F.col("c") / 2)).alias("proc_id"))
    cols = ["pid", "x", "y", "z", "dst", "s_x", "s_y", "s_z"]
    by = dc.ghosts_by_cells(p, catalogue.BOX, (4, 4, 4), owners, 40).select(cols)
    assert Counter(map(tuple, by.collect())) == Counter(map(tuple, pt.ghosts(p, catalogue.BOX, (2, 2, 2), 40).select(cols).collect()))


def test_redistribute_over_slices(spark):
    from driftmesh.operators import graph as gr

    v = spark.range(500).select(F.col("id").alias("gid"), (F.col("id") % 3).alias("proc_id"))
    moves = v.where("gid % 7 = 0").select("gid", F.lit(1).cast("long").alias("target"))
    rows = sorted((r["proc_id"], r["gid"], r["rid"]) for r in gr.redistribute(v, moves, width=16).collect())
    assert [r[2] for r in rows] == list(range(500))


def test_random_set_is_uniform_and_stable(spark):
    a = pt.random_set(spark, 4000, catalogue.BOX, 1, 2)
    assert Counter(map(tuple, a.collect())) == Counter(map(tuple, pt.random_set(spark, 4000, catalogue.BOX, 1, 7).collect()))
    mean = a.agg(F.avg("x"), F.avg("y"), F.avg("z"), F.corr("x", "y")).first()
    assert all(abs(m - 500) < 25 for m in mean[:3]) and abs(mean[3]) < 0.06


def test_vtk_files_are_whole_and_named_once(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 0.5, None if i == 3 else i) for i in range(10)], "x double, y double, v int").repartition(3)
    files.write_vtk(df, str(tmp_path / "out"))
    parts = list((tmp_path / "out").glob("*.vtk"))
    assert 0 < len(parts) <= 3 and not list((tmp_path / "out" / "_temporary").iterdir())
    lines = [x for p in parts for x in p.read_text().split("\n")]
    assert sum(int(x.split()[1]) for x in lines if x.startswith("POINTS")) == 10 and lines.count("nan") == 1
    files.write_vtk(df.where("x < 0"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_config_helpers():
    assert axis_factors(12, 3) == (2, 2, 3) and axis_factors(1, 2) == (1, 1)
    assert good_divisions(8, 3) == (8, 8, 8)
    assert gd.default_staggering(1, 2) == [(-1, 0), (0, -1)] and len(gd.default_staggering(2, 3)) == 9
    with pytest.raises(ValueError):
        gd.default_staggering(3, 3)


def test_balancer():
    assert dc.Balancer(5).due(6) and not dc.Balancer(5).due(4)
    b = dc.Balancer(None, cost=10)
    assert [b.due(x) for x in (1, 1, 1, 20)] == [False, False, False, True]


def test_simulation_and_frames(spark, tmp_path):
    df = spark.range(5).select(F.col("id").alias("pid"), F.lit(0.0).alias("x"))
    out = steps.simulate(df, lambda d: d.withColumn("x", F.col("x") + F.col("pid")), 3, f"file://{tmp_path}/sim", 2)
    assert {(r["pid"], r["x"]) for r in out.collect()} == {(i, 3.0 * i) for i in range(5)}
    for it in (0, 1):
        files.write_frame(out, f"{tmp_path}/frames", it, it / 2)
    assert spark.read.parquet(f"{tmp_path}/frames").where("iteration = 1").count() == 5
    files.write_csv(out, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 5


def test_vtk(spark, sf):
    assert catalogue.vtk_write(spark, sf).first()[0] == catalogue.particles(spark, sf).count()


def test_streamed_cell_counts(spark, tmp_path):
    rows = [{"cell": i % 3, "ts": f"2024-01-01T00:0{i % 5}:00"} for i in range(30)] + [{"cell": 0, "ts": "2024-01-02T00:00:00"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = spark.readStream.schema("cell long, ts timestamp").json(str(tmp_path / "in"))
    q = steps.cell_counts(stream, "cell", "ts", "5 minutes", "1 minute").writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["cell"], r["n"]) for r in spark.table("counts").collect()} == {(0, 10), (1, 10), (2, 10)}
    assert time.time() > 0


def test_plans_have_no_distance_join(spark, sf):
    plan = catalogue.nn_count(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for name in ("nn_count", "force_sum", "nn_sym_pairs", "cell_candidates", "nn_two_phase"):
        plan = catalogue.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 1 and plan.count("Exchange hashpartitioning(__b") == 2 and plan.count("Exchange") <= 3
    p = spark.read.parquet(f"{sf}/orders.parquet")
    scan = catalogue.is_in_box(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderstatus" not in scan and len(p.columns) > 3
