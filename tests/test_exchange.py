"""Tiles, grown boxes, kept labels, checkpoints for other processors, asked-for vertices and half pairs, against brute force."""

import itertools
import random
from collections import Counter

import pytest
from driftmesh.functions.space import Space, cross_offsets
from driftmesh.operators import decomposition as dc
from driftmesh.operators import graph as gr
from driftmesh.operators import grid as gd
from driftmesh.operators import neighbors as nb
from driftmesh.operators import particles as pt
from driftmesh.operators import tiles as tl
from driftmesh.sources import files
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
OFFS = [tuple(o) for o in cross_offsets(3)]
WEIGHTS = dict(zip(OFFS, [-6.5, 1.0, 2.0, 0.5, 1.5, 3.0, 0.25], strict=True))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("counts", "share", "background"), [((2, 3, 2), 1.0, 0.0), ((2, 3, 2), 0.1, 4.0), (None, 0.3, -2.0), (None, 0.01, 1.0)])
def test_tiles_like_rows(spark, counts, share, background):
    """The same values as the row-wise stencil: dense and sparse, periodic and open, also at negative indexes."""
    rng = random.Random(5)
    sizes = tuple(c * tl.SIDE for c in counts) if counts else (20, 20, 20)
    low = 0 if counts else -9
    rows = [(i + low, j, k, float(rng.randrange(100))) for i, j, k in itertools.product(*map(range, sizes)) if rng.random() < share]
    g = spark.createDataFrame(rows, "i long, j long, k long, v double").repartition(4)
    tiles = tl.to_tiles(g, AXES, "v")
    assert Counter(map(tuple, tl.from_tiles(tiles, AXES, "v").collect())) == Counter(rows)
    want = gd.gather(g, AXES, sizes if counts else None, OFFS, {"v": ("v", [WEIGHTS[o] for o in OFFS])}, {"v": background})
    got = tl.from_tiles(tl.cross(tiles, WEIGHTS, counts, background), AXES, "v")
    rounded = lambda df: Counter((r["i"], r["j"], r["k"], round(r["v"], 6)) for r in df.collect())
    assert rounded(got) == rounded(want)


def test_only_faces_move(spark):
    g = gd.nodes(spark, (32, 32, 32), 4).select(*AXES, F.col("id").alias("v"))
    tiles = files.written(tl.to_tiles(g, AXES, "v"))
    sent = tl.faces(tiles, (4, 4, 4))
    assert sent.count() == 6 * tiles.count() == 6 * 64  # 7 * 32^3 rows in the row-wise form
    assert 7 * sent.select(F.sum(F.size("f"))).first()[0] <= 7 * 32**3
    moved = tl.cross(tl.to_tiles(g, AXES, "v"), WEIGHTS, (4, 4, 4))
    text = plan(moved)
    # nodes to tiles (once for the tiles and once for their faces, of which Spark reuses one), and the faces
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 3
    empty = tl.to_tiles(g.limit(0), AXES, "v")
    assert tl.from_tiles(tl.cross(empty, WEIGHTS, None), AXES, "v").count() == 0


def brute_boxes(cells):
    """Greedy growth, layer by layer, each layer's cells looked up one by one."""
    free, out, d = set(cells), [], len(next(iter(cells)))
    for start in sorted(cells):
        if start not in free:
            continue
        lo, hi, grew = list(start), list(start), True
        while grew:
            grew = False
            for ax, up in itertools.product(range(d), (True, False)):
                at = hi[ax] + 1 if up else lo[ax] - 1
                layer = itertools.product(*[[at] if i == ax else range(lo[i], hi[i] + 1) for i in range(d)])
                if all(c in free for c in layer):
                    (hi if up else lo)[ax], grew = at, True
        free -= set(itertools.product(*[range(x, y + 1) for x, y in zip(lo, hi, strict=True)]))
        out.append((*lo, *hi))
    return out


@pytest.mark.parametrize(("sizes", "procs"), [((9, 7), 3), ((5, 6, 4), 2), ((6, 6, 6), 7)])
def test_boxes_grow_as_a_brute_force_greedy(spark, sizes, procs):
    rng = random.Random(procs)
    names = ("a", "b", "c")[: len(sizes)]
    cut = [rng.randrange(1, n) for n in sizes]
    cells = {c: (sum((x > y) << i for i, (x, y) in enumerate(zip(c, cut))) if rng.random() < 0.9 else rng.randrange(procs)) % procs for c in itertools.product(*map(range, sizes))}
    owners = spark.createDataFrame([(p, *c) for c, p in cells.items()], "proc_id long, " + ", ".join(f"{n} long" for n in names))
    got = Counter(tuple(r) for r in dc.grown_boxes(owners, names).collect())
    want = Counter((p, *b) for p in set(cells.values()) for b in brute_boxes([c for c, q in cells.items() if q == p]))
    assert got == want
    d = len(sizes)
    covered = Counter((b[0], c) for b in got for c in itertools.product(*[range(b[1 + i], b[1 + d + i] + 1) for i in range(d)]))
    assert covered == Counter((p, c) for c, p in cells.items())


def test_labels_are_kept(spark):
    box = Space(AXES, (0, 0, 0), (100, 100, 100), (True, True, False))
    rng = random.Random(2)
    rows = spark.createDataFrame([(n, *(rng.randrange(100) for _ in range(3)), 0) for n in range(400)], "pid long, i long, j long, k long, v long")
    made = pt.ghosts(rows, box, (2, 2, 2), 9)
    pt.keep_labels(made, box, "kept_labels_test", files.fresh(spark), 4)
    new = rows.withColumn("v", F.col("pid") * 3)
    again = pt.ghosts_by_labels(new, box, "kept_labels_test")
    cols = ("pid", *AXES, "v", "proc_id", "dst", "s_i", "s_j", "s_k")
    assert Counter(map(tuple, again.select(*cols).collect())) == Counter(map(tuple, pt.ghosts(new, box, (2, 2, 2), 9).select(*cols).collect()))
    text = plan(again)
    assert text.count("Exchange hashpartitioning") == 1 and "Generate" not in text
    spark.sql("DROP TABLE kept_labels_test")


def test_checkpoint_for_other_processors(spark):
    rng = random.Random(3)
    points = [(n, rng.random() * 10, rng.random() * 10) for n in range(500)]
    rows = spark.createDataFrame(points, "pid long, x double, y double").withColumn("proc_id", (F.floor(F.col("x") / 2.5) * 2 + F.floor(F.col("y") / 5)).cast("long"))
    path = files.fresh(spark)
    files.save_by_owner(rows, path, ("x", "y"))
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 3.0, 4.0), (1, 3.0, 4.0, 10.0, 10.0), (2, 20.0, 20.0, 30.0, 30.0)], "to long, lo0 double, lo1 double, hi0 double, hi1 double")
    found = Counter(r["to"] for r in files.files_for(spark, path, boxes).collect())
    assert found == {0: 2, 1: 6}
    part = files.load_part(spark, path, (0.0, 0.0), (3.0, 4.0), ("x", "y"))
    assert {r["pid"] for r in part.collect()} == {n for n, x, y in points if x < 3 and y < 4}
    assert "PartitionFilters: [proc_id" in plan(part)
    assert files.load_part(spark, path, (20.0, 20.0), (30.0, 30.0), ("x", "y")).count() == 0


def test_requested_vertices(spark):
    v = spark.createDataFrame([(g, g % 3, f"d{g}") for g in range(12)], "gid long, proc_id long, data string")
    pairs = [(a, (a * 5 + 1) % 12) for a in range(12)] + [(0, 7), (3, 99)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    want = spark.createDataFrame([(0, 1), (0, 1), (0, 3), (1, 5), (2, 77), (None, 4)], "proc_id long, gid long")
    found, edges = gr.requested(want, v, e)
    assert Counter(tuple(r) for r in found.select("proc_id", "gid", "home", "data", "is_ghost").collect()) == Counter([(0, 1, 1, "d1", True), (0, 3, 0, "d3", False), (1, 5, 2, "d5", True), (None, 4, 1, "d4", None)])
    assert Counter(tuple(r) for r in edges.select("proc_id", "src", "dst").collect()) == Counter([(0, 1, 6), (1, 5, 2)])
    owner = {g: g % 3 for g in range(12)}
    far = {(owner[a], b) for a, b in pairs if b in owner and owner[a] != owner[b]}
    assert {tuple(r) for r in gr.border(e, v).select("proc_id", "gid").collect()} == far


@pytest.mark.parametrize(("dims", "periodic"), [(2, True), (3, True), (3, False)])
def test_half_pairs_give_the_same_forces(spark, dims, periodic):
    rng = random.Random(dims)
    box = Space(AXES[:dims], (0,) * dims, (100,) * dims, (periodic,) * dims)
    rows = spark.createDataFrame([(n, *(rng.randrange(100) for _ in range(dims))) for n in range(300)], "pid long, " + ", ".join(f"{a} long" for a in AXES[:dims]))
    full = nb.force(nb.neighbours(rows, rows, box, 20).where(nb.d2(box) > 0), box)
    half = nb.symmetric_force(rows, box, 20)
    table = lambda df: {r["pid"]: tuple(r[f"f_{a}"] for a in box.dims) for r in df.collect()}
    want, got = table(full), table(half)
    assert set(got) == set(want)
    for pid, f in want.items():
        assert got[pid] == pytest.approx(f, abs=1e-9)
    assert nb.candidates(rows, rows, box, 20, half=True).count() <= 0.55 * nb.candidates(rows, rows, box, 20).count()


@pytest.mark.parametrize("periodic", [True, False])
def test_ten_dimensions(spark, periodic):
    rng = random.Random(10)
    dims = tuple(f"x{i}" for i in range(10))
    box = Space(dims, (0,) * 10, (100,) * 10, (periodic,) * 10)
    centres = [[rng.randrange(100) for _ in dims] for _ in range(8)]
    points = [(n, *((c + rng.randint(-6, 6)) % 100 for c in rng.choice(centres))) for n in range(150)]
    rows = spark.createDataFrame(points, "pid long, " + ", ".join(f"{d} long" for d in dims))
    got = Counter((r["pid"], r["qid"]) for r in nb.neighbours(rows, rows, box, 14).collect())
    gap = lambda a, b: min(abs(a - b), 100 - abs(a - b)) if periodic else abs(a - b)
    want = Counter((a[0], b[0]) for a, b in itertools.permutations(points, 2) if sum(gap(x, y) ** 2 for x, y in zip(a[1:], b[1:], strict=True)) < 196)
    assert got == want and len(want) > 100
    half = Counter((r["pid"], r["qid"]) for r in nb.symmetric(rows, box, 14).collect())
    assert half == Counter((a, b) for a, b in want if a < b)


def test_binary_pieces_and_index(spark, tmp_path):
    rows = [(n, n * 0.5, None if n % 7 == 0 else -n * 1.5, n**2 if n % 5 else None, 0.25 * n) for n in range(1000)]
    df = spark.createDataFrame(rows, "pid long, x double, w double, n int, y double").repartition(3)
    files.write_vtp(df, f"{tmp_path}/a", name="set")
    back = Counter(map(tuple, files.read_vtp(spark, f"{tmp_path}/a", "set").select("pid", "x", "y", "z", "n", F.expr("nanvl(w, -1.0)").alias("w")).collect()))
    assert back == Counter((p, x, y, 0.0, -(2**63) if n is None else n, -1.0 if w is None else w) for p, x, w, n, y in rows)
    names = sorted(p.name for p in (tmp_path / "a").iterdir() if p.suffix == ".vtp")
    index = (tmp_path / "a" / "set.pvtp").read_text()
    assert len(names) == 3 and all(f'Source="{n}"' in index for n in names)
    content = (tmp_path / "a" / names[0]).read_bytes()
    assert content.startswith(b'<?xml version="1.0"?>\n<VTKFile type="PolyData"') and content.endswith(b"</AppendedData></VTKFile>\n")
    files.write_vtp(df.limit(0), f"{tmp_path}/b")
    assert files.read_vtp(spark, f"{tmp_path}/b").count() == 0


def test_a_run_rebalances_itself(spark):
    from driftmesh.streaming import steps

    rng = random.Random(12)
    box = Space(("x", "y"), (0, 0), (64, 64), (True, True))
    points = {n: (rng.randrange(64), rng.randrange(64)) for n in range(2000)}
    step = lambda df: df.withColumn("x", F.when(F.col("pid") % 3 > 0, F.floor(F.col("x") / 2)).otherwise(F.col("x") + 5).cast("long"))
    rows = spark.createDataFrame([(n, *p) for n, p in points.items()], "pid long, x long, y long")
    frame, log = steps.simulate_balanced(rows, step, 4, files.fresh(spark), box, (16, 16), 4, dc.Balancer(25.0))
    for _ in range(4):
        points = {n: (x // 2 if n % 3 else (x + 5) % 64, y) for n, (x, y) in points.items()}
    assert {r["pid"]: (r["x"], r["y"]) for r in frame.collect()} == points
    log = log.orderBy("step").collect()
    assert [r["n"] for r in log] == [2000] * 4
    assert all(r["rebalanced"] == (r["spread_before"] > 25.0) for r in log) and any(r["rebalanced"] for r in log)
    assert all((r["spread"] < r["spread_before"] and 0 < r["moved_rows"] < 2000) if r["rebalanced"] else r["moved_cells"] == 0 for r in log)
    held = Counter(r["proc_id"] for r in frame.collect())
    assert 100 * (max(held.values()) - min(held.values())) / 500 == pytest.approx(log[-1]["spread"])


@pytest.mark.parametrize(("sizes", "reach", "crowd"), [((20, 13), 1, None), ((20, 13), 2, 5), ((9, 16, 11), 2, None), ((5, 5, 5), 1, 3)])
def test_particles_and_mesh_as_by_rows(spark, monkeypatch, sizes, reach, crowd):
    """The same sums as row by row: sizes that aren't whole blocks, places out of the box, crowded blocks that are cut, missing nodes."""
    from driftmesh.functions.space import hat, m4_prime
    from driftmesh.operators import blocks

    if crowd:
        monkeypatch.setattr(blocks, "BLOCK_ROWS", crowd)
    rng = random.Random(sum(sizes))
    names, axes, weight = ("x", "y", "z")[: len(sizes)], AXES[: len(sizes)], hat if reach == 1 else m4_prime
    rows = [(n, *(rng.choice([rng.uniform(-4, 2 * s + 4), 2.0 * rng.randrange(s)]) for s in sizes), rng.uniform(-1, 1), float(n)) for n in range(120)]
    p = spark.createDataFrame(rows, "pid long, " + ", ".join(f"{c} double" for c in names) + ", q double, w2 double")
    by_row = gd.particle_nodes(p, names, 2.0, sizes, weight, reach)
    table = lambda df, key, fields: {tuple(r[c] for c in key): tuple(r[f] for f in fields) for r in df.collect()}

    def same(got, want):
        assert set(got) == set(want)
        for k, v in want.items():
            assert got[k] == pytest.approx(v, abs=1e-9)

    want = by_row.groupBy(*axes).agg(F.sum(F.col("w") * F.col("q")).alias("q"), F.sum(F.col("w") * F.col("w2")).alias("w2"))
    same(table(gd.to_mesh(p, names, 2.0, sizes, weight, reach, ("q", "w2"), 4), axes, ("q", "w2")), table(want, axes, ("q", "w2")))
    nodes = [(*at, rng.uniform(0, 9), rng.uniform(0, 9)) for at in itertools.product(*map(range, sizes)) if rng.random() < 0.7]
    mesh = spark.createDataFrame(nodes, ", ".join(f"{a} long" for a in axes) + ", u double, v double")
    want = by_row.join(mesh, list(axes)).groupBy("pid").agg(F.sum(F.col("w") * F.col("u")).alias("u"), F.sum(F.col("w") * F.col("v")).alias("v"))
    same(table(gd.from_mesh(p, mesh, names, 2.0, sizes, weight, reach, ("u", "v"), 4), ("pid",), ("u", "v")), table(want, ("pid",), ("u", "v")))
    assert gd.to_mesh(p.limit(0), names, 2.0, sizes, weight, reach, ("q",), 4).count() == 0


def test_binary_pieces_are_read_in_parts(spark, tmp_path, monkeypatch):
    """A task holds some points of a piece, not all: the plan holds no file's content, and batches stay small."""
    df = spark.range(5000).select(F.col("id").alias("pid"), *[(F.col("id") * k).cast("double").alias(x) for k, x in enumerate("xyz", 1)])
    files.write_vtp(df.coalesce(1), f"{tmp_path}/a")
    monkeypatch.setattr(files, "POINTS", 300)
    back = files.read_vtp(spark, f"{tmp_path}/a")
    assert "content" not in back._jdf.queryExecution().toString()
    assert sorted(map(tuple, back.select("pid", "x", "y", "z").collect())) == [(n, 1.0 * n, 2.0 * n, 3.0 * n) for n in range(5000)]
