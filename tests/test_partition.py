"""k-way partitions against exhaustive search, and refinement against brute-force costs of each round."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from driftmesh.operators import graph as gr
from driftmesh.operators import partition as pn
from pyspark.sql import functions as F


def frames(spark, w, edges):
    v = spark.createDataFrame(sorted(w.items()), "gid long, w long")
    return v, spark.createDataFrame([(a, b, k) for (a, b), k in edges.items()], "src long, dst long, w long")


def cut_of(label, edges):
    return sum(k for (a, b), k in edges.items() if label[a] != label[b])


def loads_of(label, w):
    out = defaultdict(int)
    for g, p in label.items():
        out[p] += w[g]
    return out


def labels(df):
    return {r["gid"]: r["proc_id"] for r in df.collect()}


@pytest.mark.parametrize(("parts", "seed"), [(2, 1), (3, 2), (2, 3)])
def test_best_of_all_on_twelve_vertices(spark, parts, seed):
    rng = random.Random(seed)
    w = {g: 1 for g in range(12)}
    edges = {(a, b): rng.randint(1, 9) for a, b in itertools.combinations(range(12), 2) if rng.random() < 0.4}
    best = min(cut_of(dict(enumerate(x)), edges) for x in itertools.product(range(parts), repeat=12) if max(Counter(x).values()) == 12 // parts and len(set(x)) == parts)
    got = labels(pn.partition(*frames(spark, w, edges), parts))
    assert set(got) == set(w) and max(loads_of(got, w).values()) == 12 // parts
    assert cut_of(got, edges) == best


@pytest.mark.parametrize("kind", ["mesh", "star", "pieces", "loose"])
def test_levels_cover_and_balance(spark, kind):
    """Coarsened by several levels: a mesh, one hub with all others, many small components, and no edges at all."""
    n = 900
    if kind == "mesh":
        v, e = gr.cartesian(spark, (30, 30), 4, 4)
        v = v.select("gid")
    else:
        v = spark.range(n).withColumnRenamed("id", "gid")
        pairs = {"star": [(0, i) for i in range(1, n)], "pieces": [(i, i + 1) for i in range(n) if i % 3 < 2], "loose": []}[kind]
        e = spark.createDataFrame(pairs, "src long, dst long")
    got = pn.partition(v, e, 4, coarse=200)
    label = labels(got)
    assert len(label) == got.count() == n and set(label.values()) == {0, 1, 2, 3}
    assert max(Counter(label.values()).values()) <= 1.05 * n / 4 + 1
    cut = sum(label[r["src"]] != label[r["dst"]] for r in e.collect())
    assert cut <= {"mesh": 2 * 110, "star": n, "pieces": 40, "loose": 0}[kind]


def test_empty_and_foreign_edges(spark):
    none = spark.createDataFrame([], "gid long, w long")
    e = spark.createDataFrame([(1, 2, 5), (1, 1, 9), (7, 8, 1)], "src long, dst long, w long")
    assert pn.partition(none, e, 3).count() == 0
    assert labels(pn.partition(spark.createDataFrame([(1, 1), (2, 1)], "gid long, w long"), e, 1)) == {1: 0, 2: 0}


@pytest.mark.parametrize("migrates", [False, True])
def test_no_round_of_refinement_costs_more(spark, migrates):
    rng = random.Random(7)
    w = {g: rng.randint(1, 3) for g in range(144)}
    edges = {(g, g + d): rng.randint(1, 5) for g in w for d in (1, 12) if g + d < 144 and (d == 12 or g % 12 < 11)}
    home = {g: rng.randrange(4) for g in w} if migrates else {g: g // 36 for g in w}
    start = {g: g // 36 for g in w} if migrates else {g: (g * 7) % 4 for g in w}
    v, e = frames(spark, w, edges)
    rows = spark.createDataFrame([(g, w[g], start[g], home[g]) for g in w], "gid long, w long, proc_id long, home long")
    cost = lambda x: (2 * cut_of(x, edges) + sum(w[g] for g in w if x[g] != home[g])) if migrates else cut_of(x, edges)
    most = 1.3 * sum(w.values()) / 4
    now, costs = start, [cost(start)]
    for _ in range(5):
        rows = pn.refined(rows if migrates else rows.drop("home"), e, 4, 0.3, 1, F.col("w") if migrates else None, 2 if migrates else 1)
        if not migrates:
            rows = rows.withColumn("home", F.lit(0).cast("long"))
        now = labels(rows)
        costs.append(cost(now))
        assert max(loads_of(now, w).values()) <= max(most, max(loads_of(start, w).values()))
    assert all(b <= a for a, b in zip(costs, costs[1:])) and costs[-1] < (1.0 if migrates else 0.8) * costs[0]


def test_gains_by_brute_force(spark):
    rng = random.Random(3)
    w = {g: rng.randint(1, 4) for g in range(40)}
    edges = {(a, b): rng.randint(1, 5) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.1}
    label, home = {g: rng.randrange(3) for g in w}, {g: rng.randrange(3) for g in w}
    rows = spark.createDataFrame([(g, w[g], label[g], home[g]) for g in w], "gid long, w long, proc_id long, home long")
    total = lambda x: 3 * cut_of(x, edges) + sum(w[g] for g in w if x[g] != home[g])
    both = pn.both_ways(pn.undirected(frames(spark, w, edges)[1]))
    found = pn.gains(rows, both, F.col("w"), 3).collect()
    assert len(found) > 20
    for r in found:
        assert total(label) - total(label | {r["gid"]: r["to"]}) == r["gain"]


def test_full_processors_give_away(spark):
    v, e = gr.cartesian(spark, (20, 20), 4, 4)
    rows = v.select("gid", F.lit(1).cast("long").alias("w"), F.when(F.col("gid") < 300, 0).otherwise(F.col("proc_id")).cast("long").alias("proc_id"))
    after = Counter(labels(pn.refined(rows, e, 4, 0.1, 6)).values())
    assert sum(after.values()) == 400 and max(after.values()) <= 110


def books(spark, n=300, orders=9):
    """n hubs with ``orders`` leaves each, which also hang on each other in a row, as customers and their orders do."""
    hub = lambda g: g // (orders + 1) * (orders + 1)
    pairs = [(g, hub(g)) for g in range(n * (orders + 1)) if g != hub(g)] + [(g, g + 1) for g in range(n * (orders + 1) - 1) if g != hub(g) and g + 1 != hub(g + 1)]
    return spark.range(n * (orders + 1)).withColumnRenamed("id", "gid"), spark.createDataFrame(pairs, "src long, dst long"), hub


def test_books_contract_at_once_and_need_no_refinement(spark, monkeypatch):
    """whole components took a level for each halving, and every level was refined though nothing was cut."""
    v, e, hub = books(spark)
    steps, contract, gains = [], pn.contracted, pn.gains
    monkeypatch.setattr(pn, "contracted", lambda *a: steps.append("level") or contract(*a))
    monkeypatch.setattr(pn, "gains", lambda *a: steps.append("gains") or gains(*a))
    label = labels(pn.partition(v, e, 4, coarse=200))
    assert len(label) == 3000 and all(label[g] == label[hub(g)] for g in label)
    assert max(Counter(label.values()).values()) <= 1.05 * 750
    assert steps == ["level"] * 2  # hubs, then whole books by hash


def test_joins_are_stars_along_edges(spark):
    rng = random.Random(11)
    random_graph = {(a, b): rng.randint(1, 3) for a, b in itertools.combinations(range(120), 2) if rng.random() < 0.03}
    chain = {(g, g + 1): 1 for g in range(400)}
    for edges in (random_graph, chain):
        e = pn.undirected(frames(spark, {0: 1}, edges)[1])
        ends = {g for pair in edges for g in pair}
        for level in range(3):
            by_hubs, active = pn.by_hubs(e, level)
            assert active == len(ends)
            for to in (by_hubs, pn.by_coin(e, level)):
                rows = [tuple(r) for r in to.select("gid", "to").collect()]
                assert len({g for g, _ in rows}) == len(rows) >= 0.15 * active
                assert not {g for g, _ in rows} & {t for _, t in rows}
                assert all((min(r), max(r)) in edges for r in rows)


def test_coin_where_hubs_do_not_join(spark, monkeypatch):
    """Twenty middles, each with 15 heavy edges to vertices that have more neighbours than it: only the middles join, so the coin decides."""
    edges = {(g, 300 + g // 15): 9 for g in range(300)} | {(min(g, h), max(g, h)): 1 for g in range(300) for h in ((g + 15 * d) % 300 for d in range(1, 10))}
    v, e = frames(spark, {g: 1 for g in range(320)}, edges)
    assert pn.by_hubs(pn.undirected(e), 0)[0].count() == 20
    levels, coin = [], pn.by_coin
    monkeypatch.setattr(pn, "by_coin", lambda e, level: levels.append(level) or coin(e, level))
    label = labels(pn.partition(v, e, 2, 0.2, coarse=40))
    assert 0 in levels and len(label) == 320 and max(Counter(label.values()).values()) <= 1.2 * 160 + 1
    assert cut_of(label, edges) < 0.6 * sum(edges.values())


def test_cuts_count_edges_of_any_direction(spark):
    v = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (3, 1, 0)], "gid long, p long, q long")
    e = spark.createDataFrame([(1, 2, 5), (2, 1, 2), (2, 3, 7), (3, 3, 9), (3, 8, 100)], "src long, dst long, w long")
    assert pn.cuts(v, e, ("p", "q")).collect() == [(7, 7)]
    assert pn.cuts(v, e.drop("w"), ("p", "q")).collect() == [(1, 2)]
    assert pn.cuts(v, e.where("src = 9"), ("p", "q")).collect() == [(0, 0)]
