"""k-way partition of graphs by edge tables: coarsening, a first partition of the coarsest graph, refinement on the way back.

Vertices are (gid, w), edges (src, dst, w) in any direction.  Only the coarsest graph, of at most ``coarse`` vertices, and loads
by processor come to the driver; every other step is a join or a grouping of the edge table.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import forget, written

#: Moves into a processor are accepted by levels of gain, and within a level by so many bins of a hash.
GAIN_LEVELS, HASH_BINS = 32, 256
#: So many neighbours, or more, make a hub.
DEGREES = (1 << 16) - 1


def undirected(edges: DataFrame) -> DataFrame:
    """u < v and the weight of all edges between them; loops go.  Without a column w an edge weighs 1."""
    w = F.col("w") if "w" in edges.columns else F.lit(1)
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), w.cast("long").alias("w"))
    return e.groupBy("u", "v").agg(F.sum("w").alias("w"))


def cell_edges(cells: DataFrame, div: tuple[int, ...], names: tuple[str, ...], periodic: tuple[bool, ...]) -> DataFrame:
    """src, dst of cells of a decomposition grid (cell and its indexes) that share a face, each pair once an axis."""
    out, stride = None, 1
    for n, k, p in reversed(list(zip(names, div, periodic, strict=True))):
        up = F.when(F.col(n) == k - 1, F.col("cell") - (k - 1) * stride).otherwise(F.col("cell") + stride)
        pairs = (cells if p and k > 2 else cells.where(F.col(n) < k - 1)).select(F.col("cell").alias("src"), up.cast("long").alias("dst"))
        out, stride = pairs if out is None else out.unionByName(pairs), stride * k
    return out


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("a"), F.col("v").alias("b"), "w").unionByName(e.select(F.col("v").alias("a"), F.col("u").alias("b"), "w"))


def _heads(c: str, level: int) -> Column:
    return F.xxhash64(c, F.lit(level)) % 2 == 0


def _ranked(near: DataFrame, level: int) -> DataFrame:
    """rank of b for a: the edge's weight, then b's neighbours (column d), then a hash; one number, so that the best is found without sorting."""
    weight = F.least(F.greatest("w", F.lit(0)), F.lit((1 << 31) - 1)).cast("long")
    mix = F.xxhash64("b", F.lit(level)).bitwiseAND(F.lit(DEGREES).cast("long"))
    return near.select("a", "b", (F.shiftleft(weight, 32) + F.shiftleft(F.col("d").cast("long"), 16) + mix).alias("rank"))


def by_hubs(e: DataFrame, level: int) -> tuple[DataFrame, int]:
    """gid, to: vertices that join another one, which itself stays; and how many vertices have an edge at all.

    Each vertex looks at its heaviest neighbour, of such the one with the most neighbours, and joins it if that has more neighbours than itself
    (a hash decides ties) and doesn't join another: leaves and chains around a hub are contracted at once.  Of longer chains half of the
    vertices by hash stay, for the others to join.
    """
    both = both_ways(e)
    degree = both.groupBy("b").agg(F.least(F.count("*"), F.lit(DEGREES)).alias("d"))
    near = _ranked(both.join(degree, "b"), level)
    best = near.groupBy("a").agg(F.max_by("b", "rank").alias("b"), F.max("rank").alias("rank"), F.least(F.count("*"), F.lit(DEGREES)).alias("d"))
    theirs = F.shiftright("rank", 16).bitwiseAND(F.lit(DEGREES).cast("long"))
    mine, other = (F.struct(d.alias("d"), F.xxhash64(c, F.lit(level)).alias("h"), F.col(c).alias("c")) for d, c in ((F.col("d"), "a"), (theirs, "b")))
    best = written(best.select(F.col("a").alias("gid"), F.when(other > mine, F.col("b")).alias("to")))
    up = best.where("to IS NOT NULL")
    chained = written(up.join(up.select(F.col("gid").alias("to"), F.lit(True).alias("on")), "to", "left").select("gid", "to", "on"))
    long = chained.where("on").select("gid", "to")
    ends = long.where(_heads("gid", level)).select(F.col("gid").alias("to"))
    out = written(chained.where("on IS NULL").select("gid", "to").unionByName(long.where(~_heads("gid", level)).join(ends, "to", "left_semi").select("gid", "to")))
    active = best.count()
    forget(best, chained)
    return out, active


def by_coin(e: DataFrame, level: int) -> DataFrame:
    """gid, to: half of the vertices, by hash, join their heaviest neighbour of the other half, whatever the numbers of their neighbours."""
    tails = both_ways(e).where(~_heads("a", level) & _heads("b", level)).withColumn("d", F.lit(0))
    return written(_ranked(tails, level).groupBy("a").agg(F.max_by("b", "rank").alias("to")).withColumnRenamed("a", "gid"))


def clusters(v: DataFrame, to: DataFrame) -> DataFrame:
    """Vertices gid, w, key of clusters: those without a row in ``to`` (gid, to) stay as they are."""
    named = v.join(to, "gid", "left").withColumn("gid", F.coalesce("to", "gid"))
    return written(named.groupBy("gid").agg(F.sum("w").alias("w"), F.min("key").alias("key")))


def split(to: DataFrame, heavy: DataFrame, most: int, level: int) -> DataFrame:
    """``to`` where clusters of more than ``most`` keep a share; the others form clusters of their own by hash, so that hubs contract as fast as meshes do.

    ``heavy`` (gid, w) are these clusters, less than the total weight over ``most``.
    """
    k = F.ceil(F.col("w") / most).cast("long")
    placed = to.join(F.broadcast(heavy.select(F.col("gid").alias("to"), k.alias("k"))), "to", "left").withColumn("k", F.pmod(F.xxhash64("gid", F.lit(-level - 1)), F.col("k")))
    first = placed.where("k > 0").groupBy("to", "k").agg(F.min("gid").alias("first"))
    return written(placed.join(first, ["to", "k"], "left").select("gid", F.coalesce("first", "to").alias("to")))


def _by_hash(v: DataFrame, clusters: int) -> DataFrame:
    """gid, to: vertices in clusters by hash, whatever their edges."""
    keyed = v.select("gid", F.pmod(F.xxhash64("gid"), F.lit(clusters)).alias("k"))
    return written(keyed.join(keyed.groupBy("k").agg(F.min("gid").alias("to")), "k").select("gid", "to"))


def coarsened(v: DataFrame, e: DataFrame, n: int, most: int, bins: int, level: int) -> tuple[DataFrame, DataFrame, int]:
    """to, the clusters and their number, of n vertices: around hubs; if less than a tenth of the vertices with edges joins, by a coin; else by hash.

    Clusters have a weight of about ``most`` at most.
    """
    if e.take(1):
        to, active = by_hubs(e, level)
        for again in (True, False):
            cv = clusters(v, to)
            cn, top = cv.agg(F.count("*"), F.max("w")).first()
            if top > most:
                before, to = (cv, to), split(to, cv.where(F.col("w") > most), most, level)
                cv = clusters(v, to)
                cn = cv.count()
                forget(*before)
            if n - cn >= 0.1 * active:
                return to, cv, cn
            forget(cv, to)
            if again:
                to = by_coin(e, level)
    to = _by_hash(v, bins)
    cv = clusters(v, to)
    return to, cv, cv.count()


def contracted(e: DataFrame, to: DataFrame) -> DataFrame:
    """Edges between clusters, with the sums of their weights."""
    for c in ("u", "v"):
        e = e.join(to.select(F.col("gid").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    return undirected(e.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w"))


class Local:
    """The coarsest graph on the driver: greedy growth of parts, then moves that lessen the cut."""

    def __init__(self, weights: dict[int, int], keys: dict[int, int], edges: list[tuple[int, int, int]], parts: int, most: float):
        self.w, self.keys, self.parts, self.most = weights, keys, parts, most
        self.reach = most + max(weights.values(), default=0)  # how full a part may get on the way
        self.near: dict[int, dict[int, int]] = defaultdict(dict)
        for a, b, w in edges:
            self.near[a][b] = self.near[b][a] = self.near[a].get(b, 0) + w

    def grown(self, rng: random.Random) -> dict[int, int]:
        """Parts grow one after another from a random vertex, by the vertex that hangs on them most, until each has its share."""
        label: dict[int, int] = {}
        order = sorted(self.w)
        rng.shuffle(order)
        left = sum(self.w.values())
        for p in range(self.parts - 1):
            share, load, heap, pull = left / (self.parts - p), 0, [], defaultdict(int)
            seeds = iter([g for g in order if g not in label])
            while load < share:
                while heap and (heap[0][2] in label or -heap[0][0] != pull[heap[0][2]]):
                    heapq.heappop(heap)
                g = heapq.heappop(heap)[2] if heap else next((x for x in seeds if x not in label), None)
                if g is None or load and load + self.w[g] - share > share - load:
                    break
                label[g] = p
                load += self.w[g]
                for b, w in self.near[g].items():
                    if b not in label:
                        pull[b] += w
                        heapq.heappush(heap, (-pull[b], rng.random(), b))
            left -= load
        return label | {g: self.parts - 1 for g in order if g not in label}

    def along_keys(self) -> dict[int, int]:
        """Equal weights along the order of keys."""
        up, total, label = 0, sum(self.w.values()), {}
        for g in sorted(self.w, key=lambda g: (self.keys[g], g)):
            label[g] = min((2 * up + self.w[g]) * self.parts // (2 * total), self.parts - 1)
            up += self.w[g]
        return label

    def _best_move(self, g: int, label: dict[int, int], load: dict[int, int]) -> tuple | None:
        p, ties = label[g], defaultdict(int)
        for b, w in self.near[g].items():
            ties[label[b]] += w
        targets = range(self.parts) if load[p] > self.most else ties
        return max(((ties.get(q, 0) - ties.get(p, 0), -load[q], q) for q in targets if q != p and load[q] + self.w[g] <= self.reach), default=None)

    def improved(self, label: dict[int, int], rng: random.Random, passes: int = 8, patience: int = 200) -> dict[int, int]:
        """Passes of moves, the best first, each vertex once a pass, also such that don't lessen the cut or that fill a part by a vertex too much; the best state of a pass is kept."""
        load = defaultdict(int)
        for g, p in label.items():
            load[p] += self.w[g]
        for _ in range(passes):
            heap, stamp = [], defaultdict(int)

            def push(g: int) -> None:
                stamp[g] += 1
                if move := self._best_move(g, label, load):
                    heapq.heappush(heap, (not load[label[g]] > self.most, -move[0], -move[1], rng.random(), g, move[2], stamp[g]))

            for g in sorted(self.w):
                push(g)
            over = lambda p: max(0, load[p] - self.most)
            done, log, now, at, excess = set(), [], 0, 0, sum(map(over, range(self.parts)))
            best = (excess, 0)
            while heap and len(log) - at < patience:
                _, minus, _, _, g, q, t = heapq.heappop(heap)
                if g in done or t != stamp[g]:
                    continue
                if load[q] + self.w[g] > self.reach:
                    push(g)
                    continue
                p = label[g]
                excess -= over(p) + over(q)
                load[p], load[q], label[g] = load[p] - self.w[g], load[q] + self.w[g], q
                excess += over(p) + over(q)
                done.add(g)
                log.append((g, p))
                now += minus
                if (excess, now) < best:
                    best, at = (excess, now), len(log)
                for b in self.near[g]:
                    if b not in done:
                        push(b)
            for g, p in reversed(log[at:]):
                load[label[g]] -= self.w[g]
                load[p] += self.w[g]
                label[g] = p
            if not at:
                break
        return label

    def cut(self, label: dict[int, int]) -> int:
        return sum(w for a, bs in self.near.items() for b, w in bs.items() if a < b and label[a] != label[b])

    def cost(self, label: dict[int, int]) -> tuple[float, int]:
        """What the fullest part has above ``most``, and the cut."""
        load = defaultdict(int)
        for g, p in label.items():
            load[p] += self.w[g]
        return max(0, max(load.values(), default=0) - self.most), self.cut(label)

    def best(self, tries: int, seed: int) -> dict[int, int]:
        def tried(i: int) -> tuple:
            rng = random.Random(seed * 1000 + i)
            label = self.improved(self.grown(rng) if i else self.along_keys(), rng)
            return *self.cost(label), i, label

        found = []
        for i in range(max(tries, min(200, 4000 // max(len(self.w), 1)))):
            found.append(tried(i))
            if found[-1][:2] == (0, 0):  # none is better
                break
        return min(found, key=lambda x: x[:3])[3]


def loads(v: DataFrame, parts: int) -> dict[int, int]:
    """The load of each processor; one row a processor comes to the driver."""
    found = {r["proc_id"]: r["w"] for r in v.groupBy("proc_id").agg(F.sum("w").alias("w")).collect()}
    return {p: found.get(p, 0) for p in range(parts)}


def _fitting(moves: DataFrame, by: str, room: dict[int, int], seed: int) -> DataFrame:
    """Moves, by gain downward, whose weights add up to at most room[by].

    Weights are summed by (by, level of gain, bin of a hash), a table of bounded size; running sums tell the bins that fit.  No
    processor's moves are ordered one by one.
    """
    spark = moves.sparkSession
    moves = moves.withColumns({"__l": F.least(F.greatest(F.col("gain"), F.lit(-GAIN_LEVELS)), F.lit(GAIN_LEVELS)), "__h": F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(HASH_BINS))})
    sums = moves.groupBy(by, "__l", "__h").agg(F.sum("w").alias("s"))
    up = Window.partitionBy(by).orderBy(F.desc("__l"), "__h").rowsBetween(Window.unboundedPreceding, 0)
    free = spark.createDataFrame(sorted(room.items()), f"{by} long, room long")
    fit = sums.withColumn("up", F.sum("s").over(up)).join(F.broadcast(free), by).where("up <= room").select(by, "__l", "__h")
    return moves.join(F.broadcast(fit), [by, "__l", "__h"]).drop("__l", "__h")  # at most 2 * GAIN_LEVELS * HASH_BINS bins a processor


def gains(v: DataFrame, both: DataFrame, cost: Column | None = None, weight: int = 1) -> DataFrame:
    """gid, w, proc_id, to, gain: the other processor that each border vertex has the most edges to, and what a move there saves.

    A move saves ``weight`` times the edges that it uncuts less those that it cuts; ``cost`` is what a vertex at home (column home)
    pays to leave and one away saves by going back.
    """
    at = v.select(F.col("gid").alias("b"), F.col("proc_id").alias("p"))
    ties = both.join(at, "b").groupBy("a", "p").agg((weight * F.sum("w")).alias("c"))
    mine = v.withColumnRenamed("gid", "a")
    rows = ties.join(mine, "a")
    away = F.col("p") != F.col("proc_id")
    value = F.col("c")
    if cost is not None:
        value = value + F.when(F.col("p") == F.col("home"), cost).otherwise(0)
    keep = [c for c in v.columns if c not in ("gid", "proc_id", "w")]
    first = [F.first(c).alias(c) for c in keep]
    best = rows.groupBy("a").agg(F.first("w").alias("w"), F.first("proc_id").alias("proc_id"), *first, F.sum(F.when(~away, F.col("c")).otherwise(0)).alias("own"), F.max(F.when(away, F.struct(value.alias("value"), (-F.col("p")).alias("minus")))).alias("x"))
    gain = F.col("x.value") - F.col("own")
    if cost is not None:
        gain = gain - F.when(F.col("proc_id") == F.col("home"), cost).otherwise(0)
    return best.where("x IS NOT NULL").select(F.col("a").alias("gid"), "w", "proc_id", (-F.col("x.minus")).alias("to"), gain.cast("long").alias("gain"))


def _alone(moves: DataFrame, both: DataFrame, seed: int) -> DataFrame:
    """Moves that no neighbour's move of more gain stands against: of two neighbours only one moves, so gains add up."""
    rank = F.struct(F.col("gain").alias("gain"), F.xxhash64("gid", F.lit(seed)).alias("h"), F.col("gid").alias("gid"))
    ranked = moves.select("gid", rank.alias("rank"))
    met = both.join(ranked.select(F.col("gid").alias("a"), F.col("rank").alias("mine")), "a").join(ranked.select(F.col("gid").alias("b"), F.col("rank").alias("theirs")), "b")
    beaten = met.where("theirs > mine").select(F.col("a").alias("gid")).distinct()
    return moves.join(beaten, "gid", "left_anti")


def _moved(v: DataFrame, moves: DataFrame) -> DataFrame:
    out = v.join(moves.select("gid", "to"), "gid", "left").withColumn("proc_id", F.coalesce("to", "proc_id")).drop("to")
    return written(out.select(*v.columns))


def refined(v: DataFrame, edges: DataFrame, parts: int, slack: float = 0.05, rounds: int = 4, cost: Column | None = None, weight: int = 1) -> DataFrame:
    """Vertices (gid, w, proc_id) with better processors: rounds of moves that each save something, until none does.

    With ``cost`` (and a column home, where a vertex's data lie) the cut, times ``weight``, and migration are lessened together.
    Their sum never rises.  No processor gets above (1 + slack) times the mean load by moves; one that is above it gives vertices away first,
    those that cost least, to processors with room, and only there the sum may rise.
    """
    return _refined(v, undirected(edges), parts, slack, rounds, cost, weight)


def _refined(v: DataFrame, e: DataFrame, parts: int, slack: float, rounds: int, cost: Column | None = None, weight: int = 1) -> DataFrame:
    both = written(both_ways(e))
    v = written(v)
    most = (1 + slack) * sum(loads(v, parts).values()) / parts
    for r in range(rounds):
        before, (v, n) = v, _relieved(v, both, parts, most, r)
        if not n:
            break
        forget(before)
    for r in range(rounds):
        found = written(gains(v, both, cost, weight).where("gain > 0"))
        room = {p: int(most - x) for p, x in loads(v, parts).items()}
        moves = written(_fitting(_alone(found, both, r), "to", room, r))
        if not moves.take(1):
            forget(found, moves)
            break
        before, v = v, _moved(v, moves)
        forget(before, found, moves)
    forget(both)
    return v


def _relieved(v: DataFrame, both: DataFrame, parts: int, most: float, r: int) -> tuple[DataFrame, int]:
    """One round of moves out of processors above ``most``, to the least loaded if a vertex has no edge to one with room."""
    load = loads(v, parts)
    over = {p: int(x - most) + 1 for p, x in load.items() if x > most}
    room = {p: int(most - x) for p, x in load.items() if most - x >= 1}
    if not over or not room:
        return v, 0
    spare = sorted(room, key=lambda p: -room[p])[: max(1, len(room) // 2)]
    full = v.where(F.col("proc_id").isin(*over))
    ties = both.join(v.select(F.col("gid").alias("b"), F.col("proc_id").alias("p")), "b").join(full.select(F.col("gid").alias("a"), F.col("proc_id").alias("mine")), "a")
    ties = ties.groupBy("a").agg(F.sum(F.when(F.col("p") == F.col("mine"), F.col("w")).otherwise(0)).alias("own"), F.max(F.when(F.col("p").isin(*room), F.struct("w", "p"))).alias("x"))
    any_spare = F.element_at(F.array(*[F.lit(p) for p in spare]), (F.pmod(F.xxhash64("gid", F.lit(r)), F.lit(len(spare))) + 1).cast("int"))
    moves = full.join(ties.withColumnRenamed("a", "gid"), "gid", "left")
    moves = moves.select("gid", "w", "proc_id", F.coalesce("x.p", any_spare).cast("long").alias("to"), (F.coalesce("x.w", F.lit(0)) - F.coalesce("own", F.lit(0))).cast("long").alias("gain"))
    arriving = _fitting(moves, "to", room, r + 100)
    moves = written(_fitting(arriving, "proc_id", {p: x + x // 8 for p, x in over.items()}, r))
    n = moves.count()
    out = _moved(v, moves) if n else v
    forget(moves)
    return out, n


def partition(vertices: DataFrame, edges: DataFrame, parts: int, slack: float = 0.05, coarse: int = 8000, rounds: int = 3, tries: int = 12, seed: int = 0) -> DataFrame:
    """gid, w, proc_id: a k-way partition with loads of at most (1 + slack) times the mean and few edges cut.

    Clusters of vertices that hang together are contracted level by level, until at most ``coarse`` are left; these are
    partitioned on the driver; on the way back each level starts with its clusters' processors and is refined, unless the coarsest graph is
    balanced with nothing cut, which holds for all levels then.  Clusters stay light
    (slack / 4 of a processor's share, or 3 times the coarsest graph's mean), so that the coarsest graph can be balanced.  Vertices that don't contract further, such as
    whole components, are put together by hash.  Every level is written, so a lost executor costs one step, and deleted after use.

    Vertices without w weigh 1.  One of the first partitions follows the column key (such as a space-filling curve's index; the gid if there is
    none), the others grow from random vertices.  Vertices without edges are placed for balance.  Edges whose ends aren't among the vertices
    are ignored.  No vertices give no rows.
    """
    w = F.col("w") if "w" in vertices.columns else F.lit(1)
    key = F.col("key") if "key" in vertices.columns else F.col("gid")
    v = written(vertices.select("gid", w.cast("long").alias("w"), key.cast("long").alias("key")))
    known = v.select("gid")
    e = undirected(edges).join(known.withColumnRenamed("gid", "u"), "u", "left_semi").join(known.withColumnRenamed("gid", "v"), "v", "left_semi")
    e = written(e)
    n, total, heaviest = v.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0)), F.coalesce(F.max("w"), F.lit(1))).first()
    light = max(int(heaviest), int(total * slack / (4 * parts)), -(-3 * total // coarse), 1)
    levels, level = [], 0
    while n > coarse:
        to, cv, cn = coarsened(v, e, n, light, max(coarse // 2, parts), level)
        levels.append((v, e, to))
        v, e, n, level = cv, written(contracted(e, to)), cn, level + 1
    most = (1 + slack) * total / parts
    rows, ties = v.collect(), [tuple(r) for r in e.select("u", "v", "w").collect()]
    local = Local({r["gid"]: r["w"] for r in rows}, {r["gid"]: r["key"] for r in rows}, sorted(ties), parts, most)
    label = local.best(tries, seed)
    schema = "gid long, w long, proc_id long"
    out = v.sparkSession.createDataFrame([(r["gid"], r["w"], label[r["gid"]]) for r in rows], schema)
    best = local.cost(label) == (0, 0)  # clusters' edges and loads are those of what is in them, so no level has a move to make
    forget(v, e)
    for v, e, to in reversed(levels):
        above = out
        named = v.join(to, "gid", "left").withColumn("to", F.coalesce("to", "gid")).join(above.select(F.col("gid").alias("to"), "proc_id"), "to").select("gid", "w", "proc_id")
        out = written(named) if best else _refined(named, e, parts, slack, rounds)
        forget(v, e, to, above)
    return out


def cuts(v: DataFrame, edges: DataFrame, names: tuple[str, ...] = ("proc_id",)) -> DataFrame:
    """One row: for each column of processors the weight of edges between different ones, under the column's name."""
    e = edges if "w" in edges.columns else edges.withColumn("w", F.lit(1))
    for c in ("src", "dst"):
        e = e.join(v.select(F.col("gid").alias(c), *[F.col(n).alias(f"{c}_{n}") for n in names]), c)
    return e.agg(*[F.coalesce(F.sum(F.when(F.col(f"src_{n}") != F.col(f"dst_{n}"), F.col("w").cast("long"))), F.lit(0)).alias(n) for n in names])


def quality(v: DataFrame, edges: DataFrame, parts: int) -> DataFrame:
    """One row: cut (weight of edges between processors), balance (largest load over the mean) and, with a column home, migration (weight away from home)."""
    cut = cuts(v, edges).withColumnRenamed("proc_id", "cut")
    return cut.crossJoin(balance(v, parts))  # one row each


def balance(v: DataFrame, parts: int) -> DataFrame:
    """One row: balance and, with a column home, migration, as ``quality`` has them."""
    by_proc = v.groupBy("proc_id").agg(F.sum("w").alias("load"), *([F.sum(F.when(F.col("proc_id") != F.col("home"), F.col("w")).otherwise(0)).alias("away")] if "home" in v.columns else []))
    return by_proc.agg((F.max("load") * parts / F.sum("load")).alias("balance"), *([F.sum("away").alias("migration")] if "home" in v.columns else []))
