"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CLASS, materialize, maybe_broadcast

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Entries of the subset-sum table.
TABLE = 200_000
#: Slices of the hash are SLICES groups of SLICES.
SLICES = 32


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source_key, source_size, target of each source; ``sizes`` has source_key and source_size.

    Sources in code point order, null last, weigh ``weights`` in turn.  Targets share the total size by
    weight; a target stops at ``most`` times its source's size and the excess is shared again until none
    is above.  That is the level v at which sum(min(most * size, weight * v)) is the total: sources sorted
    by most * size / weight are full up to a point, and the others share what is left.

    The windows run over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("source_key.missing"), F.col("source_key.name").cast("binary"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights)) + 1).cast("double")
    cap = F.col("source_size") * most
    ranked = sizes.withColumn("w", w).withColumn("level", cap / F.col("w"))
    up = Window.orderBy("level", "source_key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("level", "source_key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(up), F.lit(0.0))
    open_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up), F.lit(0.0))
    level = ranked.withColumn("v", left / open_w)
    stop = level.withColumn("full", F.col("level") <= F.col("v"))
    # the first source that isn't full has the common level
    common = stop.withColumn("common", F.min(F.when(~F.col("full"), F.struct("level", "v"))).over(whole)["v"])
    return common.select("source_key", "source_size", F.when(F.col("full") | F.col("common").isNull(), cap).otherwise(F.least(cap, F.col("w") * F.col("common"))).alias("target"))


def _spread(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """An even start: of each length as many documents as the budget's share of the total says, rounded so that the rest carries over to the next lengths."""
    up = np.cumsum(counts)
    total = max(int((lengths * counts).sum()), 1)
    share = budget / total
    take = np.diff(np.floor(up * share), prepend=0.0).astype(np.int64)
    return np.minimum(take, counts)


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take so that their total comes near to ``budget``, never above: as near as a choice can while the table below suffices, else by less than the longest document.

    An even share over the lengths is taken first and a window of it, some of the longest documents and
    the rounding, given back; a bounded-knapsack table fits that window from all documents that are free.
    Mostly its sum is the budget itself, and nothing can be nearer.  If not, the window grows; in the end
    the even share is given up and one table fits the whole budget, which is the best sum there is.

    A table has an entry for each sum in units of the lengths' greatest common divisor.  Windows stop
    growing at ``table`` entries or 16 times the longest document, whichever is more.  A budget beyond
    that is mostly met all the same; what is left over is less than the longest document (lengths of 100,001 and 100,003 words only,
    100,000 documents each: 0.01 % of a budget of 10^9 words).
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    if budget >= int((lengths * counts).sum()):
        return counts.copy()
    unit, longest = int(np.gcd.reduce(lengths[lengths > 0])), int(lengths.max())
    start, by_length = _spread(lengths, counts, budget), np.argsort(-lengths, kind="stable")
    best, most, window = (-1, start), max(table * unit, 16 * longest), 4 * longest
    while best[0] < budget // unit * unit:
        window = min(window, most, budget)
        base = start.copy() if window < budget else np.zeros_like(counts)
        left = budget - int((lengths * base).sum())
        while left < window:
            for i in by_length[base[by_length] > 0]:
                if left >= window:
                    break
                k = max(1, int(base[i]) // 8)
                base[i] -= k
                left += k * int(lengths[i])
        take = base + _table(lengths, counts - base, left // unit, unit)
        best = max(best, (int((lengths * take).sum()), take), key=lambda x: x[0])
        if window >= min(most, budget):
            break
        window *= 8
    return best[1]


def _table(lengths: np.ndarray, spare: np.ndarray, size: int, unit: int) -> np.ndarray:
    """The bounded knapsack: the counts whose total, in units, comes nearest to ``size`` from below."""
    take = np.zeros_like(spare)
    by = np.full(size + 1, -1, np.int32)
    reach = np.zeros(size + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    usable = np.flatnonzero((lengths > 0) & (lengths // unit <= size) & (spare > 0))
    for i in usable[np.argsort(-lengths[usable], kind="stable")].tolist():  # longest first, so that few documents fill the rest
        w = int(lengths[i]) // unit
        n, k = min(int(spare[i]), size // w), 1
        while n > 0 and not reach[size]:
            k = min(k, n)
            step = k * w
            new = np.zeros_like(reach)
            if step <= size:
                new[step:] = reach[:-step]
            new &= ~reach
            by[new] = len(items)
            reach |= new
            items.append((i, k))
            n, k = n - k, 2 * k
        if reach[size]:
            break
    s = int(np.flatnonzero(reach)[-1])
    while s > 0:
        i, k = items[by[s]]
        take[i] += k
        s -= k * int(lengths[i]) // unit
    return take


def _plans(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's counts by length become the number of repeats that all get and of documents that get one more."""
    rows = rows.sort_values("size")
    lengths, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    total, target = int((lengths * counts).sum()), float(rows["target"].iloc[0])
    repeats = int(min(target // total, 3)) if total else 1
    extra = fit_budget(lengths, counts, int(target - repeats * total)) if total and repeats < 3 else np.zeros(len(rows), np.int64)
    return pd.DataFrame({"source_key": rows["source_key"], "size": lengths, "repeats": repeats, "extra": extra})


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 7, broadcast_rows: int = 100_000, keep: tuple[str, ...] = ()) -> DataFrame:
    r"""One row per document: doc_id, source, size, source_size, target, repeats, taken (= repeats * size), and the row's columns that ``keep`` names.

    Size is the number of ``[^\x20\x09-\x0D]+`` in the text.  ``targets`` gives each source's target; every
    document of a source is repeated as often as fits whole, at most 3 times in all, and what is left of
    the target is fitted by ``fit_budget`` over the source's counts of documents by exact length.  Of each
    length the documents with the smallest seeded hashes are taken.

    A source's group in the fitting has one row a distinct length, not one a document.  Ranks by hash are
    taken in 1,024 slices of the hash, and slices are summed in groups of 32 before, so that a source and
    length with a third of all rows is spread over that many tasks' groups.  Documents meet one table, by
    source, length and slice; sources are broadcast if they are counted as few.

    Null text has size 0; a null source is a source of its own, the last.  Sources of size 0 have target
    0 and their documents repeats 1, taken 0.  Repeated rows are separate documents; which of two equal
    rows is taken doesn't show.  Reruns agree.  An empty table gives no rows.
    """
    words = F.filter(F.split(F.coalesce("text", F.lit("")), WS_CLASS + "+"), lambda x: x != "")
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    slices, group = F.pmod(h, F.lit(SLICES * SLICES)).cast("int"), F.floor(F.col("slice") / SLICES).cast("int").alias("g")
    sized = materialize(docs.select("doc_id", key.alias("source_key"), F.size(words).cast("long").alias("size"), h.alias("h"), slices.alias("slice"), *keep))
    per_slice = materialize(sized.groupBy("source_key", "size", "slice").agg(F.count("*").alias("n")).withColumn("g", group))
    per_group = materialize(per_slice.groupBy("source_key", "size", "g").agg(F.sum("n").alias("n")))
    by_length = per_group.groupBy("source_key", "size").agg(F.sum("n").alias("n"))
    shares = materialize(targets(by_length.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights))
    few = maybe_broadcast(shares, shares.count(), broadcast_rows)
    plan = by_length.join(few.drop("source_size"), "source_key").groupBy("source_key").applyInPandas(_plans, "source_key struct<missing:boolean,name:string>, size long, repeats int, extra long")

    def before(*by: str) -> Column:
        return F.coalesce(F.sum("n").over(Window.partitionBy("source_key", "size", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    of_group = per_group.select("source_key", "size", "g", before("g").alias("first")).join(plan, ["source_key", "size"]).join(few, "source_key")
    offsets = per_slice.select("source_key", "size", "g", "slice", before("g", "slice").alias("before")).join(of_group, ["source_key", "size", "g"]).drop("g")
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("source_key", "size", "slice").orderBy("h", "doc_id")))
    repeats = F.col("repeats") + (F.col("first") + F.col("before") + F.col("rank") <= F.col("extra")).cast("int")
    # by merge: the window has dealt and sorted the documents by these keys, so only the offsets move
    out = ranked.join(offsets.hint("merge"), ["source_key", "size", "slice"]).withColumn("repeats", repeats)
    return out.select("doc_id", F.when(~F.col("source_key.missing"), F.col("source_key.name")).alias("source"), "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), *keep)
