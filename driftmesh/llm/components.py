"""Connected components by alternating stars; every step is a join or a grouping on Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _fingerprint(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _plain(c: str) -> Column:
    """The same value as a new expression: the join deals it anew after the aggregate, so that Spark can split a hub's rows."""
    return F.col(c).bitwiseXOR(F.lit(0).cast("long")).alias(c)


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, comp (the least node of its component) for all nodes but the least ones themselves.

    Large star: every node's greater neighbours are hung on its least neighbour; small star: so are its
    lesser ones.  Both keep connectivity, and about log(n) rounds end in one star a component.  Hubs are
    combined before the shuffle (min) or met in plain joins, which Spark splits.  Each round's edges are
    written, so a lost executor costs one round at most.  No edges give no rows; null ends are dropped.
    """
    e = materialize(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _fingerprint(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(_plain("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node's least neighbour itself hangs on that neighbour by its own greater-neighbour edge
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min.select(_plain("u"), "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_min.select("u", F.col("m").alias("v")))
        e = materialize(small.distinct())
        now = _fingerprint(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
