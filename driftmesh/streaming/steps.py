"""Simulation steps: a driver loop over written frames, and counts of arriving rows by cell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.space import Space
from ..operators import decomposition as dc
from ..sources.files import load, save, written


def simulate(df: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, folder: str, every: int = 1) -> DataFrame:
    """Applies ``step`` over and over; every few steps the frame is written and read, so that plans stay short and a lost executor costs little."""
    for i in range(1, steps + 1):
        df = step(df)
        if i % every == 0 or i == steps:
            save(df, f"{folder}/step-{i}")
            df = load(df.sparkSession, f"{folder}/step-{i}")
    return df


def simulate_balanced(df: DataFrame, step: Callable[[DataFrame], DataFrame], steps: int, folder: str, space: Space, div: tuple[int, ...], procs: int, balancer: dc.Balancer) -> tuple[DataFrame, DataFrame]:
    """``simulate`` with owners by cell that follow the load: the last frame (with cell and proc_id) and a log, a row a step.

    After each step rows find their cells; counts by cell give the loads.  When the balancer (its state lasts over the steps) finds a
    rebalance due, cells are dealt anew along the weighted curve, and only rows of cells that moved change their processor.  Frames
    are laid out by processor.  The log has step, n, spread_before and spread (in percent of the mean load, before and after), rebalanced,
    moved_cells and moved_rows.
    """
    spark, log = df.sparkSession, []
    owners = written(dc.decompose(spark, div, procs, "weighted", dc.costs(dc.with_cell(df, space, div))))
    for i in range(1, steps + 1):
        rows = dc.with_cell(space.wrapped(step(df)), space, div).drop(*[f"c_{d}" for d in space.dims])
        cost = written(dc.costs(rows))  # a row a cell
        weighed = owners.drop("cost").join(cost, "cell", "left").na.fill(0, ["cost"])
        spread = lambda t: t.join(spark.range(procs).select(F.col("id").alias("proc_id")), "proc_id", "right").groupBy("proc_id").agg(F.coalesce(F.sum("cost"), F.lit(0)).alias("load"))
        before = dc.unbalance(spread(weighed)).first()["spread"] or 0.0
        after, cells, moved_rows, due = before, 0, 0, balancer.due(before)
        if due:
            new = written(dc.decompose(spark, div, procs, "weighted", cost))
            found = dc.moved(owners, new).join(cost, "cell", "left").agg(F.count("*").alias("cells"), F.coalesce(F.sum("cost"), F.lit(0)).alias("n")).first()
            cells, moved_rows, owners = found["cells"], found["n"], new
            after = dc.unbalance(spread(new.drop("cost").join(cost, "cell", "left").na.fill(0, ["cost"]))).first()["spread"] or 0.0
        placed = rows.join(F.broadcast(owners.select("cell", "proc_id")), "cell")  # a row a cell of the decomposition
        save(placed, f"{folder}/step-{i}", "proc_id")
        frame = load(spark, f"{folder}/step-{i}")
        df = frame.select(*df.columns)
        log.append((i, frame.count(), float(before), float(after), due, cells, int(moved_rows)))
    schema = "step long, n long, spread_before double, spread double, rebalanced boolean, moved_cells long, moved_rows long"
    return frame, spark.createDataFrame(log, schema)


def cell_counts(stream: DataFrame, cell: str, time: str, window: str, late: str) -> DataFrame:
    """Rows by cell and time window of a stream; state older than the watermark is dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), cell).agg(F.count("*").alias("n")).select("window.start", cell, "n")
