"""Sequence operators: sessions, islands, slots, motion, jumps, neighbours and even subsamples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import session


def sessions(df: DataFrame, by: Sequence[str], on: Column, gap: float, tie: str, out: str = "session") -> DataFrame:
    """Numbers runs of rows no further than ``gap`` apart, from 0 within each key."""
    order = Window.partitionBy(*by).orderBy("_on", tie)
    df = df.withColumn("_on", on)
    new = F.coalesce((F.col("_on") - F.lag("_on").over(order) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_on", "_new")


def islands(df: DataFrame, by: Sequence[str], index: str, value: str) -> DataFrame:
    """(by, value, first, last, n): runs of equal values at consecutive integer indexes.

    Large tables are dealt to as many tasks as their rows ask for.
    """
    rows = df.count()
    if rows > session.ROWS_A_TASK:
        df = df.select(*by, index, value).repartition(session.tasks_of(df.sparkSession, rows), *by, value)
    same = Window.partitionBy(*by, value).orderBy(index)
    run = F.col(index) - F.row_number().over(same)
    runs = df.withColumn("_run", run).groupBy(*by, value, "_run").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.drop("_run")


def slot_best(df: DataFrame, by: Sequence[str], slot: Column, score: str, order: str, values: Sequence[str]) -> DataFrame:
    """Of each slot the row of the highest score, the first of equals."""
    best = F.max_by(F.struct(*values), F.struct(F.col(score), -F.col(order)))
    return df.groupBy(*by, slot.alias("slot")).agg(best.alias("_best")).select(*by, "slot", "_best.*")


def calm_view_per_slot(df: DataFrame, by: Sequence[str], slot: Column, valid: str, motion: str, order: str, good: float) -> DataFrame:
    """Of each slot one row: well-measured ones first, then least motion, then order."""
    w = Window.partitionBy(*by, "slot").orderBy((F.col(valid) >= good).desc(), motion, order)
    return df.withColumn("slot", slot).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def motion_score(df: DataFrame, by: Sequence[str], t: str, axes: Sequence[str]) -> DataFrame:
    """speed: distance from the row before to the row after over the time between, clipped at the ends."""
    order = Window.partitionBy(*by).orderBy(t)
    side = lambda f, c: F.coalesce(f(c).over(order), F.col(c))
    moved = sum(((side(F.lead, a) - side(F.lag, a)) ** 2 for a in axes), F.lit(0.0))
    dt = side(F.lead, t) - side(F.lag, t)
    return df.withColumn("speed", F.when(dt > 0, F.sqrt(moved) / dt).otherwise(F.lit(0.0)))


def jumps(df: DataFrame, by: Sequence[str], t: str, axes: Sequence[str], speed: float, distance: float) -> DataFrame:
    """jump: the row is further than ``distance`` from the one before, faster than ``speed``."""
    order = Window.partitionBy(*by).orderBy(t)
    moved = F.sqrt(sum(((F.col(a) - F.lag(a).over(order)) ** 2 for a in axes), F.lit(0.0)))
    dt = F.greatest(F.col(t) - F.lag(t).over(order), F.lit(1e-9))
    return df.withColumn("_d", moved).withColumn("jump", F.coalesce((F.col("_d") > distance) & (F.col("_d") / dt > speed), F.lit(False))).drop("_d")


def segments(df: DataFrame, by: Sequence[str], t: str, seconds: float, jump: str = "jump") -> DataFrame:
    """segment: fixed time bins from the first row, broken at jumps; anchor: the row nearest the middle of its bin."""
    order = Window.partitionBy(*by).orderBy(t)
    start = F.min(t).over(Window.partitionBy(*by))
    df = df.withColumn("_bin", F.floor((F.col(t) - start) / seconds)).withColumn("_mid", start + (F.col("_bin") + 0.5) * seconds)
    df = df.withColumn("_broken", F.sum(F.col(jump).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    step = F.coalesce(((F.col("_bin") != F.lag("_bin").over(order)) | (F.col("_broken") != F.lag("_broken").over(order))).cast("int"), F.lit(0))
    df = df.withColumn("_step", step).withColumn("segment", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = Window.partitionBy(*by, "segment").orderBy(F.abs(F.col(t) - F.col("_mid")), t)
    return df.withColumn("anchor", F.row_number().over(near) == 1).drop("_bin", "_mid", "_broken", "_step")


def even_subsample(df: DataFrame, by: Sequence[str], order: Sequence[str], m: int) -> DataFrame:
    """At most m rows a key, evenly spread: positions round(k (n - 1) / (m - 1)), halves to even."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    if m == 1:
        return numbered.where("_i = 0").drop("_i", "_n")
    # position i is hit by some k: the k nearest to i (m - 1) / (n - 1), or a neighbour
    k = F.round(F.col("_i") * (m - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = lambda d: (k + d >= 0) & (k + d <= m - 1) & (F.bround((k + d) * (F.col("_n") - 1) / (m - 1)) == F.col("_i"))
    return numbered.where((F.col("_n") <= m) | hit(-1) | hit(0) | hit(1)).drop("_i", "_n")


def cyclic_neighbours(df: DataFrame, by: Sequence[str], k: str, value: str) -> DataFrame:
    """previous and next value around a ring."""
    w, whole = Window.partitionBy(*by).orderBy(k), Window.partitionBy(*by)
    last, first = F.max_by(value, k).over(whole), F.min_by(value, k).over(whole)
    return df.withColumns({"previous": F.coalesce(F.lag(value).over(w), last), "next": F.coalesce(F.lead(value).over(w), first)})


def merge_close(df: DataFrame, by: Sequence[str], x: str, weight: str, tolerance: float, tie: str) -> DataFrame:
    """Sorted values chained while neighbours are within the tolerance: (by, group, value, weight), weighted means."""
    chained = sessions(df, by, F.col(x), tolerance, tie, "group")
    return chained.groupBy(*by, "group").agg((F.sum(F.col(x) * F.col(weight)) / F.sum(weight)).alias(x), F.sum(weight).alias(weight))


def owned_chunks(frames: DataFrame, by: Sequence[str], order: str, chunk: int, overlap: int) -> DataFrame:
    """(by, order, chunk): overlapping spans of ``chunk`` frames; a frame belongs to the span whose ends are farthest, the first of equals."""
    step = chunk - overlap
    w = Window.partitionBy(*by).orderBy(order)
    f = frames.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    last = F.greatest(F.ceil((F.col("_n") - chunk) / step), F.lit(0))
    lo, hi = F.greatest(F.ceil((F.col("_i") - chunk + 1) / step), F.lit(0)), F.least(F.floor(F.col("_i") / step), last)
    f = f.withColumn("chunk", F.explode(F.sequence(F.least(lo, last).cast("int"), hi.cast("int"))))
    start = F.col("chunk") * step
    depth = F.least(F.col("_i") - start, F.least(start + chunk, F.col("_n")) - 1 - F.col("_i"))
    mine = Window.partitionBy(*by, "_i").orderBy(depth.desc(), "chunk")
    return f.withColumn("_r", F.row_number().over(mine)).where("_r = 1").select(*by, order, "chunk")


def cumulative_path(df: DataFrame, by: Sequence[str], t: str, axes: Sequence[str]) -> DataFrame:
    """path: distance walked up to each row."""
    order = Window.partitionBy(*by).orderBy(t)
    moved = F.coalesce(F.sqrt(sum(((F.col(a) - F.lag(a).over(order)) ** 2 for a in axes), F.lit(0.0))), F.lit(0.0))
    return df.withColumn("_d", moved).withColumn("path", F.sum("_d").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_d")


def neighbour_average(df: DataFrame, by: Sequence[str], order: str, value: str, reach: int) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach))


def frame_median(by: Sequence[str], order: Sequence[str], value: str, reach: int) -> Column:
    """Median of the rows up to ``reach`` before and after, of which there are 2 reach + 1 at the most."""
    held = F.array_sort(F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)))
    n = F.size(held)
    return (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2


def outliers(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, reach: int, most: float) -> DataFrame:
    """outlier: further than ``most`` from the median of the rows up to ``reach`` before and after; the frame holds 2 reach + 1 rows."""
    return df.withColumn("outlier", F.abs(F.col(value) - frame_median(by, order, value, reach)) > most)


def chain_poses(steps: DataFrame, by: Sequence[str], order: str, dx: str, dy: str, yaw: str) -> DataFrame:
    """x, y and yaw after each relative step: moved by (dx, dy) in the frame reached so far, then turned.

    The product of planar transforms is a running sum: the turn before a step
    turns its shift.
    """
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turned = steps.withColumn("_b", F.coalesce(F.sum(yaw).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    c, s = F.cos("_b"), F.sin("_b")
    return turned.withColumns({
        "x": F.sum(c * F.col(dx) - s * F.col(dy)).over(upto), "y": F.sum(s * F.col(dx) + c * F.col(dy)).over(upto), "yaw": F.col("_b") + F.col(yaw)
    }).drop("_b")


def rank_share(df: DataFrame, by: Sequence[str], value: str, tie: str, out: str) -> DataFrame:
    """The row's rank by value within its key as a share from 0 to 1; alone it is 1."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value, tie)) - 1
    return df.withColumn(out, F.when(n < 2, 1.0).otherwise(rank / (n - 1)))
