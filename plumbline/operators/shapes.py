"""Directions, polygons, interval and box unions, interval arithmetic."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize

from .bins import bin_of
from .joins import hot_keys, join_few


def manhattan_angle(df: DataFrame, by: Sequence[str], angle: str, weight: str) -> DataFrame:
    """(by, theta, concentration): weighted circular mean of directions modulo 90 degrees."""
    s, c = F.sum(F.col(weight) * F.sin(4 * F.col(angle))), F.sum(F.col(weight) * F.cos(4 * F.col(angle)))
    total = F.sum(weight)
    return df.groupBy(*by).agg((F.atan2(s, c) / 4).alias("theta"), F.when(total > 0, F.hypot(s, c) / total).otherwise(F.lit(0.0)).alias("concentration"))


def refined_manhattan_angle(df: DataFrame, by: Sequence[str], angle: str, weight: str, windows: Sequence[float] = (8.0, 4.0)) -> DataFrame:
    """As manhattan_angle, taken again over directions within so many degrees of the last result.

    Equal directions are summed first, and written once for all turns.
    """
    df = materialize(df.groupBy(*by, angle).agg(F.sum(weight).alias(weight)), "directions")
    hot = hot_keys(df, by)
    found = manhattan_angle(df, by, angle, weight)
    for degrees in windows:
        off = F.abs(F.pmod(F.col(angle) - F.col("theta") + math.pi / 4, F.lit(math.pi / 2)) - math.pi / 4)
        near = join_few(df, found.select(*by, "theta"), by, hot).where(off <= math.radians(degrees)).drop("theta")
        found = manhattan_angle(near, by, angle, weight)
    return found


def up_direction(df: DataFrame, by: Sequence[str], hint: tuple[float, float, float] = (0.0, 0.0, 1.0), max_degrees: float = 30.0, rounds: int = 3) -> DataFrame:
    """(by, ux, uy, uz): mean of the normals near the last estimate, signs aligned to it, over a fixed number of rounds."""
    state = df.select(*by).distinct().select(*by, *(F.lit(h).alias(u) for h, u in zip(hint, ("ux", "uy", "uz"), strict=True)))
    least, hot = math.cos(math.radians(max_degrees)), hot_keys(df, by)
    for _ in range(rounds):
        dot = F.col("nx") * F.col("ux") + F.col("ny") * F.col("uy") + F.col("nz") * F.col("uz")
        near = join_few(df, state, by, hot).withColumn("_dot", dot).where(F.abs("_dot") >= least).withColumn("_s", F.signum("_dot") * F.col("w"))
        sums = near.groupBy(*by).agg(*(F.sum(F.col("_s") * F.col(n)).alias(f"_{n}") for n in ("nx", "ny", "nz")))
        norm = F.sqrt(F.col("_nx") ** 2 + F.col("_ny") ** 2 + F.col("_nz") ** 2)
        step = sums.where(norm > 0).select(*by, *((F.col(f"_{n}") / norm).alias(f"_{u}") for n, u in (("nx", "ux"), ("ny", "uy"), ("nz", "uz"))))
        state = state.join(step, list(by), "left").select(*by, *(F.coalesce(f"_{u}", u).alias(u) for u in ("ux", "uy", "uz")))
    return state


def ring_measures(points: DataFrame, by: Sequence[str], k: str, x: str, y: str) -> DataFrame:
    """(by, area, perimeter, n): signed shoelace area (counter-clockwise positive) of rings given by their vertices in order of k."""
    w, whole = Window.partitionBy(*by).orderBy(k), Window.partitionBy(*by)
    turn = lambda c: F.coalesce(F.lead(c).over(w), F.min_by(c, k).over(whole))
    ring = points.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), turn(x).alias("_x1"), turn(y).alias("_y1"))
    return ring.groupBy(*by).agg(
        (F.sum(F.col("_x") * F.col("_y1") - F.col("_x1") * F.col("_y")) / 2).alias("area"), F.sum(F.hypot(F.col("_x1") - F.col("_x"), F.col("_y1") - F.col("_y"))).alias("perimeter"), F.count(F.lit(1)).alias("n")
    )


def ring_boxes(points: DataFrame, by: Sequence[str], k: str, x: str, y: str) -> DataFrame:
    """(by, k, u, v): sides of the box around each ring along its edge from vertex k."""
    w, whole = Window.partitionBy(*by).orderBy(k), Window.partitionBy(*by)
    turn = lambda c: F.coalesce(F.lead(c).over(w), F.min_by(c, k).over(whole))
    edges = points.select(*by, F.col(k).alias("_k"), F.atan2(turn(y) - F.col(y), turn(x) - F.col(x)).alias("_a"))
    at = edges.join(points.select(*by, x, y), list(by))
    u, v = F.col(x) * F.cos("_a") + F.col(y) * F.sin("_a"), F.col(y) * F.cos("_a") - F.col(x) * F.sin("_a")
    return at.groupBy(*by, F.col("_k").alias(k)).agg((F.max(u) - F.min(u)).alias("u"), (F.max(v) - F.min(v)).alias("v"))


def ring_aspect(points: DataFrame, by: Sequence[str], k: str, x: str, y: str) -> DataFrame:
    """(by, aspect): long over short side of the smallest box along any edge of the ring, the first of equals."""
    boxes = ring_boxes(points, by, k, x, y)
    best = boxes.groupBy(*by).agg(F.min_by(F.struct("u", "v"), F.struct(F.round(F.col("u") * F.col("v"), 9), F.col(k))).alias("_b"))
    return best.select(*by, (F.greatest("_b.u", "_b.v") / F.nullif(F.least("_b.u", "_b.v"), F.lit(0.0))).alias("aspect"))


def points_in_rings(points: DataFrame, edges: DataFrame, by: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """(point, ring): containment by crossing parity; edges (by, ring, ax, ay, bx, by_)."""
    met = points.join(edges, list(by))
    crosses = ((F.col("ay") > F.col(y)) != (F.col("by_") > F.col(y))) & (
        F.col(x) < F.col("ax") + (F.col("bx") - F.col("ax")) * (F.col(y) - F.col("ay")) / F.nullif(F.col("by_") - F.col("ay"), F.lit(0.0))
    )
    inside = met.groupBy(*by, "point", "ring").agg(F.sum(F.coalesce(crosses, F.lit(False)).cast("int")).alias("n"))
    return inside.where("n % 2 = 1").drop("n")


def union_length(df: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """(by, length, pieces): length covered by the intervals of a key; empty intervals count nothing."""
    order = Window.partitionBy(*by).orderBy(lo, hi)
    own = df.where(F.col(hi) > F.col(lo)).withColumn("_reach", F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("_reach").isNull() | (F.col(lo) > F.col("_reach"))
    gain = F.when(fresh, F.col(hi) - F.col(lo)).otherwise(F.greatest(F.col(hi) - F.col("_reach"), F.lit(0).cast("double")))
    own = own.withColumns({"_gain": gain, "_fresh": fresh.cast("long")})
    return own.groupBy(*by).agg(F.sum("_gain").alias("length"), F.sum("_fresh").alias("pieces"))


def union_area(df: DataFrame, by: Sequence[str], box: Sequence[str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """(by, area): area covered by the boxes of a key, by slabs between their x edges."""
    x0, y0, x1, y1 = box
    own = df.where((F.col(x1) > F.col(x0)) & (F.col(y1) > F.col(y0))).select(*by, *box).distinct()
    cuts = own.select(*by, F.explode(F.array(x0, x1)).alias("_s0")).distinct()
    cuts = cuts.withColumn("_s1", F.lead("_s0").over(Window.partitionBy(*by).orderBy("_s0"))).where("_s1 IS NOT NULL")
    met = own.join(cuts, list(by)).where((F.col(x0) <= F.col("_s0")) & (F.col(x1) >= F.col("_s1")))
    slabs = union_length(met, [*by, "_s0", "_s1"], y0, y1)
    return slabs.groupBy(*by).agg(F.sum(F.col("length") * (F.col("_s1") - F.col("_s0"))).alias("area"))


def quadrature(*parts: Column) -> Column:
    total = F.lit(0.0)
    for p in parts:
        total = total + p * p
    return F.sqrt(total)


def interval(value: Column, sigma: Column, zq: float, up: Column | float = 0.0, down: Column | float = 0.0, z: float = 1.645) -> Column:
    """STRUCT<lo, hi>: value -+ zq sigma, one-sided extents widening their side only, lo not below 0 for values that are not."""
    up, down = (F.lit(float(e)) if isinstance(e, (int, float)) else e for e in (up, down))
    hi = value + zq * F.hypot(sigma, up / z)
    lo = value - zq * F.hypot(sigma, down / z)
    return F.struct(F.when(value >= 0, F.greatest(lo, F.lit(0.0))).otherwise(lo).alias("lo"), hi.alias("hi"))


def fuse_scale(cues: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, log_scale, sigma) of cues (log_scale, sigma): inverse variances; exact cues (sigma 0) win and are averaged; none gives (0, infinity)."""
    exact = F.col("sigma") <= 0
    w = F.when(~exact, 1 / (F.col("sigma") * F.col("sigma")))
    g = cues.where("log_scale IS NOT NULL AND sigma IS NOT NULL").groupBy(*by).agg(
        F.avg(F.when(exact, F.col("log_scale"))).alias("_exact"), (F.sum(w * F.col("log_scale")) / F.sum(w)).alias("_mean"), F.sum(w).alias("_w")
    )
    fused = g.select(*by, F.coalesce("_exact", "_mean").alias("log_scale"), F.when(F.col("_exact").isNotNull(), F.lit(0.0)).otherwise(1 / F.sqrt("_w")).alias("sigma"))
    every = cues.select(*by).distinct().join(fused, list(by), "left")
    return every.select(*by, F.coalesce("log_scale", F.lit(0.0)).alias("log_scale"), F.coalesce("sigma", F.lit(float("inf"))).alias("sigma"))


def noisy_or(df: DataFrame, by: Sequence[str], score: str, top: int = 3, tie: str | None = None) -> DataFrame:
    """(by, score, n): 1 - product of (1 - s) over the highest scores, held in [0, 1]."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), *([tie] if tie else []))
    held = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top)
    s = F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1 - 1e-12))
    return held.groupBy(*by).agg((1 - F.exp(F.sum(F.log1p(-s)))).alias("score"), F.count(F.lit(1)).alias("n"))


def ceiling_coverage(points: DataFrame, floor_cells: DataFrame, size: float, by: Sequence[str]) -> DataFrame:
    """(by, coverage): share of floor cells with a ceiling point above."""
    seen = points.select(*by, bin_of(F.col("x"), size).alias("ix"), bin_of(F.col("y"), size).alias("iy")).distinct().withColumn("seen", F.lit(1.0))
    return floor_cells.join(seen, [*by, "ix", "iy"], "left").groupBy(*by).agg(F.avg(F.coalesce("seen", F.lit(0.0))).alias("coverage"))
