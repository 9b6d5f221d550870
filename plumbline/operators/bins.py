"""Grid bins: voxel aggregates, occupancy, histograms, smoothing, peaks and box filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def voxel_keys(size: float, axes: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    return [bin_of(F.col(a), size).alias(f"i{a}") for a in axes]


def voxel_weighted(points: DataFrame, size: float, *, by: Sequence[str] = (), tag: str = "tag", order: str = "point_id") -> DataFrame:
    """One row a voxel: weighted mean position, unit normal of the weighted sum, mean weight, tag of the heaviest point.

    Points (x, y, z, nx, ny, nz, w, tag, order). Sums are partial before the
    shuffle, so a full voxel costs one row a task.
    """
    w = F.col("w")
    means = [(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in ("x", "y", "z")]
    sums = [F.sum(w * F.col(a)).alias(f"s{a}") for a in ("nx", "ny", "nz")]
    heaviest = F.max_by(tag, F.struct(w, -F.col(order))).alias(tag)
    grouped = points.groupBy(*by, *voxel_keys(size)).agg(*means, *sums, F.avg(w).alias("w"), F.count(F.lit(1)).alias("n"), heaviest)
    norm = F.sqrt(F.col("snx") ** 2 + F.col("sny") ** 2 + F.col("snz") ** 2)
    units = {a: F.when(norm > 0, F.col(f"s{a}") / norm).otherwise(F.lit(0.0)) for a in ("nx", "ny", "nz")}
    return grouped.withColumns(units).drop("snx", "sny", "snz")


def voxel_plain(points: DataFrame, size: float, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row a voxel: unweighted mean position and attributes."""
    return points.groupBy(*by, *voxel_keys(size)).agg(*(F.avg(c).alias(c) for c in ("x", "y", "z", *attributes)))


def voxel_layout(points: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """One row a voxel: unweighted mean position, weighted normal, mean and summed weight; voxels whose normals cancel go."""
    w = F.col("w")
    grouped = points.groupBy(*by, *voxel_keys(size)).agg(
        *(F.avg(a).alias(a) for a in ("x", "y", "z")), *(F.sum(w * F.col(a)).alias(a) for a in ("nx", "ny", "nz")), F.avg(w).alias("w"), F.sum(w).alias("w_sum")
    )
    norm = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
    grouped = grouped.withColumn("n_len", norm).where("n_len > 0")
    return grouped.withColumns({a: F.col(a) / F.col("n_len") for a in ("nx", "ny", "nz")})


def voxel_fused(points: DataFrame, size: float, cameras: DataFrame, by: Sequence[str] = (), weak: float = 0.3) -> DataFrame:
    """Fused cloud: weights + 1e-6, view of the highest score, its normal where the sum is weak, turned to its camera.

    Points (..., w, score, view_idx, point_id); cameras (by, view_idx, cx, cy, cz), a row a view.
    """
    p = points.withColumn("w", F.col("w") + 1e-6)
    w = F.col("w")
    best = F.max_by(F.struct("view_idx", *(F.col(a).alias(f"b{a}") for a in ("nx", "ny", "nz"))), F.struct("score", -F.col("point_id"))).alias("best")
    g = p.groupBy(*by, *voxel_keys(size)).agg(
        *((F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in ("x", "y", "z")), *(F.sum(w * F.col(a)).alias(f"s{a}") for a in ("nx", "ny", "nz")), F.sum(w).alias("w_sum"), F.avg(w).alias("w"), best
    )
    norm = F.sqrt(F.col("snx") ** 2 + F.col("sny") ** 2 + F.col("snz") ** 2)
    g = g.withColumn("thin", norm < weak * F.col("w_sum"))
    g = g.withColumns({a: F.when(F.col("thin"), F.col(f"best.b{a}")).otherwise(F.col(f"s{a}") / norm) for a in ("nx", "ny", "nz")}).withColumn("view_idx", F.col("best.view_idx"))
    g = g.join(cameras, [*by, "view_idx"])
    away = F.col("nx") * (F.col("cx") - F.col("x")) + F.col("ny") * (F.col("cy") - F.col("y")) + F.col("nz") * (F.col("cz") - F.col("z")) < 0
    return g.withColumns({a: F.when(away, -F.col(a)).otherwise(F.col(a)) for a in ("nx", "ny", "nz")}).drop("best", "snx", "sny", "snz", "thin", "cx", "cy", "cz")


def hash_cap(df: DataFrame, keys: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """At most n rows, a fixed sample by hash of the keys."""
    return df.orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(n)


def occupied(points: DataFrame, size: float, min_count: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Voxels with at least min_count points."""
    return points.groupBy(*by, *voxel_keys(size)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def histogram(df: DataFrame, value: str, weight: str, lo: float, hi: float, size: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, bin, h): weights in every bin of [lo, hi), empty ones included; values outside count in the end bins."""
    bins = max(3, math.ceil((hi - lo) / size))
    at = F.least(F.greatest(((F.col(value) - lo) / F.lit(size)).cast("long"), F.lit(0).cast("long")), F.lit(bins - 1).cast("long"))
    held = df.groupBy(*by, at.alias("bin")).agg(F.sum(weight).alias("h"))
    every = held.select(*by).distinct() if by else held.limit(1).select(F.lit(1).alias("one"))
    every = every.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin")).drop("one")
    return every.join(held, [*by, "bin"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))


def gaussian_kernel(sigma: float, reach: float = 4.0) -> list[float]:
    """Normalised kernel weights from -r to r, r = int(reach * sigma + 0.5)."""
    r = int(reach * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def smooth(hist: DataFrame, kernel: Sequence[float], by: Sequence[str] = (), out: str = "sm") -> DataFrame:
    """Convolution along the bins with zeros outside, as a sum of shifted rows of one window."""
    order = Window.partitionBy(*by).orderBy("bin")
    r = len(kernel) // 2
    shifted = [F.coalesce(F.lag("h", k).over(order) if k >= 0 else F.lead("h", -k).over(order), F.lit(0.0)) * w for k, w in zip(range(-r, r + 1), kernel, strict=True)]
    total = shifted[0]
    for s in shifted[1:]:
        total = total + s
    return hist.withColumn(out, total)


def peaks(hist: DataFrame, half_width: int, lo: float, size: float, by: Sequence[str] = (), sm: str = "sm") -> DataFrame:
    """Local maxima of sm with the weight of h within +-half_width bins.

    A plateau is one peak, in its middle (the lower of two middles).
    """
    order = Window.partitionBy(*by).orderBy("bin")
    flat = hist.withColumn("before", F.coalesce(F.lag(sm).over(order), F.lit(0.0)))
    flat = flat.withColumn("support", F.sum("h").over(order.rowsBetween(-half_width, half_width)))
    flat = flat.withColumn("run", F.sum((F.col(sm) != F.col("before")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = flat.groupBy(*by, "run").agg(
        F.min("bin").alias("first"), F.max("bin").alias("last"), F.first(sm).alias(sm), F.min_by("before", "bin").alias("before"), F.collect_list(F.struct("bin", "support")).alias("supports")
    )
    runs = runs.withColumn("after", F.coalesce(F.lead(sm).over(Window.partitionBy(*by).orderBy("run")), F.lit(0.0)))
    top = runs.where((F.col(sm) > F.col("before")) & (F.col(sm) > F.col("after")))
    middle = F.floor((F.col("first") + F.col("last")) / 2)
    held = F.filter("supports", lambda s: s["bin"] == middle)[0]["support"]
    return top.select(*by, middle.alias("bin"), (F.lit(lo) + (middle + 0.5) * size).alias("centre"), held.alias("support"))


def box_filter(grid: DataFrame, reach: int, value: str = "v", axes: tuple[str, str] = ("ix", "iy"), by: Sequence[str] = ()) -> DataFrame:
    """Sum over the (2 reach + 1)^2 cells around each cell that gets anything; absent cells are zero."""
    steps = F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long"))
    spread = grid.select(*by, *axes, value, F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    moved = spread.select(*by, (F.col(axes[0]) + F.col("dx")).alias(axes[0]), (F.col(axes[1]) + F.col("dy")).alias(axes[1]), value)
    return moved.groupBy(*by, *axes).agg(F.sum(value).alias(value))


def box_mean_by_overlap(cells: DataFrame, grid: DataFrame, size: float, by: Sequence[str] = ()) -> DataFrame:
    """Area-weighted mean of a grid mask over irregular cells (cell, x0, y0, x1, y1); grid (ix, iy, v), zero elsewhere.

    Each cell meets only the grid squares it overlaps.
    """
    span = lambda a, b: F.sequence(bin_of(F.col(a), size), F.greatest(F.ceil(F.col(b) / size) - 1, bin_of(F.col(a), size)).cast("long"))
    met = cells.withColumn("ix", F.explode(span("x0", "x1"))).withColumn("iy", F.explode(span("y0", "y1"))).join(grid, [*by, "ix", "iy"], "left")
    part = lambda a, b, i: F.greatest(F.least(F.col(b), (F.col(i) + 1) * size) - F.greatest(F.col(a), F.col(i) * size), F.lit(0.0))
    area = part("x0", "x1", "ix") * part("y0", "y1", "iy")
    return met.groupBy(*by, "cell").agg((F.sum(F.coalesce("v", F.lit(0.0)) * area) / F.sum(area)).alias("share"))
