"""Floor levels, wall lines and openings from histograms of points and from what rays see."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.kernels.greedy import spaced, suppress
from plumbline.session import discard, materialize

from . import bins
from .graph import components
from .outlines import SLANT_LEAST, SLANT_MOST, slanted, spread
from .planes import plane_fit
from .quantiles import percentiles

# Share of the strongest peak that a floor or a wall line needs, and points of a line.
FLOOR_SHARE, LINE_SHARE, LINE_SUPPORT = 0.25, 0.005, 20.0
# Of a peeled line: reach about a peak, windows of its fit, bins along and up, least points, area and columns of enough height.
REACH, NARROW, WIDE, ALONG, UP, LEAST, AREA, COLUMNS, TALL = 0.25, 0.015, 0.12, 0.05, 0.10, 30, 0.2, 5, 4


def floor_levels(points: DataFrame, by: Sequence[str], up: float = math.cos(math.radians(20.0)), size: float = 0.02, least: int = 150, reach: float = 0.05) -> DataFrame:
    """(by, z, n, slope): the lowest well-supported level of upward-facing points, and the plane through it.

    points (by, x, y, z, nx, ny, nz, w). Heights are binned between their 0.5
    and 99.5 percentiles and summed over three bins; of the bins that no other
    within two exceeds, the lowest with FLOOR_SHARE of the strongest is the
    floor. Its points are those within ``reach``.
    """
    keys = list(by)
    own = points.where(F.col("nz") / F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) > up).withColumn("w", F.col("w") + 1e-3)
    enough = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(*by)
    own = materialize(own.join(enough, keys), "upward")
    ends = materialize(percentiles(own, by, "z", {"lo": 0.005, "hi": 0.995}), "ends")
    last = F.greatest(F.ceil((F.col("hi") - F.col("lo")) / size), F.lit(1)) - 1
    held = own.join(ends, keys).withColumn("b", F.floor((F.col("z") - F.col("lo")) / size)).where((F.col("b") >= 0) & (F.col("b") <= last))
    h = held.groupBy(*by, "b").agg(F.sum("w").alias("h"), F.first(last).alias("last"))
    around = lambda df, reach, value, how: df.withColumn("b", F.explode(F.sequence(F.col("b") - reach, F.col("b") + reach))).where("b >= 0 AND b <= last").groupBy(*by, "b", "last").agg(how(value).alias(value))
    sm = materialize(around(h, 1, "h", F.sum), "levels")
    top = around(sm, 2, "h", F.max).withColumnRenamed("h", "top")
    most = sm.groupBy(*by).agg(F.max("h").alias("most"))
    peak = sm.join(top.drop("last"), [*keys, "b"]).join(most, keys).where((F.col("h") >= FLOOR_SHARE * F.col("most")) & (F.col("h") == F.col("top")))
    level = peak.groupBy(*by).agg(F.min("b").alias("b")).join(ends, keys).select(*by, (F.col("lo") + (F.col("b") + 0.5) * size).alias("z0"))
    inl = materialize(own.join(level, keys).where(F.abs(F.col("z") - F.col("z0")) < reach), "floor")
    g = inl.groupBy(*by).agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return g.join(plane_fit(inl, by, 3).select(*by, "slope"), keys, "left")


def wall_lines(points: DataFrame, by: Sequence[str], lo: float, hi: float, size: float = 0.01, sigma: float = 1.0, half_width: int = 2, apart: float = 0.04) -> DataFrame:
    """(by, direction, coord, support): wall lines of points (by, direction, offset, w), ranked by support and no nearer than ``apart`` to a stronger one."""
    keys = [*by, "direction"]
    h = materialize(bins.histogram(points, "offset", "w", lo, hi, size, keys), "offsets")
    p = bins.peaks(bins.smooth(h, bins.gaussian_kernel(sigma), keys), half_width, lo, size, keys)
    best = p.groupBy(*keys).agg(F.max("support").alias("most"))
    p = p.join(best, keys).where(F.col("support") >= F.greatest(F.lit(LINE_SUPPORT), LINE_SHARE * F.col("most")))
    return spaced(p.select(*keys, F.col("centre").alias("coord"), "support"), keys, "coord", "support", apart)


def line_through(v: np.ndarray, t: np.ndarray, z: np.ndarray, w: np.ndarray, centre: float, sigma: float) -> dict:
    """The line v = coord + slope (t - middle) through the points near a peak, flat unless a slope explains clearly more, with what of a wall it shows."""
    at, s, middle = centre, max(0.03, 3 * sigma) / 2.5, float(np.median(t))
    window = lambda s: min(max(2.5 * s, NARROW), WIDE)
    for _ in range(6):
        own = np.abs(v - at) < window(s)
        if own.sum() < 3:
            break
        at += float(np.average(v[own] - at, weights=w[own]))
        s = spread(v[own] - at, w[own])
    held, slope = np.abs(v - at) < window(s), 0.0
    if held.any():
        middle = float(np.median(t[held]))
    if len(v) >= LEAST and (len(v) > 1.15 * held.sum() or s > 1.5 * sigma):
        zero, tilt = slanted(t, v, w, at, max(2.5 * sigma, 0.02))
        r = v - zero - tilt * t
        near = np.abs(r) < max(window(s), 2.5 * sigma)
        s2 = spread(r[near], w[near]) if near.sum() > 10 else s
        if SLANT_LEAST < abs(tilt) <= SLANT_MOST and (near.sum() >= 1.15 * held.sum() or s2 < 0.7 * s):
            middle = float(np.median(t[near]))
            held, slope, at, s = near, tilt, zero + tilt * middle, s2
    cells = np.unique(np.stack((np.floor(t[held] / ALONG), np.floor(z[held] / UP)), 1), axis=0)
    columns, tall = np.unique(cells[:, 0], return_counts=True)
    columns = columns[tall >= TALL]
    runs = np.split(columns, np.flatnonzero(np.diff(columns) > 1) + 1)
    r = (v - at - slope * (t - middle))[held]
    return {
        "coord": float(at), "slope": float(slope), "middle": middle, "half": float(np.ptp(t[held]) / 2) if held.any() else 0.0, "sigma": float(s), "rms": float(np.sqrt(np.average(r * r, weights=w[held]))) if held.any() else 0.0,
        "n": int(held.sum()), "window": max(window(s), 2.5 * sigma) if slope else window(s), "area": len(cells) * ALONG * UP, "columns": max(map(len, runs)),
    }


def peel_lines(points: DataFrame, by: Sequence[str], lo: float, hi: float, sigma: float = 0.01, size: float = 0.01, most: int = 80) -> tuple[DataFrame, DataFrame]:
    """(lines, rest): wall lines of every direction, each without the points of the lines before it, and the points that no line has.

    points (by, direction, offset, along, z, w). In a round each direction's
    histogram of offsets is made of what is left; every peak that is the
    strongest within twice REACH is fitted, all directions and all such peaks
    together, and an accepted line takes its points out. A line needs LEAST
    points, AREA square metres and COLUMNS neighbouring columns of enough
    height, and may not lie on an accepted one; a peak without a line is not
    tried again. lines (by, direction, line, coord, slope, middle, half, sigma,
    rms, n, area), numbered by round, then offset.
    """
    keys, apart, c = [*by, "direction"], max(0.04, 2 * sigma), F.col
    kinds = dict(points.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    fitted = f"{head}, centre double, coord double, slope double, middle double, half double, sigma double, rms double, n long, window double, area double, columns int"
    rest = materialize(points.select(*keys, *(c(k).cast("double").alias(k) for k in ("offset", "along", "z", "w"))).withColumn("i", F.monotonically_increasing_id()), "points")
    kernel = bins.gaussian_kernel(max(max(0.01, 0.7 * sigma) / size, 0.5))
    lines = tried = floor = None

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        rows = rows.sort_values(["offset", "along", "z", "w"])
        made = line_through(*(rows[k].to_numpy() for k in ("offset", "along", "z", "w")), one["centre"], sigma)
        return pd.DataFrame([{k: one[k] for k in keys} | {"centre": one["centre"]} | made])

    for n in range(most):
        found = bins.peaks(bins.smooth(bins.histogram(rest, "offset", "w", lo, hi, size, keys), kernel, keys), max(2, round(1.5 * sigma / size)), lo, size, keys)
        if floor is None:
            found = materialize(found, "peaks")
            floor = found.groupBy(*keys).agg(F.greatest(F.lit(LINE_SUPPORT), LINE_SHARE * F.max("support")).alias("_floor"))
        found = found.join(floor, keys).where(c("support") >= c("_floor")).drop("_floor")
        if tried is not None:  # of a few lines a direction
            met = found.join(tried, keys).where((c("centre") < c("_b")) & (c("centre") > c("_a"))).select(*keys, "centre")
            found = found.join(met, [*keys, "centre"], "left_anti")
        near = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-round(2 * REACH / size), round(2 * REACH / size))
        first = materialize(found.withColumn("_best", F.max(F.struct("support", -c("centre"))).over(near)).where(c("_best") == F.struct("support", -c("centre"))).select(*keys, "centre"), "chosen")
        if first.isEmpty():
            break
        spans = first.withColumn("_bin", F.explode(F.sequence(F.floor((c("centre") - REACH) / REACH), F.floor((c("centre") + REACH) / REACH))))
        held = rest.withColumn("_bin", F.floor(c("offset") / REACH)).join(spans, [*keys, "_bin"]).where(F.abs(c("offset") - c("centre")) <= REACH)
        made = materialize(held.select(*keys, "centre", "offset", "along", "z", "w").groupBy(*keys, "centre").applyInPandas(fit, fitted), "fits")
        good = made.where((c("n") >= LEAST) & (c("area") >= AREA) & (c("columns") >= COLUMNS))
        wide = F.abs("slope") * c("half")
        if lines is not None:
            met = good.join(lines.select(*keys, (c("coord") - apart - wide).alias("_a"), (c("coord") + apart + wide).alias("_b")), keys).where((c("coord") - wide < c("_b")) & (c("coord") + wide > c("_a"))).select(*keys, "centre")
            good = good.join(met, [*keys, "centre"], "left_anti")
        good = materialize(good, "accepted")
        bare = made.join(good.select(*keys, "centre"), [*keys, "centre"], "left_anti")
        shut = good.select(*keys, (c("coord") - apart - wide).alias("_a"), (c("coord") + apart + wide).alias("_b")).union(bare.select(*keys, c("centre") - 1.5 * size, c("centre") + 1.5 * size))
        tried = materialize(shut if tried is None else tried.union(shut), "tried")
        more = good.withColumn("_round", F.lit(n))
        lines = materialize(more if lines is None else lines.union(more), "lines")
        bands = good.withColumn("_bin", F.explode(F.sequence(F.floor((c("centre") - REACH) / REACH), F.floor((c("centre") + REACH) / REACH)))).select(*keys, "_bin", "centre", "coord", "slope", "middle", "window")
        own = (F.abs(c("offset") - c("centre")) <= REACH) & (F.abs(c("offset") - c("coord") - c("slope") * (c("along") - c("middle"))) < c("window"))
        taken = rest.withColumn("_bin", F.floor(c("offset") / REACH)).join(bands, [*keys, "_bin"]).where(own).select("i")
        last, rest = rest, materialize(rest.join(taken, "i", "left_anti"), "points")
        discard(last, made)
    if lines is None:
        lines = rest.limit(0).select(*keys, *(F.lit(None).cast(t).alias(k) for k, t in (x.split() for x in fitted.split(", ")[len(keys):])), F.lit(0).alias("_round"))
    order = Window.partitionBy(*keys).orderBy("_round", "coord")
    return lines.select(*keys, F.row_number().over(order).alias("line"), "coord", "slope", "middle", "half", "sigma", "rms", "n", "area"), rest.drop("i")


def wall_grids(faces: DataFrame, rays: DataFrame, by: Sequence[str], size: float = 0.02) -> DataFrame:
    """(by, iu, iz, mass, through): weight of face points (by, u, z, w) and number of rays (by, u, z) seen through, in square bins of a wall."""
    at = [bins.bin_of(F.col("u"), size).alias("iu"), bins.bin_of(F.col("z"), size).alias("iz")]
    mass = faces.groupBy(*by, *at).agg(F.sum("w").alias("mass"))
    through = rays.groupBy(*by, *at).agg(F.count(F.lit(1)).alias("through"))
    both = mass.join(through, [*by, "iu", "iz"], "full_outer")
    return both.select(*by, "iu", "iz", F.coalesce("mass", F.lit(0.0)).alias("mass"), F.coalesce("through", F.lit(0).cast("long")).alias("through"))


def opening_candidates(cells: DataFrame, by: str, least: int = 4) -> DataFrame:
    """(by, part, u0, u1, z0, z1, n): connected see-through cells (by, iu, iz) of a wall, of ``least`` cells or more.

    by is a whole number, bins lie from -32768 to 32767; part is the least
    (iu, iz) of its cells as one number within the wall. Bins beyond stop the job.
    """
    half = 1 << 15
    cells = cells.select(F.col(by).cast("long").alias(by), F.col("iu").cast("long").alias("iu"), F.col("iz").cast("long").alias("iz"))
    fits = F.greatest(F.abs(F.col("iu") + 0.5), F.abs(F.col("iz") + 0.5)) < half
    place = F.when(fits, (F.col("iu") + half) * 65536 + F.col("iz") + half).otherwise(F.raise_error(F.lit("bins from -32768 to 32767")).cast("long"))
    own = cells.select(by, "iu", "iz", place.alias("at")).withColumn("a", F.col(by) * (1 << 32) + F.col("at"))
    beside = lambda du, dz, inside: F.when(inside, F.struct((F.col("iu") + du).alias("iu"), (F.col("iz") + dz).alias("iz")))
    steps = own.select(by, "a", F.explode(F.array(beside(1, 0, F.col("iu") < half - 1), beside(0, 1, F.col("iz") < half - 1))).alias("s")).where("s IS NOT NULL")
    edges = steps.select(by, "a", "s.iu", "s.iz").join(own.select(by, "iu", "iz", F.col("a").alias("b")), [by, "iu", "iz"]).select("a", "b")
    part = own.join(components(edges), own["a"] == F.col("node"), "left").withColumn("part", F.coalesce("component", "a"))
    g = part.groupBy(by, "part").agg(F.min("iu").alias("u0"), (F.max("iu") + 1).alias("u1"), F.min("iz").alias("z0"), (F.max("iz") + 1).alias("z1"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).withColumn("part", F.pmod("part", F.lit(1 << 32)))


def distinct_openings(fits: DataFrame, by: Sequence[str], tie: str) -> DataFrame:
    """Fits (by, tie, u0, u1, z0, z1, confidence) without those of which a more confident one covers half of the smaller."""
    boxed = fits.withColumnsRenamed({"u0": "x0", "u1": "x1", "z0": "y0", "z1": "y1", "confidence": "score"})
    return suppress(boxed, by, math.inf, 0.5, tie).withColumnsRenamed({"x0": "u0", "x1": "u1", "y0": "z0", "y1": "z1", "score": "confidence"})
