"""Rays against boxes and planes, cells between cuts, and sight through a wall."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A ray's own start is no hit.
EPSILON = 1e-6


def first_hits(rays: DataFrame, boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ray, box, t): the first box along each ray, the one of the smaller name of equals.

    rays (by, ray, ox, oy, oz, dx, dy, dz), boxes (by, box, x0, y0, z0, x1,
    y1, z1). Slab test; a ray along a slab hits only inside it, and from
    inside a box it hits the far side.
    """
    met = rays.join(boxes, list(by))
    near, far = [], []
    for a in "xyz":
        d, o, lo, hi = F.col(f"d{a}"), F.col(f"o{a}"), F.col(f"{a}0"), F.col(f"{a}1")
        safe = F.nullif(d, F.lit(0.0))
        inside = (o >= lo) & (o <= hi)
        never = F.when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        near.append(F.coalesce(F.least((lo - o) / safe, (hi - o) / safe), never))
        far.append(F.coalesce(F.greatest((lo - o) / safe, (hi - o) / safe), -never))
    met = met.withColumns({"_in": F.greatest(*near), "_out": F.least(*far)}).where((F.col("_in") <= F.col("_out")) & (F.col("_out") > EPSILON))
    met = met.withColumn("t", F.when(F.col("_in") > EPSILON, F.col("_in")).otherwise(F.col("_out")))
    return met.groupBy(*by, "ray").agg(F.min(F.struct("t", "box")).alias("_h")).select(*by, "ray", "_h.box", "_h.t")


def between(x: Column, cuts: Column) -> Column:
    """Number of the interval of sorted cuts that x lies in, from 0; null outside. The last cut closes the last interval."""
    n = F.size(F.filter(cuts, lambda c: c <= x))
    last = F.element_at(cuts, -1)
    return F.when((n > 0) & (x < last), n - 1).when(x == last, F.size(cuts) - 2)


def crossings(rays: DataFrame, walls: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ray, wall, u, z): where rays from camera to point pass a wall's plane, in wall coordinates.

    rays (by, ray, ox, oy, oz, px, py, pz); walls (by, wall, sx, sy, ex, ey), u from the start along the wall.
    A ray along a wall, or a wall without length, has no crossing. Divisors are
    nulled, as a filter before a division may be moved behind it.
    """
    c = F.col
    length = F.hypot(c("ex") - c("sx"), c("ey") - c("sy"))
    met = rays.join(walls, list(by)).withColumn("_l", F.nullif(length, F.lit(0.0)))
    side = lambda p: ((c("ex") - c("sx")) * (c(f"{p}y") - c("sy")) - (c("ey") - c("sy")) * (c(f"{p}x") - c("sx"))) / c("_l")
    met = met.withColumns({"_a": side("o"), "_b": side("p")}).where("_a * _b < 0").withColumn("_t", c("_a") / F.nullif(c("_a") - c("_b"), F.lit(0.0)))
    at = lambda k: c(f"o{k}") + c("_t") * (c(f"p{k}") - c(f"o{k}"))
    u = ((at("x") - c("sx")) * (c("ex") - c("sx")) + (at("y") - c("sy")) * (c("ey") - c("sy"))) / c("_l")
    met = met.withColumns({"u": u, "z": at("z")})
    return met.where((c("u") >= 0) & (c("u") <= c("_l"))).select(*by, "ray", "wall", "u", "z")


def surface_coordinates(points: DataFrame, walls: DataFrame, by: Sequence[str], margin: float = 0.1) -> DataFrame:
    """points with u, v and distance on their wall, and whether they lie on it, margin included.

    points (by, wall, x, y, z), walls (by, wall, sx, sy, ex, ey, nx, ny, z0, z1), normals inward.
    On a wall without length every u is 0.
    """
    c = F.col
    length = F.hypot(c("ex") - c("sx"), c("ey") - c("sy"))
    p = points.join(walls, [*by, "wall"]).withColumn("_l", length)
    along = (c("x") - c("sx")) * (c("ex") - c("sx")) + (c("y") - c("sy")) * (c("ey") - c("sy"))
    u = F.coalesce(along / F.nullif(c("_l"), F.lit(0.0)), F.lit(0.0))
    p = p.withColumns({"u": u, "v": c("z") - c("z0"), "distance": (c("x") - c("sx")) * c("nx") + (c("y") - c("sy")) * c("ny")})
    inside = [c("u") >= -margin, c("u") <= c("_l") + margin, c("v") >= -margin, c("v") <= c("z1") - c("z0") + margin]
    return p.withColumn("inside", reduce(lambda a, b: a & b, inside)).select(*points.columns, "u", "v", "distance", "inside")
