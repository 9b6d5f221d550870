"""From image regions to the plan: rooms, surfaces, sizes on a surface, placed objects, and evidence of faces."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import segment_distance
from plumbline.session import materialize

from .bins import bin_of
from .quantiles import centred_quantiles, percentiles, widened
from .shapes import points_in_rings

# Shift towards the camera, snap to a room, wall tolerances, height tolerances, the facing that a loose wall needs,
# distance from a mask's plane, pixels and share with geometry that a mask needs, and how far behind its surround a mask is seen through.
ROOM_SHIFT, ROOM_SNAP = 0.05, 0.5
WALL_TOL, WALL_LOOSE, HEIGHT_TOL, EDGE_HEIGHT_TOL = 0.15, 0.3, 0.3, 0.1
HORIZONTAL_COS, VERTICAL_SIN, FACING_COS = 0.82, 0.57, 0.9
OFF_PLANE, MIN_PIXELS, MIN_VALID, BEHIND = 0.08, 3.0, 0.25, 0.15
#: Metres of a plan cell in which points meet the rooms around them.
CELL = 1.0


def towards_camera(x: Column, y: Column, cx: Column, cy: Column, shift: float = ROOM_SHIFT) -> tuple[Column, Column]:
    """A point moved by ``shift`` towards the camera, no further than it."""
    d = F.hypot(cx - x, cy - y)
    share = F.when(d > 1e-6, F.least(F.lit(shift), d) / d).otherwise(0.0)
    return x + (cx - x) * share, y + (cy - y) * share


def rooms_of(points: DataFrame, edges: DataFrame, by: Sequence[str], snap: float = ROOM_SNAP) -> DataFrame:
    """(by, point, ring, distance): the first room that holds each point, else the nearest within ``snap``.

    points (by, point, x, y), edges (by, ring, ax, ay, bx, by_) of rooms by
    ring number. For the snap a point meets only edges whose cells, widened by
    the snap, hold it.
    """
    inside = points_in_rings(points, edges, by).groupBy(*by, "point").agg(F.min("ring").alias("ring")).withColumn("distance", F.lit(0.0))
    rest = points.join(inside, [*by, "point"], "left_anti")
    spread = lambda a, b: F.explode(F.sequence(bin_of(F.least(a, b) - snap, CELL), bin_of(F.greatest(a, b) + snap, CELL)))
    near = edges.withColumn("_cx", spread("ax", "bx")).withColumn("_cy", spread("ay", "by_"))
    met = rest.withColumns({"_cx": bin_of(F.col("x"), CELL), "_cy": bin_of(F.col("y"), CELL)}).join(near, [*by, "_cx", "_cy"])
    c = F.col
    gap = met.withColumn("distance", segment_distance(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by_"))).where(F.col("distance") <= snap)
    best = gap.groupBy(*by, "point").agg(F.min(F.struct("distance", "ring")).alias("_b")).select(*by, "point", "_b.ring", "_b.distance")
    return inside.select(*by, "point", "ring", "distance").union(best)


def assign_surfaces(masks: DataFrame, walls: DataFrame, rooms: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, surface, method, distance): the wall, floor or ceiling a lifted mask lies on, or the reason why none.

    masks (by, mask, room, x, y, z, nx, ny, nz) with unit mean normals, walls
    (by, room, wall, sx, sy, ex, ey, nx, ny), rooms (by, room, floor_z,
    ceiling_z). A mask that is not horizontal takes the nearest wall within
    WALL_TOL, or WALL_LOOSE if it is upright and faces as the wall does; then
    the floor or ceiling within the height tolerance. A room's walls are few.
    """
    c = F.col
    w = walls.select(*by, "room", "wall", "sx", "sy", "ex", "ey", c("nx").alias("wx"), c("ny").alias("wy"))
    flat = F.abs("nz") >= HORIZONTAL_COS
    met = masks.where(c("room").isNotNull() & ~flat).join(w, [*by, "room"])
    met = met.withColumn("d", segment_distance(c("x"), c("y"), c("sx"), c("sy"), c("ex"), c("ey")))
    near = met.groupBy(*by, "mask").agg(F.min_by(F.struct("wall", "d", "nx", "ny", "nz", "wx", "wy"), F.struct("d", "wall")).alias("w"))
    loose = (F.abs("w.nz") <= VERTICAL_SIN) & (c("w.d") <= WALL_LOOSE) & (c("w.nx") * c("w.wx") + c("w.ny") * c("w.wy") >= FACING_COS)
    near = near.withColumn("how", F.when(c("w.d") <= WALL_TOL, "wall").when(loose, "wall_loose")).where("how IS NOT NULL").select(*by, "mask", "how", c("w.wall").alias("wall"), c("w.d").alias("wall_d"))
    m = masks.join(near, [*by, "mask"], "left").join(rooms, [*by, "room"], "left")
    low, high = F.abs(c("z") - c("floor_z")), F.abs(c("z") - c("ceiling_z"))
    close = F.least(low, high) <= F.when(flat, HEIGHT_TOL).otherwise(EDGE_HEIGHT_TOL)
    level = F.when(low <= high, "floor").otherwise("ceiling")
    method = F.when(c("room").isNull(), "outside_rooms").when(c("how").isNotNull(), c("how")).when(close, level).otherwise("off_surface")
    surface = F.when(method.isin("wall", "wall_loose"), c("wall")).when(method == "floor", F.concat("room", F.lit("-FLOOR"))).when(method == "ceiling", F.concat("room", F.lit("-CEIL")))
    gap = F.when(method.isin("wall", "wall_loose"), c("wall_d")).when(method.isin("floor", "ceiling"), F.least(low, high))
    return m.select(*by, "mask", surface.alias("surface"), method.alias("method"), gap.alias("distance"))


def pixel_areas(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """pixels with ok and the area vector (ax, ay, az) of each: derivative along columns times derivative along rows.

    pixels (by, i, j, x, y, z, valid) of a raster of world points. A derivative
    is the mean of both one-sided differences where these agree within a
    factor of two, else the shorter one, so that a step in depth does not
    widen the pixels at its edge. ok: geometry and both derivatives exist.
    """
    c = F.col
    whole = F.coalesce(c("valid"), F.lit(False))
    for a in "xyz":
        whole = whole & c(a).isNotNull() & ~F.isnan(a) & (F.abs(a) != float("inf"))
    p = pixels.withColumn("_v", whole).withColumn("_p", F.when(c("_v"), F.array(*(c(a).cast("double") for a in "xyz"))))
    minus = lambda a, b: F.zip_with(a, b, lambda s, t: s - t)
    size = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, t: s + t * t))
    for name, across, along in (("_dj", "i", "j"), ("_di", "j", "i")):
        order = Window.partitionBy(*by, across).orderBy(along)
        p = p.withColumn("_f", F.when(F.lead(along).over(order) == c(along) + 1, minus(F.lead("_p").over(order), c("_p"))))
        p = p.withColumn("_b", F.when(F.lag(along).over(order) == c(along) - 1, minus(c("_p"), F.lag("_p").over(order))))
        p = p.withColumns({"_nf": size(c("_f")), "_nb": size(c("_b"))})
        agree = F.greatest("_nf", "_nb") <= 2 * F.least("_nf", "_nb")
        mean = F.zip_with("_f", "_b", lambda s, t: (s + t) / 2)
        p = p.withColumn(name, F.when(c("_f").isNull(), c("_b")).when(c("_b").isNull(), c("_f")).when(agree, mean).when(c("_nf") <= c("_nb"), c("_f")).otherwise(c("_b")))
    e = lambda a, k: F.get(a, F.lit(k))
    cross = lambda k, m: e("_dj", k) * e("_di", m) - e("_dj", m) * e("_di", k)
    ok = c("_v") & c("_dj").isNotNull() & c("_di").isNotNull()
    return p.withColumns({"ax": cross(1, 2), "ay": cross(2, 0), "az": cross(0, 1), "ok": ok}).drop("_v", "_p", "_f", "_b", "_nf", "_nb", "_dj", "_di")


def mask_coverage(masks: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, i, j, coverage): the share of each raster pixel that a mask of another resolution covers.

    masks (by, mask, mi, mj, mask_h, mask_w, h, w): a row a set pixel of the
    mask, both rasters spanning the same field of view. A set pixel gives each
    raster pixel it meets their common area; repeated rows count once.
    """
    c = F.col
    own = masks.select(*by, "mask", "mi", "mj", "mask_h", "mask_w", "h", "w").distinct()
    for at, n, out, size in (("mi", "mask_h", "i", "h"), ("mj", "mask_w", "j", "w")):
        # in whole steps of 1 / n of a raster pixel, so that pixels which only touch share nothing
        lo, hi = c(at) * c(size), (c(at) + 1) * c(size)
        own = own.withColumn(out, F.explode(F.sequence(F.floor(lo / c(n)), F.ceil(hi / c(n)) - 1)))
        own = own.withColumn(f"_{out}", (F.least(hi, (c(out) + 1) * c(n)) - F.greatest(lo, c(out) * c(n))) / c(n))
    return own.groupBy(*by, "mask", "i", "j").agg(F.least(F.sum(c("_i") * c("_j")), F.lit(1.0)).alias("coverage"))


def mask_rings(covered: DataFrame, shapes: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """(by, mask, i, j, coverage): the band of ``width`` pixels around each mask's core, which is what it covers by half; shapes (by, h, w)."""
    core = covered.where("coverage >= 0.5").select(*by, "mask", "i", "j")
    steps = F.sequence(F.lit(-width).cast("long"), F.lit(width).cast("long"))
    grown = core.withColumn("i", F.explode(F.transform(steps, lambda k: F.col("i") + k))).distinct()
    grown = grown.withColumn("j", F.explode(F.transform(steps, lambda k: F.col("j") + k))).distinct()
    band = grown.join(core, [*by, "mask", "i", "j"], "left_anti").join(shapes, list(by)).where("i >= 0 AND j >= 0 AND i < h AND j < w")
    return band.select(*by, "mask", "i", "j", F.lit(1.0).alias("coverage"))


def lift_masks(covered: DataFrame, areas: DataFrame, cameras: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, i, j, coverage, valid, x, y, z, ax, ay, az, area, nx, ny, nz): masks on the world points of their view.

    covered (by, mask, i, j, coverage), areas as of pixel_areas, cameras (by,
    cx, cy, cz). A covered pixel without geometry, or without area, stays with
    valid false. Normals are turned to the camera.
    """
    c = F.col
    m = covered.where("coverage > 0.001").join(areas.where("ok").select(*by, "i", "j", "x", "y", "z", "ax", "ay", "az"), [*by, "i", "j"], "left").join(cameras, list(by))
    area = F.sqrt(c("ax") ** 2 + c("ay") ** 2 + c("az") ** 2)
    m = m.withColumn("area", area).withColumn("valid", F.coalesce(c("area") > 1e-12, F.lit(False)))
    turn = F.when(c("ax") * (c("cx") - c("x")) + c("ay") * (c("cy") - c("y")) + c("az") * (c("cz") - c("z")) < 0, -1.0).otherwise(1.0) / F.nullif(c("area"), F.lit(0.0))
    out = m.select(*by, "mask", "i", "j", "coverage", "valid", "x", "y", "z", "ax", "ay", "az", "area", *((c(f"a{k}") * turn).alias(f"n{k}") for k in "xyz"))
    return materialize(out, "lifted")  # read by the medians, the assignment and the sizes


def mask_medians(lifted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, x, y, z, nx, ny, nz, valid_share): weighted median place, unit mean normal (0 if none) and share with geometry of lifted masks."""
    c, keys = F.col, [*by, "mask"]
    weighed = lifted.withColumn("_w", F.when(c("valid"), c("coverage") * c("area")))
    place = centred_quantiles(weighed.where("valid"), keys, {a: (a, "_w", 0.5) for a in "xyz"})
    sums = weighed.groupBy(*keys).agg(*(F.sum(c("_w") * c(f"n{k}")).alias(f"_n{k}") for k in "xyz"), (F.coalesce(F.sum(F.when(c("valid"), c("coverage"))), F.lit(0.0)) / F.sum("coverage")).alias("valid_share"))
    size = F.sqrt(c("_nx") ** 2 + c("_ny") ** 2 + c("_nz") ** 2)
    out = sums.join(place, keys, "left").select(*keys, *"xyz", *(F.coalesce(F.when(size > 1e-12, c(f"_n{k}") / F.nullif(size, F.lit(0.0))), F.lit(0.0)).alias(f"n{k}") for k in "xyz"), "valid_share")
    return materialize(out, "medians")  # a row a mask, read several times by the assignment


def see_through(covered: DataFrame, pixels: DataFrame, ring: DataFrame, by: Sequence[str], behind: float = BEHIND) -> DataFrame:
    """(by, mask, share): the part of a mask's core without geometry, or further than ``behind`` behind the plane of the band around it.

    pixels (by, i, j, x, y, z, valid), ring a lifted band as of mask_rings;
    with fewer than three lifted pixels in the band the share is 0. Openings
    and mirrors show depth beyond the wall, a sheet on the wall none.
    """
    c, keys = F.col, [*by, "mask"]
    enough = ring.where("valid").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
    plane = mask_medians(ring, by).join(enough, keys).select(*keys, *(c(a).alias(f"p{a}") for a in "xyz"), "nx", "ny", "nz")
    inside = covered.where("coverage >= 0.5").join(pixels.where("valid").select(*by, "i", "j", "x", "y", "z"), [*by, "i", "j"], "left").join(plane, keys, "left")
    depth = sum(((c(f"p{a}") - c(a)) * c(f"n{a}") for a in "xyz"), F.lit(0.0))
    gone = c("px").isNotNull() & (c("x").isNull() | (depth > behind))
    return inside.groupBy(*keys).agg(F.avg(F.coalesce(gone, F.lit(False)).cast("double")).alias("share"))


def on_surfaces(lifted: DataFrame, surfaces: DataFrame, edges: DataFrame, by: Sequence[str], margin: float = 0.1) -> DataFrame:
    """Lifted pixels with u, v, d, projected and on_surface of the surface that each mask was assigned to.

    surfaces (by, mask, room, kind wall/floor/ceiling, sx, sy, ex, ey, nx, ny,
    floor_z, ceiling_z), a wall's ends and inward normal null for the others;
    edges (by, room, ax, ay, bx, by_) of rooms. On a wall u runs from its
    start and v from the floor, else both are plan coordinates. d is the
    distance into the room, projected the pixel's area on the surface. A
    pixel lies on the surface within ``margin`` of its extent.
    """
    c, keys = F.col, [*by, "mask"]
    p = lifted.drop("nx", "ny", "nz").join(surfaces, keys)
    wall, length = c("kind") == "wall", F.hypot(c("ex") - c("sx"), c("ey") - c("sy"))
    p = p.withColumn("_l", F.greatest(length, F.lit(1e-12)))
    along = ((c("x") - c("sx")) * (c("ex") - c("sx")) + (c("y") - c("sy")) * (c("ey") - c("sy"))) / c("_l")
    inward = F.when(wall, (c("x") - c("sx")) * c("nx") + (c("y") - c("sy")) * c("ny")).when(c("kind") == "floor", c("z") - c("floor_z")).otherwise(c("ceiling_z") - c("z"))
    p = p.withColumns({"u": F.when(wall, along).otherwise(c("x")), "v": F.when(wall, c("z") - c("floor_z")).otherwise(c("y")), "d": inward})
    p = p.withColumn("projected", F.abs(F.when(wall, c("ax") * c("nx") + c("ay") * c("ny")).otherwise(c("az"))))
    flat = p.where("valid AND kind <> 'wall'").select(*by, "room", F.struct("mask", "i", "j").alias("point"), "x", "y")
    held = rooms_of(flat, edges.withColumn("ring", F.lit(0)), [*by, "room"], margin).select(*by, "point.*", F.lit(True).alias("_in"))
    fits = (c("u") >= -margin) & (c("u") <= c("_l") + margin) & (c("v") >= -margin) & (c("v") <= c("ceiling_z") - c("floor_z") + margin)
    p = p.join(held, [*keys, "i", "j"], "left").withColumn("on_surface", F.coalesce(F.when(wall, fits).otherwise(c("_in")), F.lit(False)))
    return p.select(*keys, "i", "j", "coverage", "valid", "area", "u", "v", "d", "projected", "on_surface")


def measure_on_surface(pixels: DataFrame, by: Sequence[str], off_plane: float = OFF_PLANE, q_lo: float = 0.02, q_hi: float = 0.98, least: float = MIN_PIXELS, least_valid: float = MIN_VALID) -> DataFrame:
    """(by, area, width, height, length, n, u0, u1, v0, v1, pixel, inlier, valid_share): size of each mask on its surface.

    pixels (by, u, v, d, coverage, projected, on_surface, valid, and area if
    there is one): coverage is the share of the pixel in the mask, projected
    its area on the surface. Pixels further than off_plane from the mask's
    median distance (weighted by area, else by projected), or beyond the
    surface, do not count; pixels without geometry (not valid) raise the area
    in proportion. Lengths are robust extents along u, v and the principal
    axis; pixel is the side of a typical pixel. Masks with less geometry than
    least_valid, less coverage than least, or without area are left out.
    """
    c, keys = F.col, list(by)
    ok = pixels.where("valid")
    weight = "area" if "area" in pixels.columns else "projected"
    share = pixels.groupBy(*by).agg(F.sum("coverage").alias("_total"), F.coalesce(F.sum(F.when(c("valid"), c("coverage"))), F.lit(0.0)).alias("_valid"))
    mid = centred_quantiles(ok.withColumn("_a", c("coverage") * c(weight)), keys, {"_d0": ("d", "_a", 0.5)})
    inl = ok.join(mid, keys).where((F.abs(c("d") - c("_d0")) <= off_plane) & c("on_surface")).withColumn("_wa", c("coverage") * c("projected"))
    inl = materialize(inl.select(*by, "u", "v", "coverage", "projected", "_wa"), "on-surface")
    w, s = c("_wa"), F.nullif(F.sum("_wa"), F.lit(0.0))
    sums = inl.groupBy(*by).agg(F.sum("coverage").alias("_c"), F.sum(w).alias("_s"), (F.sum(w * c("u")) / s).alias("_mu"), (F.sum(w * c("v")) / s).alias("_mv"), F.count(F.lit(1)).alias("n"))
    sums = sums.where((c("_c") >= least) & (c("_s") > 0)).join(share, keys).where(c("_valid") >= least_valid * c("_total"))
    own = inl.join(sums.select(*by, "_mu", "_mv"), keys)
    du, dv = c("u") - c("_mu"), c("v") - c("_mv")
    turn = own.groupBy(*by).agg((F.atan2(2 * F.sum(w * du * dv), F.sum(w * du * du) - F.sum(w * dv * dv)) / 2).alias("_t"))
    own = own.join(turn, keys).withColumn("_along", du * F.cos("_t") + dv * F.sin("_t"))
    sides = {"u": "u", "v": "v", "l": "_along"}
    ends = centred_quantiles(own, keys, {f"_{a}{k}": (x, "_wa", q) for a, x in sides.items() for k, q in ((0, q_lo), (1, q_hi))} | {"_px": ("projected", "coverage", 0.5)})
    span = {f"{a}{k}": end for a in sides for k, end in enumerate(widened(c(f"_{a}0"), c(f"_{a}1"), q_lo, q_hi))}
    lengths = [(span[f"{a}1"] - span[f"{a}0"]).alias(name) for a, name in (("u", "width"), ("v", "height"), ("l", "length"))]
    area = c("_s") * c("_total") / F.greatest(c("_valid"), F.lit(1e-12))
    rest = [(c("_c") / F.greatest(c("_valid"), F.lit(1e-12))).alias("inlier"), (c("_valid") / c("_total")).alias("valid_share")]
    return sums.join(ends, keys).select(*by, area.alias("area"), *lengths, "n", *(span[k].alias(k) for k in ("u0", "u1", "v0", "v1")), F.sqrt(F.greatest("_px", F.lit(0.0))).alias("pixel"), *rest)


def place_objects(points: DataFrame, by: Sequence[str], w: str = "w") -> DataFrame:
    """(by, x, y, x0, x1, y0, y1, z0, z1, n): weighted median place and 5 to 95 percent ranges of lifted objects of three points or more."""
    n = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_w")).where("n >= 3 AND _w > 0").drop("_w")
    asks = {"x": ("x", w, 0.5), "y": ("y", w, 0.5)} | {f"{a}{k}": (a, w, q) for a in "xyz" for k, q in ((0, 0.05), (1, 0.95))}
    return n.join(centred_quantiles(points, by, asks), list(by))


def resolve_class(cls: Column, score: Column, scores: Column, has_line: Column, tile: Column, floors: dict[str, float], areas: Sequence[str]) -> Column:
    """STRUCT<cls, reason> of a damage detection by its evidence.

    A crack without a thin line takes its best area class (scores, a map) over
    that class's floor, in the full view only, or goes; any class with a line
    is a crack; other area classes need their floor and the full view.
    """
    floor = lambda c: reduce(lambda w, kv: w.when(c == kv[0], kv[1]), list(floors.items())[1:], F.when(c == next(iter(floors)), floors[next(iter(floors))]))
    listed = F.array(*(F.struct(F.coalesce(F.try_element_at(scores, F.lit(a)), F.lit(-1.0)).alias("s"), F.lit(-i).alias("o"), F.lit(a).alias("c")) for i, a in enumerate(areas)))
    best = F.array_max(listed)
    said = lambda c, r: F.struct(c.alias("cls"), r.alias("reason"))
    none, text = F.lit(None).cast("string"), lambda x: F.lit(x)
    again = (best["s"] >= 0) & (best["s"] >= floor(best["c"])) & ~tile
    crack = F.when(has_line, said(F.lit("crack"), none)).when(again, said(best["c"], text("relabelled"))).otherwise(said(none, text("crack_without_line")))
    other = F.when(has_line, said(F.lit("crack"), text("thin_line"))).when(tile, said(none, text("tile_area"))).when(score < floor(cls), said(none, text("below_floor"))).otherwise(said(cls, none))
    return F.when(cls == "crack", crack).otherwise(other)


def face_evidence(edges: DataFrame, lines: DataFrame, by: Sequence[str], tolerance: float = 0.015, sparse: int = 5) -> DataFrame:
    """(by, edge, line, n, flag): the observed face on each outline edge and what is odd about it.

    edges (by, edge, axis, coord, sign, ta, tb), lines (by, line, axis, coord,
    sign, synthetic, slope, points array<double> of places along the line).
    The nearest line of the axis and sign within the tolerance counts; without
    one the edge is unobserved (a closure line), a mismatch (another sign) or
    missing. Few points between the ends are sparse; over a degree is slanted.
    """
    c = F.col
    l = lines.select(*by, "axis", "line", c("coord").alias("lc"), c("sign").alias("ls"), "synthetic", "slope", "points", bin_of(c("coord"), tolerance).alias("_b"))  # noqa: E741
    e = edges.withColumn("_b", F.explode(F.array(*(bin_of(c("coord"), tolerance) + d for d in (-1, 0, 1)))))
    near = e.join(l, [*by, "axis", "_b"]).where(F.abs(c("lc") - c("coord")) <= tolerance)
    own = near.where("NOT synthetic AND ls = sign").groupBy(*by, "edge").agg(F.min_by(F.struct("line", "slope", "points"), F.struct(F.abs(c("lc") - c("coord")), "line")).alias("m"))
    rest = near.groupBy(*by, "edge").agg(F.bool_or("synthetic").alias("made"), F.bool_or(~c("synthetic")).alias("seen"))
    j = edges.join(own, [*by, "edge"], "left").join(rest, [*by, "edge"], "left")
    n = F.size(F.filter("m.points", lambda t: (t >= c("ta")) & (t <= c("tb"))))
    none = F.when(F.coalesce("made", F.lit(False)), "wall_unobserved").when(F.coalesce("seen", F.lit(False)), "wall_face_mismatch").otherwise("wall_face_missing")
    flag = F.when(c("m").isNull(), none).when(n < sparse, "wall_face_sparse").when(F.abs("m.slope") > 0.017455064928217585, "wall_slanted")
    return j.select(*by, "edge", c("m.line").alias("line"), F.when(c("m").isNotNull(), n).otherwise(0).alias("n"), flag.alias("flag"))


def closure_lines(free: DataFrame, lines: DataFrame, by: Sequence[str], size: float, reach: float = 0.25) -> DataFrame:
    """(by, axis, coord): lines where free bins (by, ix, iy) run further than ``reach`` past the outermost wall (by, axis, coord), or there is none."""
    spans = []
    for axis, bin_ in enumerate(("ix", "iy")):
        p = percentiles(free, by, bin_, {"lo": 0.005, "hi": 0.995})
        spans.append(p.select(*by, F.lit(axis).alias("axis"), ((F.col("lo") + 0.5) * size).alias("lo"), ((F.col("hi") + 0.5) * size).alias("hi")))
    ends = lines.groupBy(*by, "axis").agg(F.min("coord").alias("a"), F.max("coord").alias("b"))
    j = spans[0].union(spans[1]).join(ends, [*by, "axis"], "left")
    low = F.when(F.col("a").isNull() | (F.col("lo") < F.col("a") - reach), F.col("lo"))
    high = F.when(F.col("b").isNull() | (F.col("hi") > F.col("b") + reach), F.col("hi"))
    return j.select(*by, "axis", F.explode(F.array_compact(F.array(low, high))).alias("coord"))


def closed_profile(bins: DataFrame, by: Sequence[str], size: float, door: float = 1.4, gap: float = 0.5, piece: float = 0.4, jamb: float = 0.1, corridors: DataFrame | None = None) -> DataFrame:
    """(by, bin, closed): wall evidence along lines with door heads, short gaps and doors without a head counted as wall.

    bins (by, bin, solid, upper), every bin of a line. A run with evidence at
    head height only is closed up to the size of a door. A gap inside is
    closed if it is short, or if it is a door's size, has wall on both sides,
    a substantial piece on one, and is not in corridors (by, bin: its first).
    Pieces are counted with holes of one bin bridged.
    """
    keys = list(by)
    order = Window.partitionBy(*by).orderBy("bin")
    runs = lambda df: df.withColumn("run", F.col("bin") - F.row_number().over(order))
    heads = runs(bins.where("upper AND NOT solid"))
    fits = heads.groupBy(*by, "run").agg(F.min("bin").alias("a"), (F.count(F.lit(1)) * size).alias("long")).where(F.col("long") <= door + 1e-9)
    shut = heads.join(fits.select(*by, "run"), [*keys, "run"], "left_semi").select(*by, "bin").withColumn("head", F.lit(True))
    own = bins.join(shut, [*keys, "bin"], "left").withColumn("closed", F.col("solid") | F.coalesce("head", F.lit(False)))
    ends = bins.groupBy(*by).agg(F.min("bin").alias("first"), F.max("bin").alias("last"))
    gaps = runs(own.where("NOT closed")).groupBy(*by, "run").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b")).join(ends, keys).where("a > first AND b <= last")
    solid = bins.withColumns({"before": F.coalesce(F.lag("solid").over(order), F.lit(False)), "after": F.coalesce(F.lead("solid").over(order), F.lit(False))})
    piece_of = lambda cond: runs(solid.where(cond)).groupBy(*by, "run").agg(F.min("bin").alias("p"), F.max("bin").alias("q")).drop("run")
    left, right = piece_of("solid OR before"), piece_of("solid OR after")
    at = solid.select(*by, "bin", "solid")
    g = gaps.join(at.select(*by, (F.col("bin") + 1).alias("a"), F.col("solid").alias("sl")), [*keys, "a"]).join(at.select(*by, F.col("bin").alias("b"), F.col("solid").alias("sr")), [*keys, "b"])
    g = g.withColumns({"l0": F.when(F.col("sl"), F.col("a") - 1).otherwise(F.col("a") - 2), "r0": F.when(F.col("sr"), F.col("b")).otherwise(F.col("b") + 1)})
    ll = g.join(left, keys).where("p <= l0 AND l0 <= q").select(*by, "a", (F.col("l0") - F.col("p") + 1).alias("nl"))
    rr = g.join(right, keys).where("p <= r0 AND r0 <= q").select(*by, "a", (F.col("q") - F.col("r0") + 1).alias("nr"))
    g = g.join(ll, [*keys, "a"], "left").join(rr, [*keys, "a"], "left").fillna(0, ["nl", "nr"])
    if corridors is not None:
        g = g.join(corridors.select(*by, F.col("bin").alias("a"), F.lit(True).alias("crossed")), [*keys, "a"], "left")
    long = (F.col("b") - F.col("a")) * size
    small, large = F.least("nl", "nr") * size, F.greatest("nl", "nr") * size
    doorway = (long <= door + 1e-9) & (small >= jamb) & (large >= piece) & (F.lit(True) if corridors is None else ~F.coalesce("crossed", F.lit(False)))
    filled = g.where((long < gap - 1e-9) | doorway).select(*by, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("bin")).withColumn("fill", F.lit(True))
    return own.join(filled, [*keys, "bin"], "left").select(*by, "bin", (F.col("closed") | F.coalesce("fill", F.lit(False))).alias("closed"))


def half_level_edges(profile: DataFrame, starts: DataFrame, by: Sequence[str], levels: str = "level", most: int = 60) -> DataFrame:
    """(by, edge): where the profile first rises to half its level to the right of a start, between bins.

    profile (by, bin, v), starts (by, bin, level). The crossing lies between
    the last bin below and the first above, in proportion.
    """
    keys = list(by)
    order = Window.partitionBy(*by).orderBy("bin")
    p = profile.withColumns({"v0": F.lag("v").over(order), "b0": F.lag("bin").over(order)})
    half = 0.5 * F.col(levels)
    met = p.join(starts.withColumnRenamed("bin", "start"), keys).where((F.col("bin") > F.col("start")) & (F.col("bin") <= F.col("start") + most) & (F.col("v") >= half) & (F.col("b0") == F.col("bin") - 1))
    first = met.groupBy(*by, "start").agg(F.min_by(F.struct("bin", "v", "v0", half.alias("half")), "bin").alias("m"))
    share = F.least(F.greatest((F.col("m.half") - F.col("m.v0")) / F.greatest(F.col("m.v") - F.col("m.v0"), F.lit(1e-12)), F.lit(0.0)), F.lit(1.0))
    return first.select(*by, "start", (F.col("m.bin") - 0.5 + share).alias("edge"))


def steepest_edges(profile: DataFrame, edges: DataFrame, by: Sequence[str], sigma: float, step: int = 1) -> DataFrame:
    """edges with ``steepest``: each edge moved to the steepest rise near it, in the direction ``step`` along the bins.

    profile (by, bin, v) without gaps, edges (by, .., edge) between bins. The
    profile is smoothed by a Gaussian of ``sigma`` bins, 0.7 at least, with its
    ends carried on; the steepest boundary within three sigmas of the edge is
    refined by the parabola through it and its neighbours. An edge without a
    rise near it stays where it is.
    """
    keys, width = list(by), max(sigma, 0.7)
    reach = int(4 * width + 0.5)
    kernel = [math.exp(-0.5 * (k / width) ** 2) for k in range(-reach, reach + 1)]
    order = Window.partitionBy(*by).orderBy("bin")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = profile.withColumns({"_first": F.first("v").over(whole), "_last": F.last("v").over(whole)})
    at = lambda k: F.coalesce(F.lag("v", k).over(order), F.col("_first")) if k >= 0 else F.coalesce(F.lead("v", -k).over(order), F.col("_last"))
    smooth = sum((at(k) * (w / sum(kernel)) for k, w in zip(range(-reach, reach + 1), kernel, strict=True)), F.lit(0.0))
    rise = p.select(*by, "bin", smooth.alias("_s")).withColumn("g", (F.lead("_s").over(order) - F.col("_s")) * step).where("g IS NOT NULL")
    rise = rise.withColumns({"_g0": F.lag("g").over(order), "_g1": F.lead("g").over(order)})
    search = max(2, round(3 * width))
    asked = edges.withColumn("_e", F.monotonically_increasing_id())
    asked = materialize(asked.withColumn("_c", F.rint("edge").cast("long") - 1), "edges")
    near = asked.select(*by, "_e", F.explode(F.sequence(F.col("_c") - search, F.col("_c") + search)).alias("bin")).join(rise, [*keys, "bin"])
    best = near.groupBy("_e").agg(F.max_by(F.struct("bin", "g", "_g0", "_g1"), F.struct("g", -F.col("bin"))).alias("b"))
    den = F.col("b._g0") - 2 * F.col("b.g") + F.col("b._g1")
    off = F.when(den < 0, F.least(F.greatest(0.5 * (F.col("b._g0") - F.col("b._g1")) / F.nullif(den, F.lit(0.0)), F.lit(-0.5)), F.lit(0.5)))
    moved = F.when(F.col("b.g") > 0, F.col("b.bin") + 1 + F.coalesce(off, F.lit(0.0)))
    return asked.join(best, "_e", "left").withColumn("steepest", F.coalesce(moved, F.col("edge"))).drop("_e", "_c", "b")
