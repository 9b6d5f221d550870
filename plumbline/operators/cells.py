"""Plan cells between wall lines: sides, growth of thin cells, regions, rooms and outlines.

A plan is a key (``plan``, a whole number); its cells (plan, i, j, x0, x1, y0,
y1) lie between consecutive lines. All steps are joins on a plan's lines or
cells; regions are components of an edge table, so a plan of any size is no
single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import discard, materialize

from .graph import components

# Free run that makes a passage, share of free space inside, least room area and width, and what a room without cameras needs.
OPEN_RUN, INSIDE, MIN_AREA, MIN_WIDTH = 0.3, 0.5, 0.7, 0.5
NO_CAMERA_COVERAGE, NO_CAMERA_SUPPORT, NO_CAMERA_FLOOR = 0.75, 0.6, 0.3
#: Cells of a plan are numbered below this along either axis.
_WIDE = 1 << 16


def cells_between(cuts: DataFrame) -> DataFrame:
    """Cells (plan, i, j, x0, x1, y0, y1) of lines (plan, axis 0 or 1, k, coord), k counting from 0 by rising coord."""
    after = F.lead("coord").over(Window.partitionBy("plan", "axis").orderBy("k"))
    spans = cuts.withColumn("next", after).where("next IS NOT NULL")
    x = spans.where("axis = 0").select("plan", F.col("k").alias("i"), F.col("coord").alias("x0"), F.col("next").alias("x1"))
    y = spans.where("axis = 1").select("plan", F.col("k").alias("j"), F.col("coord").alias("y0"), F.col("next").alias("y1"))
    return x.join(y, "plan").select("plan", "i", "j", "x0", "x1", "y0", "y1")


def cell_sides(profile: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """(plan, axis, k, other, length, closed, upper, open, wide): the stretch of line k beside strip ``other``.

    profile (plan, axis, k, bin, closed, upper): wall evidence in bins of
    ``size`` along each line. closed and upper become shares; a side is open
    with a free run of OPEN_RUN or half its length, and wide if at most half
    of it is closed.
    """
    strips = cells.select("plan", F.lit(0).alias("axis"), F.col("j").alias("other"), F.col("y0").alias("a"), F.col("y1").alias("b"))
    strips = strips.union(cells.select("plan", F.lit(1), "i", "x0", "x1")).distinct()
    key = ["plan", "axis", "k", "other"]
    at = F.col("bin") * size
    held = profile.join(strips, ["plan", "axis"]).where((at >= F.col("a") - 1e-9) & (at < F.col("b") - 1e-9))
    run = F.col("bin") - F.row_number().over(Window.partitionBy(*key).orderBy("bin"))
    free = held.where("NOT closed").withColumn("run", run).groupBy(*key, "run").agg((F.count(F.lit(1)) * size).alias("long")).groupBy(*key).agg(F.max("long").alias("free"))
    sides = held.groupBy(*key).agg(F.first(F.col("b") - F.col("a")).alias("length"), F.avg(F.col("closed").cast("double")).alias("closed"), F.avg(F.col("upper").cast("double")).alias("upper"))
    enough = F.coalesce(F.col("free") >= F.least(F.lit(OPEN_RUN), 0.5 * F.col("length")) - 1e-9, F.lit(False))
    sides = sides.join(free, key, "left").withColumn("open", enough).withColumn("wide", F.col("open") & (F.col("closed") <= 0.5))
    return sides.drop("free")


def across(sides: DataFrame) -> DataFrame:
    """Sides seen from both of their cells: (plan, i, j, i2, j2, ..); the cell beyond may not exist."""
    k, o = F.col("k"), F.col("other")
    flat = F.col("axis") == 0
    cell = lambda near: (F.when(flat, near).otherwise(o), F.when(flat, o).otherwise(near))
    (li, lj), (hi, hj) = cell(k - 1), cell(k)
    rest = [c for c in sides.columns if c != "plan"]
    view = lambda a, b: sides.select("plan", a[0].alias("i"), a[1].alias("j"), b[0].alias("i2"), b[1].alias("j2"), *rest)
    return view((li, lj), (hi, hj)).union(view((hi, hj), (li, lj)))


def grow_inside(cells: DataFrame, sides: DataFrame, thin: float, rounds: int = 10) -> DataFrame:
    """(plan, i, j) of the cells inside: enough free space (``coverage``), or thin and reached across wide sides, so many cells deep."""
    inside = cells.where(F.col("coverage") >= INSIDE).select("plan", "i", "j")
    slim = cells.where(F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) < thin).select("plan", "i", "j")
    steps = materialize(across(sides.where("wide")).select("plan", "i", "j", "i2", "j2").join(slim.withColumnsRenamed({"i": "i2", "j": "j2"}), ["plan", "i2", "j2"], "left_semi"), "steps")
    inside, last = materialize(inside, "inside"), None
    fresh = inside
    for _ in range(rounds):
        new = fresh.join(steps, ["plan", "i", "j"]).select("plan", F.col("i2").alias("i"), F.col("j2").alias("j")).distinct().join(inside, ["plan", "i", "j"], "left_anti")
        fresh = materialize(new, "grown")
        if fresh.isEmpty():
            break
        last, inside = inside, materialize(inside.union(fresh), "inside")
        discard(last)
    return inside


def regions(inside: DataFrame, sides: DataFrame) -> DataFrame:
    """(plan, i, j, region): cells joined through open sides; region is the least i * 65536 + j of its cells."""
    node = lambda i, j: (F.col("plan").cast("long") * _WIDE + F.col(i)) * _WIDE + F.col(j)
    two = inside.withColumnsRenamed({"i": "i2", "j": "j2"})
    edges = across(sides.where("open")).join(inside, ["plan", "i", "j"], "left_semi").join(two, ["plan", "i2", "j2"], "left_semi")
    found = components(edges.select(node("i", "j").alias("a"), node("i2", "j2").alias("b")))
    own = inside.withColumn("node", node("i", "j")).join(found, "node", "left")
    return own.select("plan", "i", "j", F.pmod(F.coalesce("component", "node"), F.lit(_WIDE * _WIDE)).alias("region"))


def region_stats(cells: DataFrame, labelled: DataFrame, sides: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, neighbours) of regions.

    stats (plan, region, area, bx0, by0, bx1, by1, n_cams, first_cam, coverage,
    floor, support): shares are weighted by cell areas, support is the closed
    share of the boundary by length. neighbours (plan, region, other, length,
    tall): length of the common boundary and of its part with evidence above
    head height. cells (.., coverage, floor), cameras (plan, cam, x, y).
    """
    own = labelled.join(cells, ["plan", "i", "j"]).withColumn("a", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    mean = lambda c: (F.sum(F.col(c) * F.col("a")) / F.sum("a")).alias(c)
    stats = own.groupBy("plan", "region").agg(
        F.sum("a").alias("area"), F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"), mean("coverage"), mean("floor")
    )
    # a camera is in the cell whose lower lines it is beyond
    seen = cameras.join(own.select("plan", "region", "x0", "x1", "y0", "y1"), "plan").where("x > x0 AND x <= x1 AND y > y0 AND y <= y1")
    cams = seen.groupBy("plan", "region").agg(F.count(F.lit(1)).alias("n_cams"), F.min("cam").alias("first_cam"))
    beyond = labelled.select("plan", F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("region").alias("other_region"))
    edge = across(sides).join(labelled, ["plan", "i", "j"]).join(beyond, ["plan", "i2", "j2"], "left").where("NOT (region <=> other_region)")
    bounds = edge.groupBy("plan", "region").agg((F.sum(F.col("length") * F.col("closed")) / F.greatest(F.sum("length"), F.lit(1e-9))).alias("support"))
    near = edge.where("other_region IS NOT NULL").groupBy("plan", "region", F.col("other_region").alias("other")).agg(F.sum("length").alias("length"), F.sum(F.col("length") * F.col("upper")).alias("tall"))
    stats = stats.join(cams, ["plan", "region"], "left").join(bounds, ["plan", "region"], "left")
    return stats.withColumns({"n_cams": F.coalesce("n_cams", F.lit(0).cast("long")), "support": F.coalesce("support", F.lit(0.0))}), near


def region_kinds(stats: DataFrame, thin: float) -> DataFrame:
    """stats with kind: thin, small, room (with cameras, or well enough seen without) or reject."""
    side = F.least(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
    known = (F.col("coverage") >= NO_CAMERA_COVERAGE) & (F.col("support") >= NO_CAMERA_SUPPORT) & (F.col("floor") >= NO_CAMERA_FLOOR)
    kind = F.when(side < max(thin, 0.25), "thin").when((F.col("area") < MIN_AREA) | (side < MIN_WIDTH), "small").when((F.col("n_cams") > 0) | known, "room").otherwise("reject")
    return stats.withColumn("kind", kind)


def select_rooms(stats: DataFrame, neighbours: DataFrame, thin: float, single_room: bool = False) -> DataFrame:
    """(plan, region, room, room_ord): regions of each room, named by its main region, ordered by first camera, then area.

    A small region joins the one room beside it, across boundaries that reach
    head height by less than half. A plan without a room takes its largest
    region that is not thin, those with cameras first.
    """
    kinds = region_kinds(stats, thin)
    main = kinds.where("kind = 'room'")
    low = neighbours.where("tall < 0.5 * length").join(kinds.where("kind = 'small'").select("plan", "region"), ["plan", "region"])
    sole = low.join(main.select("plan", F.col("region").alias("other")), ["plan", "other"]).groupBy("plan", "region").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("room")).where("n = 1").drop("n")
    bare = kinds.join(main.select("plan").distinct(), "plan", "left_anti")
    rank = F.struct(F.col("kind") != "thin", "n_cams", "area", -F.col("region"))
    bare = bare.groupBy("plan").agg(F.max_by("region", rank).alias("region"))
    chosen = main.select("plan", "region").union(bare)
    if single_room:
        best = chosen.join(kinds, ["plan", "region"]).groupBy("plan").agg(F.max_by("region", F.struct("n_cams", "area", -F.col("region"))).alias("region"))
        chosen = best
    order = Window.partitionBy("plan").orderBy(F.col("first_cam").asc_nulls_last(), F.desc("area"), "region")
    rooms = chosen.join(stats, ["plan", "region"]).select("plan", F.col("region").alias("room"), F.row_number().over(order).alias("room_ord"))
    parts = chosen.select("plan", "region", F.col("region").alias("room")).union(sole.select("plan", "region", "room"))
    return parts.join(rooms, ["plan", "room"]).select("plan", "region", "room", "room_ord")


def outline_edges(cells: DataFrame, labelled: DataFrame, name: str = "region") -> DataFrame:
    """(plan, name, x0, y0, x1, y1): directed edges around each region, the region on the left, straight ones joined.

    Edges of holes run the other way round. Ring areas follow without
    ordering: half the sum of x0 * y1 - x1 * y0.
    """
    own = labelled.join(cells, ["plan", "i", "j"])
    beside = {"s": (0, -1), "e": (1, 0), "n": (0, 1), "w": (-1, 0)}
    walls = None
    for way, (di, dj) in beside.items():
        inner = labelled.select("plan", name, (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"))
        out = own.join(inner, ["plan", name, "i", "j"], "left_anti")
        line, lo, hi = ("y0" if way == "s" else "y1", "x0", "x1") if way in "sn" else ("x1" if way == "e" else "x0", "y0", "y1")
        side = out.select("plan", name, F.lit(way).alias("way"), F.col(line).alias("line"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
        walls = side if walls is None else walls.union(side)
    key = ["plan", name, "way", "line"]
    order = Window.partitionBy(*key).orderBy("lo")
    new = F.coalesce((F.col("lo") != F.lag("hi").over(order)).cast("int"), F.lit(1))
    joined = walls.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy(*key, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w, c = F.col("way"), F.col
    pick = lambda s, e, n, west: F.when(w == "s", c(s)).when(w == "e", c(e)).when(w == "n", c(n)).otherwise(c(west))
    return joined.select("plan", name, pick("lo", "line", "hi", "line").alias("x0"), pick("line", "lo", "line", "hi").alias("y0"), pick("hi", "line", "lo", "line").alias("x1"), pick("line", "hi", "line", "lo").alias("y1"))


def cell_of(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """points (plan, x, y) with the cell (i, j) they are in; those outside the lines go. A point on a line is in the cell below it."""
    after = F.lead("coord").over(Window.partitionBy("plan", "axis").orderBy("k"))
    spans = cuts.withColumn("next", after).where("next IS NOT NULL")
    held = points
    for axis, (x, i) in enumerate((("x", "i"), ("y", "j"))):
        span = spans.where(F.col("axis") == axis).select("plan", F.col("k").alias(i), F.col("coord").alias("_a"), F.col("next").alias("_b"))
        held = held.join(span, "plan").where((F.col(x) > F.col("_a")) & (F.col(x) <= F.col("_b"))).drop("_a", "_b")
    return held
