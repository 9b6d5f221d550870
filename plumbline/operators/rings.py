"""Rings of directed edges: their order, set operations of rectilinear shapes, and clipping by convex rings.

Edges (by, x0, y0, x1, y1) have their shape on the left: outlines run counter
clockwise, holes clockwise. ``cells.outline_edges`` and ``outline_of`` make them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import discard, materialize

#: What each operation keeps of a and b.
OPERATIONS = {"and": lambda a, b: a & b, "or": lambda a, b: a | b, "minus": lambda a, b: a & ~b, "xor": lambda a, b: a != b}


def _followed(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(e, next) of numbered edges: the edge that starts where e ends; of several the one furthest to the right, so rings that touch in a corner stay apart."""
    after = edges.select(*by, F.col("x0").alias("x1"), F.col("y0").alias("y1"), (F.col("x1") - F.col("x0")).alias("_dx"), (F.col("y1") - F.col("y0")).alias("_dy"), F.col("e").alias("next"))
    met = edges.join(after, [*by, "x1", "y1"])
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    turn = F.atan2(dx * F.col("_dy") - dy * F.col("_dx"), dx * F.col("_dx") + dy * F.col("_dy"))
    return met.groupBy("e").agg(F.min(F.struct(turn.alias("turn"), "next")).alias("n")).select("e", F.col("n.next").alias("next"))


def ordered_rings(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ring, k, x, y, size, area): the vertices of each ring in order, k from 0.

    A ring starts at its lowest vertex, of these the leftmost. Rings of a key
    are numbered from 1, outlines by falling area before holes; the area of a
    hole is below 0. List ranking by pointer doubling: in each round an edge
    learns the start of the next 2^r edges and how far ahead it lies, so rings
    of n edges take log n rounds, all in the same jobs. Edges of chains that
    do not close are left out. Repeated edges count once.
    """
    keys = list(by)
    edges = edges.select(*by, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1"))).where("x0 <> x1 OR y0 <> y1").distinct()
    own = materialize(edges.withColumn("e", F.monotonically_increasing_id()), "edges")
    longest = own.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    start = F.struct(F.round("y0", 6).alias("y"), "x0", "e")
    # jump is 2^r edges ahead, first the least start on the way and ahead its distance
    state = materialize(own.select("e", start.alias("first"), F.lit(0).cast("long").alias("ahead")).join(_followed(own, by), "e", "left").withColumnRenamed("next", "jump"), "jumps")
    for r in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        far = state.select(F.col("e").alias("jump"), F.col("first").alias("_first"), F.col("ahead").alias("_ahead"), F.col("jump").alias("_jump"))
        lower = F.col("_first") < F.col("first")
        state, last = state.join(far, "jump", "left").select(
            "e", F.when(lower, F.col("_first")).otherwise(F.col("first")).alias("first"), F.when(lower, F.col("_ahead") + (1 << r)).otherwise(F.col("ahead")).alias("ahead"), F.col("_jump").alias("jump")
        ), state
        state = materialize(state, "jumps")
        discard(last)
    held = own.join(state.where("jump IS NOT NULL").select("e", F.col("first.e").alias("lead"), "ahead"), "e")
    area = F.sum(F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    rings = held.groupBy(*by, "lead").agg(F.count(F.lit(1)).alias("size"), area.alias("area"), F.min(F.struct(F.round("y0", 6), "x0")).alias("_s"))
    rings = rings.withColumn("ring", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), "_s"))).drop("_s")
    return held.join(rings, [*keys, "lead"]).select(*by, "ring", F.pmod(F.col("size") - F.col("ahead"), "size").alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y"), "size", "area")


def combine(a: DataFrame, b: DataFrame, by: Sequence[str], how: str) -> DataFrame:
    """(by, x0, y0, x1, y1): boxes of the difference, union, intersection or symmetric difference of two rectilinear shapes a key.

    a and b are edges of rings of any form, with holes. Their heights cut a
    key's plane into slabs; within a slab the upright edges are swept by x,
    counting how deep either shape is. Boxes do not overlap, and those of a
    slab do not touch. A shape that is missing is empty.
    """
    keys = list(by)
    walls = None
    for n, df in enumerate((a, b)):
        side = df.where("x0 = x1 AND y0 <> y1").select(*by, F.col("x0").cast("double").alias("x"), F.least("y0", "y1").cast("double").alias("lo"), F.greatest("y0", "y1").cast("double").alias("hi"), *(F.when(F.lit(n == m), F.signum(F.col("y0") - F.col("y1"))).otherwise(F.lit(0.0)).alias(f"_t{m}") for m in (0, 1)))
        walls = side if walls is None else walls.union(side)
    walls = materialize(walls, "upright")
    at = Window.partitionBy(*by).orderBy("y")
    levels = walls.select(*by, F.explode(F.array("lo", "hi")).alias("y")).distinct()
    levels = materialize(levels.select(*by, "y", F.row_number().over(at).alias("n"), F.lead("y").over(at).alias("y1")), "levels")
    end = lambda c, n: levels.select(*by, F.col("y").alias(c), F.col("n").alias(n))
    spans = walls.join(end("lo", "_n0"), [*keys, "lo"]).join(end("hi", "_n1"), [*keys, "hi"]).withColumn("n", F.explode(F.sequence("_n0", F.col("_n1") - 1)))
    events = spans.groupBy(*by, "n", "x").agg(F.sum("_t0").alias("_t0"), F.sum("_t1").alias("_t1")).where("_t0 <> 0 OR _t1 <> 0")
    sweep = Window.partitionBy(*by, "n").orderBy("x")
    inside = [F.sum(f"_t{m}").over(sweep) > 0 for m in (0, 1)]
    held = events.select(*by, "n", "x", OPERATIONS[how](*inside).alias("_in"))
    # only where it changes does a box begin or end
    turns = held.withColumn("_was", F.coalesce(F.lag("_in").over(sweep), F.lit(False))).where("_in <> _was")
    boxes = turns.select(*by, "n", F.col("x").alias("x0"), F.lead("x").over(sweep).alias("x1"), "_in").where("_in AND x1 IS NOT NULL")
    return boxes.join(levels.select(*by, "n", F.col("y").alias("y0"), "y1"), [*keys, "n"]).select(*by, "x0", "y0", "x1", "y1")


def outline_of(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, x0, y0, x1, y1): directed edges around boxes that do not overlap; what two boxes share is no edge, straight edges are joined."""
    sides = []
    for axis, (p, q) in enumerate((("x", "y"), ("y", "x"))):  # lines of constant q; the shape is above or below along q
        for line, s in ((f"{q}0", 1), (f"{q}1", -1)):
            sides += [F.struct(F.lit(axis).alias("axis"), F.col(line).alias("line"), F.col(f"{p}{e}").alias("at"), F.lit(s * d).alias("d")) for e, d in ((0, 1), (1, -1))]
    events = boxes.select(*by, F.explode(F.array(*sides)).alias("s")).groupBy(*by, "s.axis", "s.line", "s.at").agg(F.sum("s.d").alias("d")).where("d <> 0")
    sweep = Window.partitionBy(*by, "axis", "line").orderBy("at")
    runs = events.select(*by, "axis", "line", "at", F.sum("d").over(sweep).alias("_s"), F.lead("at").over(sweep).alias("to")).where("_s <> 0")
    # along x the shape above runs east; along y the shape to the right runs south
    ahead = (F.col("_s") > 0) == (F.col("axis") == 0)
    first, last = F.when(ahead, F.col("at")).otherwise(F.col("to")), F.when(ahead, F.col("to")).otherwise(F.col("at"))
    flat = F.col("axis") == 0
    pick = lambda p, q: F.when(flat, p).otherwise(q)
    line = F.col("line")
    return runs.select(*by, pick(first, line).alias("x0"), pick(line, first).alias("y0"), pick(last, line).alias("x1"), pick(line, last).alias("y1"))


def clipped(ring: Column, convex: Column) -> Column:
    """A ring, array of (x, y), cut to a convex counter-clockwise one, edge by edge.

    Of a ring that is not convex several pieces may hang together by edges
    that run to and fro; its area is right nevertheless.
    """
    turned = _turned
    pairs = lambda r: F.zip_with(r, turned(r), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring, convex = (F.transform(r, lambda p: point(p["x"].cast("double"), p["y"].cast("double"))) for r in (ring, convex))

    def cut(held: Column, edge: Column) -> Column:
        side = lambda v: (edge["q"]["x"] - edge["p"]["x"]) * (v["y"] - edge["p"]["y"]) - (edge["q"]["y"] - edge["p"]["y"]) * (v["x"] - edge["p"]["x"])

        def step(pair: Column) -> Column:
            p, q = pair["p"], pair["q"]
            a, b = p["s"], q["s"]
            t = a / F.nullif(a - b, F.lit(0.0))
            here = point(p["v"]["x"], p["v"]["y"])
            there = F.when((a >= 0) != (b >= 0), point(p["v"]["x"] + t * (q["v"]["x"] - p["v"]["x"]), p["v"]["y"] + t * (q["v"]["y"] - p["v"]["y"])))
            return F.array(F.when(a >= 0, here), there)

        # each corner's side is taken once, and the ring is bound before it is turned
        sided = F.transform(held, lambda v: F.struct(v.alias("v"), side(v).alias("s")))
        return _once(sided, lambda r: F.array_compact(F.flatten(F.transform(pairs(r), step))))

    return F.aggregate(_once(convex, pairs), ring, cut)


def _turned(ring: Column) -> Column:
    """The ring from its second corner on."""
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once a row however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def signed_area(ring: Column) -> Column:
    """Area of an array of (x, y), above 0 for a counter-clockwise ring."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    return F.aggregate(_once(ring, lambda r: F.zip_with(r, _turned(r), cross)), F.lit(0.0), lambda s, c: s + c) / 2


def edges_of_boxes(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    """The four edges of each box, for shapes given as boxes that may overlap: ``combine`` counts them as one."""
    corners = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
    edge = lambda p, q: F.struct(F.col(p[0]).alias("x0"), F.col(p[1]).alias("y0"), F.col(q[0]).alias("x1"), F.col(q[1]).alias("y1"))
    return boxes.select(*by, F.explode(F.array(*(edge(corners[k], corners[(k + 1) % 4]) for k in range(4)))).alias("_e")).select(*by, "_e.*")


def area_of(boxes: DataFrame, by: Sequence[str]) -> DataFrame:
    return boxes.groupBy(*by).agg(F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def rings_as_arrays(vertices: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, ring, points): each ring of ``ordered_rings`` as an array of (x, y)."""
    g = vertices.groupBy(*by, "ring").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y"))).alias("_v"))
    return g.select(*by, "ring", F.transform("_v", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("points"))

