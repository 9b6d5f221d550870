"""Ring order, set operations of rectilinear shapes and clipping, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cells, rings

EDGE = "k long, x0 double, y0 double, x1 double, y1 double"


def grid_edges(cells_):
    """Unit edges around a set of cells, the cells on the left."""
    out = []
    for i, j in cells_:
        for (di, dj), e in {(0, -1): (i, j, i + 1, j), (1, 0): (i + 1, j, i + 1, j + 1), (0, 1): (i + 1, j + 1, i, j + 1), (-1, 0): (i, j + 1, i, j)}.items():
            if (i + di, j + dj) not in cells_:
                out.append(tuple(map(float, e)))
    return out


def walked(edges):
    """Rings by walking, the rightmost way at a corner, as cycles of vertices from the lowest, leftmost one."""
    starts = {}
    for e in edges:
        starts.setdefault(e[:2], []).append(e)
    left, out = set(edges), []
    while left:
        e = min(left, key=lambda e: (e[1], e[0]))
        ring = []
        while e in left:
            left.discard(e)
            ring.append(e)
            dx, dy = e[2] - e[0], e[3] - e[1]
            # right, straight, left
            e = min(starts[e[2:]], key=lambda n: {True: 0}.get(dx * (n[3] - n[1]) - dy * (n[2] - n[0]) < 0, 1 if dx * (n[2] - n[0]) + dy * (n[3] - n[1]) > 0 else 2))
        low = min(range(len(ring)), key=lambda k: (ring[k][1], ring[k][0]))
        out.append(tuple(p[:2] for p in ring[low:] + ring[:low]))
    return sorted(out)


def rings_of(df):
    held = {}
    for r in df.collect():
        held.setdefault((r.k0, r.ring), []).append((r.k, r.x, r.y, r.size, r.area))
    return {key: sorted(v) for key, v in held.items()}


def test_rings_of_random_cells(spark):
    """Connected sets with holes, also holes that touch the outline or each other in a corner; many sets in the same rounds."""
    rng = random.Random(1)
    shapes = {0: {(0, 0)}, 1: {(i, j) for i in range(3) for j in range(3)} - {(1, 1), (2, 2)}, 2: {(i, 0) for i in range(70)} | {(i, 2) for i in range(70)} | {(0, 1)}}
    for k in range(3, 12):
        shapes[k] = {(i, j) for i in range(9) for j in range(9) if rng.random() < 0.8}
    rows = [(k, *e) for k, s in shapes.items() for e in grid_edges(s)]
    got = rings_of(_ordered(spark, rows))
    for k, s in shapes.items():
        own = {ring: v for (key, ring), v in got.items() if key == k}
        assert sorted(tuple((x, y) for _, x, y, _, _ in v) for v in own.values()) == walked(grid_edges(s))
        assert all([n for n, *_ in v] == list(range(len(v))) and {size for *_, size, _ in v} == {len(v)} for v in own.values())
        assert sum(v[0][4] for v in own.values()) == len(s)
        areas = [own[r][0][4] for r in sorted(own)]
        assert areas == sorted(areas, reverse=True)
    assert len([1 for key in got if key[0] == 1]) == 2  # the hole that touches the outline is a ring of its own


def _ordered(spark, rows):
    df = spark.createDataFrame(rows, EDGE).withColumnRenamed("k", "k0")
    return rings.ordered_rings(df, ["k0"])


def test_open_chains_repeated_edges_and_nothing(spark):
    square = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0)]
    rows = [(1, *e) for e in square + square[:2]] + [(2, *e) for e in square[:3]] + [(3, 0.0, 0.0, 0.0, 0.0)]
    got = rings_of(_ordered(spark, rows))
    assert {key: [(x, y) for _, x, y, _, _ in v] for key, v in got.items()} == {(1, 1): [e[:2] for e in square]}
    assert _ordered(spark, []).count() == 0


@pytest.mark.parametrize("how", list(rings.OPERATIONS))
def test_set_operations(spark, how):
    """Random shapes with holes on grids of unequal steps, and a key that only one of the two has."""
    rng, rows, want = random.Random(2), ([], []), {}
    for k in range(8):
        two = [{(i, j) for i in range(7) for j in range(7) if rng.random() < 0.6} for _ in rows]
        two[1] = set() if k == 3 else two[1]
        x, y = (list(itertools.accumulate(rng.choice([0.5, 1.0, 1.5]) for _ in range(9))) for _ in "xy")
        for table, s in zip(rows, two):
            table += [(k, *map(float, (x[int(a)], y[int(b)], x[int(c)], y[int(d)]))) for a, b, c, d in grid_edges(s)]
        kept = {"and": two[0] & two[1], "or": two[0] | two[1], "minus": two[0] - two[1], "xor": two[0] ^ two[1]}[how]
        want[k] = (kept, x, y)
    a, b = (spark.createDataFrame(t, EDGE) for t in rows)
    boxes = rings.combine(a, b, ["k"], how)
    got = {}
    for r in boxes.collect():
        kept, x, y = want[r.k]
        inside = {(i, j) for i in range(7) for j in range(7) if r.x0 <= x[i] < r.x1 and r.y0 <= y[j] < r.y1}
        assert inside and not inside & got.setdefault(r.k, set())
        got[r.k] |= inside
    assert got == {k: kept for k, (kept, _, _) in want.items() if kept}
    # the outlines of the result are those of its cells
    ordered = rings.ordered_rings(rings.outline_of(boxes, ["k"]).withColumnRenamed("k", "key"), ["key"])
    area = {r.key: r.a for r in ordered.where("k = 0").groupBy("key").agg(F.sum("area").alias("a")).collect()}
    for k, (kept, x, y) in want.items():
        assert area.get(k, 0.0) == pytest.approx(sum((x[i + 1] - x[i]) * (y[j + 1] - y[j]) for i, j in kept))


def test_outline_of_boxes_is_that_of_cells(spark):
    rng = random.Random(3)
    held = [(0, i, j, float(i), i + 1.0, float(j), j + 1.0, 0) for i in range(6) for j in range(6) if rng.random() < 0.7]
    own = spark.createDataFrame(held, "plan int, i int, j int, x0 double, x1 double, y0 double, y1 double, region int")
    want = {tuple(r) for r in cells.outline_edges(own.drop("region"), own.select("plan", "i", "j", "region")).select("x0", "y0", "x1", "y1").collect()}
    assert {tuple(r) for r in rings.outline_of(own, ["plan"]).select("x0", "y0", "x1", "y1").collect()} == want


def test_clipping(spark):
    """A ring of any form and a convex one: the area against cells of a fine grid."""
    star = [(0.0, 0.0), (4.0, 1.0), (1.0, 1.5), (5.0, 5.0), (0.5, 2.5), (-1.0, 4.0)]
    convex = [[(0.5, 0.5), (3.0, 0.0), (3.5, 3.0), (1.0, 3.5)], [(-5.0, -5.0), (9.0, -5.0), (9.0, 9.0), (-5.0, 9.0)], [(20.0, 0.0), (21.0, 0.0), (20.0, 1.0)]]

    def holds(ring, x, y):
        return sum((a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1])) % 2

    schema = "k int, r array<struct<x: double, y: double>>, c array<struct<x: double, y: double>>"
    rows = spark.createDataFrame([(k, star, c) for k, c in enumerate(convex)] + [(9, [], convex[0])], schema)
    got = {r.k: r.a for r in rows.select("k", rings.signed_area(rings.clipped(F.col("r"), F.col("c"))).alias("a")).collect()}
    step = 0.02
    for k, c in enumerate(convex):
        want = sum(holds(star, i * step + 0.007, j * step + 0.003) and holds(c, i * step + 0.007, j * step + 0.003) for i in range(-60, 260) for j in range(-10, 260)) * step * step
        assert abs(got[k] - want) < 0.05
    assert got[9] == 0.0
