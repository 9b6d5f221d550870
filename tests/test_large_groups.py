"""Hot keys, copies and large tables: the same results, without a key's rows in one task."""

import math

from pyspark.sql import functions as F

from plumbline import session
from plumbline.operators import joins, quantiles, rings, shapes, windows
from plumbline.plans import rules


def test_nearest_of_other_kind(spark):
    """Copies of a place, ties, lone points and points without a kind or a place, against all pairs."""
    rows = [(i, i % 3, float(i * 37 % 101) / 90, float(i * 53 % 97) / 90, float(i * 71 % 89) / 90) for i in range(400)]
    rows += [(1000 + i, i % 2, 0.5, 0.5, 0.5) for i in range(300)] + [(2000, 7, 9.0, 9.0, 9.0), (2001, None, 0.5, 0.5, 0.5), (2002, 1, None, 0.5, 0.5)]
    got = {r.id: (r.other, r.distance) for r in joins.nearest_of_other(spark.createDataFrame(rows, "id int, kind int, x double, y double, z double"), 0.15, ["x", "y", "z"], "id", "kind").collect()}
    full = [r for r in rows if None not in r]
    want = {}
    for i, k, *p in full:
        near = [(math.sqrt(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))), j) for j, m, *q in full if m != k]
        if (best := min(near)) and best[0] <= 0.15:
            want[i] = (best[1], best[0])
    assert {i: o for i, (o, _) in got.items()} == {i: o for i, (o, _) in want.items()}
    assert all(abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_hot_keys_are_dealt_and_results_stay(spark, monkeypatch):
    """With every key taken as hot, robust spreads, directions, means and centred quantiles are as before, and a key's rows stay in many tasks."""
    rows = spark.range(0, 3000, 1, 6).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 1009 / 10).alias("x"), (1.0 + F.col("id") % 3).alias("w"), F.lit(50.0).alias("start"))
    ways = {
        "sigma": lambda: quantiles.robust_sigma(rows, ["k"], "x"), "turn": lambda: shapes.refined_manhattan_angle(rows, ["k"], "x", "w"),
        "mean": lambda: quantiles.trimmed_mean(rows, ["k"], "x", "w", "start", 30.0), "centred": lambda: quantiles.centred_quantiles(rows, ["k"], {"a": ("x", "w", 0.1), "b": ("x", "w", 0.9)}),
    }
    round_off = lambda df: sorted(tuple(round(v, 9) for v in r) for r in df.collect())
    cold = {name: round_off(way()) for name, way in ways.items()}
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    assert {name: round_off(way()) for name, way in ways.items()} == cold
    met = joins.join_few(rows, rows.groupBy("k").agg(F.max("x").alias("top")), ["k"], joins.hot_keys(rows, ["k"]))
    assert met.count() == 3000 and met.select("k", F.spark_partition_id()).distinct().count() == 12


def test_islands_of_a_large_table(spark, monkeypatch):
    rows = spark.range(0, 2000).select((F.col("id") % 50).alias("k"), F.col("id").alias("i"), (F.col("id") % 3).alias("v"))
    one = sorted(map(tuple, windows.islands(rows, ["k"], "i", "v").collect()))
    monkeypatch.setattr(session, "ROWS_A_TASK", 100)
    many = windows.islands(rows, ["k"], "i", "v")
    assert sorted(map(tuple, many.collect())) == one and many.rdd.getNumPartitions() == 20


def test_a_cut_ring_is_named_once(spark):
    """The area of a clipped ring evaluates the cutting once, not once for each time the ring is named."""
    ring = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))")
    box = F.expr("array(named_struct('x', 1D, 'y', 1D), named_struct('x', 3D, 'y', 1D), named_struct('x', 3D, 'y', 6D), named_struct('x', 1D, 'y', 6D))")
    area = rings.signed_area(rings.clipped(ring, box))
    assert spark.range(1).select(area).first()[0] == 6.0
    assert area._jc.toString().count("aggregate") <= 3


def test_regions_of_a_crowded_plan_cell_stay_where_they_are(spark, monkeypatch):
    """Distances to a few objects: a region is dealt to its own plan cell alone, and a cell of many stays in many tasks."""
    rows = [(1, i, i % 7 * 0.1 + 0.05, i % 5 * 0.15 + 0.05, i % 7 * 0.1 + 0.1, i % 5 * 0.15 + 0.05, 0.0, 1.0) for i in range(60)]
    put = lambda name, of: spark.createDataFrame(of, f"capture_id int, {name} int, ax double, ay double, bx double, by double, z0 double, z1 double")
    places = [(0, 1.7, 0.5), (1, -0.6, 0.2), (2, 0.4, 1.6), (3, 2.5, 2.5)]
    few = put("o", [(1, k, x, y, x, y, 0.5, 0.5) for k, x, y in places])
    dealt = []
    monkeypatch.setattr(session, "ROWS_A_TASK", 10)
    monkeypatch.setattr(rules, "join_few", lambda *x: dealt.append((x[0], x[3])) or joins.join_few(*x))
    got = {(r.d, r.o): r.distance for r in rules.prism_distances(put("d", rows), few, "d", "o").collect()}
    gap = lambda r, x, y: math.hypot(max(r[2] - x, x - r[4], 0), r[3] - y)
    want = {(r[1], k): g for r in rows for k, x, y in places if (g := gap(r, x, y)) <= 1}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert dealt[0][0].count() == 60 and dealt[0][1].count() == 1


def test_corners_of_many_regions_of_a_wall(spark, monkeypatch):
    """Least distance of corners against all pairs of them, with every wall taken as hot."""
    monkeypatch.setattr(session, "ROWS_A_TASK", 5)
    rows = [(1, i, "W0", i * 0.07, i * 0.07 + 0.2, i % 4 * 0.3, i % 4 * 0.3 + 0.5) for i in range(40)]
    damage = spark.createDataFrame(rows, "capture_id int, damage_id int, surface_id string, u0 double, u1 double, v0 double, v1 double")
    held = [("O1", "door", 0.5, 0.8, 2.0, None), ("O2", "window", 1.9, 0.6, 1.0, 0.9), ("O3", "window", 0.1, 0.3, 0.5, 1.0)]
    openings = spark.createDataFrame([(1, "W0", *h) for h in held], "capture_id int, wall_id string, opening_id string, type string, offset double, width double, height double, sill double")
    got = {(r.damage_id, r.type): r.distance for r in rules.corner_distances(damage, openings).collect()}
    want = {}
    for _, i, _, u0, u1, v0, v1 in rows:
        for _, kind, at, w, h, sill in held:
            gaps = [math.hypot(u - p, v - q) for u in (u0, u1) for v in (v0, v1) for p in (at, at + w) for q in (sill or 0.0, (sill or 0.0) + h)]
            want[i, kind] = min(*gaps, want.get((i, kind), math.inf))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
