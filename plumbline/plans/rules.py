"""Concealed-damage rules: a table of conditions, each a column expression, over damage regions.

A rule flags single regions, or all its regions of one surface or room
together. Conditions that need a distance are joins within a capture: shapes
are given as plan segments with a height range, so a stain, a fixture and a
window are alike.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import SQUARE_FEET, segment_distance, surface_kind
from plumbline.operators.joins import hot_keys, join_few
from plumbline.session import materialize, measured_broadcasts

CONDITIONS = {"classes", "surfaces", "bottom_within_m", "near_fixture", "near_window", "near_opening_corner", "min_length_m", "total_area_sqft"}

# Rule ids, conditions, grouping and severity, in order.
RULES: tuple[dict[str, Any], ...] = (
    {"id": "R-CEIL-STAIN", "when": {"classes": ["water_stain"], "surfaces": ["ceiling"]}, "per": "region", "severity": "medium"},
    {"id": "R-WALL-WICK", "when": {"classes": ["water_stain"], "surfaces": ["wall"], "bottom_within_m": 0.15}, "per": "region", "severity": "high"},
    {"id": "R-FIXTURE-LEAK", "when": {"classes": ["water_stain"], "near_fixture": {"classes": ["sink", "toilet", "bathtub", "shower", "washing_machine"], "within_m": 1.0}}, "per": "region", "severity": "high"},
    {"id": "R-MOLD-LIMITED", "when": {"classes": ["mold"], "total_area_sqft": {"gt": 10, "lte": 100}}, "per": "room", "severity": "high"},
    {"id": "R-MOLD-FULL", "when": {"classes": ["mold"], "total_area_sqft": {"gt": 100}}, "per": "room", "severity": "high"},
    {"id": "R-MOLD-HIDDEN", "when": {"classes": ["mold"]}, "per": "surface", "severity": "medium"},
    {"id": "R-CRACK-OPENING", "when": {"classes": ["crack"], "surfaces": ["wall"], "near_opening_corner": {"types": ["door", "window", "opening"], "within_m": 0.3}}, "per": "region", "severity": "medium"},
    {"id": "R-CRACK-LONG", "when": {"classes": ["crack"], "min_length_m": 1.0}, "per": "region", "severity": "high"},
    {"id": "R-PEEL-MOISTURE", "when": {"classes": ["peeling_paint"], "surfaces": ["wall", "ceiling"]}, "per": "region", "severity": "low"},
    {"id": "R-HOLE-CAVITY", "when": {"classes": ["hole"]}, "per": "region", "severity": "low"},
    {"id": "R-WINDOW-LEAK", "when": {"classes": ["water_stain"], "surfaces": ["wall"], "near_window": {"within_m": 0.5}}, "per": "region", "severity": "medium"},
)


def check_rules(rules: tuple[dict[str, Any], ...]) -> None:
    for rule in rules:
        if any(rule["when"].get(k, {}).get("within_m", 0) > REACH for k in ("near_fixture", "near_window")):
            raise ValueError(f"rule {rule['id']}: distances go up to {REACH} m")
        if unknown := set(rule["when"]) - CONDITIONS:
            raise ValueError(f"rule {rule['id']}: unknown conditions {sorted(unknown)}")


def damage_segments(damage: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    """(capture_id, damage_id, ax, ay, bx, by, z0, z1): plan segments of each region; four for one on a floor or ceiling."""
    on_wall = damage.where(surface_kind(F.col("surface_id")) == "wall").join(walls.select("capture_id", F.col("wall_id").alias("surface_id"), "sx", "sy", "ex", "ey"), ["capture_id", "surface_id"])
    on_wall = on_wall.join(rooms.select("capture_id", "room_id", "floor_z"), ["capture_id", "room_id"])
    length = F.greatest(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), F.lit(1e-12))
    at = lambda u, s, e: F.col(s) + (F.col(e) - F.col(s)) / length * u
    u0, u1 = F.least("u0", "u1"), F.greatest("u0", "u1")
    on_wall = on_wall.select(
        "capture_id", "damage_id", at(u0, "sx", "ex").alias("ax"), at(u0, "sy", "ey").alias("ay"), at(u1, "sx", "ex").alias("bx"), at(u1, "sy", "ey").alias("by"),
        (F.col("floor_z") + F.least("v0", "v1")).alias("z0"), (F.col("floor_z") + F.greatest("v0", "v1")).alias("z1"),
    )
    flat = damage.where(surface_kind(F.col("surface_id")) != "wall").join(rooms.select("capture_id", "room_id", "floor_z", "ceiling_z"), ["capture_id", "room_id"])
    z = F.when(surface_kind(F.col("surface_id")) == "floor", F.col("floor_z")).otherwise(F.col("ceiling_z"))
    return on_wall.unionByName(_box_segments(flat.withColumn("z", z), "damage_id", "u0", "v0", "u1", "v1", "z", "z"))


def _box_segments(df: DataFrame, name: str, x0: str, y0: str, x1: str, y1: str, z0: str, z1: str) -> DataFrame:
    c = F.col
    side = lambda a, b, d, e: F.struct(c(a).alias("ax"), c(b).alias("ay"), c(d).alias("bx"), c(e).alias("by"))
    sides = F.explode(F.array(side(x0, y0, x1, y0), side(x1, y0, x1, y1), side(x1, y1, x0, y1), side(x0, y1, x0, y0)))
    return df.select("capture_id", name, c(z0).alias("z0"), c(z1).alias("z1"), sides.alias("s")).select("capture_id", name, "s.*", "z0", "z1")


def object_segments(objects: DataFrame) -> DataFrame:
    """(capture_id, object_id, ax, ay, bx, by, z0, z1) of objects (x0..y1 or x, y; z0, z1)."""
    o = objects.withColumns({k: F.coalesce(k, v) for k, v in (("x0", "x"), ("x1", "x"), ("y0", "y"), ("y1", "y"))})
    o = o.withColumns({"z0": F.coalesce(F.least("z0", "z1"), F.lit(0.0)), "z1": F.coalesce(F.greatest("z0", "z1"), F.lit(0.0))})
    return _box_segments(o, "object_id", "x0", "y0", "x1", "y1", "z0", "z1")


def opening_segments(openings: DataFrame, walls: DataFrame, rooms: DataFrame) -> DataFrame:
    o = openings.join(walls.select("capture_id", "wall_id", "sx", "sy", "ex", "ey"), ["capture_id", "wall_id"]).join(rooms.select("capture_id", "room_id", "floor_z"), ["capture_id", "room_id"])
    length = F.greatest(F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), F.lit(1e-12))
    at = lambda u, s, e: F.col(s) + (F.col(e) - F.col(s)) / length * u
    u0, u1, sill = F.col("offset"), F.col("offset") + F.col("width"), F.coalesce("sill", F.lit(0.0))
    return o.select(
        "capture_id", "opening_id", at(u0, "sx", "ex").alias("ax"), at(u0, "sy", "ey").alias("ay"), at(u1, "sx", "ex").alias("bx"), at(u1, "sy", "ey").alias("by"),
        (F.col("floor_z") + sill).alias("z0"), (F.col("floor_z") + sill + F.col("height")).alias("z1"),
    )


#: Metres: no rule asks for a distance beyond this, and segments meet in plan cells of this size.
REACH = 1.0


def prism_distances(a: DataFrame, b: DataFrame, a_id: str, b_id: str, within: float = REACH) -> DataFrame:
    """(capture_id, a_id, b_id, distance): plan distance and height gap of two sets of segments of a capture, up to ``within``.

    Segments meet where their plan cells do, those of b widened by the reach,
    so nothing is compared across the plan: b should be the smaller set. A
    cell that holds more of a than a task should has b sent to it.
    """
    span = lambda p, q, wide: F.explode(F.sequence(F.floor((F.least(p, q) - wide) / REACH), F.floor((F.greatest(p, q) + wide) / REACH)))
    celled = lambda df, wide: df.withColumn("_cx", span("ax", "bx", wide)).withColumn("_cy", span("ay", "by", wide))
    keys = ["capture_id", "_cx", "_cy"]
    # a hair wider than the reach, so that rounding never puts a neighbour a cell too far
    a, b = celled(a, 0.0), celled(b, within * (1 + 1e-9) + 1e-9)
    y = b.select(*keys, b_id, *(F.col(k).alias(f"{k}2") for k in ("ax", "ay", "bx", "by", "z0", "z1")))
    c = F.col
    met = join_few(a, y, keys, hot_keys(a, keys))
    ends = [("ax", "ay", "ax2", "ay2", "bx2", "by2"), ("bx", "by", "ax2", "ay2", "bx2", "by2"), ("ax2", "ay2", "ax", "ay", "bx", "by"), ("bx2", "by2", "ax", "ay", "bx", "by")]
    side = lambda px, py, qx, qy, rx, ry: (c(qx) - c(px)) * (c(ry) - c(py)) - (c(qy) - c(py)) * (c(rx) - c(px))
    apart = lambda s, t: s * t < 0
    crosses = apart(side("ax", "ay", "bx", "by", "ax2", "ay2"), side("ax", "ay", "bx", "by", "bx2", "by2")) & apart(side("ax2", "ay2", "bx2", "by2", "ax", "ay"), side("ax2", "ay2", "bx2", "by2", "bx", "by"))
    plan = F.when(crosses, F.lit(0.0)).otherwise(reduce(lambda m, e: F.least(m, segment_distance(*map(c, e))), ends[1:], segment_distance(*map(c, ends[0]))))
    height = F.greatest(F.greatest("z0", "z02") - F.least("z1", "z12"), F.lit(0.0))
    return met.groupBy("capture_id", a_id, b_id).agg(F.min(F.hypot(plan, height)).alias("distance")).where(F.col("distance") <= within)


def corner_distances(damage: DataFrame, openings: DataFrame) -> DataFrame:
    """(capture_id, damage_id, type, distance): least distance of a region's corners to an opening's corners in its wall."""
    c, keys = F.col, ["capture_id", "wall_id"]
    d = damage.where(surface_kind(c("surface_id")) == "wall").select("capture_id", c("surface_id").alias("wall_id"), "damage_id", "u0", "u1", "v0", "v1")
    sill = F.coalesce("sill", F.lit(0.0))
    o = openings.select(*keys, "type", c("offset").alias("ou0"), (c("offset") + c("width")).alias("ou1"), sill.alias("ov0"), (sill + c("height")).alias("ov1"))
    met = join_few(d, o, keys, hot_keys(d, keys))
    # every u of a box goes with every v, so the nearest corners are nearest on either axis
    near = lambda x, y: F.least(*(F.abs(c(f"{x}{i}") - c(f"{y}{j}")) for i in (0, 1) for j in (0, 1)))
    gap = F.hypot(near("u", "ou"), near("v", "ov"))
    return met.groupBy("capture_id", "damage_id", "type").agg(F.min(gap).alias("distance"))


def evaluate(damage: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame, objects: DataFrame, rules: tuple[dict[str, Any], ...] = RULES) -> DataFrame:
    """Flags (capture_id, flag_id, rule_id, severity, room_id, surface_ids, damage_ids, total_area_sqft), F1 .. by room, rule and damage.

    damage (capture_id, damage_id, ord, room_id, surface_id, cls, area, width,
    height, length, u0, u1, v0, v1); rooms (capture_id, room_id, room_ord,
    floor_z, ceiling_z); walls (capture_id, room_id, wall_id, sx, sy, ex, ey);
    openings (capture_id, room_id, wall_id, opening_id, type, offset, width,
    height, sill); objects (capture_id, object_id, cls, x, y, x0, x1, y0, y1,
    z0, z1).
    """
    check_rules(rules)
    # files of regions compress well, and each region is dealt out to cells: nothing of them is broadcast unmeasured
    with measured_broadcasts(damage.sparkSession):
        shapes = materialize(damage_segments(damage, walls, rooms), "segments")
        to_objects = prism_distances(shapes, object_segments(objects), "damage_id", "object_id").join(objects.select("capture_id", "object_id", F.col("cls").alias("o_cls")), ["capture_id", "object_id"])
        near_object = to_objects.groupBy("capture_id", "damage_id", "o_cls").agg(F.min("distance").alias("d")).groupBy("capture_id", "damage_id").agg(F.map_from_entries(F.collect_list(F.struct("o_cls", "d"))).alias("object_m"))
        windows = openings.where("type = 'window'")
        near_window = prism_distances(shapes, opening_segments(windows, walls, rooms), "damage_id", "opening_id").groupBy("capture_id", "damage_id").agg(F.min("distance").alias("window_m"))
        corners = corner_distances(damage, openings).groupBy("capture_id", "damage_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "distance"))).alias("corner_m"))
        full = damage
        for extra in (near_object, near_window, corners):
            full = full.join(extra, ["capture_id", "damage_id"], "left")
        full = materialize(full.join(rooms.select("capture_id", "room_id", "room_ord"), ["capture_id", "room_id"], "left"), "regions")
    # every rule is tried on a region in one pass, and those that hold are its rows
    key = {"region": "damage_id", "surface": "surface_id", "room": "room_id"}
    tried = [F.when(_holds(r["when"]), F.struct(F.lit(i).alias("rule_ord"), F.lit(r["id"]).alias("rule_id"), F.lit(r["severity"]).alias("severity"), F.col(key[r["per"]]).cast("string").alias("grp"))) for i, r in enumerate(rules)]
    every = full.withColumn("rule", F.explode(F.array_compact(F.array(*tried)))).select("*", "rule.*")
    listed = F.sort_array(F.collect_list(F.struct("ord", "damage_id", "surface_id")))
    flags = every.groupBy("capture_id", "rule_ord", "rule_id", "severity", "grp").agg(
        listed.alias("m"), (F.sum("area") * SQUARE_FEET).alias("total_area_sqft"), F.min("ord").alias("first"), F.min_by("room_id", "ord").alias("room_id"), F.min_by("room_ord", "ord").alias("room_ord")
    )
    totals = {r["id"]: r["when"]["total_area_sqft"] for r in rules if "total_area_sqft" in r["when"]}
    for name, spec in totals.items():
        total = F.col("total_area_sqft")
        ok = (total > spec["gt"] if "gt" in spec else F.lit(True)) & (total <= spec["lte"] if "lte" in spec else F.lit(True))
        flags = flags.where((F.col("rule_id") != name) | ok)
    order = Window.partitionBy("capture_id").orderBy(F.col("room_ord").asc_nulls_last(), "rule_ord", "first")
    return flags.select(
        "capture_id", F.concat(F.lit("F"), F.row_number().over(order)).alias("flag_id"), "rule_id", "severity", "room_id",
        F.array_distinct(F.transform("m", lambda x: x["surface_id"])).alias("surface_ids"), F.transform("m", lambda x: x["damage_id"]).alias("damage_ids"), "total_area_sqft",
    )


def _holds(when: dict[str, Any]) -> Column:
    """All region-level conditions of a rule as one boolean column."""
    kind = surface_kind(F.col("surface_id"))
    ok = F.lit(True)
    if "classes" in when:
        ok &= F.col("cls").isin(when["classes"])
    if "surfaces" in when:
        ok &= kind.isin(when["surfaces"])
    if "bottom_within_m" in when:
        ok &= (kind == "wall") & (F.least("v0", "v1") <= when["bottom_within_m"])
    if "near_fixture" in when:
        spec = when["near_fixture"]
        gaps = F.array_compact(F.array(*(F.try_element_at("object_m", F.lit(c)) for c in spec["classes"])))
        ok &= F.coalesce(F.array_min(gaps) <= spec.get("within_m", 1.0), F.lit(False))
    if "near_window" in when:
        seen = F.least("window_m", F.try_element_at("object_m", F.lit("window")))
        ok &= F.coalesce(seen <= when["near_window"].get("within_m", 0.5), F.lit(False))
    if "near_opening_corner" in when:
        spec = when["near_opening_corner"]
        gaps = F.array_compact(F.array(*(F.try_element_at("corner_m", F.lit(t)) for t in spec.get("types", ["door", "window", "opening"]))))
        ok &= (kind == "wall") & F.coalesce(F.array_min(gaps) <= spec.get("within_m", 0.3), F.lit(False))
    if "min_length_m" in when:
        ok &= F.coalesce("length", F.greatest("width", "height")) > when["min_length_m"]
    return ok
