"""Repair line items: a catalog of quantities over damage regions and flags, at value, low and high bound."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import FEET, SQUARE_FEET, surface_kind
from plumbline.operators.shapes import union_area, union_length
from plumbline.session import discard, materialize, measured_broadcasts

FORMULAS = {"damage_area_margin", "surface_area", "crack_length", "flood_cut_length", "flood_cut_area", "each"}
UNITS = {"SF": SQUARE_FEET, "LF": FEET, "EA": 1.0}

# Catalog entries in order. Damage entries apply to classes and surfaces, flag entries to rules.
DAMAGE: tuple[dict[str, Any], ...] = (
    {"id": "STAIN-SEAL", "classes": ["water_stain"], "surfaces": ["wall", "ceiling"], "formula": "damage_area_margin", "margin_m": 0.15, "unit": "SF"},
    {"id": "STAIN-FLOOR-CLEAN", "classes": ["water_stain"], "surfaces": ["floor"], "formula": "damage_area_margin", "margin_m": 0.15, "unit": "SF"},
    {"id": "MOLD-HEPA", "classes": ["mold"], "surfaces": ["wall", "ceiling", "floor"], "formula": "damage_area_margin", "margin_m": 0.3, "unit": "SF"},
    {"id": "MOLD-ANTIMICROBIAL", "classes": ["mold"], "surfaces": ["wall", "ceiling", "floor"], "formula": "damage_area_margin", "margin_m": 0.3, "unit": "SF"},
    {"id": "MOLD-DRYWALL", "classes": ["mold"], "surfaces": ["wall", "ceiling"], "formula": "damage_area_margin", "margin_m": 0.3, "unit": "SF"},
    {"id": "CRACK-TAPE", "classes": ["crack"], "surfaces": ["wall", "ceiling"], "formula": "crack_length", "margin_m": 0.15, "unit": "LF"},
    {"id": "HOLE-PATCH", "classes": ["hole"], "surfaces": ["wall", "ceiling"], "max_area_m2": 0.09, "formula": "each", "count": "region", "unit": "EA"},
    {"id": "HOLE-REPLACE", "classes": ["hole"], "surfaces": ["wall", "ceiling"], "min_area_m2": 0.09, "formula": "damage_area_margin", "margin_m": 0.15, "unit": "SF"},
    {"id": "PEEL-PREP", "classes": ["peeling_paint"], "surfaces": ["wall", "ceiling"], "formula": "damage_area_margin", "margin_m": 0.1, "unit": "SF"},
    {"id": "REPAINT", "classes": ["water_stain", "mold", "crack", "hole", "peeling_paint"], "surfaces": ["wall", "ceiling"], "formula": "surface_area", "unit": "SF"},
)
FLAGS: tuple[dict[str, Any], ...] = (
    {"id": "MOISTURE-MAP", "rules": ["R-CEIL-STAIN", "R-FIXTURE-LEAK", "R-PEEL-MOISTURE", "R-WINDOW-LEAK"], "formula": "each", "count": "surface", "unit": "EA"},
    {"id": "WICK-FLOOD-CUT", "rules": ["R-WALL-WICK"], "formula": "flood_cut_length", "margin_m": 0.6, "unit": "LF"},
    {"id": "WICK-INSULATION", "rules": ["R-WALL-WICK"], "formula": "flood_cut_area", "margin_m": 0.6, "cut_height_m": 0.6, "unit": "SF"},
    {"id": "WICK-DRYWALL", "rules": ["R-WALL-WICK"], "formula": "flood_cut_area", "margin_m": 0.6, "cut_height_m": 0.6, "unit": "SF"},
    {"id": "MOLD-CONTAIN-LIMITED", "rules": ["R-MOLD-LIMITED"], "formula": "each", "count": "flag", "unit": "EA"},
    {"id": "MOLD-CONTAIN-FULL", "rules": ["R-MOLD-FULL"], "formula": "each", "count": "flag", "unit": "EA"},
    {"id": "MOLD-INSPECT", "rules": ["R-MOLD-HIDDEN"], "formula": "each", "count": "surface", "unit": "EA"},
)

BOUNDS = ("value", "lo", "hi")


def check_catalog(entries: tuple[dict[str, Any], ...]) -> None:
    for e in entries:
        if e["formula"] not in FORMULAS:
            raise ValueError(f"catalog entry {e['id']}: unknown formula {e['formula']!r}")
        if e["unit"] not in UNITS:
            raise ValueError(f"catalog entry {e['id']}: unit must be SF, LF or EA")


def at(column: str, bound: str) -> Column:
    """A measurement STRUCT<value, lo, hi> at a bound; the value where there is no interval."""
    m = F.col(column)
    return m["value"] if bound == "value" else F.coalesce(m[bound], m["value"])


def opposite(bound: str) -> str:
    return {"lo": "hi", "hi": "lo"}.get(bound, bound)


def surfaces(rooms: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Surfaces (capture_id, room_id, surface_id, surf_ord, length_b, height_b, area_b for each bound b), walls less their openings.

    A wall's low area subtracts its openings' high ones, and never goes below zero.
    """
    holes = openings.groupBy("capture_id", "wall_id").agg(*(F.sum(at("width", b) * at("height", b)).alias(f"hole_{b}") for b in BOUNDS))
    w = walls.join(holes, ["capture_id", "wall_id"], "left")
    net = [F.greatest(at("length", b) * at("height", b) - F.coalesce(f"hole_{opposite(b)}", F.lit(0.0)), F.lit(0.0)).alias(f"area_{b}") for b in BOUNDS]
    wall_rows = w.select("capture_id", "room_id", F.col("wall_id").alias("surface_id"), F.col("k").cast("long").alias("surf_ord"), *(at("length", b).alias(f"length_{b}") for b in BOUNDS), *(at("height", b).alias(f"height_{b}") for b in BOUNDS), *net)
    none = [F.lit(None).cast("double").alias(f"{n}_{b}") for n in ("length", "height") for b in BOUNDS]
    ends = F.explode(F.array(F.struct(F.lit("FLOOR").alias("s"), F.lit(1_000_000).cast("long").alias("o")), F.struct(F.lit("CEIL").alias("s"), F.lit(1_000_001).cast("long").alias("o"))))
    flat = rooms.withColumn("e", ends).select("capture_id", "room_id", F.concat_ws("-", "room_id", "e.s").alias("surface_id"), F.col("e.o").alias("surf_ord"), *none, *(F.greatest(at("floor_area", b), F.lit(0.0)).alias(f"area_{b}") for b in BOUNDS))
    return wall_rows.unionByName(flat)


def _quantities(entry: dict[str, Any], regions: DataFrame, bound: str) -> DataFrame:
    """(capture_id, surface_id, q): one formula at one bound; regions carry their surface's columns and n_flags."""
    by, margin = ["capture_id", "surface_id"], float(entry.get("margin_m", 0.0))
    formula = entry["formula"]
    if formula == "each":
        # a flag is counted once, however many regions it has
        count = {"region": F.count_distinct("damage_id"), "flag": F.count_distinct("flag_id"), "surface": F.lit(1)}[entry.get("count", "region")]
        return regions.groupBy(*by).agg(count.cast("double").alias("q"))
    if formula == "surface_area":
        return regions.groupBy(*by).agg(F.max(f"area_{bound}").alias("q"))
    regions = regions.dropDuplicates([*by, "damage_id"]).where("damage_id IS NOT NULL")
    if formula == "crack_length":
        own = F.coalesce(at("length", bound), F.greatest(at("width", bound), at("height", bound)))
        return regions.groupBy(*by).agg(F.sum(F.greatest(own, F.lit(0.0)) + margin).alias("q"))
    cu, cv = (F.col("u0") + F.col("u1")) / 2, (F.col("v0") + F.col("v1")) / 2
    hw, hh = F.greatest(at("width", bound), F.lit(0.0)) / 2 + margin, F.greatest(at("height", bound), F.lit(0.0)) / 2 + margin
    # greatest() passes over nulls: floors and ceilings have no limit
    limit = lambda c: F.when(F.col(f"{c}_{bound}").isNotNull(), F.greatest(F.col(f"{c}_{bound}"), F.lit(1e-9))).otherwise(F.lit(float("inf")))
    if formula == "damage_area_margin":
        low = lambda x: F.when(F.col(f"length_{bound}").isNotNull(), F.greatest(x, F.lit(0.0))).otherwise(x)
        boxes = regions.select(*by, low(cu - hw).alias("x0"), low(cv - hh).alias("y0"), F.least(cu + hw, limit("length")).alias("x1"), F.least(cv + hh, limit("height")).alias("y1"))
        return union_area(boxes, by).withColumnRenamed("area", "q")
    cuts = union_length(regions.select(*by, F.greatest(cu - hw, F.lit(0.0)).alias("lo"), F.least(cu + hw, limit("length")).alias("hi")), by, "lo", "hi")
    return cuts.select(*by, (F.col("length") * (float(entry.get("cut_height_m", 0.6)) if formula == "flood_cut_area" else 1.0)).alias("q"))


def line_items(damage: DataFrame, flags: DataFrame, rooms: DataFrame, walls: DataFrame, openings: DataFrame, damage_entries: tuple[dict[str, Any], ...] = DAMAGE, flag_entries: tuple[dict[str, Any], ...] = FLAGS) -> DataFrame:
    """Line items (capture_id, line_id, entry, room_id, surface_id, unit, value, lo, hi, damage_ids, flag_ids), L1 .. by room, surface and entry.

    damage (capture_id, damage_id, ord, room_id, surface_id, cls, u0, u1, v0,
    v1, and area, width, height, length as STRUCT<value, lo, hi>); flags as
    of ``rules.evaluate``; rooms (capture_id, room_id, room_ord, floor_area);
    walls (capture_id, room_id, wall_id, k, length, height); openings
    (capture_id, wall_id, width, height). Boxes on floors and ceilings are
    not clipped to the room's outline.
    """
    check_catalog(damage_entries + flag_entries)
    known = materialize(surfaces(rooms, walls, openings).drop("room_id"), "surfaces")
    area = F.col("area.value")
    per_surface = materialize(flags.select("capture_id", "flag_id", "rule_id", "damage_ids", F.posexplode("surface_ids").alias("at", "surface_id")), "flagged")
    parts = []
    for group, entries in ((0, damage_entries), (1, flag_entries)):
        for i, e in enumerate(entries):
            if group == 0:
                hit = F.col("cls").isin(e["classes"]) & surface_kind(F.col("surface_id")).isin(e.get("surfaces", ["wall", "floor", "ceiling"]))
                if "max_area_m2" in e:
                    hit &= area <= e["max_area_m2"]
                if "min_area_m2" in e:
                    hit &= area > e["min_area_m2"]
                regions = damage.where(hit).withColumn("flag_id", F.lit(None).cast("string"))
            else:
                chosen = per_surface.where(F.col("rule_id").isin(e["rules"]))
                # a flag's list goes once it is taken apart, or each of its regions would carry it; neither side is small
                single = chosen.withColumn("damage_id", F.explode(F.array_distinct("damage_ids"))).drop("damage_ids")
                chosen = chosen.drop("damage_ids")
                if e.get("count") == "flag":
                    chosen = chosen.where("at = 0")
                    met = single.where("at = 0").select("capture_id", "flag_id", "damage_id").join(damage.withColumnRenamed("surface_id", "d_surface").hint("merge"), ["capture_id", "damage_id"])
                    regions = chosen.join(met.hint("merge"), ["capture_id", "flag_id"], "left")
                else:
                    # a flag meets its own regions, not all of its surface; a surface without any region stays
                    met = single.join(damage.hint("merge"), ["capture_id", "surface_id", "damage_id"])
                    bare = chosen.join(damage.select("capture_id", "surface_id").distinct(), ["capture_id", "surface_id"], "left_anti")
                    regions = met.unionByName(bare, allowMissingColumns=True)
            # read by the list of ids and by each bound's quantity
            with measured_broadcasts(damage.sparkSession):
                regions = materialize(regions.join(known, ["capture_id", "surface_id"], "left"), "hits")
            listed = regions.groupBy("capture_id", "surface_id").agg(
                F.min_by("room_id", "ord").alias("room_id"), F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("ord", "damage_id"))), lambda x: x["damage_id"])).alias("damage_ids"),
                F.array_sort(F.collect_set("flag_id")).alias("flag_ids"), F.min("surf_ord").alias("surf_ord"),
            )
            for b in BOUNDS:
                # a row holds all ids of its surface: merged, not sent to every task
                listed = listed.join(_quantities(e, regions, b).withColumnRenamed("q", b).hint("merge"), ["capture_id", "surface_id"])
            k = UNITS[e["unit"]]
            value = F.col("value") * k
            # an entry at a time: the plan of all entries together would take the driver hundreds of MB
            own = listed.where("value > 0").select("capture_id", "surface_id", "room_id", "damage_ids", "flag_ids", "surf_ord", F.lit(e["id"]).alias("entry"), F.lit(e["unit"]).alias("unit"), F.lit(group).alias("grp"), F.lit(i).alias("e_ord"), value.alias("value"), F.least(F.col("lo") * k, value).alias("lo"), F.greatest(F.col("hi") * k, value).alias("hi"))
            with measured_broadcasts(damage.sparkSession):
                parts.append(materialize(own, "entries"))
            discard(regions)
    items = reduce(DataFrame.unionByName, parts).join(rooms.select("capture_id", "room_id", "room_ord"), ["capture_id", "room_id"], "left")
    order = Window.partitionBy("capture_id").orderBy(F.col("room_ord").asc_nulls_last(), "surf_ord", "grp", "e_ord", "surface_id")
    return items.select("capture_id", F.concat(F.lit("L"), F.row_number().over(order)).alias("line_id"), "entry", "room_id", "surface_id", "unit", "value", "lo", "hi", "damage_ids", "flag_ids")
