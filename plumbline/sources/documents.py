"""Small documents as tables: ground truth, app exports, results, configuration."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator
from statistics import median
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import parse_quantity
from plumbline.plans.rules import check_rules
from plumbline.session import materialize


def number(x: Any) -> float | None:
    """A finite number, decimal comma allowed; booleans, blanks and words are None."""
    if x is None or isinstance(x, bool):
        return None
    try:
        v = float(str(x).strip().replace(",", "."))
    except ValueError:
        return None
    return v if v == v and abs(v) != float("inf") else None


def positive(x: Any) -> float | None:
    v = number(x)
    return v if v is not None and v > 0 else None


def unique_ids(ids: list[str]) -> list[str]:
    """The ids with ~2, ~3 .. after repeats."""
    seen: dict[str, int] = {}
    out = []
    for i in ids:
        seen[i] = seen.get(i, 0) + 1
        out.append(i if seen[i] == 1 else f"{i}~{seen[i]}")
    return out


GT_SCHEMAS = {
    "rooms": "property string, room_id string, label string, ceiling_height double, floor_area double, openings_measured boolean, damage_measured boolean",
    "walls": "property string, room_id string, wall_id string, k int, length double",
    "openings": "property string, room_id string, opening_id string, type string, wall_id string, offset double, width double, height double, sill double, leads_to string",
    "damage": "property string, room_id string, damage_id string, cls string, surface string, offset double, bottom double, width double, height double, length double, area double",
    "captures": "property string, capture_id string, tier string, path string, rooms array<string>",
    "adjacency": "property string, room_a string, room_b string",
}


def _ground_truth_rows(prop: str, text: str) -> Iterator[tuple[str, tuple]]:
    """(table, row) of one ground-truth document."""
    doc = yaml.safe_load(text) or {}
    rooms = [r for r in doc.get("rooms") or [] if isinstance(r, dict)]
    ids = unique_ids([str(r.get("id", f"room{k}")) for k, r in enumerate(rooms)])
    pairs = {tuple(sorted(map(str, p))) for p in doc.get("adjacency") or [] if isinstance(p, (list, tuple)) and len(p) == 2}
    for rid, r in zip(ids, rooms, strict=True):
        readings = r.get("ceiling_height")
        heights = [h for h in map(positive, readings if isinstance(readings, list) else [readings]) if h]
        yield "rooms", (prop, rid, str(r.get("label", rid)), median(heights) if heights else None, positive(r.get("floor_area")), bool(r.get("openings_measured", True)), bool(r.get("damage_measured", True)))
        walls = [w if isinstance(w, dict) else {"length": w} for w in r.get("walls") or []]
        for k, (wid, w) in enumerate(zip(unique_ids([str(w.get("id", f"W{k + 1}")) for k, w in enumerate(walls)]), walls, strict=True)):
            yield "walls", (prop, rid, wid, k, positive(w.get("length")))
        for k, o in enumerate(r.get("openings") or []):
            yield "openings", (prop, rid, str(o.get("id", f"O{k + 1}")), o.get("type"), o.get("wall"), number(o.get("offset")), positive(o.get("width")), positive(o.get("height")), number(o.get("sill")), o.get("leads_to"))
            if o.get("leads_to"):
                pairs.add(tuple(sorted((rid, str(o["leads_to"])))))
        for k, x in enumerate(r.get("damage") or []):
            yield "damage", (prop, rid, str(x.get("id", f"D{k + 1}")), x.get("class"), x.get("surface"), *(number(x.get(c)) for c in ("offset", "bottom")), *(positive(x.get(c)) for c in ("width", "height", "length", "area")))
    yield from (("adjacency", (prop, a, b)) for a, b in sorted(pairs) if a != b and {a, b} <= set(ids))
    for c in doc.get("captures") or []:
        yield "captures", (prop, str(c.get("id")), c.get("tier"), c.get("path"), c.get("rooms"))


def ground_truth(spark: SparkSession, documents: dict[str, str] | DataFrame) -> dict[str, DataFrame]:
    """Tables of ground-truth YAML texts (property, text): rooms, walls, openings, damage, captures, adjacency.

    Measures that are blank, words or zero are missing. A room's ceiling is
    the median of its readings. Adjacency is the explicit pairs and what
    openings lead to, without direction. Documents are parsed in tasks, one at
    a time; every table reads the one written result.
    """
    texts = spark.createDataFrame(list(documents.items()), "property string, text string") if isinstance(documents, dict) else documents
    names = {k: [f.split()[0] for f in schema.split(", ")] for k, schema in GT_SCHEMAS.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(t, json.dumps(dict(zip(names[t], row, strict=True)), default=str)) for p, text in zip(f["property"], f["text"], strict=True) for t, row in _ground_truth_rows(p, text or "")]
            yield pd.DataFrame(rows, columns=["t", "row"])

    parsed = materialize(texts.select("property", "text").mapInPandas(run, "t string, row string"), "ground-truth")
    return {k: parsed.where(F.col("t") == k).select(F.from_json("row", schema).alias("r")).select("r.*") for k, schema in GT_SCHEMAS.items()}


def properties(spark: SparkSession, root: str) -> DataFrame:
    """(property, path): folders with a ground_truth.yaml, at the root or one level down, in order of their paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "ground_truth.yaml").load(root).select("path")
    below = F.regexp_extract("path", "/?([^/]*)/ground_truth.yaml$", 1)
    base = root.removeprefix("file://").rstrip("/")
    inside = F.substring_index("path", base, -1)
    deep = F.size(F.split(inside, "/")) - 2
    return found.where(deep <= 1).select(below.alias("property"), "path").orderBy("path")


def _export_cells(text: str) -> list[tuple]:
    """(room, dimension, cell, unit) of one app's CSV."""
    best = max(",;\t", key=lambda d: sum(line.count(d) for line in text.splitlines()))
    lines = list(csv.reader(io.StringIO(text.lstrip("\ufeff")), delimiter=best))
    head = next((i for i, row in enumerate(lines) if any(re.search("room|space|name", c, re.I) for c in row) and len([c for c in row if c.strip()]) > 1), 0)
    names = [c.strip() for c in lines[head]] if lines else []
    room = next((i for i, c in enumerate(names) if re.search("room|space|name", c, re.I)), 0)
    unit = [(m.group(1).lower() if (m := re.search(r"\((mm|cm|m|ft|in)\)", c)) else None) for c in names]
    return [(row[room], names[i], row[i], unit[i]) for row in lines[head + 1 :] for i in range(min(len(row), len(names))) if i != room and len(row) > room]


def app_exports(files: DataFrame) -> DataFrame:
    """(path, room, dimension, metres) of other apps' CSV files (path, text): delimiter by vote, header by search, units from cell or header."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *cell) for p, text in zip(f["path"], f["text"], strict=True) for cell in _export_cells(text or "")]
            yield pd.DataFrame(rows, columns=["path", "room", "dimension", "cell", "unit"])

    raw = files.select("path", "text").mapInPandas(run, "path string, room string, dimension string, cell string, unit string")
    return raw.select("path", "room", "dimension", parse_quantity(F.col("cell"), F.col("unit")).alias("metres")).where("metres IS NOT NULL")


def app_export(spark: SparkSession, text: str) -> DataFrame:
    """As app_exports, of one text."""
    return app_exports(spark.createDataFrame([("", text)], "path string, text string")).drop("path")


MEASURE = "struct<value: double, lo: double, hi: double, unit: string>"
RESULT = (
    f"capture struct<id: string, tier: string, flags: array<string>>, property struct<footprint_area: {MEASURE}, rooms: array<struct<id: string, label: string, ceiling_height: {MEASURE}, floor_area: {MEASURE}, "
    f"perimeter: {MEASURE}, walls: array<struct<id: string, length: {MEASURE}, height: {MEASURE}>>, openings: array<struct<id: string, wall_id: string, type: string, offset: {MEASURE}, width: {MEASURE}, height: {MEASURE}>>>>, "
    "adjacency: array<struct<room_a: string, room_b: string>>>"
)


def results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Result JSON files as tables of rooms, walls, openings and adjacency."""
    raw = spark.read.schema(RESULT).json(path, multiLine=True).select(F.col("capture.id").alias("capture_id"), F.col("capture.tier").alias("tier"), "property.*")
    rooms = raw.select("capture_id", "tier", F.posexplode("rooms").alias("room_ord", "r")).select("capture_id", "tier", "room_ord", "r.*").withColumnRenamed("id", "room_id")
    walls = rooms.select("capture_id", "room_id", F.posexplode("walls").alias("k", "w")).select("capture_id", "room_id", "k", "w.*").withColumnRenamed("id", "wall_id")
    openings = rooms.select("capture_id", "room_id", F.explode("openings").alias("o")).select("capture_id", "room_id", "o.*").withColumnRenamed("id", "opening_id")
    adjacency = raw.select("capture_id", F.explode("adjacency").alias("a")).select("capture_id", "a.*")
    return {"rooms": rooms.drop("walls", "openings"), "walls": walls, "openings": openings, "adjacency": adjacency}


def config(path: str) -> dict[str, Any]:
    with open(path) as f:
        return yaml.safe_load(f) or {}


def rules(path: str) -> tuple[dict[str, Any], ...]:
    """Concealed-damage rules of a YAML file, for plans.rules.evaluate(); unknown conditions raise."""
    found = tuple({"per": "region", "severity": "medium"} | r for r in config(path).get("rules") or [])
    check_rules(found)
    return found
