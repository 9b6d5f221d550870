"""Sensor logs: odometry, IMU and camera lines, scanned tolerantly; presence of rasters by frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import clean_number, quaternion_matrix
from plumbline.operators.joins import fill_from_next

# Columns of an odometry line without a header.
ODOMETRY = ("timestamp", "frame", "x", "y", "z", "qx", "qy", "qz", "qw", "fx", "fy", "cx", "cy")


def _fields(line: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(line, "^﻿", ""), r"\r$", "")
    return F.transform(F.split(plain, ",", -1), lambda c: F.trim(c))


def odometry(lines: DataFrame, by: str = "capture_id") -> DataFrame:
    """Poses of lines (by, line_no, line), with or without a header, in any order.

    A line needs finite time, frame, position and quaternion, a frame of 0 or
    more, and a quaternion norm in (0.5, 1.5). Of repeated frames the first
    line stays. Missing intrinsics come from the next frame that has them.
    ``gap`` counts frames missing before a row, ``late`` marks times that do
    not increase.
    """
    f = lines.withColumn("f", _fields(F.col("line")))
    heads = f.where(F.lower("line").contains("timestamp")).groupBy(by).agg(F.min_by(F.transform("f", F.lower), "line_no").alias("head"))
    f = f.join(heads, by, "left").where(~F.lower("line").contains("timestamp"))
    place = lambda name, i: F.coalesce(F.nullif(F.array_position("head", name), F.lit(0)), F.when(F.col("head").isNull(), F.lit(i + 1).cast("long")))
    f = f.select(by, "line_no", *(clean_number(F.get("f", (place(n, i) - 1).cast("int"))).alias(n) for i, n in enumerate(ODOMETRY)))
    norm = F.sqrt(F.col("qx") ** 2 + F.col("qy") ** 2 + F.col("qz") ** 2 + F.col("qw") ** 2)
    ok = f.where(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in ODOMETRY[:9])) & (F.col("frame") >= 0) & (norm > 0.5) & (norm < 1.5))
    ok = ok.withColumn("frame", F.col("frame").cast("long"))
    first = Window.partitionBy(by, "frame").orderBy("line_no")
    ok = ok.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    ok = ok.withColumns({c: fill_from_next(ok, [by], "frame", c) for c in ("fx", "fy", "cx", "cy")})
    order = Window.partitionBy(by).orderBy("frame")
    return ok.withColumns({
        "gap": F.coalesce(F.col("frame") - F.lag("frame").over(order) - 1, F.lit(0).cast("long")),
        "late": F.coalesce(F.col("timestamp") <= F.lag("timestamp").over(order), F.lit(False)),
        "R": quaternion_matrix(F.col("qx"), F.col("qy"), F.col("qz"), F.col("qw")),
    })


def imu(lines: DataFrame, by: str = "capture_id") -> DataFrame:
    """(by, t, ax .. wz, unit): accelerations in m/s^2; a median of 0.5 to 2 means the log is in g."""
    f = lines.withColumn("f", _fields(F.col("line")))
    names = ("t", "ax", "ay", "az", "wx", "wy", "wz")
    f = f.select(by, *(clean_number(F.get("f", F.lit(i))).alias(n) for i, n in enumerate(names))).where("t IS NOT NULL AND ax IS NOT NULL AND ay IS NOT NULL AND az IS NOT NULL")
    size = F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2)
    medians = f.groupBy(by).agg(F.percentile(size, F.lit(0.5)).alias("m"))
    unit = F.when(F.col("m").between(0.5, 2), "g").when(F.col("m").between(5, 20), "m/s2").otherwise("unknown")
    f = f.join(medians, by).withColumn("unit", unit)
    return f.withColumns({a: F.when(F.col("unit") == "g", F.col(a) * 9.80665).otherwise(F.col(a)) for a in ("ax", "ay", "az")}).drop("m")


def camera_matrix(text: DataFrame, by: str = "capture_id") -> DataFrame:
    """(by, K): the first nine numbers of a text, with positive focal lengths."""
    k = F.transform(F.regexp_extract_all("text", F.lit(r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"), 1), lambda x: x.cast("double"))
    return text.select(by, F.slice(k, 1, 9).alias("K")).where((F.size("K") == 9) & (F.col("K")[0] > 0) & (F.col("K")[4] > 0))


def frames(poses: DataFrame, depth: DataFrame, confidence: DataFrame, by: str = "capture_id") -> DataFrame:
    """Poses with has_depth and has_confidence, by frame number."""
    mark = lambda d, n: d.select(by, F.col("number").alias("frame"), F.lit(True).alias(n)).distinct()
    out = poses.join(mark(depth, "has_depth"), [by, "frame"], "left").join(mark(confidence, "has_confidence"), [by, "frame"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_depth", "has_confidence")})


def orphans(poses: DataFrame, depth: DataFrame, by: str = "capture_id") -> DataFrame:
    """(by, n): rasters without a pose."""
    return depth.withColumnRenamed("number", "frame").join(poses, [by, "frame"], "left_anti").groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def depth_weight(pixels: DataFrame, by: tuple[str, ...] = ("capture_id", "frame"), near: float = 0.2, far: float = 4.5, step: float = 0.1) -> DataFrame:
    """Pixels (by, i, j, depth, conf) with weight w: 0 outside the range or at a relative depth step to a 4-neighbour, else by confidence."""
    row, col = Window.partitionBy(*by, "i").orderBy("j"), Window.partitionBy(*by, "j").orderBy("i")
    edge = F.lit(False)
    for w in (row, col):
        for side in (F.lag, F.lead):
            d = side("depth").over(w)
            edge |= F.coalesce(F.abs(d - F.col("depth")) > step * F.least(d, F.col("depth")), F.lit(False))
    weight = F.when(F.col("conf") == 2, 1.0).when(F.col("conf") == 1, 0.3).when(F.col("conf") == 0, 0.0).otherwise(0.3)
    ok = F.col("depth").between(near, far) & ~edge
    return pixels.withColumn("w", F.when(ok, weight).otherwise(0.0))


def backproject(pixels: DataFrame, poses: DataFrame, by: tuple[str, ...] = ("capture_id", "frame")) -> DataFrame:
    """World points of pixels (depth along the optical axis) through K and T_wc; the rasters' own intrinsics are expected."""
    p = pixels.join(poses, list(by))
    k = lambda i: F.get("K", F.lit(i))
    x, y = (F.col("j") - k(2)) * F.col("depth") / k(0), (F.col("i") - k(5)) * F.col("depth") / k(4)
    t = lambda i: F.get("T_wc", F.lit(4 * i)) * x + F.get("T_wc", F.lit(4 * i + 1)) * y + F.get("T_wc", F.lit(4 * i + 2)) * F.col("depth") + F.get("T_wc", F.lit(4 * i + 3))
    return p.select(*by, "i", "j", "depth", "w", t(0).alias("x"), t(1).alias("y"), t(2).alias("z"))


def grid_normals(pixels: DataFrame, by: tuple[str, ...] = ("capture_id", "frame"), step: int = 1) -> DataFrame:
    """Normals by central differences of world points on the pixel grid, turned to the camera (cx, cy, cz); all four neighbours needed."""
    row, col = Window.partitionBy(*by, "i").orderBy("j"), Window.partitionBy(*by, "j").orderBy("i")
    d = lambda a, w: F.lead(a, step).over(w) - F.lag(a, step).over(w)
    p = pixels.withColumns({f"_u{a}": d(a, row) for a in "xyz"} | {f"_v{a}": d(a, col) for a in "xyz"})
    p = p.withColumns({"_ju": F.lead("j", step).over(row) - F.lag("j", step).over(row), "_iv": F.lead("i", step).over(col) - F.lag("i", step).over(col)})
    p = p.where(f"_ju = {2 * step} AND _iv = {2 * step}")
    c = F.col
    n = {"nx": c("_uy") * c("_vz") - c("_uz") * c("_vy"), "ny": c("_uz") * c("_vx") - c("_ux") * c("_vz"), "nz": c("_ux") * c("_vy") - c("_uy") * c("_vx")}
    p = p.withColumns(n)
    size = F.sqrt(c("nx") ** 2 + c("ny") ** 2 + c("nz") ** 2)
    sign = F.when(c("nx") * (c("cx") - c("x")) + c("ny") * (c("cy") - c("y")) + c("nz") * (c("cz") - c("z")) < 0, -1.0).otherwise(1.0)
    return p.withColumn("_s", sign / size).where(size > 0).withColumns({a: c(a) * c("_s") for a in n}).drop("_ux", "_uy", "_uz", "_vx", "_vy", "_vz", "_ju", "_iv", "_s")


def strided(pixels: DataFrame, stride: int) -> DataFrame:
    """Every stride-th pixel along both axes."""
    return pixels.where((F.col("i") % stride == 0) & (F.col("j") % stride == 0))


def usable(frames: DataFrame, needs: list[str]) -> DataFrame:
    """Frames for which every one of the flags is true."""
    return frames.where(F.forall(F.array(*(F.coalesce(c, F.lit(False)) for c in needs)), lambda x: x))
