"""Masks on rasters of world points, their sizes on surfaces and placed objects over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import lifting

from .capture import WORLD_SQL, pixels, world
from .tables import POINTS_SQL, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _places(keys: str, source: str) -> str:
    """SQL of each sample's place c in its group's weight, and the next sample: columns of source are keys, x, w."""
    part = f"PARTITION BY {keys}"
    return f"""o AS (SELECT *, row_number() OVER g AS i, count(*) OVER ({part}) AS n, (sum(w) OVER ({part} ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w / 2) / sum(w) OVER ({part}) AS c, lead(x) OVER g AS x1 FROM {source} WINDOW g AS ({part} ORDER BY x, w)),
e AS (SELECT *, lead(c) OVER ({part} ORDER BY i) AS c1 FROM o)"""


def _centred(q: float, only: str = "true") -> str:
    """SQL of a group's quantile from the rows of _places."""
    line = f"CASE WHEN c1 > c THEN x + ({q}::double - c) * (x1 - x) / (c1 - c) ELSE x1 END"
    held = f"least(greatest({line}, CASE WHEN i = 1 THEN x - (x1 - x) / 2 ELSE '-inf'::double END), CASE WHEN i = n - 1 THEN x1 + (x1 - x) / 2 ELSE 'inf'::double END)"
    return f"min(CASE WHEN n = 1 THEN x WHEN x1 IS NOT NULL AND ({q}::double >= c OR i = 1) AND ({q}::double < c1 OR i = n - 1) THEN {held} END) FILTER ({only})"


def _side(lo: str, hi: str, q_lo: float, q_hi: float) -> str:
    return f"({hi} - {lo}) / ({q_hi}::double - {q_lo}::double)"


_AXES = ("x", "y", "z")
_STEPS = ", ".join(f"lead({a}) OVER {w} - {a} AS f{w}{a}, {a} - lag({a}) OVER {w} AS b{w}{a}" for w in ("r", "c") for a in _AXES)
_SIZES = ", ".join(f"sqrt({s}{w}x * {s}{w}x + {s}{w}y * {s}{w}y + {s}{w}z * {s}{w}z) AS {s}{w}" for w in ("r", "c") for s in ("f", "b"))
_DERIVATIVES = ", ".join(f"CASE WHEN f{w} IS NULL THEN b{w}{a} WHEN b{w} IS NULL THEN f{w}{a} WHEN greatest(f{w}, b{w}) <= 2 * least(f{w}, b{w}) THEN (f{w}{a} + b{w}{a}) / 2 WHEN f{w} <= b{w} THEN f{w}{a} ELSE b{w}{a} END AS d{w}{a}" for w in ("r", "c") for a in _AXES)
_AREAS_SQL = f"""{WORLD_SQL}, v AS (SELECT frame, i, j, depth, {", ".join(f"CASE WHEN (frame + i * 8 + j) % 7 <> 0 THEN {a} END AS {a}" for a in _AXES)} FROM world),
st AS (SELECT *, {_STEPS} FROM v WINDOW r AS (PARTITION BY frame, i ORDER BY j), c AS (PARTITION BY frame, j ORDER BY i)), sz AS (SELECT *, {_SIZES} FROM st), dv AS (SELECT frame, i, j, x, y, z, depth, {_DERIVATIVES} FROM sz),
areas AS (SELECT frame, i, j, x, y, z, depth, dry * dcz - drz * dcy AS ax, drz * dcx - drx * dcz AS ay, drx * dcy - dry * dcx AS az, x IS NOT NULL AND drx IS NOT NULL AND dcx IS NOT NULL AS ok FROM dv)"""


def _raster(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).withColumn("valid", (F.col("frame") + F.col("i") * 8 + F.col("j")) % 7 != 0)


@query(f"WITH {_AREAS_SQL} SELECT frame, i, j, round(ax, 5) AS ax, round(ay, 5) AS ay, round(az, 5) AS az FROM areas WHERE ok")
def pixel_areas(spark: SparkSession, d: str) -> DataFrame:
    a = lifting.pixel_areas(_raster(spark, d), ["frame"])
    return a.where("ok").select("frame", "i", "j", *(F.round(c, 5).alias(c) for c in ("ax", "ay", "az")))


_SHARE = "greatest(least((m.{0} + 1) * {1}, (g{0}.n + 1) * 8) - greatest(m.{0} * {1}, g{0}.n * 8), 0) / 8.0::double"


@query(f"""WITH {WORLD_SQL}, m AS (SELECT frame, i, j FROM pixels WHERE depth > 2), s AS (SELECT frame, gi.n AS i, gj.n AS j, {_SHARE.format("i", 5)} * {_SHARE.format("j", 12)} AS s FROM m, generate_series(0, 4) gi(n), generate_series(0, 11) gj(n))
SELECT frame, i, j, round(sum(s), 9) AS coverage FROM s WHERE s > 0 GROUP BY 1, 2, 3""")
def mask_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Masks of 8 x 8 on a raster of 5 x 12."""
    shape = {"mask": 0, "mask_h": 8, "mask_w": 8, "h": 5, "w": 12}
    m = pixels(spark, d).where("depth > 2").select("frame", F.col("i").alias("mi"), F.col("j").alias("mj"), *(F.lit(v).alias(k) for k, v in shape.items()))
    return lifting.mask_coverage(m, ["frame"]).select("frame", "i", "j", F.round("coverage", 9).alias("coverage"))


@query(f"""WITH {_AREAS_SQL}, m AS (SELECT *, (i * 3 + j) % 4 AS mask, sqrt(ax * ax + ay * ay + az * az) AS area, least(depth / 4, 1) AS cov FROM areas), l AS (SELECT frame, mask, x, y, z, ax, ay, az, cov, area, coalesce(ok AND area > 1e-12::double, false) AS valid, CASE WHEN ax * (frame % 7 - x) + ay * (frame % 5 - y) + az * (1.5::double - z) < 0 THEN -1 ELSE 1 END AS turn FROM m WHERE cov > 0.001::double),
f AS (SELECT frame, mask, sum(CASE WHEN valid THEN cov * ax * turn END) AS sx, sum(CASE WHEN valid THEN cov * ay * turn END) AS sy, sum(CASE WHEN valid THEN cov * az * turn END) AS sz, coalesce(sum(cov) FILTER (valid), 0) / sum(cov) AS share FROM l GROUP BY 1, 2),
s AS (SELECT frame, mask, unnest(['x', 'y', 'z']) AS what, unnest([x, y, z]) AS x, cov * area AS w FROM l WHERE valid), {_places("frame, mask, what", "s")}, q AS (SELECT frame, mask, {", ".join(f"{_centred(0.5, f"what = '{a}'")} AS {a}" for a in _AXES)} FROM e GROUP BY 1, 2)
SELECT frame, mask, {", ".join(f"round({a}, 5) AS {a}" for a in _AXES)}, {", ".join(f"round(coalesce(s{a} / sqrt(sx * sx + sy * sy + sz * sz), 0), 5) AS n{a}" for a in _AXES)}, round(share, 6) AS valid_share FROM f LEFT JOIN q USING (frame, mask)""")
def lifted_masks(spark: SparkSession, d: str) -> DataFrame:
    """Masks of every fourth diagonal, covered in proportion to depth, on the points of their view."""
    f, p = F.col("frame"), _raster(spark, d)
    covered = p.select("frame", ((F.col("i") * 3 + F.col("j")) % 4).alias("mask"), "i", "j", F.least(F.col("depth") / 4, F.lit(1.0)).alias("coverage"))
    cameras = p.select("frame").distinct().select("frame", (f % 7).cast("double").alias("cx"), (f % 5).cast("double").alias("cy"), F.lit(1.5).alias("cz"))
    lifted = lifting.lift_masks(covered, lifting.pixel_areas(p, ["frame"]), cameras, ["frame"])
    found = lifting.mask_medians(lifted, ["frame"])
    return found.select("frame", "mask", *(F.round(c, 5).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")), F.round("valid_share", 6).alias("valid_share"))


@query(f"""WITH {POINTS_SQL}, p AS (SELECT label, point_id % 5 AS m, x AS u, y AS v, z AS d, w AS coverage, score + 0.1::double AS projected, abs(nx) < 0.2::double AS fits, point_id % 4 <> 0 AS valid FROM points), t AS (SELECT label, m, sum(coverage) AS total, sum(coverage) FILTER (valid) AS known FROM p GROUP BY 1, 2),
s0 AS (SELECT label, m, d AS x, coverage * projected AS w FROM p WHERE valid), {_places("label, m", "s0").replace("o AS", "o0 AS").replace("e AS", "e0 AS").replace("FROM o)", "FROM o0)")}, mid AS (SELECT label, m, {_centred(0.5)} AS d0 FROM e0 GROUP BY 1, 2),
inl AS (SELECT p.*, coverage * projected AS wa FROM p JOIN mid USING (label, m) WHERE valid AND fits AND abs(d - d0) <= 0.1::double), sums AS (SELECT label, m, sum(coverage) AS c, sum(wa) AS s, sum(wa * u) / sum(wa) AS mu, sum(wa * v) / sum(wa) AS mv, count(*) AS n FROM inl GROUP BY 1, 2), kept AS (SELECT * FROM sums WHERE c >= 0.5::double AND s > 0),
turn AS (SELECT label, m, atan2(2 * sum(wa * (u - mu) * (v - mv)), sum(wa * (u - mu) * (u - mu)) - sum(wa * (v - mv) * (v - mv))) / 2 AS t FROM inl JOIN kept USING (label, m) GROUP BY 1, 2), al AS (SELECT inl.*, (u - mu) * cos(t) + (v - mv) * sin(t) AS along FROM inl JOIN kept USING (label, m) JOIN turn USING (label, m)),
s AS (SELECT label, m, unnest(['u', 'v', 'l', 'p']) AS what, unnest([u, v, along, projected]) AS x, unnest([wa, wa, wa, coverage]) AS w FROM al), {_places("label, m, what", "s")},
q AS (SELECT label, m, {", ".join(f"{_centred(at, f"what = '{a}'")} AS {a}{k}" for a in "uvl" for k, at in ((0, 0.02), (1, 0.98)))}, {_centred(0.5, "what = 'p'")} AS px FROM e GROUP BY 1, 2)
SELECT label, m, round(s * total / known, 6) AS area, n, round({_side("u0", "u1", 0.02, 0.98)}, 6) AS width, round({_side("v0", "v1", 0.02, 0.98)}, 6) AS height, round({_side("l0", "l1", 0.02, 0.98)}, 6) AS length, round(sqrt(px), 6) AS pixel, round(c / known, 6) AS inlier, round(known / total, 6) AS valid_share FROM kept JOIN t USING (label, m) JOIN q USING (label, m) WHERE known >= 0.25::double * total""")
def measured_masks(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    p = points(spark, d).select("label", (c("point_id") % 5).alias("m"), c("x").alias("u"), c("y").alias("v"), c("z").alias("d"), c("w").alias("coverage"), (c("score") + 0.1).alias("projected"), (F.abs("nx") < 0.2).alias("on_surface"), (c("point_id") % 4 != 0).alias("valid"))
    s = lifting.measure_on_surface(p, ["label", "m"], off_plane=0.1, least=0.5)
    return s.select("label", "m", "n", *(F.round(k, 6).alias(k) for k in ("area", "width", "height", "length", "pixel", "inlier", "valid_share")))


@query(f"""WITH {POINTS_SQL}, s AS (SELECT label, unnest(['x', 'y', 'z']) AS what, unnest([x, y, z]) AS x, w FROM points), {_places("label, what", "s")}
SELECT label, max(n) AS n, round({_centred(0.5, "what = 'x'")}, 6) AS x, round({_centred(0.5, "what = 'y'")}, 6) AS y, {", ".join(f"round({_centred(at, f"what = '{a}'")}, 6) AS {a}{k}" for a in _AXES for k, at in ((0, 0.05), (1, 0.95)))} FROM e GROUP BY 1 HAVING max(n) >= 3""")
def placed_objects(spark: SparkSession, d: str) -> DataFrame:
    o = lifting.place_objects(points(spark, d), ["label"])
    return o.select("label", "n", *(F.round(k, 6).alias(k) for k in ("x", "y", "x0", "x1", "y0", "y1", "z0", "z1")))
