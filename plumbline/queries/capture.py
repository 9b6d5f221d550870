"""Sensor logs, depth rasters, clouds, trajectories and their summaries over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import columns as fn
from plumbline.operators import bins, joins, loops, planes, quantiles, shapes, windows
from plumbline.plans.result import annotate_lengths, fallback_interval
from plumbline.session import read_table
from plumbline.sources import sensor_log

from .tables import POINTS_SQL, events, lineitem, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# embeddings as depth rasters of 8 x 8 pixels, a frame each; confidence by place, one in four without
PIXELS_SQL = """pixels AS (SELECT vec_id AS frame, (n.k // 8)::int AS i, (n.k % 8)::int AS j, abs(embedding[n.k + 1]::double) * 20 AS depth, CASE WHEN (vec_id + n.k) % 4 < 3 THEN (vec_id + n.k) % 4 END AS conf FROM embeddings, generate_series(0, 63) n(k))"""
WORLD_SQL = f"""{PIXELS_SQL}, cam AS (SELECT *, (j - 3.5::double) * depth / 50 AS cx, (i - 3.5::double) * depth / 50 AS cy, cos(frame * 0.01::double) AS c, sin(frame * 0.01::double) AS s FROM pixels),
world AS (SELECT frame, i, j, depth, c * cx - s * cy + frame % 7 AS x, s * cx + c * cy + frame % 5 AS y, depth + 1.5::double AS z FROM cam)"""


def pixels(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("k", "v"))
    place = (F.col("frame") + F.col("k")) % 4
    return e.select("frame", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).alias("j"), (F.abs(F.col("v").cast("double")) * 20).alias("depth"), F.when(place < 3, place).alias("conf"))


def world(spark: SparkSession, d: str) -> DataFrame:
    p = pixels(spark, d)
    f = F.col("frame")
    c, s = F.cos(f * 0.01), F.sin(f * 0.01)
    number = lambda *xs: F.array(*(F.lit(float(x)) if isinstance(x, (int, float)) else x.cast("double") for x in xs))
    poses = p.select("frame").distinct().select("frame", number(50, 0, 3.5, 0, 50, 3.5, 0, 0, 1).alias("K"), number(c, -s, 0, f % 7, s, c, 0, f % 5, 0, 0, 1, 1.5, 0, 0, 0, 1).alias("T_wc"))
    return sensor_log.backproject(p.withColumn("w", F.lit(1.0)), poses, ("frame",))


@query(f"""WITH {PIXELS_SQL}, n AS (SELECT *, lag(depth) OVER r AS a, lead(depth) OVER r AS b, lag(depth) OVER c AS u, lead(depth) OVER c AS v FROM pixels WINDOW r AS (PARTITION BY frame, i ORDER BY j), c AS (PARTITION BY frame, j ORDER BY i))
SELECT frame, i, j, CASE WHEN depth BETWEEN 0.2::double AND 4.5::double AND NOT coalesce(abs(a - depth) > 0.1::double * least(a, depth), false) AND NOT coalesce(abs(b - depth) > 0.1::double * least(b, depth), false) AND NOT coalesce(abs(u - depth) > 0.1::double * least(u, depth), false) AND NOT coalesce(abs(v - depth) > 0.1::double * least(v, depth), false)
 THEN CASE conf WHEN 2 THEN 1.0::double WHEN 1 THEN 0.3::double WHEN 0 THEN 0.0::double ELSE 0.3::double END ELSE 0.0::double END AS w FROM n""")
def depth_weights(spark: SparkSession, d: str) -> DataFrame:
    return sensor_log.depth_weight(pixels(spark, d), ("frame",)).select("frame", "i", "j", "w")


@query(f"WITH {WORLD_SQL} SELECT frame, i, j, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM world")
def backprojected(spark: SparkSession, d: str) -> DataFrame:
    return world(spark, d).select("frame", "i", "j", *(F.round(c, 6).alias(c) for c in "xyz"))


@query(f"""WITH {WORLD_SQL}, n AS (SELECT *, lead(x) OVER r - lag(x) OVER r AS ux, lead(y) OVER r - lag(y) OVER r AS uy, lead(z) OVER r - lag(z) OVER r AS uz, lead(x) OVER c - lag(x) OVER c AS vx, lead(y) OVER c - lag(y) OVER c AS vy, lead(z) OVER c - lag(z) OVER c AS vz FROM world WINDOW r AS (PARTITION BY frame, i ORDER BY j), c AS (PARTITION BY frame, j ORDER BY i)),
m AS (SELECT *, uy * vz - uz * vy AS nx, uz * vx - ux * vz AS ny, ux * vy - uy * vx AS nz FROM n WHERE ux IS NOT NULL AND vx IS NOT NULL), l AS (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS size, CASE WHEN nx * (frame % 7 - x) + ny * (frame % 5 - y) + nz * (1.5::double - z) < 0 THEN -1 ELSE 1 END AS s FROM m)
SELECT frame, i, j, round(nx * s / size, 5) AS nx, round(ny * s / size, 5) AS ny, round(nz * s / size, 5) AS nz FROM l WHERE size > 0""")
def pixel_normals(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("frame")
    p = world(spark, d).withColumns({"cx": (f % 7).cast("double"), "cy": (f % 5).cast("double"), "cz": F.lit(1.5)})
    return sensor_log.grid_normals(p, ("frame",)).select("frame", "i", "j", *(F.round(c, 5).alias(c) for c in ("nx", "ny", "nz")))


@query(f"WITH {PIXELS_SQL} SELECT frame, i, j, depth FROM pixels WHERE i % 3 = 0 AND j % 3 = 0")
def pixel_stride(spark: SparkSession, d: str) -> DataFrame:
    return sensor_log.strided(pixels(spark, d), 3).select("frame", "i", "j", "depth")


@query(f"""WITH {POINTS_SQL}, ok AS (SELECT * FROM points WHERE nx*nx+ny*ny+nz*nz > 0 AND w > 0 AND w <= 1), m AS (SELECT label, median(x) AS mx, median(y) AS my, median(z) AS mz FROM ok GROUP BY 1), d AS (SELECT ok.*, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS d FROM ok JOIN m USING (label)), l AS (SELECT label, 1.5::double * median(d) AS top FROM d GROUP BY 1)
SELECT point_id FROM d JOIN l USING (label) WHERE d <= top""")
def sane_points(spark: SparkSession, d: str) -> DataFrame:
    return planes.sanitise(points(spark, d), ["label"], 1.5).select("point_id")


@query(f"""WITH {POINTS_SQL} SELECT point_id, CASE WHEN abs(nz) / sqrt(nx*nx+ny*ny+nz*nz) > 0.85::double THEN 'horizontal' WHEN abs(nz) / sqrt(nx*nx+ny*ny+nz*nz) < 0.3::double THEN 'vertical' END AS facing,
CASE WHEN greatest(abs(nx), abs(ny)) / sqrt(nx*nx+ny*ny) < {math.cos(math.radians(25.0))!r}::double THEN -1 WHEN abs(nx) >= abs(ny) THEN CASE WHEN nx > 0 THEN 0 ELSE 1 END ELSE CASE WHEN ny > 0 THEN 2 ELSE 3 END END AS code FROM points""")
def direction_codes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("point_id", planes.facing("nx", "ny", "nz").alias("facing"), planes.direction_code("nx", "ny").alias("code"))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS capture_id, o_orderkey AS frame FROM orders), z AS (SELECT DISTINCT l_suppkey AS capture_id, l_orderkey AS frame FROM lineitem WHERE l_returnflag = 'A'), c AS (SELECT DISTINCT l_suppkey AS capture_id, l_orderkey AS frame FROM lineitem WHERE l_linestatus = 'F')
SELECT p.capture_id, p.frame, z.frame IS NOT NULL AS has_depth, c.frame IS NOT NULL AS has_confidence FROM p LEFT JOIN z USING (capture_id, frame) LEFT JOIN c USING (capture_id, frame)""")
def frame_presence(spark: SparkSession, d: str) -> DataFrame:
    o, li = orders(spark, d), lineitem(spark, d)
    found = lambda c, v: li.where(F.col(c) == v).select(F.col("l_suppkey").alias("capture_id"), F.col("l_orderkey").alias("number"))
    f = sensor_log.frames(o.select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("frame")), found("l_returnflag", "A"), found("l_linestatus", "F"))
    return f.select("capture_id", "frame", "has_depth", "has_confidence")


@query("""SELECT l_suppkey AS capture_id, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = l_suppkey AND o_orderkey = l_orderkey) GROUP BY 1""")
def orphan_rasters(spark: SparkSession, d: str) -> DataFrame:
    poses = orders(spark, d).select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").alias("frame"))
    return sensor_log.orphans(poses, lineitem(spark, d).select(F.col("l_suppkey").alias("capture_id"), F.col("l_orderkey").alias("number")))


@query("""WITH p AS (SELECT DISTINCT o_custkey AS c, o_orderkey AS f, o_totalprice FROM orders), z AS (SELECT DISTINCT l_orderkey AS f FROM lineitem WHERE l_returnflag = 'A') SELECT c AS o_custkey, f AS o_orderkey FROM p WHERE f IN (SELECT f FROM z) AND o_totalprice > 100000""")
def usable_frames(spark: SparkSession, d: str) -> DataFrame:
    depth = lineitem(spark, d).where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("frame")).distinct().withColumn("has_depth", F.lit(True))
    f = orders(spark, d).withColumn("frame", F.col("o_orderkey")).join(depth, "frame", "left").withColumn("good", F.col("o_totalprice") > 100_000)
    return sensor_log.usable(f, ["has_depth", "good"]).select("o_custkey", "o_orderkey")


_LINES_SQL = """lines AS (SELECT user_id AS capture_id, event_id AS frame, epoch_us(ts) / 1e6::double AS t, value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 10 END AS fx, (event_id % 13) <> 0 AND (event_id % 17) <> 0 AS ok FROM events)"""


@query(f"""WITH {_LINES_SQL}, k AS (SELECT *, frame - lag(frame) OVER w - 1 AS gap, t <= lag(t) OVER w AS late, last_value(fx IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f0, first_value(fx IGNORE NULLS) OVER (PARTITION BY capture_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f1 FROM lines WHERE ok WINDOW w AS (PARTITION BY capture_id ORDER BY frame))
SELECT capture_id, frame, round(t, 6) AS timestamp, round(value, 6) AS x, round(coalesce(f1, f0), 6) AS fx, coalesce(gap, 0) AS gap, coalesce(late, false) AS late FROM k""")
def odometry_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as odometry lines of a capture: with a header, a byte order mark, missing intrinsics, words for numbers and bad quaternions."""
    e = events(spark, d)
    i = F.col("event_id")
    fx = F.when(i % 5 == 0, "").otherwise((F.col("value") * 10).cast("string"))
    qw = F.when(i % 13 == 0, "0.1").otherwise("1.0")
    x = F.when(i % 17 == 0, "word").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(", ", (F.col("t_us") / 1e6).cast("string"), i.cast("string"), x, F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), qw, fx, fx, F.lit("1"), F.concat(F.lit("2"), F.lit("\r")))
    lines = e.select(F.col("user_id").alias("capture_id"), (i + 1).alias("line_no"), line.alias("line"))
    head = e.select(F.col("user_id").alias("capture_id")).distinct().select("capture_id", F.lit(0).cast("long").alias("line_no"), F.lit("﻿timestamp, frame, x, y, z, qx, qy, qz, qw, fx, fy, cx, cy").alias("line"))
    o = sensor_log.odometry(lines.union(head))
    return o.select("capture_id", "frame", F.round("timestamp", 6).alias("timestamp"), F.round("x", 6).alias("x"), F.round("fx", 6).alias("fx"), "gap", "late")


@query("""WITH m AS (SELECT user_id, event_id, value / CASE WHEN user_id % 2 = 0 THEN 40 ELSE 4 END AS ax FROM events), g AS (SELECT user_id, median(sqrt(ax * ax)) AS m FROM m GROUP BY 1), u AS (SELECT user_id, CASE WHEN m BETWEEN 0.5 AND 2 THEN 'g' WHEN m BETWEEN 5 AND 20 THEN 'm/s2' ELSE 'unknown' END AS unit FROM g)
SELECT m.user_id AS capture_id, event_id::double AS t, unit, round(CASE unit WHEN 'g' THEN ax * 9.80665::double ELSE ax END, 6) AS ax FROM m JOIN u USING (user_id)""")
def imu_units(spark: SparkSession, d: str) -> DataFrame:
    ax = F.col("value") / F.when(F.col("user_id") % 2 == 0, 40).otherwise(4)
    lines = events(spark, d).select(F.col("user_id").alias("capture_id"), F.concat_ws(",", "event_id", ax.cast("string"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0"), F.lit("0")).alias("line"))
    return sensor_log.imu(lines).select("capture_id", "t", "unit", F.round("ax", 6).alias("ax"))


@query("""SELECT s_suppkey AS capture_id, 100.0::double + s_suppkey AS fx, 0.5::double + s_suppkey AS cx FROM supplier WHERE s_suppkey % 7 <> 0""")
def camera_matrices(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as camera files; every seventh has a focal length of 0, which is none."""
    k = F.col("s_suppkey")
    f = F.when(k % 7 == 0, F.lit(0)).otherwise(100 + k).cast("string")
    text = F.concat(f, F.lit(" 0 "), (k + 0.5).cast("string"), F.lit("\n0, "), f, F.lit(", 3e1\n[0;0;1] rest 7"))
    m = sensor_log.camera_matrix(read_table(spark, d, "supplier").select(k.alias("capture_id"), text.alias("text")))
    return m.select("capture_id", F.col("K")[0].alias("fx"), F.col("K")[2].alias("cx"))


@query("""WITH f AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'view'), v AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'purchase'), r AS (SELECT f.user_id, f.event_id, v.event_id AS nearest, row_number() OVER (PARTITION BY f.event_id ORDER BY abs(f.t - v.t), v.t, v.event_id DESC) AS n FROM f LEFT JOIN v ON v.user_id = f.user_id)
SELECT user_id, event_id, nearest AS nearest_view FROM r WHERE n = 1""")
def nearest_views(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    f, v = e.where("event_type = 'view'").select("user_id", "t_us", "event_id"), e.where("event_type = 'purchase'").select("user_id", "t_us", F.col("event_id").alias("view"))
    return joins.nearest_in_time(f, v, ["user_id"], "t_us", "view").select("user_id", "event_id", "nearest_view")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::double AS t, value FROM events), n AS (SELECT *, abs(value - lag(value) OVER w) AS d, greatest(t - lag(t) OVER w, 1e-9::double) AS dt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, event_id, coalesce(d > 20 AND d / dt > 0.001::double, false) AS jump FROM n""")
def pose_jumps(spark: SparkSession, d: str) -> DataFrame:
    return windows.jumps(_timed(spark, d), ["user_id"], "t", ["value"], 0.001, 20.0).select("user_id", "event_id", "jump")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("t", F.col("t_us") / 1e6)


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::double AS t, value FROM events), n AS (SELECT *, abs(value - lag(value) OVER w) AS d, greatest(t - lag(t) OVER w, 1e-9::double) AS dt, min(t) OVER (PARTITION BY user_id) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
b AS (SELECT *, floor((t - t0) / 86400.0::double) AS bin, sum(coalesce(d > 40 AND d / dt > 0.001::double, false)::int) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS broken FROM n), s AS (SELECT *, coalesce((bin <> lag(bin) OVER w OR broken <> lag(broken) OVER w)::int, 0) AS step FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::bigint AS segment FROM s) SELECT user_id, event_id, segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY abs(t - (t0 + (bin + 0.5::double) * 86400.0::double)), t) = 1 AS anchor FROM g""")
def trajectory_segments(spark: SparkSession, d: str) -> DataFrame:
    j = windows.jumps(_timed(spark, d), ["user_id"], "t", ["value"], 0.001, 40.0)
    return windows.segments(j, ["user_id"], "t", 86_400.0).select("user_id", "event_id", "segment", "anchor")


@query("""WITH e AS (SELECT user_id, event_id, date_trunc('day', ts)::timestamp AS slot, value, event_id % 10 / 10.0::double AS valid FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, slot ORDER BY valid >= 0.5::double DESC, value, event_id) AS n FROM e) SELECT user_id, slot, event_id FROM r WHERE n = 1""")
def calm_views(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("valid", F.col("event_id") % 10 / 10.0)
    return windows.calm_view_per_slot(e, ["user_id"], F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"), "valid", "value", "event_id", 0.5).select("user_id", "slot", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, value FROM events) SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS smooth FROM e""")
def neighbour_smoothing(spark: SparkSession, d: str) -> DataFrame:
    e = _timed(spark, d)
    return e.withColumn("smooth", F.round(windows.neighbour_average(e, ["user_id"], "t_us", "value", 1), 6)).select("user_id", "event_id", "smooth")


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), m AS (SELECT a.user_id, a.event_id, any_value(a.value) AS value, median(b.value) AS m FROM e a JOIN e b ON a.user_id = b.user_id AND abs(a.n - b.n) <= 3 GROUP BY 1, 2) SELECT user_id, event_id, abs(value - m) > 30 AS outlier FROM m""")
def neighbour_outliers(spark: SparkSession, d: str) -> DataFrame:
    return windows.outliers(_timed(spark, d), ["user_id"], ["t_us", "event_id"], "value", 3, 30.0).select("user_id", "event_id", "outlier")


@query("""WITH e AS (SELECT user_id, event_id, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts)), 0) AS d FROM events) SELECT user_id, event_id, round(sum(d) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS path FROM e""")
def path_lengths(spark: SparkSession, d: str) -> DataFrame:
    return windows.cumulative_path(_timed(spark, d), ["user_id"], "t", ["value"]).select("user_id", "event_id", F.round("path", 6).alias("path"))


@query("""WITH s AS (SELECT l_suppkey AS k, l_linenumber AS n, sum(l_quantity) AS yaw, sum(l_discount) AS dx FROM lineitem GROUP BY 1, 2), a AS (SELECT *, sum(yaw) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * 0.001::double AS before FROM s)
SELECT k AS l_suppkey, n AS l_linenumber, round(sum(cos(coalesce(before, 0)) * dx) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS x, round(sum(sin(coalesce(before, 0)) * dx) OVER (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS y, round((coalesce(before, 0) + yaw * 0.001::double), 6) AS yaw FROM a""")
def chained_poses(spark: SparkSession, d: str) -> DataFrame:
    """Relative steps (turn, then distance ahead) chained from the origin: the product of the transforms so far."""
    s = lineitem(spark, d).groupBy("l_suppkey", "l_linenumber").agg((F.sum("l_quantity") * 0.001).alias("yaw"), F.sum("l_discount").alias("dx"), F.lit(0.0).alias("dy"))
    c = windows.chain_poses(s, ["l_suppkey"], "l_linenumber", "dx", "dy", "yaw")
    return c.select("l_suppkey", "l_linenumber", *(F.round(k, 6).alias(k) for k in ("x", "y", "yaw")))


@query(f"WITH {PIXELS_SQL.replace('pixels AS (', 'pixels AS MATERIALIZED (')}, a AS MATERIALIZED (SELECT frame * 64 + i * 8 + j AS k, frame, i, j, depth FROM pixels), b AS MATERIALIZED (SELECT frame * 64 + j * 8 + i AS k, depth FROM pixels) SELECT frame, i, j, round(a.depth + b.depth, 6) AS both FROM a JOIN b USING (k)")
def shared_pixels(spark: SparkSession, d: str) -> DataFrame:
    """A raster and its mirror as two runs; all their common pixels, as a frame has fewer than the sample."""
    a = pixels(spark, d).select("frame", "i", "j", *(F.col("depth").alias(k) for k in "xyz"))
    b = a.select("frame", F.col("j").alias("i"), F.col("i").alias("j"), "x", "y", "z")
    return planes.shared_pixels(a, b, [], 64).select("frame", "i", "j", F.round(F.col("x") + F.col("x_b"), 6).alias("both"))


@query()
def covisibility(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each frame's points that another frame of its label sees: no SQL, tested against plain Python."""
    points_, views, depth = _covisible_inputs(spark, d)
    return planes.covisible(points_, views, depth, cell=1.0).select("capture_id", "view_a", F.round("share", 9).alias("share"))


def _covisible_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    label = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("capture_id"))
    p = pixels(spark, d).join(label, "frame").withColumn("depth", 1 + F.col("depth") / 4)
    at = lambda c, n: F.col("frame") % n / 50.0
    world = p.select("capture_id", F.col("frame").alias("view_a"), (F.col("i") * 8 + F.col("j")).alias("point"), ((F.col("j") - 3.5) * F.col("depth") / 8 + at("x", 7)).alias("x"), ((F.col("i") - 3.5) * F.col("depth") / 8 + at("y", 5)).alias("y"), F.col("depth").alias("z"))
    one = F.array(*(F.lit(float(x)) for x in (1, 0, 0, 0, 1, 0, 0, 0, 1)))
    views = label.select("capture_id", F.col("frame").alias("view_id"), one.alias("R"), (-at("x", 7)).alias("tx"), (-at("y", 5)).alias("ty"), F.lit(0.0).alias("tz"), F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.lit(3.5).alias("cx"), F.lit(3.5).alias("cy"))
    return world, views, p.select("capture_id", F.col("frame").alias("view_id"), "i", "j", "depth")


@query(f"""WITH {POINTS_SQL}, p AS (SELECT *, w + 1e-6::double AS ww, floor(x / 0.2::double)::bigint AS ix, floor(y / 0.2::double)::bigint AS iy, floor(z / 0.2::double)::bigint AS iz FROM points),
g AS (SELECT ix, iy, iz, sum(ww*x)/sum(ww) AS x, sum(ww*y)/sum(ww) AS y, sum(ww*z)/sum(ww) AS z, sum(ww*nx) AS sx, sum(ww*ny) AS sy, sum(ww*nz) AS sz, sum(ww) AS s, arg_max(label, (score, -point_id)) AS label, arg_max(nx, (score, -point_id)) AS bx, arg_max(ny, (score, -point_id)) AS by_, arg_max(nz, (score, -point_id)) AS bz FROM p GROUP BY 1, 2, 3),
n AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz) AS len FROM g), m AS (SELECT *, CASE WHEN len < 0.3::double * s THEN bx ELSE sx/len END AS nx, CASE WHEN len < 0.3::double * s THEN by_ ELSE sy/len END AS ny, CASE WHEN len < 0.3::double * s THEN bz ELSE sz/len END AS nz FROM n),
f AS (SELECT *, CASE WHEN nx*(label-x)+ny*(1-y)+nz*(2-z) < 0 THEN -1 ELSE 1 END AS t FROM m) SELECT ix, iy, iz, label AS view_idx, round(x, 9) AS x, round(nx*t, 6) AS nx, round(ny*t, 6) AS ny, round(nz*t, 6) AS nz FROM f""")
def voxel_fused(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("view_idx", F.col("label"))
    cams = p.select("view_idx").distinct().select("view_idx", F.col("view_idx").cast("double").alias("cx"), F.lit(1.0).alias("cy"), F.lit(2.0).alias("cz"))
    v = bins.voxel_fused(p, 0.2, cams)
    return v.select("ix", "iy", "iz", "view_idx", F.round("x", 9).alias("x"), *(F.round(c, 6).alias(c) for c in ("nx", "ny", "nz")))


@query("""WITH s AS (SELECT l_suppkey, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM s) SELECT l_suppkey, min(CASE WHEN cw >= 0.9::double * t THEN x END) AS q FROM c GROUP BY 1""")
def weighted_quantile(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.weighted_quantile_step(lineitem(spark, d), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.9)


_EXTENT = """a{n} AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY k) AS n, (sum(w) OVER (PARTITION BY k ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w / 2) / sum(w) OVER (PARTITION BY k) AS c, lead(x) OVER o AS x1 FROM a WINDOW o AS (PARTITION BY k ORDER BY x, w)),
e{n} AS (SELECT *, lead(c) OVER (PARTITION BY k ORDER BY i) AS c1 FROM a{n}), p{n} AS (SELECT * FROM e{n} WHERE n = 1 OR (x1 IS NOT NULL AND ({q}::double >= c OR i = 1) AND ({q}::double < c1 OR i = n - 1))), v{n} AS (SELECT *, CASE WHEN n = 1 THEN x WHEN c1 > c THEN x + ({q}::double - c) * (x1 - x) / (c1 - c) ELSE x1 END AS line FROM p{n}),
q{n} AS (SELECT k, min(CASE WHEN n = 1 THEN x ELSE least(greatest(line, CASE WHEN i = 1 THEN x - (x1 - x) / 2 ELSE line END), CASE WHEN i = n - 1 THEN x1 + (x1 - x) / 2 ELSE line END) END) AS q FROM v{n} GROUP BY 1)"""


@query("WITH a AS (SELECT l_suppkey AS k, l_extendedprice AS x, l_quantity::double AS w FROM lineitem), " + _EXTENT.format(n=1, q=0.05) + ", " + _EXTENT.format(n=2, q=0.95) + " SELECT q1.k AS l_suppkey, round((q1.q + q2.q) / 2 - (q2.q - q1.q) / 2 / 0.9::double, 4) AS lo, round((q1.q + q2.q) / 2 + (q2.q - q1.q) / 2 / 0.9::double, 4) AS hi FROM q1 JOIN q2 ON q1.k = q2.k")
def robust_extents(spark: SparkSession, d: str) -> DataFrame:
    r = quantiles.robust_extent(lineitem(spark, d), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.05, 0.95)
    return r.select("l_suppkey", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("""WITH r AS (SELECT l_suppkey AS k, l_extendedprice AS x, l_quantity AS y, l_returnflag = 'A' AS f FROM lineitem), n AS (SELECT k, sum(f::int) >= 100 AS enough FROM r GROUP BY 1), o AS (SELECT r.* FROM r JOIN n USING (k) WHERE f OR NOT enough)
SELECT k AS l_suppkey, round(quantile_cont(x, 0.02), 6) AS x0, round(quantile_cont(x, 0.98), 6) AS x1, round(quantile_cont(y, 0.02), 6) AS y0, round(quantile_cont(y, 0.98), 6) AS y1 FROM o GROUP BY 1 HAVING quantile_cont(x, 0.98) - quantile_cont(x, 0.02) >= 0.5 AND quantile_cont(y, 0.98) - quantile_cont(y, 0.02) >= 0.5""")
def fallback_extents(spark: SparkSession, d: str) -> DataFrame:
    own = lineitem(spark, d).withColumn("f", F.col("l_returnflag") == "A")
    r = quantiles.fallback_extent(own, ["l_suppkey"], "l_extendedprice", "l_quantity", "f")
    return r.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("x0", "x1", "y0", "y1")))


@query("""WITH g AS (SELECT l_linenumber AS ix, l_quantity::bigint AS iy, sum(l_tax) AS v FROM lineitem GROUP BY 1, 2), c AS (SELECT o_orderkey AS cell, 1.25::double + o_orderkey % 3 AS x0, 3.5::double + o_orderkey % 4 AS x1, 10.0::double + o_orderkey % 7 / 2.0::double AS y0, 14.5::double + o_orderkey % 5 AS y1 FROM orders),
m AS (SELECT cell, coalesce(v, 0) AS v, greatest(least(x1, i.i + 1) - greatest(x0, i.i), 0) * greatest(least(y1, j.j + 1) - greatest(y0, j.j), 0) AS a FROM c JOIN generate_series(0, 20) i(i) ON i.i >= floor(x0) AND i.i < x1 JOIN generate_series(0, 60) j(j) ON j.j >= floor(y0) AND j.j < y1 LEFT JOIN g ON g.ix = i.i AND g.iy = j.j) SELECT cell, round(sum(v * a) / sum(a), 6) AS share FROM m GROUP BY 1""")
def box_overlap_mean(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cells = orders(spark, d).select(k.alias("cell"), (1.25 + k % 3).alias("x0"), (3.5 + k % 4).alias("x1"), (10.0 + k % 7 / 2.0).alias("y0"), (14.5 + k % 5).alias("y1"))
    grid = lineitem(spark, d).groupBy(F.col("l_linenumber").cast("long").alias("ix"), F.col("l_quantity").cast("long").alias("iy")).agg(F.sum("l_tax").alias("v"))
    return bins.box_mean_by_overlap(cells, grid, 1.0).select("cell", F.round("share", 6).alias("share"))


@query(f"WITH {POINTS_SQL}, f AS (SELECT DISTINCT label, floor(x / 0.25::double)::bigint AS ix, floor(y / 0.25::double)::bigint AS iy FROM points), s AS (SELECT DISTINCT label, floor(z / 0.25::double)::bigint AS ix, floor(nx / 0.25::double)::bigint AS iy FROM points) SELECT label, round(avg((s.ix IS NOT NULL)::int), 9) AS coverage FROM f LEFT JOIN s USING (label, ix, iy) GROUP BY 1")
def ceiling_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    floor = p.select("label", bins.bin_of(F.col("x"), 0.25).alias("ix"), bins.bin_of(F.col("y"), 0.25).alias("iy")).distinct()
    above = p.select("label", F.col("z").alias("x"), F.col("nx").alias("y"))
    return shapes.ceiling_coverage(above, floor, 0.25, ["label"]).select("label", F.round("coverage", 9).alias("coverage"))


_TURN = "abs((a - theta + pi() / 4) - floor((a - theta + pi() / 4) / (pi() / 2)) * (pi() / 2) - pi() / 4)"
_ANGLE = "SELECT l_returnflag, atan2(sum(l_quantity * sin(4 * a)), sum(l_quantity * cos(4 * a))) / 4 AS theta FROM"


@query(f"""WITH v AS (SELECT *, l_discount * 10 AS a FROM lineitem), t0 AS ({_ANGLE} v GROUP BY 1), t1 AS ({_ANGLE} v JOIN t0 USING (l_returnflag) WHERE {_TURN} <= radians(20.0::double) GROUP BY 1), t2 AS ({_ANGLE} v JOIN t1 USING (l_returnflag) WHERE {_TURN} <= radians(12.0::double) GROUP BY 1) SELECT l_returnflag, round(theta, 6) AS theta FROM t2""")
def refined_direction(spark: SparkSession, d: str) -> DataFrame:
    m = shapes.refined_manhattan_angle(lineitem(spark, d).withColumn("a", F.col("l_discount") * 10), ["l_returnflag"], "a", "l_quantity", (20.0, 12.0))
    return m.select("l_returnflag", F.round("theta", 6).alias("theta"))


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS i, datediff('day', DATE '1992-01-01', o_orderdate::date)::double AS x, floor(o_totalprice / 1000) AS y FROM orders), e AS (SELECT *, atan2(coalesce(lead(y) OVER w, first_value(y) OVER f) - y, coalesce(lead(x) OVER w, first_value(x) OVER f) - x) AS a FROM v WINDOW w AS (PARTITION BY k ORDER BY i), f AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
b AS (SELECT e.k, e.i, max(v.x * cos(a) + v.y * sin(a)) - min(v.x * cos(a) + v.y * sin(a)) AS u, max(v.y * cos(a) - v.x * sin(a)) - min(v.y * cos(a) - v.x * sin(a)) AS w FROM e JOIN v ON v.k = e.k GROUP BY 1, 2), m AS (SELECT k, min(round(u * w, 6)) AS area FROM b GROUP BY 1) SELECT k AS o_custkey, area FROM m""")
def ring_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Area of the smallest box along an edge; its aspect has ties that two engines may break apart."""
    o = orders(spark, d)
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("double")
    b = shapes.ring_boxes(o.withColumns({"x": day, "y": F.floor(F.col("o_totalprice") / 1000).cast("double")}), ["o_custkey"], "o_orderkey", "x", "y")
    return b.groupBy("o_custkey").agg(F.min(F.round(F.col("u") * F.col("v"), 6)).alias("area"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice * 0.9::double END AS lo, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice * 1.1::double END AS hi FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo ELSE greatest(x - 1.5::double * (0.5::double * x + 3), 0) END, 6) AS lo, round(CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN hi ELSE x + 1.5::double * (0.5::double * x + 3) END, 6) AS hi FROM v""")
def fallback_intervals(spark: SparkSession, d: str) -> DataFrame:
    x, n = F.col("l_extendedprice"), F.col("l_linenumber")
    iv = fallback_interval(x, F.when(n % 2 == 0, x * 0.9), F.when(n % 3 != 0, x * 1.1), 3.0, 1.5)
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(iv["lo"], 6).alias("lo"), F.round(iv["hi"], 6).alias("hi"))


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x, l_quantity / 50 AS f, l_discount * 100 AS r, CASE WHEN l_linenumber = 1 THEN 4.0::double ELSE 0 END AS up FROM lineitem), s AS (SELECT *, sqrt(pow(x * 0.01::double, 2) + pow(sqrt(pow(2.0::double * CASE WHEN f < 0.3::double THEN 2.0::double WHEN f < 0.6::double THEN 1.4::double ELSE 1 END, 2) + pow(r, 2)), 2)) AS sigma FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(x - 1.645::double * 1.3::double * sigma, 0), 6) AS lo, round(x + 1.645::double * 1.3::double * sqrt(pow(sigma, 2) + pow(up / 1.645::double, 2)), 6) AS hi FROM s""")
def annotated_lengths(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    w = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").alias("length"), (F.col("l_quantity") / 50).alias("observed_fraction"), (F.col("l_discount") * 100).alias("residual"), F.when(F.col("l_linenumber") == 1, 4.0).otherwise(0.0).alias("up"), F.lit(0.0).alias("down"))
    a = annotate_lengths(w, 0.01, 2.0, 1.3)
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@query("""SELECT event_id, round(((value + 45) - floor((value + 45) / 90) * 90) - 45, 9) AS wrapped, round(value * 1.5::double, 9) AS fx, round((value + 0.5::double) * 1.5::double - 0.5::double, 9) AS cx, round(value * sqrt(4000.0::double * 4000 + 3000.0::double * 3000) / 43.26661530556787::double, 6) AS focal FROM events""")
def angles_and_intrinsics(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    fx, _, cx, _ = fn.scale_intrinsics(v, v, v, v, F.lit(1.5), F.lit(1.5))
    return events(spark, d).select("event_id", F.round(fn.wrap_angle(v, 90.0), 9).alias("wrapped"), F.round(fx, 9).alias("fx"), F.round(cx, 9).alias("cx"), F.round(fn.focal_from_35mm(v, F.lit(4000.0), F.lit(3000.0)), 6).alias("focal"))


@query(f"""WITH {POINTS_SQL}, q AS (SELECT point_id, x / n AS x, y / n AS y, z / n AS z, w / n AS w, nx AS px, ny AS py, nz AS pz FROM (SELECT *, sqrt(x*x+y*y+z*z+w*w) AS n FROM points)),
r AS (SELECT *, (1-2*(y*y+z*z))*px + 2*(x*y-z*w)*py + 2*(x*z+y*w)*pz AS rx, 2*(x*y+z*w)*px + (1-2*(x*x+z*z))*py + 2*(y*z-x*w)*pz AS ry, 2*(x*z-y*w)*px + 2*(y*z+x*w)*py + (1-2*(x*x+y*y))*pz AS rz FROM q) SELECT point_id, round(rx, 6) AS rx, round(ry, 6) AS ry, round(rz, 6) AS rz, round(px, 6) AS bx, round(py, 6) AS by_, round(pz, 6) AS bz FROM r""")
def rigid_transforms(spark: SparkSession, d: str) -> DataFrame:
    """A point turned by its quaternion and shifted, and brought back by the inverse."""
    p = points(spark, d)
    c = F.col
    p = p.withColumn("R", fn.quaternion_matrix(c("x"), c("y"), c("z"), c("w")))
    cell = lambda i: F.get("R", F.lit(i))
    zero, one = F.lit(0.0), F.lit(1.0)
    shift = (F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    p = p.withColumn("T", F.array(*(x for i in range(3) for x in (cell(3 * i), cell(3 * i + 1), cell(3 * i + 2), shift[i])), zero, zero, zero, one))
    moved = fn.transform_point(c("T"), c("nx"), c("ny"), c("nz"))
    p = p.withColumns(dict(zip(("mx", "my", "mz"), moved, strict=True))).withColumn("I", fn.invert_rigid(c("T")))
    back = fn.transform_point(c("I"), c("mx"), c("my"), c("mz"))
    return p.select("point_id", *(F.round(c(m) - s, 6).alias(a) for m, s, a in zip(("mx", "my", "mz"), shift, ("rx", "ry", "rz"), strict=True)), *(F.round(b, 6).alias(a) for b, a in zip(back, ("bx", "by_", "bz"), strict=True)))


@query("""SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment || ' #0' || (c_custkey % 7)), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS name, trim(regexp_replace(lower(c_mktsegment), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS label, CASE c_custkey % 3 WHEN 0 THEN 'floor' WHEN 1 THEN 'ceiling' ELSE 'wall' END AS kind, 'W' || (c_custkey % 4) AS short FROM customer""")
def room_names(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.matching import label_of, plain_name

    k = F.col("c_custkey")
    hint = F.concat("c_mktsegment", F.lit(" #0"), (k % 7).cast("string"))
    surface = F.concat(F.lit("R1"), F.when(k % 3 == 0, "-FLOOR").when(k % 3 == 1, "-CEIL").otherwise("-W2"))
    wall = F.concat("c_name", F.lit("-W"), (k % 4).cast("string"))
    return read_table(spark, d, "customer").select("c_custkey", plain_name(hint).alias("name"), label_of(hint).alias("label"), fn.surface_kind(surface).alias("kind"), fn.short_id(wall, F.col("c_name")).alias("short"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 3 = 0 THEN '+02:00' ELSE '' END AS iso, printf('%.1f cm', o_totalprice * 100) AS cm, printf('%.1f%%', o_orderkey % 1000 / 10.0::double) AS pct, printf('%.2f [%.2f, %.2f]', round(o_totalprice, 2), round(o_totalprice - 1, 2), round(o_totalprice + 1, 2)) AS iv FROM orders""")
def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    k, x = F.col("o_orderkey"), F.col("o_totalprice")
    exif = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    off = F.when(k % 3 == 0, "+02:00").when(k % 3 == 1, "Z")
    return orders(spark, d).select("o_orderkey", fn.exif_to_iso(exif, off).alias("iso"), fn.centimetres(x).alias("cm"), fn.percent(k % 1000 / 1000.0).alias("pct"), fn.interval_text(F.round(x, 2), F.round(x - 1, 2), F.round(x + 1, 2), 2).alias("iv"))


@query("""WITH e AS (SELECT user_id, event_id, value FROM events), w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM e) SELECT user_id, event_id, round(least(greatest(ln(greatest(value, 1)) / ln(20.0::double), 0), 1), 9) AS weight, round(CASE WHEN n < 2 THEN 1 ELSE r / (n - 1)::double END, 9) AS rank FROM w""")
def confidence_weights(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    w = windows.rank_share(e, ["user_id"], "value", "event_id", "rank")
    return w.select("user_id", "event_id", F.round(fn.confidence_weight(F.col("value"), 20.0), 9).alias("weight"), F.round("rank", 9).alias("rank"))


@query("""SELECT n_nationkey, '{"a":' || n_nationkey || ',"b":"' || n_name || '","z":' || n_regionkey || '}' AS key, sha256('{"a":' || n_nationkey || ',"b":"' || n_name || '","z":' || n_regionkey || '}') AS hash FROM nation""")
def content_keys(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("z"), F.col("n_name").alias("b"), F.col("n_nationkey").alias("a"))
    return n.withColumn("key", fn.canonical_json(["z", "b", "a"])).select("n_nationkey", "key", F.sha2("key", 256).alias("hash"))


@query("""SELECT label, count(*) AS n, round(median(r), 9) AS ratio FROM (SELECT label, (abs(embedding[1]::double) + 1) / (abs(embedding[2]::double) + 1) AS r FROM embeddings) GROUP BY 1 HAVING count(*) >= 30""")
def depth_ratios(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.abs(F.get("embedding", F.lit(i)).cast("double")) + 1
    p = read_table(spark, d, "embeddings").select("label", e(0).alias("a"), e(1).alias("b"))
    return quantiles.median_ratio(p, ["label"], "a", "b", 30).select("label", "n", F.round("ratio", 9).alias("ratio"))


@query("""WITH f AS (SELECT l_suppkey AS capture, median(l_quantity / 50) AS f FROM lineitem GROUP BY 1), r AS (SELECT capture, f, CASE WHEN capture % 2 = 0 THEN 0.5::double END AS ref FROM f)
SELECT capture, round(f, 9) AS focal, CASE WHEN ref IS NULL THEN 'protocol_min' ELSE 'exif' END AS kind, round(CASE WHEN ref IS NOT NULL THEN CASE WHEN abs(ln(f / ref)) > 0.1::double THEN abs(ln(f / ref)) ELSE 0 END WHEN f < 0.6::double THEN ln(0.6::double / f) ELSE 0 END, 9) AS sigma_log FROM r""")
def focal_checks(spark: SparkSession, d: str) -> DataFrame:
    v = lineitem(spark, d).select(F.col("l_suppkey").alias("capture"), (F.col("l_quantity") / 50).alias("focal"))
    ref = v.select("capture").distinct().withColumn("reference", F.when(F.col("capture") % 2 == 0, 0.5))
    c = quantiles.focal_check(v, ref, ["capture"])
    return c.select("capture", F.round("focal", 9).alias("focal"), "kind", F.round("sigma_log", 9).alias("sigma_log"))


@query("""SELECT l_suppkey AS capture, count(*) AS n, sum((l_returnflag = 'A')::int)::bigint AS n_a, round(sum(l_quantity), 6) AS total, min(l_shipdate)::timestamp AS first, max(l_shipdate)::timestamp AS last, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1""")
def input_summaries(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem(spark, d).groupBy(F.col("l_suppkey").alias("capture"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("n_a"), F.round(F.sum("l_quantity"), 6).alias("total"), F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.countDistinct("l_partkey").alias("parts"))


@query("""WITH k AS (SELECT user_id, event_id AS frame, (row_number() OVER w - 1) * 0.7::double AS t, coalesce(value, 0) / 20.0::double AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT *, coalesce(abs(x - lag(x) OVER w), 0) AS step, greatest(t - lag(t) OVER w, 1e-3::double) AS dt FROM k WINDOW w AS (PARTITION BY user_id ORDER BY t, frame)),
c AS (SELECT *, sum(step) OVER w AS way, sum((step / dt > 3 AND step > 0.15::double)::int) OVER w AS leaps, floor((t - min(t) OVER (PARTITION BY user_id)) / 3) AS slot FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, frame ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY leaps, slot) - 1 AS segment FROM c), m AS (SELECT user_id, segment, (min(t) + max(t)) / 2 AS mid FROM g GROUP BY 1, 2),
a AS (SELECT * FROM g JOIN m USING (user_id, segment) QUALIFY row_number() OVER (PARTITION BY user_id, segment ORDER BY abs(t - mid), t, frame) = 1)
SELECT user_id, segment, round(t, 6) AS t, round(x, 6) AS x, round(lead(way) OVER w - way, 6) AS path, lead(leaps) OVER w > leaps AS jumped FROM a WINDOW w AS (PARTITION BY user_id ORDER BY segment)""")
def drift_segments(spark: SparkSession, d: str) -> DataFrame:
    """Events as keyframes 0.7 s apart: segments of 3 s, broken where the camera leaps."""
    e = events(spark, d)
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(one, zero, zero, F.coalesce("value", zero) / 20.0, zero, one, zero, zero, zero, zero, one, F.lit(1.4), zero, zero, zero, one)
    _, segs = loops.segments(e.select("user_id", F.col("event_id").alias("frame"), (n * 0.7).alias("t"), pose.alias("pose")), ["user_id"])
    return segs.select("user_id", "segment", F.round("t", 6).alias("t"), F.round(F.get("pose", F.lit(3)), 6).alias("x"), F.round("path", 6).alias("path"), "jumped")
