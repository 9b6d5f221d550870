"""Surfaces, rays, lifting, matching and placing of rooms over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.kernels import greedy
from plumbline.operators import joins, lifting, openings, rays, walls
from plumbline.plans import matching, placement, stitching
from plumbline.plans.result import null_dangling, unique_ids
from plumbline.session import fresh_path, materialize, read_table

from .tables import POINTS_SQL, SPANS_SQL, events, lineitem, order_spans, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# suppliers as walls 50 m apart, three metres high, standing at an angle
_WALLS_SQL = """walls AS (SELECT s_suppkey AS wall, s_suppkey % 9 * 50.0::double AS sx, 10.0::double AS sy, s_suppkey % 9 * 50.0::double + 30 AS ex, 10.0::double + s_suppkey % 5 * 10 AS ey FROM supplier)"""


def _walls(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, d, "supplier").select(k.alias("wall"), (k % 9 * 50.0).alias("sx"), F.lit(10.0).alias("sy"), (k % 9 * 50.0 + 30).alias("ex"), (10.0 + k % 5 * 10).alias("ey"))


@query(f"""WITH {_WALLS_SQL}, p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS wall, l_quantity * 10 AS x, l_discount * 500 AS y, l_tax * 50 AS z FROM lineitem), m AS (SELECT p.*, sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) AS len, sx, sy, ex, ey FROM p JOIN walls USING (wall)), u AS (SELECT *, ((x - sx) * (ex - sx) + (y - sy) * (ey - sy)) / len AS u, (x - sx) * -(ey - sy) / len + (y - sy) * (ex - sx) / len AS dist FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, wall, round(u, 6) AS u, round(z, 6) AS v, round(dist, 6) AS distance, u >= -0.1::double AND u <= len + 0.1::double AND z >= -0.1::double AND z <= 3 + 0.1::double AS inside FROM u""")
def surface_coordinates(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    w = _walls(spark, d)
    length = F.hypot(c("ex") - c("sx"), c("ey") - c("sy"))
    w = w.withColumns({"nx": -(c("ey") - c("sy")) / length, "ny": (c("ex") - c("sx")) / length, "z0": F.lit(0.0), "z1": F.lit(3.0)})
    p = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", c("l_suppkey").alias("wall"), (c("l_quantity") * 10).alias("x"), (c("l_discount") * 500).alias("y"), (c("l_tax") * 50).alias("z"))
    s = rays.surface_coordinates(p, w, [])
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "wall", *(F.round(k, 6).alias(k) for k in ("u", "v", "distance")), "inside")


@query(f"""WITH {_WALLS_SQL}, r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS wall, l_quantity * 10 AS px, l_discount * 500 AS py, 15.0::double + l_linenumber AS ox, 0.0::double AS oy FROM lineitem), m AS (SELECT r.*, w.sx, w.sy, w.ex, w.ey, sqrt(pow(ex - sx, 2) + pow(ey - sy, 2)) AS len FROM r JOIN walls w USING (wall)),
s AS (SELECT *, ((ex - sx) * (oy - sy) - (ey - sy) * (ox - sx)) / len AS a, ((ex - sx) * (py - sy) - (ey - sy) * (px - sx)) / len AS b FROM m), t AS (SELECT *, a / (a - b) AS t FROM s WHERE a * b < 0), u AS (SELECT *, ((ox + t * (px - ox) - sx) * (ex - sx) + (oy + t * (py - oy) - sy) * (ey - sy)) / len AS u FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, wall, round(u, 6) AS u FROM u WHERE u >= 0 AND u <= len""")
def wall_crossings(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    ray = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    r = lineitem(spark, d).select(ray.alias("ray"), c("l_suppkey").alias("own"), (15.0 + c("l_linenumber")).alias("ox"), F.lit(0.0).alias("oy"), F.lit(1.5).alias("oz"), (c("l_quantity") * 10).alias("px"), (c("l_discount") * 500).alias("py"), F.lit(1.5).alias("pz"))
    x = rays.crossings(r, _walls(spark, d).withColumn("own", c("wall")), ["own"])
    return x.select("ray.*", "wall", F.round("u", 6).alias("u"))


@query("""WITH r AS (SELECT user_id AS k, event_id AS ray, value AS ox, event_id % 7 AS oy, 1.0::double AS oz, 1.0::double AS dx, (event_id % 3 - 1)::double AS dy, 0.0::double AS dz FROM events), b AS (SELECT c_custkey AS k, x.i AS box, 20.0::double * x.i AS x0, 20.0::double * x.i + 5 AS x1, c_custkey % 5 AS y0, c_custkey % 5 + 3.0::double AS y1, 0.0::double AS z0, 2.0::double AS z1 FROM customer, generate_series(0, 4) x(i)),
m AS (SELECT ray, box, greatest((x0 - ox) / dx, CASE WHEN dy <> 0 THEN least((y0 - oy) / dy, (y1 - oy) / dy) WHEN oy BETWEEN y0 AND y1 THEN '-inf'::double ELSE 'inf'::double END) AS a, least((x1 - ox) / dx, CASE WHEN dy <> 0 THEN greatest((y0 - oy) / dy, (y1 - oy) / dy) WHEN oy BETWEEN y0 AND y1 THEN 'inf'::double ELSE '-inf'::double END) AS b FROM r JOIN b USING (k)),
h AS (SELECT ray, box, CASE WHEN a > 1e-6::double THEN a ELSE b END AS t FROM m WHERE a <= b AND b > 1e-6::double) SELECT ray, arg_min(box, (t, box)) AS box, round(min(t), 6) AS t FROM h GROUP BY 1""")
def first_hits(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    r = events(spark, d).select(c("user_id").alias("k"), c("event_id").alias("ray"), c("value").alias("ox"), (c("event_id") % 7).cast("double").alias("oy"), F.lit(1.0).alias("oz"), F.lit(1.0).alias("dx"), (c("event_id") % 3 - 1).cast("double").alias("dy"), F.lit(0.0).alias("dz"))
    b = read_table(spark, d, "customer").select(c("c_custkey").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("box"))
    y = (c("k") % 5).cast("double")
    b = b.withColumns({"x0": 20.0 * c("box"), "x1": 20.0 * c("box") + 5, "y0": y, "y1": y + 3, "z0": F.lit(0.0), "z1": F.lit(2.0)})
    return rays.first_hits(r, b, ["k"]).select("ray", "box", F.round("t", 6).alias("t"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity < 3 OR l_quantity > 40 THEN NULL WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 12.5 THEN 1 ELSE 2 END::int AS cell FROM lineitem""")
def cut_intervals(spark: SparkSession, d: str) -> DataFrame:
    cuts = F.array(*map(F.lit, (3.0, 10.0, 12.5, 40.0)))
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rays.between(F.col("l_quantity"), cuts).alias("cell"))


@query("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'R' END AS t, (o_orderkey % 97)::double AS x, (o_orderkey % 89)::double AS y, 1.0::double + o_orderkey % 4 AS w FROM orders), m AS (SELECT user_id AS c, (event_id % 97)::double AS x, (event_id % 89)::double AS y FROM events), g AS (SELECT DISTINCT o.c, o.id FROM o JOIN m ON m.c = o.c AND o.t IS NULL AND sqrt(pow(o.x - m.x, 2) + pow(o.y - m.y, 2)) <= greatest(w / 2, 0.4::double))
SELECT c AS capture_id, id AS opening_id, 'opening' AS what FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.c = o.c AND g.id = o.id) UNION ALL SELECT c, id, 'pair' FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.c = o.c AND g.id IN (o.id, o.id + 1))""")
def mirrored_openings(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("o_orderkey"), F.col("event_id")
    o = orders(spark, d).select(F.col("o_custkey").alias("capture_id"), k.alias("opening_id"), F.when(k % 3 != 0, "R").alias("connects_to"), (k % 97).cast("double").alias("cx"), (k % 89).cast("double").alias("cy"), (1.0 + k % 4).alias("width"))
    pairs = o.select("capture_id", F.col("opening_id").alias("opening_a"), (F.col("opening_id") + 1).alias("opening_b"))
    m = events(spark, d).select(F.col("user_id").alias("capture_id"), (e % 97).cast("double").alias("x"), (e % 89).cast("double").alias("y"))
    kept, adjacency = joins.drop_mirrored(o, pairs, m)
    return kept.select("capture_id", "opening_id", F.lit("opening").alias("what")).union(adjacency.select("capture_id", "opening_a", F.lit("pair")))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT point_id, label, x AS px, y AS py FROM points), m AS (SELECT point_id, px + (0.5::double - px) * CASE WHEN d > 1e-6::double THEN least(0.05::double, d) / d ELSE 0 END AS x, py + (0.5::double - py) * CASE WHEN d > 1e-6::double THEN least(0.05::double, d) / d ELSE 0 END AS y FROM (SELECT *, sqrt(pow(0.5::double - px, 2) + pow(0.5::double - py, 2)) AS d FROM r)),
b AS (SELECT g.i AS ring, -0.3::double + 0.15::double * g.i AS x0, -0.3::double + 0.15::double * g.i + 0.1::double AS x1, -0.25::double AS y0, 0.2::double AS y1 FROM generate_series(0, 3) g(i)), q AS (SELECT point_id, ring, sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2)) AS d FROM m, b)
SELECT point_id, arg_min(ring, (d, ring))::int AS ring, round(min(d), 6) AS distance FROM q WHERE d <= 0.5::double GROUP BY 1""")
def snapped_rooms(spark: SparkSession, d: str) -> DataFrame:
    """Points, moved towards a camera, in four narrow rooms or beside them."""
    x, y = lifting.towards_camera(F.col("x"), F.col("y"), F.lit(0.5), F.lit(0.5))
    p = points(spark, d).select(F.lit(1).alias("one"), F.col("point_id").alias("point"), x.alias("x"), y.alias("y"))
    i = F.col("ring")
    b = spark.range(4).select(F.lit(1).alias("one"), F.col("id").cast("int").alias("ring")).withColumns({"x0": -0.3 + 0.15 * i, "x1": -0.3 + 0.15 * i + 0.1, "y0": F.lit(-0.25), "y1": F.lit(0.2)})
    side = lambda a, c, e, g: F.struct(F.col(a).alias("ax"), F.col(c).alias("ay"), F.col(e).alias("bx"), F.col(g).alias("by_"))
    edges = b.select("one", "ring", F.explode(F.array(side("x0", "y0", "x1", "y0"), side("x1", "y0", "x1", "y1"), side("x1", "y1", "x0", "y1"), side("x0", "y1", "x0", "y0"))).alias("s")).select("one", "ring", "s.*")
    r = lifting.rooms_of(p, edges, ["one"])
    return r.select(F.col("point").alias("point_id"), "ring", F.round("distance", 6).alias("distance"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS k, CASE WHEN l_linenumber = 7 THEN NULL ELSE 'R' END AS room, l_quantity / 10 AS x, l_discount * 2 AS y, l_tax * 30 AS z, cos(l_quantity) AS nx, sin(l_quantity) AS ny0, CASE WHEN l_linestatus = 'F' THEN 0.9::double ELSE 0.1::double END AS nz FROM lineitem),
n AS (SELECT *, nx * sqrt(1 - nz * nz) AS ax, ny0 * sqrt(1 - nz * nz) AS ay FROM m), w AS (SELECT *, y AS d0, abs(4 - x) AS d1 FROM (SELECT *, sqrt(pow(x - least(greatest(x, 0), 4), 2) + y * y) AS e0, sqrt(pow(x - 4, 2) + pow(y - least(greatest(y, 0), 3), 2)) AS e1 FROM n)),
b AS (SELECT *, CASE WHEN e0 <= e1 THEN 'A' ELSE 'B' END AS wall, least(e0, e1) AS d, CASE WHEN e0 <= e1 THEN ay ELSE -ax END AS facing FROM w), s AS (SELECT *, CASE WHEN room IS NOT NULL AND nz < 0.82::double AND d <= 0.15::double THEN 'wall' WHEN room IS NOT NULL AND nz < 0.82::double AND nz <= 0.57::double AND d <= 0.3::double AND facing >= 0.9::double THEN 'wall_loose' END AS how FROM b)
SELECT l_orderkey, l_linenumber, l_partkey, k AS l_suppkey, CASE WHEN room IS NULL THEN 'outside_rooms' WHEN how IS NOT NULL THEN how WHEN least(abs(z), abs(z - 2.5::double)) <= CASE WHEN nz >= 0.82::double THEN 0.3::double ELSE 0.1::double END THEN CASE WHEN abs(z) <= abs(z - 2.5::double) THEN 'floor' ELSE 'ceiling' END ELSE 'off_surface' END AS method, CASE WHEN room IS NOT NULL AND how IS NOT NULL THEN wall END AS wall FROM s""")
def assigned_surfaces(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    mask = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    nz = F.when(c("l_linestatus") == "F", 0.9).otherwise(0.1)
    flat = F.sqrt(1 - nz * nz)
    # a row may be there twice; a mask is a row
    m = lineitem(spark, d).select(mask.alias("mask"), F.when(c("l_linenumber") != 7, "R").alias("room"), (c("l_quantity") / 10).alias("x"), (c("l_discount") * 2).alias("y"), (c("l_tax") * 30).alias("z"), (F.cos("l_quantity") * flat).alias("nx"), (F.sin("l_quantity") * flat).alias("ny"), nz.alias("nz"), F.lit(1).alias("one"))
    walls = spark.createDataFrame([(1, "R", "A", 0.0, 0.0, 4.0, 0.0, 0.0, 1.0), (1, "R", "B", 4.0, 0.0, 4.0, 3.0, -1.0, 0.0)], "one int, room string, wall string, sx double, sy double, ex double, ey double, nx double, ny double")
    rooms = spark.createDataFrame([(1, "R", 0.0, 2.5)], "one int, room string, floor_z double, ceiling_z double")
    a = lifting.assign_surfaces(m, walls, rooms, ["one"])
    return a.select("mask.*", "method", F.when(c("method").startswith("wall"), c("surface")).alias("wall"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'crack' WHEN 'view' THEN 'mold' ELSE 'hole' END AS cls, value / 100 AS score, event_id % 7 / 7.0::double AS hole, event_id % 5 / 5.0::double AS mold, event_id % 4 = 0 AS line, event_id % 3 = 0 AS tile FROM events), b AS (SELECT *, CASE WHEN mold >= hole THEN 'mold' ELSE 'hole' END AS alt, greatest(hole, mold) AS top FROM e)
SELECT event_id, CASE WHEN line THEN 'crack' WHEN cls = 'crack' THEN CASE WHEN top >= CASE alt WHEN 'mold' THEN 0.4::double ELSE 0.6::double END AND NOT tile THEN alt END WHEN tile THEN NULL WHEN score < CASE cls WHEN 'mold' THEN 0.4::double ELSE 0.6::double END THEN NULL ELSE cls END AS cls,
CASE WHEN line THEN CASE WHEN cls <> 'crack' THEN 'thin_line' END WHEN cls = 'crack' THEN CASE WHEN top >= CASE alt WHEN 'mold' THEN 0.4::double ELSE 0.6::double END AND NOT tile THEN 'relabelled' ELSE 'crack_without_line' END WHEN tile THEN 'tile_area' WHEN score < CASE cls WHEN 'mold' THEN 0.4::double ELSE 0.6::double END THEN 'below_floor' END AS reason FROM b""")
def resolved_classes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    cls = F.when(F.col("event_type") == "click", "crack").when(F.col("event_type") == "view", "mold").otherwise("hole")
    scores = F.create_map(F.lit("hole"), k % 7 / 7.0, F.lit("mold"), k % 5 / 5.0)
    r = lifting.resolve_class(cls, F.col("value") / 100, scores, k % 4 == 0, k % 3 == 0, {"mold": 0.4, "hole": 0.6}, ["mold", "hole"])
    return events(spark, d).select("event_id", r.alias("r")).select("event_id", "r.*")


@query("""WITH l AS (SELECT l_suppkey AS k, l_linenumber AS line, 0 AS axis, l_linenumber * 0.01::double AS coord, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS sign, l_linenumber = 5 AS synthetic, CASE WHEN l_linenumber = 2 THEN 0.05::double ELSE 0 END AS slope, list(l_quantity) AS pts FROM lineitem WHERE l_suppkey % 3 <> 0 OR l_linenumber < 4 GROUP BY ALL), e AS (SELECT s_suppkey AS k, g.i AS edge, 0 AS axis, g.i * 0.007::double AS coord, CASE WHEN g.i % 3 = 0 THEN -1 ELSE 1 END AS sign, 10.0::double AS ta, 20.0::double AS tb FROM supplier, generate_series(0, 14) g(i)),
n AS (SELECT e.*, l.line, l.sign AS ls, synthetic, slope, abs(l.coord - e.coord) AS d, len(list_filter(pts, lambda t: t BETWEEN 10 AND 20)) AS n FROM e JOIN l ON l.k = e.k AND abs(l.coord - e.coord) <= 0.015::double), own AS (SELECT k, edge, arg_min(line, (round(d, 9), line)) AS line FROM n WHERE NOT synthetic AND ls = sign GROUP BY 1, 2), rest AS (SELECT k, edge, bool_or(synthetic) AS made, bool_or(NOT synthetic) AS seen FROM n GROUP BY 1, 2)
SELECT e.k AS l_suppkey, e.edge, own.line, coalesce(n.n, 0)::int AS n, CASE WHEN own.line IS NULL THEN CASE WHEN made THEN 'wall_unobserved' WHEN seen THEN 'wall_face_mismatch' ELSE 'wall_face_missing' END WHEN n.n < 5 THEN 'wall_face_sparse' WHEN slope > 0.018::double THEN 'wall_slanted' END AS flag
FROM e LEFT JOIN own ON own.k = e.k AND own.edge = e.edge LEFT JOIN rest ON rest.k = e.k AND rest.edge = e.edge LEFT JOIN n ON n.k = e.k AND n.edge = e.edge AND n.line = own.line""")
def face_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    own = lineitem(spark, d).where("l_suppkey % 3 <> 0 OR l_linenumber < 4")
    lines = own.groupBy(F.col("l_suppkey").alias("k"), n.alias("line")).agg(F.collect_list("l_quantity").alias("points"))
    k = F.col("line")
    lines = lines.withColumns({"axis": F.lit(0), "coord": k * 0.01, "sign": F.when(k % 2 == 0, 1).otherwise(-1), "synthetic": k == 5, "slope": F.when(k == 2, 0.05).otherwise(0.0)})
    e = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(14).cast("long"))).alias("edge"))
    e = e.withColumns({"axis": F.lit(0), "coord": F.col("edge") * 0.007, "sign": F.when(F.col("edge") % 3 == 0, -1).otherwise(1), "ta": F.lit(10.0), "tb": F.lit(20.0)})
    return lifting.face_evidence(e, lines, ["k"]).withColumnRenamed("k", "l_suppkey")


@query("""WITH f AS (SELECT l_suppkey AS k, l_quantity::bigint AS ix, (l_extendedprice / 1000)::bigint AS iy FROM lineitem), l AS (SELECT s_suppkey AS k, g.a AS axis, CASE g.a WHEN 0 THEN s_suppkey % 4 * 0.1::double ELSE 2.0::double END AS coord FROM supplier, (VALUES (0), (1)) g(a) WHERE s_suppkey % 5 <> 0),
p AS (SELECT k, 0 AS axis, (quantile_cont(ix, 0.005) + 0.5::double) * 0.1::double AS lo, (quantile_cont(ix, 0.995) + 0.5::double) * 0.1::double AS hi FROM f GROUP BY 1 UNION ALL SELECT k, 1, (quantile_cont(iy, 0.005) + 0.5::double) * 0.1::double, (quantile_cont(iy, 0.995) + 0.5::double) * 0.1::double FROM f GROUP BY 1), j AS (SELECT p.*, l.coord FROM p LEFT JOIN l USING (k, axis))
SELECT k AS l_suppkey, axis::int AS axis, round(lo, 6) AS coord FROM j WHERE coord IS NULL OR lo < coord - 0.25::double UNION ALL SELECT k, axis::int, round(hi, 6) FROM j WHERE coord IS NULL OR hi > coord + 0.25::double""")
def closure_lines(spark: SparkSession, d: str) -> DataFrame:
    free = lineitem(spark, d).select(F.col("l_suppkey").alias("k"), F.round("l_quantity").alias("ix"), F.bround(F.col("l_extendedprice") / 1000).alias("iy"))
    k = F.col("k")
    lines = read_table(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("axis"))
    lines = lines.withColumn("coord", F.when(F.col("axis") == 0, k % 4 * 0.1).otherwise(2.0))
    return lifting.closure_lines(free, lines, ["k"], 0.1).select(k.alias("l_suppkey"), "axis", F.round("coord", 6).alias("coord"))


@query()
def closed_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Gap rules follow one another, so there is no short SQL; tested against plain Python."""
    return lifting.closed_profile(_profiles(spark, d), ["k"], 0.1)


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem(spark, d).groupBy((F.col("l_suppkey") % 100).alias("k"), (F.col("l_orderkey") % 40).alias("bin"))
    return g.agg((F.sum("l_quantity") > 25 * F.count(F.lit(1))).alias("solid"), (F.max("l_discount") > 0.08).alias("upper"))


@query("""WITH p AS (SELECT o_custkey AS k, (o_orderkey % 30)::int AS bin, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), s AS (SELECT k, min(bin) AS start, max(v) AS level FROM p GROUP BY 1), l AS (SELECT p.*, lag(v) OVER w AS v0, lag(bin) OVER w AS b0 FROM p WINDOW w AS (PARTITION BY k ORDER BY bin)),
m AS (SELECT l.k, start, bin, v, v0, 0.5::double * level AS h FROM l JOIN s ON s.k = l.k WHERE bin > start AND v >= 0.5::double * level AND b0 = bin - 1), f AS (SELECT k, start, min(bin) AS bin FROM m GROUP BY 1, 2)
SELECT k AS o_custkey, start, round(m.bin - 0.5::double + least(greatest((h - v0) / greatest(v - v0, 1e-12::double), 0), 1), 6) AS edge FROM f JOIN m USING (k, start, bin)""")
def half_level_edges(spark: SparkSession, d: str) -> DataFrame:
    p = orders(spark, d).groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 30).cast("int").alias("bin")).agg(F.sum("o_totalprice").alias("v"))
    s = p.groupBy("k").agg(F.min("bin").alias("bin"), F.max("v").alias("level"))
    return lifting.half_level_edges(p, s, ["k"]).select(F.col("k").alias("o_custkey"), "start", F.round("edge", 6).alias("edge"))


@query("""WITH q AS (SELECT (l_suppkey % 50)::int AS k, (l_partkey % 30)::int AS bin, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT k FROM q), p AS (SELECT g.k, b.b::int AS bin, coalesce(q.v, 0)::double AS v FROM g CROSS JOIN generate_series(0, 29) b(b) LEFT JOIN q ON q.k = g.k AND q.bin = b.b),
lv AS (SELECT k, arg_min(bin, (v, bin)) AS start, max(v) AS level FROM p GROUP BY 1), l AS (SELECT p.*, lag(v) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY k ORDER BY bin)),
m AS (SELECT l.k, start, bin, v, v0, 0.5::double * level AS h FROM l JOIN lv USING (k) WHERE bin > start AND v >= 0.5::double * level), f AS (SELECT k, min(bin) AS bin FROM m GROUP BY 1), e AS (SELECT k, start, m.bin - 0.5::double + least(greatest((h - v0) / greatest(v - v0, 1e-12::double), 0), 1) AS edge FROM f JOIN m USING (k, bin)),
w AS (SELECT j.j, exp(-0.5::double * pow(j.j / 1.5::double, 2)) / (SELECT sum(exp(-0.5::double * pow(i.i / 1.5::double, 2))) FROM generate_series(-6, 6) i(i)) AS w FROM generate_series(-6, 6) j(j)),
s AS (SELECT p.k, p.bin, sum(w.w * o.v) AS s FROM p CROSS JOIN w JOIN p o ON o.k = p.k AND o.bin = least(greatest(p.bin - w.j, 0), 29) GROUP BY 1, 2), r AS (SELECT k, bin, lead(s) OVER x - s AS g FROM s WINDOW x AS (PARTITION BY k ORDER BY bin)), n AS (SELECT *, lag(g) OVER x AS g0, lead(g) OVER x AS g1 FROM r WHERE g IS NOT NULL WINDOW x AS (PARTITION BY k ORDER BY bin)),
b AS (SELECT e.k, edge, n.* EXCLUDE (k) FROM e JOIN n ON n.k = e.k AND n.bin BETWEEN round_even(edge, 0) - 5 AND round_even(edge, 0) + 3 QUALIFY row_number() OVER (PARTITION BY e.k ORDER BY g DESC, n.bin) = 1)
SELECT e.k, start, round(e.edge, 6) AS edge, round(CASE WHEN g > 0 THEN b.bin + 1 + CASE WHEN g0 - 2 * g + g1 < 0 THEN least(greatest(0.5::double * (g0 - g1) / (g0 - 2 * g + g1), -0.5::double), 0.5::double) ELSE 0 END ELSE e.edge END, 6) AS steepest FROM e LEFT JOIN b USING (k)""")
def steepest_edges(spark: SparkSession, d: str) -> DataFrame:
    """From the lowest bin of a profile to half its level, then to the steepest rise of the smoothed profile."""
    held = lineitem(spark, d).groupBy((F.col("l_suppkey") % 50).cast("int").alias("k"), (F.col("l_partkey") % 30).cast("int").alias("bin")).agg(F.sum("l_quantity").alias("v"))
    every = held.select("k").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(29))))
    p = materialize(every.join(held, ["k", "bin"], "left").withColumn("v", F.coalesce("v", F.lit(0.0))), "profile")
    s = p.groupBy("k").agg(F.min_by("bin", F.struct("v", "bin")).alias("bin"), F.max("v").alias("level"))
    e = lifting.steepest_edges(p, lifting.half_level_edges(p, s, ["k"]), ["k"], 1.5)
    return e.select("k", "start", F.round("edge", 6).alias("edge"), F.round("steepest", 6).alias("steepest"))


@query()
def fitted_openings(spark: SparkSession, d: str) -> DataFrame:
    """See-through parts of suppliers' walls: fits have no SQL, tested on made walls."""
    c = F.col
    # an item is a patch of 6 x 11 bins; through the middle of a wall one looks, from the floor or, on every other wall, from half its height
    at = [(c("l_suppkey") % 20).alias("wall"), (c("l_partkey") % 10).cast("int").alias("pu"), (c("l_orderkey") % 10).cast("int").alias("pz")]
    gap = c("pu").between(3, 7) & c("pz").between(F.when(c("wall") % 2 == 0, 0).otherwise(4), 8)
    g = lineitem(spark, d).groupBy(*at).agg(F.sum("l_quantity").alias("_q"), F.count(F.lit(1)).cast("double").alias("_n"))
    g = g.select("wall", "pu", "pz", *(F.when(test, v).otherwise(0.0).alias(k) for k, test, v in (("mass", ~gap, c("_q")), ("hits", ~gap, c("_n")), ("see", gap, c("_n")))))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = g.select("wall").distinct().withColumn("iu", numbers(60)).withColumn("iz", numbers(110)).withColumns({"pu": F.floor(c("iu") / 6).cast("int"), "pz": F.floor(c("iz") / 11).cast("int")})
    cells = cells.join(g, ["wall", "pu", "pz"], "left").fillna(0.0, ["mass", "hits", "see"]).drop("pu", "pz")
    cells = materialize(cells.withColumn("empty", c("mass") == 0), "cells")
    parts = walls.opening_candidates(cells.where("see > 0").select("wall", "iu", "iz"), "wall", least=2)
    sizes = cells.select("wall").distinct().withColumns({"length": F.lit(1.2), "height": F.lit(2.2), "sigma": F.lit(0.01)})
    fits = openings.fit_openings(cells, parts.drop("n"), sizes, ["wall"])
    return fits.select("wall", "part", "kind", "header", *(F.round(k, 6).alias(k) for k in ("left", "right", "bottom", "top", "see", "empty", "confidence")), "flags")


_DOORS_SQL = """doors AS (SELECT o_custkey AS k, o_orderkey % 3 AS room, o_orderkey AS door, CASE WHEN o_orderkey % 2 = 0 THEN 'door' ELSE 'opening' END AS type, o_orderkey % 11 AS cx, o_orderkey % 13 AS cy, cos(o_orderkey % 8 * pi() / 4) AS nx, sin(o_orderkey % 8 * pi() / 4) AS ny, 0.7::double + o_orderkey % 5 / 20.0::double AS width, 2.0::double + o_orderkey % 4 / 10.0::double AS height, o_orderkey % 10 / 10.0::double AS conf FROM orders)"""


def _doors(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    turn = k % 8 * math.pi / 4
    return orders(spark, d).select(
        F.col("o_custkey").alias("capture_id"), (k % 3).alias("room"), k.alias("door"), F.when(k % 2 == 0, "door").otherwise("opening").alias("type"), (k % 11).cast("double").alias("cx"), (k % 13).cast("double").alias("cy"), F.cos(turn).alias("nx"), F.sin(turn).alias("ny"),
        (0.7 + k % 5 / 20.0).alias("width"), (2.0 + k % 4 / 10.0).alias("height"), (k % 10 / 10.0).alias("confidence"), F.lit(0.0).alias("manhattan"),
    )


@query(f"""WITH {_DOORS_SQL}, p AS (SELECT a.k, a.door AS da, b.door AS db, least(a.width, b.width) / greatest(a.width, b.width) AS ratio, least(a.height, b.height) / greatest(a.height, b.height) AS hr, a.type = b.type AS same, a.conf AS ca, b.conf AS cb, b.conf FROM doors a JOIN doors b ON a.k = b.k AND a.room < b.room)
SELECT k AS capture_id, da AS door_a, db AS door_b, round(0.6::double * exp(-0.5::double * pow((1 - ratio) / 0.08::double, 2)) * CASE WHEN same THEN 1 ELSE 0.8::double END * (0.5::double + 0.5::double * sqrt(ca * cb)) * exp(-0.5::double * pow((1 - hr) / 0.1::double, 2)), 6) AS base FROM p WHERE ratio >= 0.8::double""")
def door_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scores as they are where axes agree: a pair that was not snapped has half."""
    h = stitching.door_pairs(_doors(spark, d))
    return h.select("capture_id", "door_a", "door_b", F.round(F.col("score") / F.when(F.col("snapped"), 1.0).otherwise(0.5), 6).alias("base"))


@query()
def facing_doors(spark: SparkSession, d: str) -> DataFrame:
    """Each door once, so order-dependent: tested against plain Python."""
    return stitching.facing_doors(_doors(spark, d)).select("capture_id", "room_a", "room_b", "door_a", "door_b", "confidence")


@query()
def placement_trees(spark: SparkSession, d: str) -> DataFrame:
    return stitching.placement_tree(stitching.door_pairs(_doors(spark, d))).select("capture_id", "a", "b", F.round("score", 6).alias("score"))

@query()
def room_placements(spark: SparkSession, d: str) -> DataFrame:
    """Customers' orders as doors of three rooms: trees, exchanges and flags have no SQL, tested on made properties."""
    doors = _doors(spark, d)
    width, height = (2 + F.col(c) % 5 for c in ("capture_id", "room"))
    corner = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    rooms = doors.select("capture_id", "room").distinct().select("capture_id", "room", F.array(corner(0, 0), corner(width, 0), corner(width, height), corner(0, height)).alias("points"), F.lit(0.0).alias("manhattan"))
    placed, _ = placement.place_rooms(rooms, placement.door_edges(doors, rooms), ["capture_id"])
    return placed.select("capture_id", "room", "part", "parent", *(F.round(c, 6).alias(c) for c in ("x", "y", "yaw", "nudge")), "flags")



@query(f"""WITH {POINTS_SQL} SELECT point_id, round(cos(label * 0.1::double) * x - sin(label * 0.1::double) * y + label, 6) AS x, round(sin(label * 0.1::double) * x + cos(label * 0.1::double) * y - 2.0::double, 6) AS y, round(z - label * 0.5::double, 6) AS z FROM points""")
def rebased_points(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select(F.lit(1).alias("capture_id"), F.col("label").alias("room"), "point_id", "x", "y", "z")
    r = p.select("capture_id", "room").distinct()
    t = r.select("capture_id", "room", (F.col("room") * 0.1).alias("yaw"), F.col("room").cast("double").alias("tx"), F.lit(-2.0).alias("ty"))
    moved = stitching.rebase(r.withColumn("floor_z", F.col("room") * 0.5), p, t)
    return moved.select("point_id", *(F.round(c, 6).alias(c) for c in "xyz"))


@query("""SELECT c_custkey, 'R' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '-K' || c_custkey ELSE '-W' || (c_custkey % 5) END AS name FROM customer""")
def renamed_children(spark: SparkSession, d: str) -> DataFrame:
    k, new = F.col("c_custkey"), F.concat(F.lit("R"), F.col("c_nationkey").cast("string"))
    child = F.when(k % 3 == 0, F.concat(F.lit("old-K"), k.cast("string"))).otherwise("elder-7")
    return read_table(spark, d, "customer").select("c_custkey", stitching.renamed(child, F.lit("old"), new, "W", k % 5).alias("name"))


@query("""WITH r AS (SELECT l_suppkey AS k, l_linenumber AS room, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem GROUP BY 1, 2)
SELECT k AS l_suppkey, 'x' AS axis, round(max(x1) - min(x0), 6) AS extent, arg_min(room, (x0, room)) AS low, arg_min(room, (-x1, room)) AS high FROM r GROUP BY 1 UNION ALL SELECT k, 'y', round(max(y1) - min(y0), 6), arg_min(room, (y0, room)), arg_min(room, (-y1, room)) FROM r GROUP BY 1""")
def placed_extents(spark: SparkSession, d: str) -> DataFrame:
    c = lineitem(spark, d).select("l_suppkey", F.col("l_linenumber").alias("room"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    e = stitching.extents(c, ["l_suppkey"])
    return e.select("l_suppkey", "axis", F.round("extent", 6).alias("extent"), "low", "high")


@query("""WITH RECURSIVE chunks AS (SELECT c_nationkey AS k, c_custkey % 12 AS chunk, min(c_custkey % 12 * 20) AS first, max(c_custkey % 12 * 20 + 24 + c_custkey % 3) AS last FROM customer GROUP BY 1, 2), link AS (SELECT DISTINCT c_nationkey AS k, c_custkey % 12 AS a, (c_custkey * 5 + 1) % 12 AS b FROM customer WHERE c_custkey % 4 = 0), two AS (SELECT k, a, b FROM link UNION SELECT k, b, a FROM link),
r(k, n, m) AS (SELECT k, chunk, chunk FROM chunks UNION SELECT r.k, t.b, r.m FROM r JOIN two t ON t.k = r.k AND t.a = r.n), g AS (SELECT k, n AS chunk, min(m) AS grp FROM r GROUP BY 1, 2), f AS (SELECT g.k, grp, count(DISTINCT f.i) AS n FROM g JOIN chunks c ON c.k = g.k AND c.chunk = g.chunk JOIN generate_series(0, 300) f(i) ON f.i BETWEEN first AND last GROUP BY 1, 2),
b AS (SELECT k, arg_max(grp, (n, -grp)) AS grp FROM f GROUP BY 1) SELECT g.k AS c_nationkey, g.chunk FROM g JOIN b ON b.k = g.k AND b.grp = g.grp JOIN chunks c ON c.k = g.k AND c.chunk = g.chunk""")
def largest_chunk_group(spark: SparkSession, d: str) -> DataFrame:
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    chunks = c.groupBy("c_nationkey", (k % 12).alias("chunk")).agg(F.min(k % 12 * 20).alias("first"), F.max(k % 12 * 20 + 24 + k % 3).alias("last"))
    links = c.where("c_custkey % 4 = 0").select("c_nationkey", (k % 12).alias("a"), ((k * 5 + 1) % 12).alias("b"))
    return stitching.largest_group(links, chunks, "c_nationkey")


@query("""WITH RECURSIVE p AS (SELECT c_nationkey AS k, c_custkey AS room, CASE WHEN c_custkey < 60 THEN NULL ELSE (SELECT max(b.c_custkey) FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_custkey <= a.c_custkey // 2) END AS parent FROM customer a), c(k, room, up, n) AS (SELECT k, room, room, 0 FROM p UNION ALL SELECT c.k, c.room, p.parent, n + 1 FROM c JOIN p ON p.k = c.k AND p.room = c.up WHERE p.parent IS NOT NULL), q AS (SELECT k, room AS a, lead(room) OVER (PARTITION BY k ORDER BY room) AS b FROM p)
SELECT q.k AS c_nationkey, q.a, q.b, min(x.n + y.n)::bigint AS edges FROM q JOIN c x ON x.k = q.k AND x.room = q.a JOIN c y ON y.k = q.k AND y.room = q.b AND y.up = x.up GROUP BY 1, 2, 3""")
def tree_paths(spark: SparkSession, d: str) -> DataFrame:
    """Customers of a nation as rooms: each hangs on the largest key up to half its own; the first ones are roots."""
    c = read_table(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("room"))
    half = c.withColumn("at", F.floor(F.col("room") / 2))
    up = joins.asof(half, c.select("c_nationkey", F.col("room").alias("at"), F.col("room").alias("p")), ["c_nationkey"], "at", ["p"])
    parents = materialize(up.select("c_nationkey", "room", F.when(F.col("room") >= 60, F.col("right_p")).alias("parent")), "parents")
    pairs = c.select("c_nationkey", F.col("room").alias("a"), F.lead("room").over(Window.partitionBy("c_nationkey").orderBy("room")).alias("b")).where("b IS NOT NULL")
    return stitching.tree_paths(parents, pairs, "c_nationkey")


@query("""WITH s AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, o_orderstatus AS hint FROM orders), p AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CASE event_type WHEN 'click' THEN 'F' WHEN 'view' THEN 'O' END AS hint FROM events), c AS (SELECT k, sa.n = pa.n AS even FROM (SELECT k, count(*) AS n FROM s GROUP BY 1) sa FULL JOIN (SELECT k, count(*) AS n FROM p GROUP BY 1) pa USING (k)),
ev AS (SELECT s.k, s.n AS scene, p.n AS plan FROM s JOIN c ON c.k = s.k AND c.even JOIN p ON p.k = s.k AND p.n = s.n), so AS (SELECT s.* FROM s JOIN c ON c.k = s.k AND coalesce(NOT c.even, true)), po AS (SELECT p.* FROM p JOIN c ON c.k = p.k AND coalesce(NOT c.even, true)),
h AS (SELECT a.k, a.n AS scene, b.n AS plan FROM (SELECT *, row_number() OVER (PARTITION BY k, hint ORDER BY n) AS r FROM so WHERE hint IS NOT NULL) a JOIN (SELECT *, row_number() OVER (PARTITION BY k, hint ORDER BY n) AS r FROM po WHERE hint IS NOT NULL) b ON a.k = b.k AND a.hint = b.hint AND a.r = b.r),
f AS (SELECT so.k, so.n, row_number() OVER (PARTITION BY so.k ORDER BY so.n) AS r FROM so WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.k = so.k AND h.scene = so.n)), b AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) AS r FROM po WHERE hint IS NULL), x AS (SELECT * FROM ev UNION ALL SELECT * FROM h UNION ALL SELECT f.k, f.n, b.n FROM f JOIN b ON f.k = b.k AND f.r = b.r)
SELECT k, scene, plan FROM x UNION ALL SELECT k, n, NULL FROM s WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = s.k AND x.scene = s.n) UNION ALL SELECT k, NULL, n FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.k = p.k AND x.plan = p.n)""")
def paired_inputs(spark: SparkSession, d: str) -> DataFrame:
    n = lambda k, o: (F.row_number().over(Window.partitionBy(k).orderBy(o)) - 1).cast("long")
    s = orders(spark, d).select(F.col("o_custkey").alias("k"), n("o_custkey", "o_orderkey").alias("scene"), F.col("o_orderstatus").alias("hint"))
    hint = F.when(F.col("event_type") == "click", "F").when(F.col("event_type") == "view", "O")
    p = events(spark, d).select(F.col("user_id").alias("k"), n("user_id", "event_id").alias("plan"), hint.alias("hint"))
    return stitching.paired_inputs(s, p, ["k"])


@query("""WITH r AS (SELECT c_nationkey AS k, c_custkey AS room, 'P' || (c_custkey % 40) AS n1, c_mktsegment AS n2 FROM customer), s AS (SELECT s_nationkey AS k, s_suppkey AS scene, CASE s_suppkey % 3 WHEN 0 THEN 'P' || (s_suppkey % 40) WHEN 1 THEN 'unknown' END AS hint, abs(s_acctbal) AS factor FROM supplier), nm AS (SELECT DISTINCT k, h FROM (SELECT k, n1 AS h FROM r UNION ALL SELECT k, n2 FROM r)),
o AS (SELECT r.k, r.room, min(scene) AS scene FROM r JOIN s ON s.k = r.k AND s.hint IN (r.n1, r.n2) GROUP BY 1, 2), f AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.k = s.k AND nm.h = s.hint)), w AS (SELECT k, arg_max(scene, (factor, -scene)) AS scene FROM f GROUP BY 1), j AS (SELECT r.k, r.room, coalesce(o.scene, w.scene) AS scene FROM r LEFT JOIN o ON o.k = r.k AND o.room = r.room LEFT JOIN w ON w.k = r.k)
SELECT j.k AS c_nationkey, j.room, j.scene, s.factor FROM j LEFT JOIN s ON s.k = j.k AND s.scene = j.scene""")
def room_quality(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("P"), (x % 40).cast("string"))
    rooms = read_table(spark, d, "customer").select("c_nationkey", k.alias("room"), F.array(name(k), F.col("c_mktsegment")).alias("names"))
    scenes = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), s.alias("scene"), F.when(s % 3 == 0, name(s)).when(s % 3 == 1, "unknown").alias("hint"), F.abs("s_acctbal").alias("factor"))
    return stitching.room_quality(rooms, scenes, ["c_nationkey"])


@query(f"""WITH {SPANS_SQL}, b AS (SELECT o_orderpriority AS k, o_orderkey AS room, lo AS x0, hi AS x1, (o_orderkey % 500)::double AS y0, o_orderkey % 500 + 2.5::double AS y1 FROM spans WHERE hi > lo) SELECT a.k AS o_orderpriority, a.room AS a, b.room AS b, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area FROM b a JOIN b ON a.k = b.k AND a.room < b.room AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1""")
def room_overlaps(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = order_spans(spark, d).where("hi > lo").select("o_orderpriority", k.alias("room"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), (k % 500).cast("double").alias("y0"), (k % 500 + 2.5).alias("y1"))
    return stitching.box_overlaps(b, ["o_orderpriority"], cell=16.0)


@query()
def connected_openings(spark: SparkSession, d: str) -> DataFrame:
    """Each opening once, nearest first: tested against plain Python."""
    return stitching.connect_openings(_openings(spark, d), ["capture_id"], 6.0)


def _openings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    other = F.when(k % 4 != 3, (k * 7 + 1) % 3)
    return orders(spark, d).select(F.col("o_custkey").alias("capture_id"), k.alias("opening"), (k % 3).alias("room"), F.when(other != k % 3, other).alias("leads_to"), (k % 11).cast("double").alias("x"), (k % 13).cast("double").alias("y"), (k % 10 / 10.0).alias("confidence"))


@query("""WITH w AS (SELECT l_orderkey AS k, list(l_quantity ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l FROM lineitem GROUP BY 1), d AS (SELECT k, l, CASE WHEN k % 3 = 0 THEN 40.0::double END AS diag, CASE WHEN k % 5 = 0 THEN -7.0::double END AS ring FROM w),
t AS (SELECT *, len(l) = 4 AS four, (l[1] + l[2] + diag) / 2 AS s1, (l[3] + l[4] + diag) / 2 AS s2 FROM d), q AS (SELECT *, CASE WHEN four AND s1 * (s1 - l[1]) * (s1 - l[2]) * (s1 - diag) > 0 AND s2 * (s2 - l[3]) * (s2 - l[4]) * (s2 - diag) > 0 THEN sqrt(s1 * (s1 - l[1]) * (s1 - l[2]) * (s1 - diag)) + sqrt(s2 * (s2 - l[3]) * (s2 - l[4]) * (s2 - diag)) END AS quad, CASE WHEN four THEN (l[1] + l[3]) / 2 * (l[2] + l[4]) / 2 END AS box FROM t)
SELECT k AS l_orderkey, round(coalesce(abs(ring), quad, box), 6) AS floor_area, CASE WHEN ring IS NOT NULL THEN 'polygon' WHEN quad IS NOT NULL THEN 'diagonal' WHEN box IS NOT NULL THEN 'opposite_walls' END AS area_method FROM q""")
def floor_areas(spark: SparkSession, d: str) -> DataFrame:
    w = lineitem(spark, d).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))), lambda x: x["l_quantity"].cast("double")).alias("lengths"))
    k = F.col("l_orderkey")
    w = w.withColumns({"diagonal": F.when(k % 3 == 0, 40.0), "ring_area": F.when(k % 5 == 0, -7.0)})
    return matching.floor_area(w).select("l_orderkey", F.round("floor_area", 6).alias("floor_area"), "area_method")


@query("""WITH n AS (SELECT c_nationkey, c_custkey, 'W' || (c_custkey % 5) AS id, row_number() OVER (PARTITION BY c_nationkey, c_custkey % 5 ORDER BY c_custkey) AS r FROM customer) SELECT c_nationkey, c_custkey, CASE WHEN r > 1 THEN id || '~' || r ELSE id END AS id, r > 1 AS renamed FROM n""")
def repaired_ids(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_nationkey", "c_custkey", F.concat(F.lit("W"), (F.col("c_custkey") % 5).cast("string")).alias("id"))
    return unique_ids(c, ["c_nationkey"], "id", ["c_custkey"])


@query("""SELECT o_orderkey, CASE WHEN o_custkey * 2 IN (SELECT c_custkey FROM customer) THEN o_custkey * 2 END AS other FROM orders""")
def repaired_references(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_custkey")
    return null_dangling(orders(spark, d).select("o_orderkey", (F.col("o_custkey") * 2).alias("other")), "other", c, "c_custkey", [])


@query("""WITH o AS (SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey) SELECT c_custkey AS capture_id, count(o_orderkey) AS rooms, coalesce(sum((o_orderpriority = '1-URGENT')::int), 0)::bigint AS urgent FROM o GROUP BY 1""")
def result_files(spark: SparkSession, d: str) -> DataFrame:
    """Captures with nested rooms, written as JSON and read back; one without rooms stays, empty."""
    from plumbline.plans.result import assemble, write_json

    rooms = orders(spark, d).select(F.col("o_custkey").alias("capture_id"), F.col("o_orderkey").cast("string").alias("room_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("room_ord"), F.col("o_orderpriority").alias("label"))
    walls = rooms.select("capture_id", "room_id", F.lit(0).alias("k"), F.lit(1.5).alias("length"))
    openings = rooms.where("false").select("capture_id", "room_id", F.lit("").alias("opening_id"))
    nested = assemble(read_table(spark, d, "customer").select(F.col("c_custkey").alias("capture_id")), rooms, walls, openings)
    path = fresh_path(spark, "results")
    write_json(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("capture_id", F.size(F.coalesce("rooms", F.array().cast(back.schema["rooms"].dataType))).cast("long").alias("rooms"), F.size(F.filter(F.coalesce("rooms", F.array().cast(back.schema["rooms"].dataType)), lambda r: r["label"] == "1-URGENT")).cast("long").alias("urgent"))


@query("""WITH s AS (SELECT md5(coalesce(text, '')) AS key, min(doc_id) AS first, count(*) AS copies FROM documents GROUP BY 1) SELECT key, length(key)::int AS n FROM s""")
def stored_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Outputs by content key, computed once though asked for twice."""
    from plumbline.plans.result import KeyedStore

    docs = read_table(spark, d, "documents").select(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("key")).distinct()
    store = KeyedStore(spark, fresh_path(spark, "store"), "key string, n int")
    run = lambda new: new.select("key", F.length("key").alias("n"))
    store.compute(docs.where("key < '8'"), "key", run)
    return store.compute(docs, "key", run).select("key", "n")


@query()
def quota_pairs(spark: SparkSession, d: str) -> DataFrame:
    """At most two pairs an end, eight a customer: order-dependent, tested against plain Python."""
    return greedy.top_with_quota(_quota(spark, d), ["k"], "score", ("a", "b"), 2, 8)


def _quota(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, d).select(F.col("o_custkey").alias("k"), (k % 5).alias("a"), (5 + k % 7).alias("b"), F.col("o_totalprice").alias("score"))


@query()
def room_matches(spark: SparkSession, d: str) -> DataFrame:
    """Nations' customers as true rooms, their suppliers as predicted ones: named, else assigned by shape and neighbours."""
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("capture_id"), F.col("c_custkey").cast("string").alias("gt"), F.col("c_mktsegment").alias("label"), F.abs("c_acctbal").alias("area"), (1 + F.col("c_custkey") % 5 / 10.0).alias("aspect"))
    s = read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("capture_id"), F.concat(F.lit("P"), F.col("s_suppkey").cast("string")).alias("pred"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_suppkey").cast("string")).alias("hint"), F.abs("s_acctbal").alias("area"), (1 + F.col("s_suppkey") % 5 / 10.0).alias("aspect"))
    edge = lambda df, name: df.select("capture_id", F.col(name).alias("a"), F.lead(name).over(Window.partitionBy("capture_id").orderBy(name)).alias("b")).where("b IS NOT NULL")
    return matching.match_rooms(c, s, edge(c, "gt"), edge(s, "pred"))


@query()
def merged_hypotheses(spark: SparkSession, d: str) -> DataFrame:
    """Door pairs of two rooms that place them alike, strongest first: tested against plain Python."""
    return greedy.merge_hypotheses(_hypotheses(spark, d), ["capture_id", "a", "b"], 3.0, 0.9, 0.05).select("capture_id", "a", "b", "edge", F.round("score", 9).alias("score"), "members")


def _hypotheses(spark: SparkSession, d: str) -> DataFrame:
    h = stitching.door_pairs(_doors(spark, d))
    return h.select("capture_id", "a", "b", F.concat_ws("/", "door_a", "door_b").alias("id"), F.col("tx").alias("x"), F.col("ty").alias("y"), "yaw", F.round("score", 9).alias("score"))
