"""Detections, fits and coverage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import detections, planes, shapes, windows

from .tables import POINTS_SQL, SPANS_SQL, events, lineitem, order_spans, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query("""WITH raw AS (SELECT o_orderkey AS view_id, o_totalprice / 1000 AS w, (o_orderkey % 400)::double AS x0, (o_orderkey % 300)::double AS y0 FROM orders), ph AS (SELECT l_orderkey AS view_id, l_returnflag AS cls, max(l_quantity / 50) AS score FROM lineitem GROUP BY 1, 2),
b AS (SELECT view_id, arg_max(cls, (score, cls)) AS cls, max(score) AS score FROM ph GROUP BY 1), c AS (SELECT view_id, least(greatest(x0, 0), 640) AS x0, least(greatest(x0 + w, 0), 640) AS x1, least(greatest(y0, 0), 480) AS y0, least(greatest(y0 + w, 0), 480) AS y1 FROM raw)
SELECT c.view_id, b.cls, b.score, x0, y0, x1, y1 FROM c JOIN b ON b.view_id = c.view_id WHERE x1 - x0 >= 4 AND y1 - y0 >= 4 AND (x1 - x0) * (y1 - y0) <= 0.3::double * 640 * 480 AND score >= CASE cls WHEN 'R' THEN 0.3::double ELSE 0.5::double END AND score >= 0.4::double""")
def detection_decode(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    x, y, w = (F.col("o_orderkey") % 400).cast("double"), (F.col("o_orderkey") % 300).cast("double"), F.col("o_totalprice") / 1000
    raw = o.select(F.col("o_orderkey").alias("view_id"), F.lit(0).alias("det_id"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + w).alias("y1"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    phrases = lineitem(spark, d).select(F.col("l_orderkey").alias("view_id"), F.lit(0).alias("det_id"), F.col("l_returnflag").alias("cls"), F.col("l_linenumber").alias("phrase"), (F.col("l_quantity") / 50).alias("score"))
    least = phrases.select("cls").distinct().withColumn("least", F.when(F.col("cls") == "R", 0.3).otherwise(0.5))
    return detections.decode(raw, phrases, least, 0.4, 4.0, 0.3).drop("det_id")


@query("""SELECT o_orderkey AS view_id, t.i::int AS tile, greatest((t.i % 2) * w / 2.0::double - 0.1::double * w / 2, 0) AS tx0, greatest((t.i // 2) * h / 2.0::double - 0.1::double * h / 2, 0) AS ty0, least((t.i % 2 + 1) * w / 2.0::double + 0.1::double * w / 2, w) AS tx1, least((t.i // 2 + 1) * h / 2.0::double + 0.1::double * h / 2, h) AS ty1 FROM (SELECT o_orderkey, (100 + o_orderkey % 50)::double AS w, (200 + o_orderkey % 30)::double AS h FROM orders), generate_series(0, 3) t(i)""")
def tile_grid(spark: SparkSession, d: str) -> DataFrame:
    v = orders(spark, d).select(F.col("o_orderkey").alias("view_id"), (100 + F.col("o_orderkey") % 50).cast("double").alias("width"), (200 + F.col("o_orderkey") % 30).cast("double").alias("height"))
    return detections.tiles(v)


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS cls, l_linestatus AS kind, l_quantity / 50 AS score, l_linenumber AS n_views FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM o WHERE NOT (cls = 'A' AND kind = 'F') AND (NOT (cls = 'N' AND kind = 'O') OR (score >= 0.5::double AND n_views >= 2))""")
def surface_rules(spark: SparkSession, d: str) -> DataFrame:
    o = lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("cls"), F.col("l_linestatus").alias("kind"), (F.col("l_quantity") / 50).alias("score"), F.col("l_linenumber").alias("n_views"))
    rules = o.select("cls", "kind").distinct().where("(cls = 'A' AND kind = 'F') OR (cls = 'N' AND kind = 'O')")
    rules = rules.select("cls", "kind", (F.col("cls") != "A").alias("allowed"), F.lit(0.5).alias("min_score"), F.lit(2).alias("min_views"))
    return detections.plausible(o, rules).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH m AS (SELECT user_id, event_type AS cls, event_id, value FROM events), v AS (SELECT user_id, cls, round(sum(value), 9) AS votes FROM m GROUP BY 1, 2), b AS (SELECT user_id, arg_max(cls, (value, event_id)) AS best FROM m GROUP BY 1),
r AS (SELECT v.user_id, cls, votes, row_number() OVER (PARTITION BY v.user_id ORDER BY votes DESC, cls = best DESC, cls) AS n FROM v JOIN b ON b.user_id = v.user_id) SELECT user_id, cls, round(votes, 6) AS votes FROM r WHERE n = 1""")
def cluster_votes(spark: SparkSession, d: str) -> DataFrame:
    m = events(spark, d).select("user_id", "event_id", F.col("event_type").alias("own_cls"), F.col("value").alias("own_score"), F.col("event_type").alias("cls"), F.col("value").alias("score"))
    return detections.cluster_classes(m, ["user_id"], "event_id").select("user_id", "cls", F.round("votes", 6).alias("votes"))


@query(f"""WITH {SPANS_SQL}, m AS (SELECT o_custkey, o_orderkey, o_orderpriority AS view_id, CASE WHEN o_orderkey % 3 = 0 THEN 'crack' ELSE 'stain' END AS cls, (o_totalprice % 100) / 200 AS score, hi - lo AS length, lo, hi FROM spans), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS n FROM m),
s AS (SELECT o_custkey, 1 - exp(sum(ln(1 - score))) AS score FROM r WHERE n <= 3 GROUP BY 1), g AS (SELECT o_custkey, arg_max(cls, (score, o_orderkey)) AS cls, count(DISTINCT view_id) AS n_views, median(length) AS length, min(lo) AS u0, max(hi) AS u1 FROM m GROUP BY 1)
SELECT g.o_custkey, cls, n_views, CASE WHEN cls = 'crack' AND greatest(u1 - u0, 1) > 1.5::double * length THEN greatest(u1 - u0, 1) ELSE length END AS length, u0, u1, round(score, 6) AS score FROM g JOIN s ON s.o_custkey = g.o_custkey WHERE n_views > 1 OR score >= 0.5::double""")
def damage_merge(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    length = F.col("hi") - F.col("lo")
    m = s.select(
        "o_custkey", "o_orderkey", F.col("o_orderpriority").alias("view_id"), F.when(F.col("o_orderkey") % 3 == 0, "crack").otherwise("stain").alias("cls"), ((F.col("o_totalprice") % 100) / 200).alias("score"),
        length.alias("area"), length.alias("width"), F.lit(1.0).alias("height"), length.alias("length"), F.col("lo").alias("u0"), F.col("hi").alias("u1"), F.lit(0.0).alias("v0"), F.lit(1.0).alias("v1"),
    )
    g = detections.merged_damage(m, ["o_custkey"], "o_orderkey")
    return g.select("o_custkey", "cls", "n_views", "length", "u0", "u1", F.round("score", 6).alias("score"))


@query(f"""WITH {POINTS_SQL}, o AS (SELECT label, point_id, x, y, CASE WHEN point_id % 3 = 0 THEN NULL ELSE 'R' || (point_id % 4) END AS room_id FROM points), r AS (SELECT label, room_id, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, room_id) AS n FROM o WHERE room_id IS NOT NULL GROUP BY 1, 2)
SELECT o.label, round(median(x), 9) AS x, round(median(y), 9) AS y, any_value(r.room_id) AS room_id FROM o LEFT JOIN r ON r.label = o.label AND r.n = 1 GROUP BY 1""")
def object_merge(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("label", "point_id", "x", "y", F.lit("sofa").alias("cls"), F.col("point_id").alias("view_id"), "score", F.when(F.col("point_id") % 3 != 0, F.concat(F.lit("R"), F.col("point_id") % 4)).alias("room_id"))
    g = detections.merged_objects(p, ["label"], "point_id")
    return g.select("label", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "room_id")


@query("""WITH g AS (SELECT o_custkey AS wall, o_orderkey AS gt_id FROM orders WHERE o_orderkey % 2 = 0), p AS (SELECT o_custkey AS wall, o_orderkey AS pred_id FROM orders WHERE o_orderkey % 2 = 1), m AS (SELECT wall, min(gt_id) AS gt_id, min(pred_id) AS pred_id FROM g JOIN p USING (wall) GROUP BY 1)
SELECT wall, gt_id, pred_id, 'matched' AS status FROM m UNION ALL SELECT wall, gt_id, NULL, 'missed' FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.wall = g.wall AND m.gt_id = g.gt_id) UNION ALL SELECT wall, NULL, pred_id, 'phantom' FROM p WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.wall = p.wall AND m.pred_id = p.pred_id)""")
def match_statuses(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumnRenamed("o_custkey", "wall")
    g, p = o.where("o_orderkey % 2 = 0").select("wall", F.col("o_orderkey").alias("gt_id")), o.where("o_orderkey % 2 = 1").select("wall", F.col("o_orderkey").alias("pred_id"))
    m = g.groupBy("wall").agg(F.min("gt_id").alias("gt_id")).join(p.groupBy("wall").agg(F.min("pred_id").alias("pred_id")), "wall")
    return detections.statuses(m, g, p, ["wall"], "gt_id", "pred_id")


@query("""WITH o AS (SELECT l_suppkey AS wall, l_orderkey * 10 + l_linenumber AS id, CASE l_returnflag WHEN 'A' THEN 'door' WHEN 'N' THEN 'opening' ELSE 'window' END AS type, l_quantity AS centre, l_discount * 20 AS width FROM lineitem), g AS (SELECT DISTINCT * FROM o WHERE id % 2 = 0), p AS (SELECT DISTINCT * FROM o WHERE id % 2 = 1)
SELECT g.wall, g.id AS gt_id, p.id AS pred_id, abs(g.centre - p.centre) AS cost FROM g JOIN p ON g.wall = p.wall AND (g.type = 'window') = (p.type = 'window') AND abs(g.centre - p.centre) <= g.width / 2 + 1e-9::double""")
def opening_candidates(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "door").when(F.col("l_returnflag") == "N", "opening").otherwise("window")
    o = lineitem(spark, d).select(F.col("l_suppkey").alias("wall"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), kind.alias("type"), F.col("l_quantity").alias("centre"), (F.col("l_discount") * 20).alias("width")).distinct()
    return detections.opening_candidates(o.where("id % 2 = 0").withColumnRenamed("id", "gt_id"), o.where("id % 2 = 1").withColumnRenamed("id", "pred_id"), ["wall"])


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_id FROM events JOIN m USING (event_type) WHERE value >= 0.35::double * m""")
def sharp_frames(spark: SparkSession, d: str) -> DataFrame:
    return detections.sharp_frames(events(spark, d), ["event_type"], "event_id", "value").select("event_id")


@query("""WITH p AS (SELECT l_suppkey AS g, l_quantity AS x, l_discount * 100 AS y, l_extendedprice / 1000 AS z, 1 + l_tax AS w FROM lineitem), m AS (SELECT g, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*z)/sum(w) AS mz FROM p GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT p.g, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, sum(w*(x-mx)*(x-mx)) AS xx, sum(w*(x-mx)*(y-my)) AS xy, sum(w*(y-my)*(y-my)) AS yy, sum(w*(x-mx)*(z-mz)) AS xz, sum(w*(y-my)*(z-mz)) AS yz, sum(w*(z-mz)*(z-mz)) AS zz, sum(w) AS sw FROM p JOIN m ON m.g = p.g GROUP BY 1),
f AS (SELECT *, (xz*yy - yz*xy) / (xx*yy - xy*xy) AS a, (yz*xx - xz*xy) / (xx*yy - xy*xy) AS b FROM s WHERE xx*yy - xy*xy > 0) SELECT g AS l_suppkey, round(a, 6) AS a, round(b, 6) AS b, round(mz - a*mx - b*my, 6) AS c, round(sqrt(a*a + b*b), 6) AS slope, round(sqrt(greatest(zz - a*xz - b*yz, 0) / sw), 6) AS rms FROM f""")
def plane_fit(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem(spark, d).select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("z"), (1 + F.col("l_tax")).alias("w"))
    f = planes.plane_fit(p, ["l_suppkey"])
    return f.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("a", "b", "c", "slope", "rms")))


@query("""WITH g AS (SELECT l_suppkey, var_pop(l_quantity) AS vx, var_pop(l_extendedprice / 1000) AS vy, covar_pop(l_quantity, l_extendedprice / 1000) AS vxy FROM lineitem GROUP BY 1), h AS (SELECT *, (vx + vy) / 2 AS half, sqrt(pow((vx - vy) / 2, 2) + pow(vxy, 2)) AS gap FROM g)
SELECT l_suppkey, round(atan2(2 * vxy, vx - vy) / 2, 6) AS angle, round(sqrt(half + gap), 6) AS major, round(sqrt(greatest(half - gap, 0)), 6) AS minor FROM h""")
def principal_axis(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem(spark, d).select("l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    f = planes.principal_axis(p, ["l_suppkey"])
    return f.select("l_suppkey", *(F.round(c, 6).alias(c) for c in ("angle", "major", "minor")))


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS g, floor(l_quantity / 2.0::double)::bigint AS it, floor(l_discount / 0.02::double)::bigint AS iz FROM lineitem), k AS (SELECT g, it, count(*) AS filled, it - row_number() OVER (PARTITION BY g ORDER BY it) AS run FROM c GROUP BY 1, 2), r AS (SELECT g, run, count(*) AS long, sum(filled) AS filled FROM k GROUP BY 1, 2)
SELECT g AS l_suppkey, sum(long)::bigint AS columns, sum(filled)::bigint AS cells, max(long) * 2.0::double AS longest FROM r GROUP BY 1""")
def face_occupancy(spark: SparkSession, d: str) -> DataFrame:
    return planes.occupancy_runs(lineitem(spark, d), ["l_suppkey"], "l_quantity", "l_discount", 2.0, 0.02).drop("area")


@query("""WITH n AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) SELECT o_custkey, o_orderpriority AS label FROM n WHERE r = 1""")
def room_labels(spark: SparkSession, d: str) -> DataFrame:
    return planes.room_labels(orders(spark, d), ["o_custkey"], "o_orderpriority")


@query(f"""WITH {POINTS_SQL}, e AS (SELECT label, point_id, x, y FROM points), p AS (SELECT label, point_id AS point, x, y FROM points), v AS (SELECT label, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER f) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER f) AS by_ FROM points WINDOW w AS (PARTITION BY label ORDER BY point_id), f AS (PARTITION BY label ORDER BY point_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT p.label, p.point FROM p JOIN v ON p.label = v.label GROUP BY 1, 2 HAVING sum(coalesce((ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / nullif(by_ - ay, 0), false)::int) % 2 = 1""")
def points_in_rings(spark: SparkSession, d: str) -> DataFrame:
    """Every point against its label's ring of all points."""
    p = points(spark, d)
    turn = windows.cyclic_neighbours(windows.cyclic_neighbours(p, ["label"], "point_id", "x").withColumnRenamed("next", "bx").drop("previous"), ["label"], "point_id", "y")
    edges = turn.select("label", F.lit(0).alias("ring"), F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", F.col("next").alias("by_"))
    inside = shapes.points_in_rings(p.select("label", F.col("point_id").alias("point"), "x", "y"), edges, ["label"])
    return inside.select("label", "point")


@query("""WITH a AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, epoch_us(ts) AS t, event_id FROM events WHERE event_type = 'view'), b AS (SELECT f.*, p.t AS t0, p.value AS v0 FROM f ASOF LEFT JOIN a p ON f.user_id = p.user_id AND f.t >= p.t), c AS (SELECT b.*, n.t AS t1, n.value AS v1 FROM b ASOF LEFT JOIN a n ON b.user_id = n.user_id AND b.t <= n.t)
SELECT user_id, event_id, round(coalesce(v0 + coalesce((t - t0) / nullif(t1 - t0, 0)::double, 0) * (v1 - v0), v0, v1), 6) AS value FROM c""")
def anchor_interpolation(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    frames, anchors = e.where("event_type = 'view'").select("user_id", "t_us", "event_id"), e.where("event_type = 'purchase'").select("user_id", "t_us", "value")
    return planes.interpolate_corrections(frames, anchors, ["user_id"], "t_us", ["value"]).select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN NOT l_discount < 0.02::double THEN 'rmse' WHEN NOT l_tax * 10 > 0.30::double THEN 'overlap' WHEN NOT l_linenumber >= 4 THEN 'dof' WHEN NOT l_quantity <= 15 THEN 'rotation' WHEN NOT l_tax <= 1.5::double THEN 'translation' END AS reason FROM lineitem""")
def registration_verdicts(spark: SparkSession, d: str) -> DataFrame:
    r = lineitem(spark, d).withColumn("o", F.col("l_tax") * 10)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", detections.registration_verdict("l_discount", "o", "l_linenumber", "l_quantity", "l_tax").alias("reason"))

