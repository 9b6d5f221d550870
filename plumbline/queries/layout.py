"""Plan cells, their sides, regions, rooms and outlines over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.kernels import greedy
from plumbline.operators import cells, outlines, rings, walls
from plumbline.session import materialize, read_table

from .tables import POINTS_SQL, lineitem, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# line items as wall evidence of five plans of 7 x 7 lines a metre apart, orders as free space, suppliers as cameras
_PLAN_SQL = """profile AS (SELECT (l_suppkey % 5)::int AS plan, (l_linenumber % 2)::int AS axis, (l_partkey % 7)::int AS k, (l_orderkey % 60)::int AS bin, sum(l_quantity) > 25 * count(*) AS closed, sum(round(l_discount * 100)::bigint) > 5 * count(*) AS upper FROM lineitem GROUP BY 1, 2, 3, 4),
held AS (SELECT *, bin // 10 AS other FROM profile), runs AS (SELECT plan, axis, k, other, max(n) * 0.1::double AS free FROM (SELECT plan, axis, k, other, run, count(*) AS n FROM (SELECT *, bin - row_number() OVER (PARTITION BY plan, axis, k, other ORDER BY bin) AS run FROM held WHERE NOT closed) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4),
shares AS (SELECT plan, axis, k, other, avg(closed::int) AS closed, avg(upper::int) AS upper FROM held GROUP BY 1, 2, 3, 4),
sides AS (SELECT s.*, 1.0::double AS length, coalesce(free >= 0.3::double - 1e-9::double, false) AS open, coalesce(free >= 0.3::double - 1e-9::double, false) AND closed <= 0.5::double AS wide FROM shares s LEFT JOIN runs USING (plan, axis, k, other)),
two AS (SELECT *, CASE axis WHEN 0 THEN k - 1 ELSE other END AS i, CASE axis WHEN 0 THEN other ELSE k - 1 END AS j, CASE axis WHEN 0 THEN k ELSE other END AS i2, CASE axis WHEN 0 THEN other ELSE k END AS j2 FROM sides),
adj AS (SELECT plan, i, j, i2, j2, length, closed, upper, open, wide FROM two UNION ALL SELECT plan, i2, j2, i, j, length, closed, upper, open, wide FROM two),
space AS (SELECT (o_custkey % 5)::int AS plan, (o_orderkey % 6)::int AS i, (floor(o_totalprice)::bigint % 6)::int AS j, sum(o_orderkey % 100) / (100.0::double * count(*)) AS coverage, sum(o_custkey % 10) / (10.0::double * count(*)) AS floor FROM orders GROUP BY 1, 2, 3),
cells AS (SELECT p.plan, x.i::int AS i, y.j::int AS j, coalesce(coverage, 0) AS coverage, coalesce(floor, 0) AS floor FROM (SELECT DISTINCT plan FROM profile) p CROSS JOIN generate_series(0, 5) x(i) CROSS JOIN generate_series(0, 5) y(j) LEFT JOIN space s ON s.plan = p.plan AND s.i = x.i AND s.j = y.j),
inside AS (SELECT plan, i, j FROM cells WHERE coverage >= 0.5::double),
link AS (SELECT a.* FROM adj a JOIN inside x ON x.plan = a.plan AND x.i = a.i AND x.j = a.j JOIN inside y ON y.plan = a.plan AND y.i = a.i2 AND y.j = a.j2 WHERE a.open),
closure(plan, i, j, m) AS (SELECT plan, i, j, i * 65536 + j FROM inside UNION SELECT l.plan, l.i2, l.j2, c.m FROM closure c JOIN link l ON l.plan = c.plan AND l.i = c.i AND l.j = c.j),
labelled AS (SELECT plan, i, j, min(m)::bigint AS region FROM closure GROUP BY 1, 2, 3)"""

_STATS_SQL = """cams AS (SELECT (s_suppkey % 5)::int AS plan, s_suppkey AS cam, (s_suppkey * 7 % 60) / 10.0::double + 0.05::double AS x, (s_suppkey * 11 % 60) / 10.0::double + 0.05::double AS y FROM supplier),
seen AS (SELECT l.plan, region, count(*) AS n_cams, min(cam) AS first_cam FROM labelled l JOIN cams c ON c.plan = l.plan AND c.x > l.i AND c.x <= l.i + 1 AND c.y > l.j AND c.y <= l.j + 1 GROUP BY 1, 2),
edge AS (SELECT a.*, l.region, o.region AS other FROM adj a JOIN labelled l USING (plan, i, j) LEFT JOIN labelled o ON o.plan = a.plan AND o.i = a.i2 AND o.j = a.j2 WHERE o.region IS NULL OR o.region <> l.region),
bound AS (SELECT plan, region, sum(length * closed) / sum(length) AS support FROM edge GROUP BY 1, 2), near AS (SELECT plan, region, other, sum(length) AS length, sum(length * upper) AS tall FROM edge WHERE other IS NOT NULL GROUP BY 1, 2, 3),
stats AS (SELECT l.plan, l.region, count(*)::double AS area, min(l.i)::double AS bx0, min(l.j)::double AS by0, max(l.i) + 1.0::double AS bx1, max(l.j) + 1.0::double AS by1, avg(coverage) AS coverage, avg(floor) AS floor, coalesce(any_value(n_cams), 0)::bigint AS n_cams, any_value(first_cam) AS first_cam, coalesce(any_value(support), 0) AS support
 FROM labelled l JOIN cells USING (plan, i, j) LEFT JOIN seen s ON s.plan = l.plan AND s.region = l.region LEFT JOIN bound b ON b.plan = l.plan AND b.region = l.region GROUP BY 1, 2),
kinds AS (SELECT *, CASE WHEN least(bx1 - bx0, by1 - by0) < 0.25 THEN 'thin' WHEN area < 2.5 OR least(bx1 - bx0, by1 - by0) < 0.5 THEN 'small' WHEN n_cams > 0 OR (coverage >= 0.75 AND support >= 0.6 AND floor >= 0.3) THEN 'room' ELSE 'reject' END AS kind FROM stats)"""


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(cells, sides) of the plans."""
    li, o = lineitem(spark, d), orders(spark, d)
    at = [(F.col(c) % n).cast("int").alias(a) for c, n, a in (("l_suppkey", 5, "plan"), ("l_linenumber", 2, "axis"), ("l_partkey", 7, "k"), ("l_orderkey", 60, "bin"))]
    n = F.count(F.lit(1))
    profile = li.groupBy(*at).agg((F.sum("l_quantity") > 25 * n).alias("closed"), (F.sum(F.round(F.col("l_discount") * 100).cast("long")) > 5 * n).alias("upper"))
    profile = materialize(profile, "profile")
    own = cells.cells_between(profile.select("plan", "axis", "k", F.col("k").cast("double").alias("coord")).distinct())
    space = o.groupBy((F.col("o_custkey") % 5).cast("int").alias("plan"), (F.col("o_orderkey") % 6).cast("int").alias("i"), (F.floor("o_totalprice") % 6).cast("int").alias("j"))
    space = space.agg((F.sum(F.col("o_orderkey") % 100) / (100.0 * n)).alias("coverage"), (F.sum(F.col("o_custkey") % 10) / (10.0 * n)).alias("floor"))
    own = own.join(space, ["plan", "i", "j"], "left").fillna(0.0, ["coverage", "floor"])
    return materialize(own, "cells"), materialize(cells.cell_sides(profile, own, 0.1), "sides")


def _labelled(own: DataFrame, sides: DataFrame) -> DataFrame:
    return materialize(cells.regions(own.where(F.col("coverage") >= cells.INSIDE).select("plan", "i", "j"), sides), "regions")


def _cameras(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read_table(spark, d, "supplier").select((s % 5).cast("int").alias("plan"), s.alias("cam"), ((s * 7 % 60) / 10.0 + 0.05).alias("x"), ((s * 11 % 60) / 10.0 + 0.05).alias("y"))


@query(f"WITH RECURSIVE {_PLAN_SQL} SELECT plan, axis, k, other, length, round(closed, 9) AS closed, round(upper, 9) AS upper, open, wide FROM sides")
def cell_sides(spark: SparkSession, d: str) -> DataFrame:
    sides = _plan(spark, d)[1]
    return sides.select("plan", "axis", "k", "other", "length", F.round("closed", 9).alias("closed"), F.round("upper", 9).alias("upper"), "open", "wide")


@query(f"WITH RECURSIVE {_PLAN_SQL}, g(plan, i, j, n) AS (SELECT plan, i, j, 0 FROM inside UNION SELECT a.plan, a.i2, a.j2, n + 1 FROM g JOIN adj a ON a.plan = g.plan AND a.i = g.i AND a.j = g.j WHERE a.wide AND n < 10 AND a.i2 BETWEEN 0 AND 5 AND a.j2 BETWEEN 0 AND 5) SELECT DISTINCT plan, i, j FROM g")
def grown_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells.grow_inside(*_plan(spark, d), thin=1.5)


@query(f"WITH RECURSIVE {_PLAN_SQL} SELECT plan, i, j, region FROM labelled")
def plan_regions(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(*_plan(spark, d))


@query(f"WITH RECURSIVE {_PLAN_SQL}, {_STATS_SQL} SELECT plan, region, area, bx0, by0, bx1, by1, round(coverage, 9) AS coverage, round(floor, 9) AS floor, n_cams, first_cam, round(support, 9) AS support FROM stats")
def region_stats(spark: SparkSession, d: str) -> DataFrame:
    own, sides = _plan(spark, d)
    stats, _ = cells.region_stats(own, _labelled(own, sides), sides, _cameras(spark, d))
    return stats.select("plan", "region", "area", "bx0", "by0", "bx1", "by1", *(F.round(c, 9).alias(c) for c in ("coverage", "floor", "support")), "n_cams", "first_cam")


@query(f"WITH RECURSIVE {_PLAN_SQL}, {_STATS_SQL} SELECT plan, region, other, length, round(tall, 9) AS tall FROM near")
def region_neighbours(spark: SparkSession, d: str) -> DataFrame:
    own, sides = _plan(spark, d)
    _, near = cells.region_stats(own, _labelled(own, sides), sides, _cameras(spark, d))
    return near.select("plan", "region", "other", "length", F.round("tall", 9).alias("tall"))


@query(f"""WITH RECURSIVE {_PLAN_SQL}, {_STATS_SQL.replace("area < 2.5", "area < 0.7")}, main AS (SELECT plan, region FROM kinds WHERE kind = 'room'),
sole AS (SELECT n.plan, n.region, min(n.other) AS room FROM near n JOIN kinds k ON k.plan = n.plan AND k.region = n.region AND k.kind = 'small' JOIN main m ON m.plan = n.plan AND m.region = n.other WHERE tall < 0.5 * length GROUP BY 1, 2 HAVING count(*) = 1),
bare AS (SELECT plan, arg_max(region, (kind <> 'thin', n_cams, area, -region)) AS region FROM kinds WHERE plan NOT IN (SELECT plan FROM main) GROUP BY 1), chosen AS (SELECT * FROM main UNION ALL SELECT * FROM bare),
rooms AS (SELECT c.plan, c.region AS room, row_number() OVER (PARTITION BY c.plan ORDER BY first_cam NULLS LAST, area DESC, c.region)::int AS room_ord FROM chosen c JOIN stats s ON s.plan = c.plan AND s.region = c.region), parts AS (SELECT plan, region, region AS room FROM chosen UNION ALL SELECT * FROM sole)
SELECT p.plan, p.region, p.room, room_ord FROM parts p JOIN rooms r ON r.plan = p.plan AND r.room = p.room""")
def selected_rooms(spark: SparkSession, d: str) -> DataFrame:
    own, sides = _plan(spark, d)
    stats, near = cells.region_stats(own, _labelled(own, sides), sides, _cameras(spark, d))
    return cells.select_rooms(stats, near, 0.25).select("plan", "region", "room", "room_ord")


@query(f"""WITH RECURSIVE {_PLAN_SQL}, side AS (SELECT l.plan, l.region, w.way, l.i, l.j FROM labelled l CROSS JOIN (VALUES ('s', 0, -1), ('e', 1, 0), ('n', 0, 1), ('w', -1, 0)) w(way, di, dj) LEFT JOIN labelled o ON o.plan = l.plan AND o.region = l.region AND o.i = l.i + w.di AND o.j = l.j + w.dj WHERE o.plan IS NULL),
line AS (SELECT plan, region, way, CASE way WHEN 's' THEN j WHEN 'n' THEN j + 1 WHEN 'e' THEN i + 1 ELSE i END AS line, CASE WHEN way IN ('s', 'n') THEN i ELSE j END AS lo FROM side), isl AS (SELECT *, lo - row_number() OVER (PARTITION BY plan, region, way, line ORDER BY lo) AS run FROM line),
e AS (SELECT plan, region, way, line::double AS line, min(lo)::double AS lo, max(lo) + 1.0::double AS hi FROM isl GROUP BY plan, region, way, line, run)
SELECT plan, region, CASE way WHEN 's' THEN lo WHEN 'e' THEN line WHEN 'n' THEN hi ELSE line END AS x0, CASE way WHEN 's' THEN line WHEN 'e' THEN lo WHEN 'n' THEN line ELSE hi END AS y0, CASE way WHEN 's' THEN hi WHEN 'e' THEN line WHEN 'n' THEN lo ELSE line END AS x1, CASE way WHEN 's' THEN line WHEN 'e' THEN hi WHEN 'n' THEN line ELSE lo END AS y1 FROM e""")
def outline_edges(spark: SparkSession, d: str) -> DataFrame:
    own, sides = _plan(spark, d)
    return cells.outline_edges(own, _labelled(own, sides))


@query(f"""WITH RECURSIVE oe AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY plan, region, y0, x0, x1, y1) AS e FROM ({ORACLE_SQL["outline_edges"]})),
nxt AS MATERIALIZED (SELECT a.e, b.e AS f FROM oe a JOIN oe b ON b.plan = a.plan AND b.region = a.region AND b.x0 = a.x1 AND b.y0 = a.y1
 QUALIFY row_number() OVER (PARTITION BY a.e ORDER BY atan2((a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0), (a.x1 - a.x0) * (b.x1 - b.x0) + (a.y1 - a.y0) * (b.y1 - b.y0))) = 1),
walk(s, e, k) AS (SELECT e, e, 0 FROM oe UNION ALL SELECT s, f, k + 1 FROM walk JOIN nxt USING (e) WHERE f <> s),
lead AS (SELECT s, min(e) AS low, count(*) AS size FROM walk GROUP BY 1 HAVING min(e) = s), held AS (SELECT plan, region, w.s, k, x0, y0, x1, y1, size FROM walk w JOIN lead USING (s) JOIN oe ON oe.e = w.e),
area AS (SELECT plan, region, s, sum(x0 * y1 - x1 * y0) / 2 AS area FROM held GROUP BY 1, 2, 3), ring AS (SELECT *, row_number() OVER (PARTITION BY plan, region ORDER BY area DESC, s)::int AS ring FROM area)
SELECT h.plan, h.region, ring, k::bigint AS k, x0 AS x, y0 AS y, size, area FROM held h JOIN ring USING (plan, region, s)""")
def outline_rings(spark: SparkSession, d: str) -> DataFrame:
    """The outline of each region in order, holes after it."""
    own, sides = _plan(spark, d)
    return rings.ordered_rings(cells.outline_edges(own, _labelled(own, sides)), ["plan", "region"])


@query(f"""WITH {_PLAN_SQL.partition("link AS")[0].rstrip().rstrip(",")}, t AS (SELECT plan, coverage >= 0.5::double AS a, floor >= 0.45::double AS b FROM cells),
o AS (SELECT plan, unnest(['and', 'or', 'minus', 'xor']) AS how, unnest([a AND b, a OR b, a AND NOT b, a <> b]) AS held FROM t) SELECT plan, how, count(*)::double AS area FROM o WHERE held GROUP BY 1, 2""")
def ring_operations(spark: SparkSession, d: str) -> DataFrame:
    """Free space against floor seen, both as outlines with holes: areas of what each operation keeps."""
    own = _plan(spark, d)[0]
    shape = lambda test: rings.outline_of(own.where(test).select("plan", "x0", "y0", "x1", "y1"), ["plan"])
    a, b = materialize(shape("coverage >= 0.5"), "free"), materialize(shape("floor >= 0.45"), "seen")
    out = [rings.area_of(rings.combine(a, b, ["plan"], how), ["plan"]).withColumn("how", F.lit(how)) for how in rings.OPERATIONS]
    return out[0].union(out[1]).union(out[2]).union(out[3]).select("plan", "how", "area")


@query()
def refined_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Regions put on the faces of line items: rounds of rewriting have no SQL, tested on made faces."""
    own, sides = _plan(spark, d)
    labelled = _labelled(own, sides)
    ring = rings.ordered_rings(cells.outline_edges(own, labelled), ["plan", "region"]).where("ring = 1")
    rooms = rings.rings_as_arrays(ring, ["plan", "region"]).select("plan", "region", "points", F.lit(0.0).alias("floor_z"), F.lit(2.5).alias("ceil_z"), F.lit(0.01).alias("sigma"))
    c = F.col
    near = lineitem(spark, d).select(
        (c("l_suppkey") % 5).cast("int").alias("plan"), (c("l_linenumber") % 2).cast("int").alias("axis"), F.when(c("l_quantity") > 25, 1).otherwise(-1).alias("sign"), (c("l_partkey") % 7 + (c("l_discount") - 0.05) * 0.6).alias("v"),
        (c("l_orderkey") % 600 / 100.0).alias("t"), (F.floor("l_extendedprice") % 250 / 100.0).alias("z"), F.lit(1.0).alias("wa"), (c("l_tax") + 0.1).alias("wf"),
    )
    out = outlines.refine_outlines(rooms, near, ["plan", "region"], labelled.join(own, ["plan", "i", "j"]).select("plan", "region", "x0", "y0", "x1", "y1"))
    return out.select("plan", "region", "ok", "steps", "filled", "k", "axis", "sign", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", "refined")


@query("""WITH t AS (SELECT o_orderkey, 1 + o_custkey % 9 AS a, 1 + o_orderkey % 7 AS b, 0.5::double + floor(o_totalprice)::bigint % 8 AS w, 0.5::double + o_custkey % 5 AS h FROM orders)
SELECT o_orderkey, round(a * b / 2.0::double - CASE WHEN w < a THEN (a - w) ** 2 * b / (2 * a) ELSE 0 END - CASE WHEN h < b THEN (b - h) ** 2 * a / (2 * b) ELSE 0 END + CASE WHEN 1 - w / a - h / b > 0 THEN (1 - w / a - h / b) ** 2 * a * b / 2 ELSE 0 END, 6) AS area FROM t""")
def clipped_rings(spark: SparkSession, d: str) -> DataFrame:
    """Triangles cut to boxes."""
    o = orders(spark, d).select("o_orderkey", (1 + F.col("o_custkey") % 9).alias("a"), (1 + F.col("o_orderkey") % 7).alias("b"), (0.5 + F.floor("o_totalprice") % 8).alias("w"), (0.5 + F.col("o_custkey") % 5).alias("h"))
    ring = lambda *points: F.array(*(F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in points))
    c = F.col
    left = rings.clipped(ring((0, 0), (c("a"), 0), (0, c("b"))), ring((0, 0), (c("w"), 0), (c("w"), c("h")), (0, c("h"))))
    return o.select("o_orderkey", F.round(rings.signed_area(left), 6).alias("area"))


@query(f"WITH RECURSIVE {_PLAN_SQL}, {_STATS_SQL} SELECT c.plan, cam, (ceil(x) - 1)::int AS i, (ceil(y) - 1)::int AS j FROM cams c WHERE x > 0 AND x <= 6 AND y > 0 AND y <= 6 AND c.plan IN (SELECT plan FROM profile)")
def camera_cells(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    cuts = li.select((F.col("l_suppkey") % 5).cast("int").alias("plan"), (F.col("l_linenumber") % 2).cast("int").alias("axis"), (F.col("l_partkey") % 7).cast("int").alias("k")).distinct().withColumn("coord", F.col("k").cast("double"))
    return cells.cell_of(_cameras(spark, d), cuts).select("plan", "cam", "i", "j")


@query(f"""WITH {POINTS_SQL}, up AS (SELECT label, z, w + 1e-3::double AS w FROM points WHERE nz / sqrt(nx*nx+ny*ny+nz*nz) > 0.1::double), k AS (SELECT label, quantile_cont(z, 0.005) AS lo, quantile_cont(z, 0.995) AS hi FROM up GROUP BY 1 HAVING count(*) >= 5),
h AS (SELECT label, floor((z - lo) / 0.02::double)::bigint AS b, sum(w) AS h, any_value(greatest(ceil((hi - lo) / 0.02::double), 1) - 1)::bigint AS last FROM up JOIN k USING (label) WHERE floor((z - lo) / 0.02::double) >= 0 AND floor((z - lo) / 0.02::double) <= greatest(ceil((hi - lo) / 0.02::double), 1) - 1 GROUP BY 1, 2),
sm AS (SELECT label, b + d.d AS b, sum(h) AS h, any_value(last) AS last FROM h, (VALUES (-1), (0), (1)) d(d) WHERE b + d.d BETWEEN 0 AND last GROUP BY 1, 2), tp AS (SELECT label, b + d.d AS b, max(h) AS top FROM sm, (VALUES (-2), (-1), (0), (1), (2)) d(d) GROUP BY 1, 2), pk AS (SELECT sm.label, min(sm.b) AS b FROM sm JOIN tp ON tp.label = sm.label AND tp.b = sm.b WHERE h = top AND h >= 0.25::double * (SELECT max(m.h) FROM sm m WHERE m.label = sm.label) GROUP BY 1),
i AS (SELECT up.* FROM up JOIN pk USING (label) JOIN k USING (label) WHERE abs(z - (lo + (b + 0.5::double) * 0.02::double)) < 0.05::double) SELECT label, round(sum(z * w) / sum(w), 6) AS z, count(*) AS n FROM i GROUP BY 1 HAVING count(*) >= 5""")
def floor_levels(spark: SparkSession, d: str) -> DataFrame:
    f = walls.floor_levels(points(spark, d), ["label"], up=0.1, least=5)
    return f.select("label", F.round("z", 6).alias("z"), "n")


@query()
def wall_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines are taken strongest first: tested against plain Python."""
    return walls.wall_lines(_offsets(spark, d), ["k"], 0.0, 55.0, size=0.5, apart=2.0).select("k", "direction", F.round("coord", 6).alias("coord"), F.round("support", 6).alias("support"))


@query()
def peeled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their points taken out, round by round: tested against plain Python."""
    lines, _ = walls.peel_lines(_faces(spark, d), ["k"], -0.5, 7.5)
    return lines.select("k", "direction", "line", "n", *(F.round(c, 6).alias(c) for c in ("coord", "slope", "rms", "area")))


def _faces(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return lineitem(spark, d).select(
        (c("l_suppkey") % 5).alias("k"), (c("l_linenumber") % 2 * 2 + F.when(c("l_quantity") > 25, 1).otherwise(0)).alias("direction"), (c("l_partkey") % 7 + (c("l_discount") - 0.05) * 0.4 + (c("l_orderkey") % 60 / 200.0 - 0.15) * 0.06).alias("offset"),
        (c("l_orderkey") % 60 / 200.0).alias("along"), (F.floor("l_extendedprice") % 250 / 100.0).alias("z"), (c("l_tax") + 0.5).alias("w"),
    )


def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return lineitem(spark, d).select((F.col("l_suppkey") % 10).alias("k"), (F.col("l_linenumber") % 4).alias("direction"), (F.col("l_quantity") + F.col("l_discount")).alias("offset"), F.lit(1.0).alias("w"))


@query("""WITH f AS (SELECT l_suppkey % 20 AS k, floor(l_quantity / 2.0::double)::bigint AS iu, floor(l_linenumber / 2.0::double)::bigint AS iz, sum(l_tax) AS mass FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2, 3), t AS (SELECT l_suppkey % 20 AS k, floor(l_quantity / 2.0::double)::bigint AS iu, floor(l_linenumber / 2.0::double)::bigint AS iz, count(*) AS through FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2, 3)
SELECT k, iu, iz, round(coalesce(mass, 0), 6) AS mass, coalesce(through, 0) AS through FROM f FULL JOIN t USING (k, iu, iz)""")
def wall_grids(spark: SparkSession, d: str) -> DataFrame:
    p = lineitem(spark, d).select((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").alias("u"), F.col("l_linenumber").cast("double").alias("z"), F.col("l_tax").alias("w"), "l_returnflag")
    g = walls.wall_grids(p.where("l_returnflag <> 'A'"), p.where("l_returnflag = 'A'"), ["k"], 2.0)
    return g.select("k", "iu", "iz", F.round("mass", 6).alias("mass"), "through")


@query("""WITH RECURSIVE c AS (SELECT l_suppkey % 20 AS k, l_quantity::bigint AS iu, l_linenumber::bigint AS iz FROM lineitem GROUP BY 1, 2, 3 HAVING sum((l_returnflag = 'A')::int) * 3 > count(*)), r(k, iu, iz, m) AS (SELECT k, iu, iz, (iu + 32768) * 65536 + iz + 32768 FROM c UNION SELECT c.k, c.iu, c.iz, r.m FROM r JOIN c ON c.k = r.k AND abs(c.iu - r.iu) + abs(c.iz - r.iz) = 1), p AS (SELECT k, iu, iz, min(m) AS part FROM r GROUP BY 1, 2, 3)
SELECT k, part, min(iu) AS u0, max(iu) + 1 AS u1, min(iz) AS z0, max(iz) + 1 AS z1, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 4""")
def opening_parts(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem(spark, d).groupBy((F.col("l_suppkey") % 20).alias("k"), F.col("l_quantity").cast("long").alias("iu"), F.col("l_linenumber").cast("long").alias("iz"))
    cells_ = g.agg((F.count_if(F.col("l_returnflag") == "A") * 3 > F.count(F.lit(1))).alias("open")).where("open")
    return walls.opening_candidates(cells_, "k")


@query()
def distinct_openings(spark: SparkSession, d: str) -> DataFrame:
    """The most confident first: tested against plain Python."""
    return walls.distinct_openings(_fits(spark, d), ["k"], "id").select("k", "id")


def _fits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    return orders(spark, d).select(F.col("o_custkey").alias("k"), n.alias("id"), (n % 20).cast("double").alias("u0"), (n % 20 + 2 + n % 5).cast("double").alias("u1"), (n % 3).cast("double").alias("z0"), (n % 3 + 3).cast("double").alias("z1"), F.col("o_totalprice").alias("confidence"))


@query()
def same_regions(spark: SparkSession, d: str) -> DataFrame:
    """In order of arrival: tested against plain Python."""
    f = _fits(spark, d).withColumnsRenamed({"u0": "x0", "u1": "x1", "z0": "y0", "z1": "y1", "confidence": "score"})
    return greedy.same_region(f, ["k"], "id").select("k", "id")
