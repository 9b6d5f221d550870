"""Bins, quantiles, sequences, joins and shapes over the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import natural_key
from plumbline.operators import bins, graph, joins, quantiles, shapes, windows
from plumbline.session import read_table

from .tables import POINTS_SQL, SPANS_SQL, events, lineitem, order_spans, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


@query(f"""WITH {POINTS_SQL}, v AS (SELECT floor(x / 0.1::double)::bigint AS ix, floor(y / 0.1::double)::bigint AS iy, floor(z / 0.1::double)::bigint AS iz, * FROM points),
g AS (SELECT ix, iy, iz, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, sum(w*z)/sum(w) AS mz, sum(w*nx) AS sx, sum(w*ny) AS sy, sum(w*nz) AS sz, avg(w) AS mw, count(*) AS n, arg_max(point_id, (w, -point_id)) AS tag FROM v GROUP BY ALL)
SELECT ix, iy, iz, round(mx, 9) AS x, round(my, 9) AS y, round(mz, 9) AS z, round(CASE WHEN sqrt(sx*sx+sy*sy+sz*sz) > 0 THEN sx / sqrt(sx*sx+sy*sy+sz*sz) ELSE 0 END, 9) AS nx, round(mw, 9) AS w, n, tag FROM g""")
def voxel_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    v = bins.voxel_weighted(points(spark, d), 0.1)
    return v.select("ix", "iy", "iz", *(F.round(c, 9).alias(c) for c in ("x", "y", "z", "nx", "w")), "n", "tag")


@query(f"""WITH {POINTS_SQL} SELECT floor(x / 0.2::double)::bigint AS ix, floor(y / 0.2::double)::bigint AS iy, floor(z / 0.2::double)::bigint AS iz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, round(avg(score), 9) AS score FROM points GROUP BY 1, 2, 3""")
def voxel_plain_mean(spark: SparkSession, d: str) -> DataFrame:
    v = bins.voxel_plain(points(spark, d), 0.2, ["score"])
    return v.select("ix", "iy", "iz", *(F.round(c, 9).alias(c) for c in ("x", "y", "z", "score")))


@query(f"""WITH {POINTS_SQL}, g AS (SELECT floor(x / 0.2::double)::bigint AS ix, floor(y / 0.2::double)::bigint AS iy, floor(z / 0.2::double)::bigint AS iz, avg(x) AS x, sum(w*nx) AS nx, sum(w*ny) AS ny, sum(w*nz) AS nz, avg(w) AS w, sum(w) AS w_sum FROM points GROUP BY 1, 2, 3), l AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS n_len FROM g)
SELECT ix, iy, iz, round(x, 9) AS x, round(nx/n_len, 9) AS nx, round(w, 9) AS w, round(w_sum, 9) AS w_sum, round(n_len, 9) AS n_len FROM l WHERE n_len > 0""")
def voxel_layout_normals(spark: SparkSession, d: str) -> DataFrame:
    v = bins.voxel_layout(points(spark, d), 0.2)
    return v.select("ix", "iy", "iz", *(F.round(c, 9).alias(c) for c in ("x", "nx", "w", "w_sum", "n_len")))


@query(f"""WITH {POINTS_SQL} SELECT floor(x / 0.1::double)::bigint AS ix, floor(y / 0.1::double)::bigint AS iy, floor(z / 0.1::double)::bigint AS iz, count(*) AS n FROM points GROUP BY 1, 2, 3 HAVING count(*) >= 2""")
def occupied_voxels(spark: SparkSession, d: str) -> DataFrame:
    return bins.occupied(points(spark, d), 0.1, 2)


_K = bins.gaussian_kernel(2.0)
_KSQL = " + ".join(f"coalesce(lag(h, {k}) OVER o, 0) * {w!r}::double" if k >= 0 else f"coalesce(lead(h, {-k}) OVER o, 0) * {w!r}::double" for k, w in zip(range(-(len(_K) // 2), len(_K) // 2 + 1), _K, strict=True))


@query(f"""WITH b AS (SELECT least(greatest(trunc((p_retailprice - 900) / 20.0::double)::bigint, 0), 59) AS bin, sum(p_size::double) AS h FROM part GROUP BY 1),
e AS (SELECT s.bin::bigint AS bin, coalesce(b.h, 0) AS h FROM generate_series(0, 59) s(bin) LEFT JOIN b ON b.bin = s.bin),
m AS (SELECT bin, h, {_KSQL} AS sm FROM e WINDOW o AS (ORDER BY bin)),
f AS (SELECT *, coalesce(lag(sm) OVER o, 0) AS before, sum(h) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS support FROM m WINDOW o AS (ORDER BY bin)),
r AS (SELECT *, sum((sm <> before)::int) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f),
g AS (SELECT run, min(bin) AS first, max(bin) AS last, any_value(sm) AS sm, arg_min(before, bin) AS before FROM r GROUP BY run),
a AS (SELECT *, coalesce(lead(sm) OVER (ORDER BY run), 0) AS after FROM g),
t AS (SELECT floor((first + last) / 2.0)::bigint AS bin FROM a WHERE sm > before AND sm > after)
SELECT t.bin, round(900 + (t.bin + 0.5::double) * 20, 6) AS centre, round(r.support, 6) AS support FROM t JOIN r ON r.bin = t.bin""")
def hist_peaks(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").select("p_retailprice", F.col("p_size").cast("double").alias("w"))
    h = bins.histogram(part, "p_retailprice", "w", 900.0, 2100.0, 20.0)
    p = bins.peaks(bins.smooth(h, _K), 2, 900.0, 20.0)
    return p.select("bin", F.round("centre", 6).alias("centre"), F.round("support", 6).alias("support"))


@query(f"""WITH {POINTS_SQL}, g AS (SELECT floor(x / 0.1::double)::bigint AS ix, floor(y / 0.1::double)::bigint AS iy, sum(w) AS v FROM points GROUP BY 1, 2),
s AS (SELECT ix + dx.i AS ix, iy + dy.i AS iy, v FROM g, (VALUES (-1), (0), (1)) dx(i), (VALUES (-1), (0), (1)) dy(i)) SELECT ix, iy, round(sum(v), 9) AS v FROM s GROUP BY 1, 2""")
def box_filter_grid(spark: SparkSession, d: str) -> DataFrame:
    grid = points(spark, d).groupBy(bins.bin_of(F.col("x"), 0.1).alias("ix"), bins.bin_of(F.col("y"), 0.1).alias("iy")).agg(F.sum("w").alias("v"))
    return bins.box_filter(grid, 1).select("ix", "iy", F.round("v", 9).alias("v"))


@query("""WITH s AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM s)
SELECT l_returnflag, min(CASE WHEN cw >= 0.5::double * t THEN x END) AS q FROM c GROUP BY 1""")
def weighted_median(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.weighted_quantile_step(lineitem(spark, d), ["l_returnflag"], "l_extendedprice", "l_quantity", 0.5)


_CENTRED = """WITH a AS (SELECT k, x, w FROM (SELECT l_suppkey AS k, l_extendedprice AS x, l_quantity::double AS w FROM lineitem)),
c AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY k) AS n, (sum(w) OVER (PARTITION BY k ORDER BY x, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - w / 2) / sum(w) OVER (PARTITION BY k) AS c, lead(x) OVER o AS x1 FROM a WINDOW o AS (PARTITION BY k ORDER BY x, w)),
e AS (SELECT *, lead(c) OVER (PARTITION BY k ORDER BY i) AS c1 FROM c),
p AS (SELECT * FROM e WHERE n = 1 OR (x1 IS NOT NULL AND (0.9::double >= c OR i = 1) AND (0.9::double < c1 OR i = n - 1))),
v AS (SELECT *, CASE WHEN n = 1 THEN x WHEN c1 > c THEN x + (0.9::double - c) * (x1 - x) / (c1 - c) ELSE x1 END AS line FROM p)
SELECT k AS l_suppkey, round(min(CASE WHEN n = 1 THEN x ELSE least(greatest(line, CASE WHEN i = 1 THEN x - (x1 - x) / 2 ELSE line END), CASE WHEN i = n - 1 THEN x1 + (x1 - x) / 2 ELSE line END) END), 6) AS q FROM v GROUP BY 1"""


@query(_CENTRED)
def weighted_quantile_interp(spark: SparkSession, d: str) -> DataFrame:
    q = quantiles.weighted_quantile_centred(lineitem(spark, d), ["l_suppkey"], "l_extendedprice", "l_quantity", 0.9)
    return q.select("l_suppkey", F.round("q", 6).alias("q"))


@query("""WITH r AS (SELECT o_orderpriority AS g, o_custkey AS u, o_totalprice AS s FROM orders), n AS (SELECT *, count(*) OVER (PARTITION BY g, u) AS k FROM r), t AS (SELECT g, count(DISTINCT u) AS units FROM r GROUP BY 1),
w AS (SELECT n.g, s, sum(1.0::double / (units * k)) AS w FROM n JOIN t ON t.g = n.g GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM w)
SELECT g AS o_orderpriority, min(CASE WHEN cw >= 0.9::double - 1e-9::double THEN s END) AS q FROM c GROUP BY 1""")
def room_equal_quantile(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.unit_equal_quantile(orders(spark, d), ["o_orderpriority"], "o_custkey", "o_totalprice", 0.9)


@query("""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(1.4826::double * median(abs(l_extendedprice - m)), 6) AS sigma FROM lineitem JOIN m USING (l_returnflag) GROUP BY 1""")
def robust_mad(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.robust_sigma(lineitem(spark, d), ["l_returnflag"], "l_extendedprice").select("l_returnflag", F.round("sigma", 6).alias("sigma"))


@query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.005), 8) AS p_lo, round(quantile_cont(l_extendedprice, 0.5), 8) AS p_mid, round(quantile_cont(l_extendedprice, 0.995), 8) AS p_hi FROM lineitem GROUP BY 1, 2""")
def percentile_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = quantiles.percentiles(lineitem(spark, d), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p_lo": 0.005, "p_mid": 0.5, "p_hi": 0.995})
    return p.select("l_returnflag", "l_linestatus", *(F.round(c, 8).alias(c) for c in ("p_lo", "p_mid", "p_hi")))


_TRIM_ROUND = """i{n} AS (SELECT x.g, x.x, s.c, s.win FROM x JOIN s{p} s ON s.g = x.g WHERE abs(x.x - s.c) < s.win),
m{n} AS (SELECT g, count(*) AS k, avg(x) AS c FROM i{n} GROUP BY 1 HAVING count(*) >= 3),
d{n} AS (SELECT i.g, abs(i.x - m.c) AS r, count(*)::double AS w FROM i{n} i JOIN m{n} m ON m.g = i.g GROUP BY 1, 2),
w{n} AS (SELECT g, r, sum(w) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER (PARTITION BY g) AS t FROM d{n}),
q{n} AS (SELECT g, min(CASE WHEN cw >= 0.5::double * t THEN r END) AS s FROM w{n} GROUP BY 1),
s{n} AS (SELECT s.g, coalesce(m.c, s.c) AS c, coalesce(least(greatest(2.5::double * 1.4826::double * q.s, 0.5::double), 20::double), s.win) AS win FROM s{p} s LEFT JOIN m{n} m ON m.g = s.g LEFT JOIN q{n} q ON q.g = s.g)"""


@query("WITH x AS (SELECT l_suppkey AS g, l_quantity::double AS x FROM lineitem), s0 AS (SELECT g, 25::double AS c, 15::double AS win FROM x GROUP BY 1), " + ", ".join(_TRIM_ROUND.format(n=n, p=n - 1) for n in (1, 2, 3)) + " SELECT g AS l_suppkey, round(c, 6) AS c, round(win, 6) AS win FROM s3")
def trimmed_mean_unrolled(spark: SparkSession, d: str) -> DataFrame:
    own = lineitem(spark, d).select("l_suppkey", F.col("l_quantity").cast("double").alias("x"), F.lit(1.0).alias("w"), F.lit(25.0).alias("start"))
    t = quantiles.trimmed_mean(own, ["l_suppkey"], "x", "w", "start", 15.0, rounds=3, low=0.5, high=20.0)
    return t.select("l_suppkey", F.round("c", 6).alias("c"), F.round("win", 6).alias("win"))


@query("""SELECT user_id, date_trunc('hour', ts)::timestamp AS slot, arg_max(event_id, (value, -event_id)) AS event_id, arg_max(value, (value, -event_id)) AS value FROM events GROUP BY 1, 2""")
def slot_argmax(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return windows.slot_best(e, ["user_id"], F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"), "value", "event_id", ["event_id", "value"])


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, value FROM events), n AS (SELECT *, coalesce((t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 1800000000)::int, 0) AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM n)
SELECT user_id, session::bigint AS session, min(t) AS first_us, max(t) AS last_us, count(*) AS n, round(sum(value), 6) AS value FROM s GROUP BY 1, 2""")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = windows.sessions(events(spark, d), ["user_id"], F.col("t_us"), 1_800_000_000, "event_id")
    return s.groupBy("user_id", "session").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("value"))


@query("""WITH r AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM lineitem)
SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS n FROM r GROUP BY l_orderkey, l_returnflag, run""")
def run_islands(spark: SparkSession, d: str) -> DataFrame:
    return windows.islands(lineitem(spark, d), ["l_orderkey"], "l_linenumber", "l_returnflag")


@query("""SELECT o_custkey, o_orderkey, coalesce(lag(o_totalprice) OVER w, last_value(o_totalprice) OVER f) AS previous, coalesce(lead(o_totalprice) OVER w, first_value(o_totalprice) OVER f) AS next FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def cyclic_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return windows.cyclic_neighbours(orders(spark, d), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "previous", "next")


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), k AS (SELECT DISTINCT user_id, n, j.k FROM n, generate_series(0, 7) j(k) WHERE n > 8),
t AS (SELECT DISTINCT user_id, round_even(k * (n - 1) / 7.0::double, 0)::bigint AS i FROM k) SELECT n.user_id, event_id FROM n LEFT JOIN t ON t.user_id = n.user_id AND t.i = n.i WHERE n.n <= 8 OR t.i IS NOT NULL""")
def even_subsample(spark: SparkSession, d: str) -> DataFrame:
    return windows.even_subsample(events(spark, d), ["user_id"], ["t_us", "event_id"], 8).select("user_id", "event_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::double AS t, value FROM events), w AS (SELECT *, coalesce(lag(value) OVER o, value) AS v0, coalesce(lead(value) OVER o, value) AS v1, coalesce(lag(t) OVER o, t) AS t0, coalesce(lead(t) OVER o, t) AS t1 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, event_id, round(CASE WHEN t1 > t0 THEN sqrt((v1 - v0) * (v1 - v0)) / (t1 - t0) ELSE 0 END, 9) AS speed FROM w""")
def motion_scores(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d).withColumn("t", F.col("t_us") / 1e6)
    return windows.motion_score(e, ["user_id"], "t", ["value"]).select("user_id", "event_id", F.round("speed", 9).alias("speed"))


@query("""WITH p AS (SELECT p_size AS g, p_partkey, p_retailprice AS x, 1.0::double + p_partkey % 3 AS w FROM part), n AS (SELECT *, coalesce((x - lag(x) OVER (PARTITION BY g ORDER BY x, p_partkey) > 5)::int, 0) AS new FROM p), s AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY x, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM n)
SELECT g AS p_size, grp::bigint AS "group", round(sum(x * w) / sum(w), 6) AS p_retailprice, round(sum(w), 6) AS w FROM s GROUP BY 1, 2""")
def merge_close_values(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part").withColumn("w", 1.0 + F.col("p_partkey") % 3)
    m = windows.merge_close(p, ["p_size"], "p_retailprice", "w", 5.0, "p_partkey")
    return m.select("p_size", "group", F.round("p_retailprice", 6).alias("p_retailprice"), F.round("w", 6).alias("w"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events), c AS (SELECT n.*, j.c FROM n, generate_series(0, (SELECT max(n) // 19 FROM n)) j(c) WHERE j.c * 19 <= i AND j.c <= greatest(ceil((n - 24) / 19.0), 0) AND i < j.c * 19 + 24),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, i ORDER BY least(i - c * 19, least(c * 19 + 24, n) - 1 - i) DESC, c) AS k FROM c) SELECT user_id, event_id, c::int AS chunk FROM r WHERE k = 1""")
def chunk_ownership(spark: SparkSession, d: str) -> DataFrame:
    return windows.owned_chunks(events(spark, d), ["user_id"], "event_id", 24, 5)


@query("""SELECT e.event_id, e.user_id, l.event_id AS login_id, l.value AS login_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') l ON e.user_id = l.user_id AND e.ts >= l.ts""")
def asof_last_event(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    hit = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "t_us"), e.where("event_type = 'click'"), ["user_id"], "t_us", ["event_id", "value"], tie="event_id", prefix="login_", bucket=86_400e6)
    return hit.select("event_id", "user_id", F.col("login_event_id").alias("login_id"), "login_value")


@query("""WITH a AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'view') SELECT a.user_id, a.event_id AS a_id, b.event_id AS b_id FROM a JOIN b ON a.user_id = b.user_id AND abs(a.value - b.value) <= 2.0::double""")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("a_id"), F.col("value").alias("av"))
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b_id"), F.col("value").alias("bv"))
    return joins.band_join(a, b, ["user_id"], "av", 2.0, "bv").select("user_id", "a_id", "b_id")


@query(f"""WITH {POINTS_SQL}, p AS (SELECT a.point_id, b.point_id AS other, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM points a JOIN points b ON a.label <> b.label AND a.point_id <> b.point_id), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, other) AS n FROM p WHERE d <= 0.15::double)
SELECT point_id, other, round(d, 9) AS distance FROM r WHERE n = 1""")
def nearest_neighbour_k1(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).select("point_id", "label", "x", "y", "z")
    return joins.nearest_of_other(p, 0.15, ["x", "y", "z"], "point_id", "label").select("point_id", "other", F.round("distance", 9).alias("distance"))


@query(f"""WITH {SPANS_SQL} SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, round((least(a.hi, b.hi) - greatest(a.lo, b.lo)) / ((a.hi - a.lo) + (b.hi - b.lo) - (least(a.hi, b.hi) - greatest(a.lo, b.lo))), 9) AS iou
FROM spans a JOIN spans b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND least(a.hi, b.hi) > greatest(a.lo, b.lo)""")
def interval_iou_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    a = s.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("lo").alias("a0"), F.col("hi").alias("a1"))
    b = s.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("lo").alias("b0"), F.col("hi").alias("b1"))
    pairs = joins.overlapping(a, b, ["o_custkey"], ("a0", "a1"), ("b0", "b1"), 64.0).where("a < b").withColumn("i", joins.overlap(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1")))
    return pairs.select("o_custkey", "a", "b", F.round(F.col("i") / ((F.col("a1") - F.col("a0")) + (F.col("b1") - F.col("b0")) - F.col("i")), 9).alias("iou"))


_BOXES_SQL = f"""{SPANS_SQL}, boxes AS (SELECT o_custkey AS view_id, o_orderkey AS box_id, o_orderpriority AS cls, o_totalprice AS score, lo AS x0, hi AS x1, 0.0::double AS y0, 1.0::double + o_orderkey % 3 AS y1 FROM spans),
m AS (SELECT a.*, b.box_id AS other, b.score AS o_score, b.cls AS o_cls, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS inter, (a.x1 - a.x0) * (a.y1 - a.y0) AS area, (b.x1 - b.x0) * (b.y1 - b.y0) AS o_area FROM boxes a JOIN boxes b ON a.view_id = b.view_id)"""


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    return s.select(F.col("o_custkey").alias("view_id"), F.col("o_orderkey").alias("box_id"), F.col("o_orderpriority").alias("cls"), F.col("o_totalprice").alias("score"), F.col("lo").alias("x0"), F.col("hi").alias("x1"), F.lit(0.0).alias("y0"), (1.0 + F.col("o_orderkey") % 3).alias("y1"))


@query(f"""WITH {_BOXES_SQL} SELECT view_id, box_id FROM boxes WHERE cls = '1-URGENT' AND box_id NOT IN (SELECT box_id FROM m WHERE cls = '1-URGENT' AND o_cls <> '1-URGENT' AND o_score >= score - 1000 AND area + o_area - inter > 0 AND inter / (area + o_area - inter) >= 0.2::double)""")
def lookalike_anti(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return joins.drop_lookalikes(b.where("cls = '1-URGENT'"), b.where("cls <> '1-URGENT'"), 0.2, 1000.0).select("view_id", "box_id")


@query(f"""WITH {_BOXES_SQL} SELECT view_id, box_id FROM boxes WHERE cls <> '2-HIGH' AND box_id NOT IN (SELECT box_id FROM m WHERE o_cls = '2-HIGH' AND o_score >= 50000 AND area > 0 AND inter / area >= 0.5::double)""")
def contain_anti(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return joins.drop_inside(b.where("cls <> '2-HIGH'"), b.where("cls = '2-HIGH'"), 0.5, 50_000.0).select("view_id", "box_id")


@query(f"""WITH {_BOXES_SQL}, f AS (SELECT * FROM boxes WHERE box_id % 2 = 0), t AS (SELECT * FROM boxes WHERE box_id % 2 = 1) SELECT view_id, box_id FROM f UNION ALL SELECT view_id, box_id FROM t WHERE box_id NOT IN (SELECT box_id FROM m WHERE box_id % 2 = 1 AND other % 2 = 0 AND cls = o_cls AND ((area + o_area - inter > 0 AND inter / (area + o_area - inter) >= 0.3::double) OR (area > 0 AND inter / area >= 0.6::double)))""")
def tile_union(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return joins.add_uncovered(b.where("box_id % 2 = 0"), b.where("box_id % 2 = 1"), 0.3, 0.6).select("view_id", "box_id")


@query("""SELECT l_returnflag, round(atan2(sum(l_quantity * sin(4 * a)), sum(l_quantity * cos(4 * a))) / 4, 6) AS theta, round(sqrt(pow(sum(l_quantity * sin(4 * a)), 2) + pow(sum(l_quantity * cos(4 * a)), 2)) / sum(l_quantity), 6) AS concentration FROM (SELECT *, l_discount * 10 AS a FROM lineitem) GROUP BY 1""")
def circular_direction(spark: SparkSession, d: str) -> DataFrame:
    m = shapes.manhattan_angle(lineitem(spark, d).withColumn("a", F.col("l_discount") * 10), ["l_returnflag"], "a", "l_quantity")
    return m.select("l_returnflag", F.round("theta", 6).alias("theta"), F.round("concentration", 6).alias("concentration"))


@query(f"""WITH RECURSIVE {POINTS_SQL}, s(k, label, ux, uy, uz) AS (SELECT 0, label, 0::double, 0::double, 1::double FROM (SELECT DISTINCT label FROM points) UNION ALL
SELECT k + 1, label, sx / n, sy / n, sz / n FROM (SELECT k, label, sx, sy, sz, sqrt(sx*sx+sy*sy+sz*sz) AS n FROM (SELECT s.k, s.label, sum(sign(p.nx*ux+p.ny*uy+p.nz*uz)*w*p.nx) AS sx, sum(sign(p.nx*ux+p.ny*uy+p.nz*uz)*w*p.ny) AS sy, sum(sign(p.nx*ux+p.ny*uy+p.nz*uz)*w*p.nz) AS sz FROM s JOIN points p ON p.label = s.label WHERE k < 3 AND abs(p.nx*ux+p.ny*uy+p.nz*uz) >= {math.cos(math.radians(85.0))!r}::double GROUP BY s.k, s.label)))
SELECT label, round(ux, 6) AS ux, round(uy, 6) AS uy, round(uz, 6) AS uz FROM s WHERE k = 3""")
def up_direction(spark: SparkSession, d: str) -> DataFrame:
    u = shapes.up_direction(points(spark, d), ["label"], max_degrees=85.0)
    return u.select("label", *(F.round(c, 6).alias(c) for c in ("ux", "uy", "uz")))


@query("""WITH v AS (SELECT o_custkey, o_orderkey, datediff('day', DATE '1992-01-01', o_orderdate::date)::double AS x, floor(o_totalprice / 1000) AS y FROM orders), r AS (SELECT o_custkey, x, y, coalesce(lead(x) OVER w, first_value(x) OVER f) AS x1, coalesce(lead(y) OVER w, first_value(y) OVER f) AS y1 FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey), f AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT o_custkey, sum(x * y1 - x1 * y) / 2 AS area, round(sum(sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y))), 6) AS perimeter, count(*) AS n FROM r GROUP BY 1""")
def ring_area(spark: SparkSession, d: str) -> DataFrame:
    o = order_spans(spark, d).withColumn("y", F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return shapes.ring_measures(o, ["o_custkey"], "o_orderkey", "lo", "y").select("o_custkey", "area", F.round("perimeter", 6).alias("perimeter"), "n")


@query(f"""WITH {SPANS_SQL}, r AS (SELECT *, max(hi) OVER (PARTITION BY o_custkey ORDER BY lo, hi, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans WHERE hi > lo)
SELECT o_custkey, sum(CASE WHEN reach IS NULL OR lo > reach THEN hi - lo ELSE greatest(hi - reach, 0) END) AS length, sum((reach IS NULL OR lo > reach)::bigint)::bigint AS pieces FROM r GROUP BY 1""")
def interval_union_length(spark: SparkSession, d: str) -> DataFrame:
    return shapes.union_length(order_spans(spark, d), ["o_custkey"], "lo", "hi")


@query(f"""WITH {_BOXES_SQL}, b AS (SELECT * FROM boxes WHERE x1 > x0), c AS (SELECT DISTINCT view_id, s0 FROM (SELECT view_id, x0 AS s0 FROM b UNION ALL SELECT view_id, x1 FROM b)), s AS (SELECT view_id, s0, lead(s0) OVER (PARTITION BY view_id ORDER BY s0) AS s1 FROM c),
k AS (SELECT s.view_id, s0, s1, max(y1) AS top FROM s JOIN b ON b.view_id = s.view_id AND b.x0 <= s0 AND b.x1 >= s1 WHERE s1 IS NOT NULL GROUP BY 1, 2, 3) SELECT view_id, sum((s1 - s0) * top) AS area FROM k GROUP BY 1""")
def box_union_area(spark: SparkSession, d: str) -> DataFrame:
    return shapes.union_area(_boxes(spark, d), ["view_id"])


@query("""WITH r AS (SELECT user_id, event_type, least(greatest(value / 200, 0), 1 - 1e-12::double) AS s, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_type, round(1 - exp(sum(ln(1 - s))), 6) AS score, count(*) AS n FROM r WHERE n <= 3 GROUP BY 1, 2""")
def noisy_or_top3(spark: SparkSession, d: str) -> DataFrame:
    s = shapes.noisy_or(events(spark, d).withColumn("s", F.col("value") / 200), ["user_id", "event_type"], "s", 3, "event_id")
    return s.select("user_id", "event_type", F.round("score", 6).alias("score"), "n")


@query("""WITH c AS (SELECT s_nationkey, ln(1 + abs(s_acctbal)) AS m, CASE WHEN s_suppkey % 17 = 0 THEN 0.0::double ELSE 0.1::double * (1 + s_suppkey % 5) END AS sigma FROM supplier)
SELECT s_nationkey, round(coalesce(avg(CASE WHEN sigma <= 0 THEN m END), sum(CASE WHEN sigma > 0 THEN m / (sigma * sigma) END) / sum(CASE WHEN sigma > 0 THEN 1 / (sigma * sigma) END)), 6) AS log_scale, round(CASE WHEN count(CASE WHEN sigma <= 0 THEN 1 END) > 0 THEN 0 ELSE 1 / sqrt(sum(CASE WHEN sigma > 0 THEN 1 / (sigma * sigma) END)) END, 6) AS sigma FROM c GROUP BY 1""")
def scale_fusion(spark: SparkSession, d: str) -> DataFrame:
    cues = read_table(spark, d, "supplier").select("s_nationkey", F.log(1 + F.abs("s_acctbal")).alias("log_scale"), F.when(F.col("s_suppkey") % 17 == 0, 0.0).otherwise(0.1 * (1 + F.col("s_suppkey") % 5)).alias("sigma"))
    return shapes.fuse_scale(cues, ["s_nationkey"]).select("s_nationkey", F.round("log_scale", 6).alias("log_scale"), F.round("sigma", 6).alias("sigma"))


@query(f"""WITH {POINTS_SQL}, r AS (SELECT point_id AS ray, x AS ex, y AS ey, z AS ez, sqrt((x-0.6::double)*(x-0.6::double)+(y-0.6::double)*(y-0.6::double)+(z-0.6::double)*(z-0.6::double)) AS span FROM points), s AS (SELECT ray, k.k, CASE WHEN span > 0 THEN k.k * 0.05::double / span ELSE 0 END AS t, ex, ey, ez FROM r, generate_series(0, 400) k(k) WHERE k.k <= floor(span / 0.05::double)),
c AS (SELECT ray, k, floor((0.6::double + (ex - 0.6::double) * t) / 0.1::double)::bigint AS ix, floor((0.6::double + (ey - 0.6::double) * t) / 0.1::double)::bigint AS iy, floor((0.6::double + (ez - 0.6::double) * t) / 0.1::double)::bigint AS iz FROM s),
o AS (SELECT floor(x / 0.1::double)::bigint AS ix, floor(y / 0.1::double)::bigint AS iy, floor(z / 0.1::double)::bigint AS iz FROM points GROUP BY 1, 2, 3 HAVING count(*) >= 2), h AS (SELECT ray, min(k) AS stop FROM c JOIN o USING (ix, iy, iz) GROUP BY 1)
SELECT ix, iy, count(DISTINCT c.ray) AS rays FROM c LEFT JOIN h ON h.ray = c.ray WHERE stop IS NULL OR k < stop GROUP BY 1, 2""")
def ray_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    rays = p.select(F.col("point_id").alias("ray"), F.lit(0.6).alias("ox"), F.lit(0.6).alias("oy"), F.lit(0.6).alias("oz"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"))
    return joins.free_cells(rays, bins.occupied(p, 0.1, 2), 0.05, 0.1)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_custkey * 7 + 3) % (SELECT max(c_custkey) FROM customer) AS b FROM orders), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), r(n, m) AS (SELECT a, a FROM g UNION SELECT r.n, g.b FROM r JOIN g ON g.a = r.m) SELECT n AS node, min(m) AS component FROM r GROUP BY 1""")
def components_min_label(spark: SparkSession, d: str) -> DataFrame:
    top = read_table(spark, d, "customer").agg(F.max("c_custkey").alias("top"))
    edges = orders(spark, d).join(F.broadcast(top)).select(F.col("o_custkey").alias("a"), ((F.col("o_custkey") * 7 + 3) % F.col("top")).alias("b"))
    return graph.components(edges)


@query("""WITH k AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, list_aggregate(list_transform(regexp_extract_all(lower(url), '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END, 20, '0') ELSE r END), 'string_agg', '') AS key FROM pages)
SELECT page_id, row_number() OVER (PARTITION BY host ORDER BY key, url, page_id)::int AS place FROM k""")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return p.select("page_id", F.row_number().over(Window.partitionBy("host").orderBy(natural_key(F.col("url")), "url", "page_id")).alias("place"))
