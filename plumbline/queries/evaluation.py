"""Gates, coverage, calibration, matching, sets, rules and cleaning over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.binomial import clopper_pearson
from plumbline.functions.columns import clean_number, parse_quantity
from plumbline.kernels import assignment, greedy
from plumbline.operators import bins, posegraph, registration, shapes, windows
from plumbline.plans import evaluation as ev
from plumbline.session import materialize, read_table

from .tables import SPANS_SQL, events, lineitem, order_spans, orders, points

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# orders as measured items: the price is the truth, and some orders were not measured
_PAIRS_SQL = """pairs AS (SELECT o_orderstatus AS tier, o_orderpriority AS kind, o_custkey AS room, o_orderkey AS item, o_totalprice AS gt, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice * (1 + ((o_orderkey % 21) - 10) / 500.0::double) END AS pred, o_totalprice * (0.002::double + 0.001::double * (o_orderkey % 17)) AS half FROM orders),
scored AS (SELECT tier, kind, room, item, gt, pred, pred - half AS lo, pred + half AS hi, pred - gt AS err, abs(pred - gt) AS abs_err, (pred - half - 1e-9::double <= gt AND gt <= pred + half + 1e-9::double) AS covered, ((pred + half) - (pred - half)) / 2 AS half_width,
 CASE WHEN pred - gt < 0 THEN (pred + half) - pred ELSE pred - (pred - half) END AS width FROM pairs WHERE pred IS NOT NULL),
records AS (SELECT *, CASE WHEN width > 0 THEN abs_err / width WHEN err = 0 THEN 0 ELSE 'inf'::double END AS score FROM scored)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d)
    pred = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_totalprice") * (1 + ((F.col("o_orderkey") % 21) - 10) / 500.0))
    half = F.col("o_totalprice") * (0.002 + 0.001 * (F.col("o_orderkey") % 17))
    return o.select(
        F.col("o_orderstatus").alias("tier"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("room"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("gt"), pred.alias("pred"), (pred - half).alias("lo"), (pred + half).alias("hi")
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    return ev.score(_pairs(spark, d), ["tier", "kind", "room", "item"])


@query(f"""WITH {_PAIRS_SQL}, i AS (SELECT tier, item, pred - gt AS err, greatest(500::double, 0.01::double * abs(gt)) AS allowed FROM pairs), r AS (SELECT *, abs(err) / allowed AS ratio, coalesce(abs(err) / allowed <= 1, false) AS ok FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ok, err IS NOT NULL, ratio DESC NULLS LAST, item) AS k FROM r)
SELECT tier, count(*) AS n, sum(ok::bigint)::bigint AS n_pass, sum((err IS NULL)::bigint)::bigint AS n_missing, round(max(ratio), 9) AS worst_ratio, string_agg(item::varchar, ',' ORDER BY k) FILTER (k <= 5 AND (NOT ok OR k = 1)) AS worst, CASE WHEN bool_and(ok) THEN 'pass' ELSE 'fail' END AS status,
round(CASE WHEN bool_and(ok) THEN 0 ELSE greatest(greatest(coalesce(max(ratio), 0), CASE WHEN sum((err IS NULL)::int) > 0 THEN 2 ELSE 0 END) - 1, 0) END, 9) AS score FROM n GROUP BY 1""")
def tolerance_gate(spark: SparkSession, d: str) -> DataFrame:
    items = _pairs(spark, d).select("tier", "item", "gt", (F.col("pred") - F.col("gt")).alias("err"))
    g = ev.error_gate(items, ["tier"], "item", ev.threshold(F.col("gt"), 500.0, 0.01))
    return g.select("tier", "n", "n_pass", "n_missing", F.round("worst_ratio", 9).alias("worst_ratio"), F.array_join(F.transform("worst", lambda w: w["item"].cast("string")), ",").alias("worst"), "status", F.round("score", 9).alias("score"))


@query(f"""WITH {_PAIRS_SQL}, i AS (SELECT kind, CASE WHEN pred IS NULL THEN 'missed' WHEN item % 50 = 1 THEN 'phantom' ELSE 'matched' END AS status, pred - gt AS err, 0.02::double * gt AS allowed FROM pairs), g AS (SELECT kind, count(*) AS n, sum(coalesce(status = 'matched' AND abs(err) <= allowed + 1e-12::double, false)::bigint)::bigint AS n_pass, sum((status = 'missed')::bigint)::bigint AS n_missed, sum((status = 'phantom')::bigint)::bigint AS n_phantom FROM i GROUP BY 1)
SELECT kind, n, n_pass, n_missed, n_phantom, round(n_pass / n, 9) AS rate, CASE WHEN n_pass / n >= 0.85::double - 1e-12::double THEN 'pass' ELSE 'fail' END AS verdict, round(CASE WHEN n_pass / n >= 0.85::double - 1e-12::double THEN 0 ELSE (0.85::double - n_pass / n) / 0.85::double END, 9) AS score FROM g""")
def rate_gate(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    status = F.when(F.col("pred").isNull(), "missed").when(F.col("item") % 50 == 1, "phantom").otherwise("matched")
    g = ev.rate_gate(p.select("kind", status.alias("status"), (F.col("pred") - F.col("gt")).alias("err"), (0.02 * F.col("gt")).alias("allowed")), ["kind"], 0.85)
    return g.select("kind", "n", "n_pass", "n_missed", "n_phantom", F.round("rate", 9).alias("rate"), "verdict", F.round("score", 9).alias("score"))


@query(f"""WITH {_PAIRS_SQL}, g AS (SELECT kind, count(*) AS n, sum((gt < 400000)::bigint)::bigint AS n_pass, array_to_string(list_slice(list_sort(list(item) FILTER (NOT gt < 400000)), 1, 5), ',') AS worst FROM pairs GROUP BY 1) SELECT kind, n, n_pass, coalesce(worst, '') AS worst, CASE WHEN n = n_pass THEN 'pass' ELSE 'fail' END AS verdict FROM g""")
def check_gate(spark: SparkSession, d: str) -> DataFrame:
    g = ev.check_gate(_pairs(spark, d).select("kind", "item", (F.col("gt") < 400_000).alias("ok")), ["kind"], "item")
    return g.select("kind", "n", "n_pass", F.array_join(F.transform("worst", lambda w: w.cast("string")), ",").alias("worst"), "verdict")


@query(f"""WITH {_PAIRS_SQL} SELECT tier, kind, count(*) AS n, sum(covered::bigint)::bigint AS n_covered, round(avg(half_width), 4) AS mean_half_width, round(avg(abs_err), 4) AS mean_abs_err, count(DISTINCT room) AS rooms, sum((NOT covered AND abs_err > 2 * half_width)::bigint)::bigint AS garbage FROM records GROUP BY GROUPING SETS ((tier), (tier, kind))""")
def coverage_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = ev.coverage(_records(spark, d), "tier", "kind", "room")
    return c.select("tier", "kind", "n", "n_covered", F.round("mean_half_width", 4).alias("mean_half_width"), F.round("mean_abs_err", 4).alias("mean_abs_err"), "rooms", "garbage")


_ROOM_Q = """n AS (SELECT *, count(*) OVER (PARTITION BY {g}, u) AS k FROM {r}), t AS (SELECT {g}, count(DISTINCT u) AS units FROM {r} GROUP BY {g}), w AS (SELECT {gn}, n.s, sum(1.0::double / (units * k)) AS w FROM n JOIN t USING ({g}) GROUP BY {gn}, n.s), c AS (SELECT *, sum(w) OVER (PARTITION BY {g} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw FROM w)"""


@query(f"""WITH {_PAIRS_SQL}, r AS (SELECT kind AS g, room AS u, score AS s FROM records), {_ROOM_Q.format(g="g", gn="g", r="r")}, m AS (SELECT g, max(s) AS top FROM r GROUP BY 1)
SELECT c.g AS kind, any_value(t.units) AS rooms, round(coalesce(min(CASE WHEN cw >= 0.9::double - 1e-9::double THEN s END), any_value(m.top)), 9) AS empirical, round(CASE WHEN ceil((any_value(t.units) + 1) * 0.9::double - 1e-9::double) / any_value(t.units) > 1 THEN 'inf'::double ELSE coalesce(min(CASE WHEN cw >= ceil((t.units + 1) * 0.9::double - 1e-9::double) / t.units - 1e-9::double THEN s END), any_value(m.top)) END, 9) AS conformal FROM c JOIN t ON t.g = c.g JOIN m ON m.g = c.g GROUP BY 1""")
def conformal_q(spark: SparkSession, d: str) -> DataFrame:
    f = ev.conformal_fit(_records(spark, d), "kind", "room")
    return f.select("kind", "rooms", F.round("empirical", 9).alias("empirical"), F.round("conformal", 9).alias("conformal"))


@query(f"""WITH {_PAIRS_SQL}, rec AS (SELECT r.tier, c.c_nationkey AS u, score AS s FROM records r JOIN customer c ON c.c_custkey = r.room), rooms AS (SELECT DISTINCT tier, u FROM rec), cnt AS (SELECT tier, count(*) AS rooms FROM rooms GROUP BY 1),
tr AS (SELECT rec.tier || '/' || o.u AS g, rec.tier, o.u AS out_u, rec.u, s FROM rec JOIN rooms o ON o.tier = rec.tier AND o.u <> rec.u JOIN cnt ON cnt.tier = rec.tier WHERE cnt.rooms - 1 >= 9), {_ROOM_Q.format(g="g", gn="g", r="tr")}, mx AS (SELECT g, any_value(tier) AS tier, any_value(out_u) AS u, max(s) AS top FROM tr GROUP BY 1),
f AS (SELECT any_value(mx.tier) AS tier, any_value(mx.u) AS u, CASE WHEN any_value(ceil((t.units + 1) * 0.9::double - 1e-9::double) / t.units) > 1 THEN 'inf'::double ELSE coalesce(min(CASE WHEN cw >= ceil((t.units + 1) * 0.9::double - 1e-9::double) / t.units - 1e-9::double THEN s END), any_value(mx.top)) END AS q FROM c JOIN t ON t.g = c.g JOIN mx ON mx.g = c.g GROUP BY c.g)
SELECT rec.tier, any_value(cnt.rooms) AS rooms, count(*) AS n, sum((s <= coalesce(greatest(f.q, 0.2::double), 1))::bigint)::bigint AS n_covered, round(sum((s <= coalesce(greatest(f.q, 0.2::double), 1))::int) / count(*), 9) AS coverage FROM rec JOIN cnt ON cnt.tier = rec.tier LEFT JOIN f ON f.tier = rec.tier AND f.u = rec.u GROUP BY 1""")
def loro_coverage(spark: SparkSession, d: str) -> DataFrame:
    nation = read_table(spark, d, "customer").select(F.col("c_custkey").alias("room"), F.col("c_nationkey").alias("nation"))
    r = _records(spark, d).join(nation, "room").select("tier", "nation", "score")
    c = ev.leave_one_room_out(r, "tier", "nation")
    return c.select("tier", "rooms", "n", "n_covered", F.round("coverage", 9).alias("coverage"))


@query("""WITH v AS (SELECT l_partkey AS wall, l_suppkey AS capture, avg(l_extendedprice / l_quantity) AS x FROM lineitem GROUP BY 1, 2), p AS (SELECT a.wall, a.capture AS capture_a, b.capture AS capture_b, abs(a.x - b.x) AS delta, p_retailprice AS gt FROM v a JOIN v b ON a.wall = b.wall AND a.capture < b.capture JOIN part ON p_partkey = a.wall)
SELECT wall, capture_a, capture_b, round(delta, 6) AS delta, delta <= greatest(20::double, 0.02::double * gt) + 1e-9::double AS pass, delta <= least(20::double, 0.02::double * gt) + 1e-9::double AS strict_pass FROM p""")
def repeat_pairs(spark: SparkSession, d: str) -> DataFrame:
    v = lineitem(spark, d).groupBy(F.col("l_partkey").alias("wall"), F.col("l_suppkey").alias("capture")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    v = v.join(read_table(spark, d, "part").select(F.col("p_partkey").alias("wall"), F.col("p_retailprice").alias("gt")), "wall")
    p = ev.repeat_pairs(v, ["wall"], "capture", "x", "gt", 20.0, 0.02)
    return p.select("wall", "capture_a", "capture_b", F.round("delta", 6).alias("delta"), "pass", "strict_pass")


@query("""WITH s AS (SELECT l_suppkey AS capture, l_linestatus AS mode, avg(l_discount - 0.05::double) AS err, max(abs(l_discount - 0.05::double)) AS worst FROM lineitem GROUP BY 1, 2)
SELECT a.capture, round(a.err, 9) AS err, round(b.err, 9) AS off_err, round(abs(b.err) - abs(a.err), 9) AS gain_err, round(abs(b.worst) - abs(a.worst), 9) AS gain_worst FROM s a JOIN s b ON a.capture = b.capture AND a.mode = 'O' AND b.mode = 'F'""")
def ablation_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = lineitem(spark, d).groupBy(F.col("l_suppkey").alias("capture"), "l_linestatus").agg(F.avg(F.col("l_discount") - 0.05).alias("err"), F.max(F.abs(F.col("l_discount") - 0.05)).alias("worst"))
    a = ev.ablation(s.where("l_linestatus = 'O'").drop("l_linestatus"), s.where("l_linestatus = 'F'").drop("l_linestatus"), ["capture"], ["err", "worst"])
    return a.select("capture", *(F.round(c, 9).alias(c) for c in ("err", "off_err", "gain_err", "gain_worst")))


@query("""WITH w AS (SELECT l_returnflag, l_linestatus, l_extendedprice * (l_discount - 0.05::double) AS err, l_extendedprice AS gt FROM lineitem) SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(err)), 4) AS mean_abs_err, round(max(abs(err)), 4) AS max_abs_err, round(sqrt(avg(err * err)), 4) AS rms_err, round(avg((abs(err) <= greatest(100::double, 0.02::double * gt) + 1e-12::double)::int::double), 9) AS pass_share FROM w GROUP BY 1, 2""")
def wall_stats(spark: SparkSession, d: str) -> DataFrame:
    w = lineitem(spark, d).select("l_returnflag", "l_linestatus", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("err"), F.col("l_extendedprice").alias("gt"))
    s = ev.wall_stats(w, ["l_returnflag", "l_linestatus"], ev.threshold(F.col("gt"), 100.0, 0.02))
    return s.select("l_returnflag", "l_linestatus", "n", *(F.round(c, 4).alias(c) for c in ("mean_abs_err", "max_abs_err", "rms_err")), F.round("pass_share", 9).alias("pass_share"))


@query("""WITH a AS (SELECT doc_id, CASE quality WHEN 1 THEN 'pass' ELSE 'fail' END AS before FROM labels), b AS (SELECT doc_id, CASE WHEN n_chars > 1000 THEN 'pass' ELSE 'fail' END AS after FROM documents)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, before, after, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' WHEN before = after THEN 'same' WHEN before = 'fail' AND after = 'pass' THEN 'fixed' WHEN before = 'pass' AND after = 'fail' THEN 'broken' ELSE 'changed' END AS change FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def status_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status"))
    b = read_table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, "pass").otherwise("fail").alias("status"))
    return ev.status_change(a, b, ["doc_id"])


@query("""WITH gt AS (SELECT DISTINCT least(n_nationkey, (n_nationkey * 3 + 1) % 25) AS a, greatest(n_nationkey, (n_nationkey * 3 + 1) % 25) AS b FROM nation WHERE n_nationkey <> (n_nationkey * 3 + 1) % 25), pr AS (SELECT DISTINCT l_suppkey % 40 AS a, (l_suppkey * 3 + 1 + l_partkey % 2) % 25 AS b FROM lineitem),
m AS (SELECT DISTINCT CASE WHEN a < 25 AND b < 25 THEN least(a, b) END AS a, CASE WHEN a < 25 AND b < 25 THEN greatest(a, b) END AS b, least(a, b) AS ra, greatest(a, b) AS rb FROM pr WHERE a <> b), mm AS (SELECT DISTINCT a, b FROM m WHERE a IS NOT NULL)
SELECT a::bigint AS room_a, b::bigint AS room_b, 'correct' AS status FROM (SELECT * FROM gt INTERSECT SELECT * FROM mm) UNION ALL SELECT a, b, 'missing' FROM (SELECT * FROM gt EXCEPT SELECT * FROM mm) UNION ALL SELECT a, b, 'extra' FROM (SELECT * FROM mm EXCEPT SELECT * FROM gt) UNION ALL SELECT DISTINCT ra, rb, 'unmatched' FROM m WHERE a IS NULL""")
def adjacency_sets(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").withColumn("k", F.col("n_nationkey").cast("long"))
    one = F.lit(1).alias("capture_id")
    gt = n.select(one, F.col("k").alias("room_a"), ((F.col("k") * 3 + 1) % 25).alias("room_b")).where("room_a <> room_b")
    pred = lineitem(spark, d).select(one, (F.col("l_suppkey") % 40).alias("room_a"), ((F.col("l_suppkey") * 3 + 1 + F.col("l_partkey") % 2) % 25).alias("room_b"))
    mapping = n.select(one, F.col("k").alias("pred_room"), F.col("k").alias("gt_room"))
    return ev.adjacency_sets(gt, pred, mapping).select("room_a", "room_b", "status")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity - 1.645::double * 1.2::double * sqrt(pow(l_quantity * 0.02::double, 2) + pow(l_tax, 2)), 9) AS raw_lo, round(greatest(l_quantity - 1.645::double * 1.2::double * sqrt(pow(sqrt(pow(l_quantity * 0.02::double, 2) + pow(l_tax, 2)), 2)), 0), 9) AS lo, round(l_quantity + 1.645::double * 1.2::double * sqrt(pow(sqrt(pow(l_quantity * 0.02::double, 2) + pow(l_tax, 2)), 2) + pow(l_discount / 1.645::double, 2)), 9) AS hi FROM lineitem""")
def interval_quadrature(spark: SparkSession, d: str) -> DataFrame:
    sigma = shapes.quadrature(F.col("l_quantity") * 0.02, F.col("l_tax"))
    zq = 1.645 * 1.2
    iv = shapes.interval(F.col("l_quantity"), sigma, zq, up=F.col("l_discount"))
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_quantity") - zq * sigma, 9).alias("raw_lo"), F.round(iv["lo"], 9).alias("lo"), F.round(iv["hi"], 9).alias("hi"))


@query(f"""WITH {SPANS_SQL}, h AS (SELECT l_orderkey, sum(l_quantity * 0.9::double) AS lo, sum(l_quantity) AS v, sum(l_quantity * 1.1::double) AS hi FROM lineitem GROUP BY 1)
SELECT o_orderkey, round(greatest((s.hi - s.lo) * 2.4::double - coalesce(h.hi, 0), 0), 6) AS area_lo, round(greatest((s.hi - s.lo) * 2.5::double - coalesce(h.v, 0), 0), 6) AS area_value, round(greatest((s.hi - s.lo) * 2.6::double - coalesce(h.lo, 0), 0), 6) AS area_hi FROM spans s LEFT JOIN h ON h.l_orderkey = s.o_orderkey""")
def net_area_intervals(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.scope import surfaces

    s = order_spans(spark, d)
    same = lambda c, lo=1.0, hi=1.0: F.struct(c.alias("value"), (c * lo).alias("lo"), (c * hi).alias("hi"))
    walls = s.select(F.lit(1).alias("capture_id"), F.lit(1).alias("room_id"), F.col("o_orderkey").alias("wall_id"), F.lit(0).alias("k"), same(F.col("hi") - F.col("lo")).alias("length"), F.struct(F.lit(2.5).alias("value"), F.lit(2.4).alias("lo"), F.lit(2.6).alias("hi")).alias("height"))
    openings = lineitem(spark, d).select(F.lit(1).alias("capture_id"), F.col("l_orderkey").alias("wall_id"), same(F.col("l_quantity"), 0.9, 1.1).alias("width"), same(F.lit(1.0)).alias("height"))
    rooms = s.select(F.lit(1).alias("capture_id"), F.lit(1).alias("room_id"), same(F.lit(0.0)).alias("floor_area")).where("false")  # walls alone have openings
    a = surfaces(rooms, walls, openings)
    return a.select(F.col("surface_id").cast("long").alias("o_orderkey"), *(F.round(f"area_{b}", 6).alias(f"area_{b}") for b in ("lo", "value", "hi")))


@query("""WITH r AS (SELECT doc_id, md5(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END, doc_id) AS n, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS copies FROM documents) SELECT doc_id, h, copies FROM r WHERE n = 1""")
def keyed_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("rank"))
    best = docs.groupBy("h").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    return best.select("doc_id", "h", "copies")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS q, l_linenumber % 5 AS f FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE f WHEN 0 THEN q * 0.01::double WHEN 1 THEN q + 0.5::double WHEN 2 THEN q * 0.3048::double + 6 * 0.0254::double WHEN 3 THEN (q::int * 1000 + 250) * 0.001::double ELSE NULL END, 9) AS metres FROM t""")
def quantity_parse(spark: SparkSession, d: str) -> DataFrame:
    t = lineitem(spark, d)
    whole, f = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 5
    text = F.when(f == 0, F.concat(whole, F.lit(" cm"))).when(f == 1, F.concat(whole, F.lit(",5 m"))).when(f == 2, F.concat(whole, F.lit("' 6\""))).when(f == 3, F.concat(whole, F.lit(",250 mm"))).otherwise("n/a")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(parse_quantity(text), 9).alias("metres"))


@query("""WITH e AS (SELECT event_id, props, try_cast(replace(trim(json_extract_string(props, '$.k')), ',', '.') AS double) AS k FROM events) SELECT event_id, k, k IS NULL AS bad FROM e""")
def csv_clean(spark: SparkSession, d: str) -> DataFrame:
    k = clean_number(F.get_json_object("props", "$.k"))
    return events(spark, d).select("event_id", k.alias("k"), k.isNull().alias("bad"))


_FKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("labels", "doc_id", "documents", "doc_id"))
_KEYS = (("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey"), ("documents", "doc_id"))
_RANGES = (("lineitem", "l_discount", 0.0, 0.05), ("orders", "o_totalprice", 0.0, 300_000.0), ("events", "value", 0.0, 50.0))


@query(" UNION ALL ".join([f"SELECT 'fk:{a}.{c}' AS rule, count(*) AS n FROM {a} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {b} WHERE {k} IS NOT NULL)" for a, c, b, k in _FKS] + [f"SELECT 'unique:{t}.{k}', count(*) FROM (SELECT {k} FROM {t} GROUP BY 1 HAVING count(*) > 1)" for t, k in _KEYS] + [f"SELECT 'range:{t}.{c}', count(*) FROM {t} WHERE {c} < {lo}::double OR {c} > {hi}::double" for t, c, lo, hi in _RANGES]))
def violations(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.result import foreign_key, in_range, unique

    t = lambda name: read_table(spark, d, name)
    found = {f"fk:{a}.{c}": foreign_key(t(a), c, t(b), k) for a, c, b, k in _FKS}
    found |= {f"unique:{a}.{k}": unique(t(a), [k]) for a, k in _KEYS}
    found |= {f"range:{a}.{c}": in_range(t(a), c, lo, hi) for a, c, lo, hi in _RANGES}
    return reduce(DataFrame.union, [f.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("rule"), "n") for r, f in found.items()])


# parts as damage regions of a room a brand: sizes in hundredths, classes and surfaces by key
_REGIONS_SQL = """regions AS (SELECT p_brand AS room_id, p_partkey AS damage_id, p_brand || CASE p_partkey % 4 WHEN 0 THEN '-FLOOR' WHEN 1 THEN '-CEIL' ELSE '-W' || (p_partkey % 3) END AS surface_id, CASE p_partkey % 4 WHEN 0 THEN 'floor' WHEN 1 THEN 'ceiling' ELSE 'wall' END AS kind,
CASE p_partkey % 5 WHEN 0 THEN 'water_stain' WHEN 1 THEN 'mold' WHEN 2 THEN 'crack' WHEN 3 THEN 'hole' ELSE 'peeling_paint' END AS cls, p_size / 100.0::double AS area, p_retailprice / 1000 AS length, p_size / 200.0::double AS v0 FROM part)"""


# each brand's room has a window, a door and a passage, a sink and a toilet; all edges lie along the axes, so distances are those of boxes
_NEAR_SQL = """walls AS (SELECT DISTINCT room_id, w.k FROM regions, (VALUES (0), (1), (2)) w(k)), o AS (SELECT room_id, room_id || '-W' || k AS surface_id, k, CASE k WHEN 0 THEN 'window' WHEN 1 THEN 'door' ELSE 'opening' END AS type, 0.5::double + 0.3::double * k AS u0, 1.3::double + 0.3::double * k AS u1, CASE k WHEN 0 THEN 0.9::double ELSE 0 END AS v0, CASE k WHEN 0 THEN 0.9::double ELSE 0 END + 1 + 0.5::double * k AS v1 FROM walls),
sized AS (SELECT r.*, p_size / 40.0::double AS u0, p_size / 40.0::double + p_size / 50.0::double AS u1, p_size / 200.0::double + p_size / 60.0::double AS v1 FROM regions r JOIN part ON p_partkey = damage_id),
segs AS (SELECT damage_id, room_id, cls, u0 AS ax, u1 AS bx, (p_partkey % 3)::double AS ay, (p_partkey % 3)::double AS by_, v0 AS z0, v1 AS z1 FROM sized JOIN part ON p_partkey = damage_id WHERE kind = 'wall' UNION ALL SELECT damage_id, room_id, cls, CASE s.s WHEN 1 THEN u1 ELSE u0 END, CASE s.s WHEN 3 THEN u0 ELSE u1 END, CASE s.s WHEN 2 THEN v1 ELSE v0 END, CASE s.s WHEN 0 THEN v0 ELSE v1 END, CASE kind WHEN 'floor' THEN 0.0::double ELSE 2.5::double END, CASE kind WHEN 'floor' THEN 0.0::double ELSE 2.5::double END FROM sized, (VALUES (0), (1), (2), (3)) s(s) WHERE kind <> 'wall'),
gap AS (SELECT damage_id, x.what, min(sqrt(pow(greatest(x.x0 - bx, ax - x.x1, 0), 2) + pow(greatest(x.y0 - by_, ay - x.y1, 0), 2) + pow(greatest(x.z0 - segs.z1, segs.z0 - x.z1, 0), 2))) AS d FROM segs, (VALUES ('fixture', 1.0::double, 1.0::double, 0.3::double, 0.3::double, 0.0::double, 0.9::double), ('fixture', 3.0::double, 3.0::double, 1.2::double, 1.2::double, 0.0::double, 0.4::double), ('window', 0.5::double, 1.3::double, 0.0::double, 0.0::double, 0.9::double, 1.9::double)) x(what, x0, x1, y0, y1, z0, z1) GROUP BY 1, 2),
corner AS (SELECT s.damage_id, min(sqrt(pow(a.u - b.u, 2) + pow(a.v - b.v, 2))) AS d FROM sized s JOIN o ON o.surface_id = s.surface_id, LATERAL (SELECT * FROM (VALUES (s.u0, s.v0), (s.u0, s.v1), (s.u1, s.v0), (s.u1, s.v1)) a(u, v)) a, LATERAL (SELECT * FROM (VALUES (o.u0, o.v0), (o.u0, o.v1), (o.u1, o.v0), (o.u1, o.v1)) b(u, v)) b GROUP BY 1)"""


@query(f"""WITH {_REGIONS_SQL}, {_NEAR_SQL}, f AS (
SELECT 'R-FIXTURE-LEAK' AS rule_id, damage_id::varchar AS grp, damage_id, area FROM regions JOIN gap USING (damage_id) WHERE cls = 'water_stain' AND what = 'fixture' AND d <= 1.0::double UNION ALL SELECT 'R-WINDOW-LEAK', damage_id::varchar, damage_id, area FROM regions JOIN gap USING (damage_id) WHERE cls = 'water_stain' AND kind = 'wall' AND what = 'window' AND d <= 0.5::double
UNION ALL SELECT 'R-CRACK-OPENING', damage_id::varchar, damage_id, area FROM regions JOIN corner USING (damage_id) WHERE cls = 'crack' AND kind = 'wall' AND d <= 0.3::double UNION ALL
SELECT 'R-CEIL-STAIN', damage_id::varchar, damage_id, area FROM regions WHERE cls = 'water_stain' AND kind = 'ceiling' UNION ALL SELECT 'R-WALL-WICK', damage_id::varchar, damage_id, area FROM regions WHERE cls = 'water_stain' AND kind = 'wall' AND v0 <= 0.15::double
UNION ALL SELECT 'R-MOLD-HIDDEN', surface_id, damage_id, area FROM regions WHERE cls = 'mold' UNION ALL SELECT 'R-CRACK-LONG', damage_id::varchar, damage_id, area FROM regions WHERE cls = 'crack' AND length > 1.0::double
UNION ALL SELECT 'R-PEEL-MOISTURE', damage_id::varchar, damage_id, area FROM regions WHERE cls = 'peeling_paint' AND kind IN ('wall', 'ceiling') UNION ALL SELECT 'R-HOLE-CAVITY', damage_id::varchar, damage_id, area FROM regions WHERE cls = 'hole'
UNION ALL SELECT 'R-MOLD-LIMITED', room_id, damage_id, area FROM regions WHERE cls = 'mold' UNION ALL SELECT 'R-MOLD-FULL', room_id, damage_id, area FROM regions WHERE cls = 'mold'), g AS (SELECT rule_id, min(damage_id) AS first_damage, count(*) AS n_damage, sum(area) * 10.7639::double AS sqft FROM f GROUP BY rule_id, grp)
SELECT rule_id, first_damage, n_damage, round(sqft, 6) AS sqft FROM g WHERE (rule_id <> 'R-MOLD-LIMITED' OR (sqft > 10 AND sqft <= 100)) AND (rule_id <> 'R-MOLD-FULL' OR sqft > 100)""")
def rule_flags(spark: SparkSession, d: str) -> DataFrame:
    f = _flags(spark, d)
    return f.select("rule_id", F.array_min("damage_ids").alias("first_damage"), F.size("damage_ids").cast("long").alias("n_damage"), F.round("total_area_sqft", 6).alias("sqft"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    surface = F.concat("p_brand", F.when(k % 4 == 0, "-FLOOR").when(k % 4 == 1, "-CEIL").otherwise(F.concat(F.lit("-W"), k % 3)))
    cls = F.element_at(F.array(*map(F.lit, ("water_stain", "mold", "crack", "hole", "peeling_paint"))), (k % 5 + 1).cast("int"))
    size = F.col("p_size")
    return read_table(spark, d, "part").select(
        F.col("p_brand").alias("capture_id"), F.col("p_brand").alias("room_id"), k.alias("damage_id"), k.alias("ord"), surface.alias("surface_id"), cls.alias("cls"), (size / 100.0).alias("area"), (F.col("p_retailprice") / 1000).alias("length"),
        (size / 50.0).alias("width"), (size / 60.0).alias("height"), (size / 40.0).alias("u0"), (size / 40.0 + size / 50.0).alias("u1"), (size / 200.0).alias("v0"), (size / 200.0 + size / 60.0).alias("v1"),
    )


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A brand is a capture with one room of three walls, an opening in each, a sink and a toilet."""
    brands = read_table(spark, d, "part").select("p_brand").distinct()
    rooms = brands.select(F.col("p_brand").alias("capture_id"), F.col("p_brand").alias("room_id"), F.lit(1).alias("room_ord"), F.lit(0.0).alias("floor_z"), F.lit(2.5).alias("ceiling_z"))
    rooms = materialize(rooms, "rooms")
    walls = rooms.select("capture_id", "room_id", F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    walls = walls.select("capture_id", "room_id", "k", F.concat("room_id", F.lit("-W"), "k").alias("wall_id"), F.lit(0.0).alias("sx"), F.col("k").cast("double").alias("sy"), F.lit(4.0).alias("ex"), F.col("k").cast("double").alias("ey"))
    k = F.col("k")
    kind = F.when(k == 0, "window").when(k == 1, "door").otherwise("opening")
    openings = walls.select("capture_id", "room_id", "wall_id", F.concat("wall_id", F.lit("-O")).alias("opening_id"), kind.alias("type"), (0.5 + 0.3 * k).alias("offset"), F.lit(0.8).alias("width"), (1 + 0.5 * k).alias("height"), F.when(k == 0, 0.9).alias("sill"))
    things = F.explode(F.array(*(F.struct(F.lit(c).alias("cls"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(h).alias("z1")) for c, x, y, h in (("sink", 1.0, 0.3, 0.9), ("toilet", 3.0, 1.2, 0.4)))))
    objects = rooms.select("capture_id", things.alias("o")).select("capture_id", F.concat("capture_id", F.lit("-"), F.col("o.cls")).alias("object_id"), "o.cls", "o.x", "o.y", *(F.lit(None).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), F.lit(0.0).alias("z0"), "o.z1")
    return rooms, walls, openings, objects


def _flags(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans.rules import evaluate

    rooms, walls, openings, objects = _plan(spark, d)
    return evaluate(_regions(spark, d), rooms, walls, openings, objects)


@query(f"""WITH {_REGIONS_SQL} SELECT surface_id, entry, count(*) AS n_damage, round(sum(q), 6) AS value FROM (SELECT surface_id, 'CRACK-TAPE' AS entry, (length + 0.15::double) * 3.28084::double AS q FROM regions WHERE cls = 'crack' AND kind IN ('wall', 'ceiling') UNION ALL SELECT surface_id, 'HOLE-PATCH', 1 FROM regions WHERE cls = 'hole' AND kind IN ('wall', 'ceiling') AND area <= 0.09::double) GROUP BY 1, 2""")
def line_items(spark: SparkSession, d: str) -> DataFrame:
    from plumbline.plans import scope

    few = tuple(e for e in scope.DAMAGE if e["id"] in ("CRACK-TAPE", "HOLE-PATCH"))
    items = _line_items(spark, d, few, ())
    return items.select("surface_id", "entry", F.size("damage_ids").cast("long").alias("n_damage"), F.round("value", 6).alias("value"))


def _line_items(spark: SparkSession, d: str, *entries: tuple) -> DataFrame:
    from plumbline.plans import scope

    rooms, walls, openings, _ = _plan(spark, d)
    m = lambda c, k=0.1: F.struct(c.alias("value"), (c * (1 - k)).alias("lo"), (c * (1 + k)).alias("hi"))
    damage = _regions(spark, d).withColumns({c: m(F.col(c)) for c in ("area", "width", "height", "length")})
    walls = walls.withColumns({"length": m(F.lit(4.0)), "height": m(F.lit(2.5))})
    rooms = rooms.withColumn("floor_area", m(F.lit(12.0)))
    openings = openings.withColumns({c: m(F.col(c)) for c in ("width", "height")})
    flags = _flags(spark, d)
    # every flag entry reads the flags at each bound
    return scope.line_items(damage, flags if entries else materialize(flags, "flags"), rooms, walls, openings, *entries)


# order-dependent and numeric kernels, and the whole catalogue: no SQL


@query()
def line_items_all(spark: SparkSession, d: str) -> DataFrame:
    """All entries of the catalogue, of damage and of flags."""
    items = _line_items(spark, d)
    return items.select("surface_id", "entry", F.size("damage_ids").cast("long").alias("n_damage"), F.size("flag_ids").cast("long").alias("n_flags"), *(F.round(c, 6).alias(c) for c in ("value", "lo", "hi")))


@query()
def nms_keep(spark: SparkSession, d: str) -> DataFrame:
    from .core import _boxes

    return greedy.suppress(_boxes(spark, d), ["view_id"], 0.3, 0.8, "box_id").select("view_id", "box_id")


@query()
def cluster_greedy(spark: SparkSession, d: str) -> DataFrame:
    from .core import _boxes

    b = _boxes(spark, d).withColumn("view", F.col("cls"))
    return greedy.cluster(b, ["view_id"], "view", 0.2, 30.0, "box_id").select("view_id", "box_id", "cluster")


@query()
def hungarian_match(spark: SparkSession, d: str) -> DataFrame:
    s = order_spans(spark, d)
    side = lambda k, name: s.where(F.col("o_orderkey") % 2 == k).select("o_custkey", F.col("o_orderkey").alias(name), "lo")
    return assignment.assign_values(side(0, "a"), side(1, "b"), ["o_custkey"], "a", "b", "lo")


@query()
def dp_align(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "gt").otherwise("pred"))
    k = F.row_number().over(Window.partitionBy("o_custkey", "side").orderBy("o_orderkey")) - 1
    walls = o.select("o_custkey", "side", k.alias("k"), (F.col("o_totalprice") / 1000).alias("length"))
    return assignment.align_walls(walls, ["o_custkey"])


@query()
def keyframes_greedy(spark: SparkSession, d: str) -> DataFrame:
    return greedy.keyframes(events(spark, d).select("user_id", "event_id", "value"), ["user_id"], "event_id", ["value"], 20.0).select("user_id", "event_id")


@query()
def clopper_pearson_bounds(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem(spark, d).groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("ci", clopper_pearson(F.col("k"), F.col("n"))).select("l_returnflag", "l_linestatus", "k", "n", F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


@query()
def icp_pair(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumns({"one": F.lit(1), "segment": F.col("label").cast("long")})
    thin = bins.voxel_weighted(p, 0.05, by=["one", "segment"]).select("one", "segment", "x", "y", "z", "nx", "ny", "nz")
    held = thin.select("one", "segment").distinct()
    pairs = held.select("one", F.col("segment").alias("a"), (F.col("segment") + 1).alias("b")).join(held.withColumnRenamed("segment", "b"), ["one", "b"])
    r = registration.register(thin, pairs, ["one"], most=8)
    return r.select("a", "b", F.transform("transform", lambda v: F.round(v, 6)).alias("transform"), "n", F.round("overlap", 6).alias("overlap"), F.round("rmse", 6).alias("rmse"), "dof", "reason")


@query()
def pose_graph_loop(spark: SparkSession, d: str) -> DataFrame:
    """Whole histories, cut into consecutive graphs of 8 steps, the last one shorter; each closes on its first node."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = events(spark, d).withColumn("n", n).withColumns({"part": F.floor(F.col("n") / 8), "i": (F.col("n") % 8).cast("long")})
    step = e.select("user_id", "part", "i", (F.col("i") + 1).alias("j"), (F.col("value") / 100).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), (F.col("event_id") % 5 / 50.0).alias("yaw"), F.lit(0.5).alias("sigma_xyz"), F.lit(0.05).alias("sigma_yaw"))
    keys = ["user_id", "part"]
    c, zero = F.col, F.lit(0.0)
    pose = lambda x, y, yaw: F.array(F.cos(yaw), -F.sin(yaw), zero, x, F.sin(yaw), F.cos(yaw), zero, y, zero, zero, F.lit(1.0), zero, zero, zero, zero, F.lit(1.0))
    chain = windows.chain_poses(step, keys, "i", "x", "y", "yaw").select(*keys, (c("i") + 1).alias("node"), pose(c("x"), c("y"), c("yaw")).alias("pose"))
    nodes = chain.union(step.select(*keys).distinct().select(*keys, F.lit(0).cast("long"), pose(zero, zero, zero)))
    rule = lambda df, a, b, m, turn, shift: df.select(*keys, a.alias("a"), b.alias("b"), F.lit("relative").alias("kind"), m.alias("m"), F.array(F.lit(turn), F.lit(shift), F.lit(1.0)).alias("s"))
    ends = step.groupBy(*keys).agg(F.max("j").alias("j"))
    rules = rule(step, c("i"), c("j"), pose(c("x"), c("y"), c("yaw")), 0.05, 0.5).union(rule(ends, F.lit(0).cast("long"), c("j"), pose(zero, zero, zero), 0.05, 0.25))
    nodes, rules = materialize(nodes, "nodes"), materialize(rules, "rules")
    g, _ = posegraph.optimise(posegraph.yaw_freedom(nodes, rules, keys), rules, keys, "yaw", most=12, tolerance=1e-6)
    at = lambda k: F.round(F.get("pose", F.lit(k)), 6)
    return g.select(*keys, "node", at(3).alias("x"), at(7).alias("y"), at(11).alias("z"), F.round(F.atan2(F.get("pose", F.lit(4)), F.get("pose", F.lit(0))), 6).alias("yaw"))

