"""Gate rows and their ranking, head-to-head, repeats, counters and rollups over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import evaluation as ev
from plumbline.plans import gates
from plumbline.session import read_table

from .evaluation import _PAIRS_SQL, _pairs, _records
from .tables import events, lineitem, orders

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_GATES_SQL = f"""{_PAIRS_SQL}, e0 AS (SELECT tier, item, pred - gt AS err, greatest(500::double, 0.01::double * abs(gt)) AS allowed FROM pairs), e1 AS (SELECT *, abs(err) / allowed AS ratio, coalesce(abs(err) / allowed <= 1, false) AS ok FROM e0),
e2 AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ok, err IS NOT NULL, ratio DESC NULLS LAST, item) AS k FROM e1),
e3 AS (SELECT tier, count(*) AS n, max(ratio) AS measured, sum(ok::int) / count(*) AS pass_share, bool_and(ok) AS ok, greatest(coalesce(max(ratio), 0), CASE WHEN sum((err IS NULL)::int) > 0 THEN 2 ELSE 0 END) AS reach, string_agg(item::varchar, ',' ORDER BY k) FILTER (k <= 5 AND (NOT ok OR k = 1)) AS worst FROM e2 GROUP BY 1),
error AS (SELECT 'price' AS gate, tier, 'error' AS kind, n, measured, pass_share, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ok THEN 0 ELSE reach END AS shortfall, CASE WHEN ok THEN 0 ELSE greatest(reach - 1, 0) END AS score, coalesce(worst, '') AS worst FROM e3),
r0 AS (SELECT tier, item, CASE WHEN pred IS NULL THEN 1 WHEN item % 50 = 1 THEN 2 ELSE 0 END AS s, coalesce(pred IS NOT NULL AND item % 50 <> 1 AND abs(pred - gt) <= 0.02::double * gt + 1e-12::double, false) AS ok FROM pairs),
r1 AS (SELECT *, row_number() OVER (PARTITION BY tier, ok ORDER BY s, item) AS k FROM r0), r2 AS (SELECT tier, count(*) AS n, sum(ok::int) / count(*) AS rate, string_agg(item::varchar, ',' ORDER BY k) FILTER (NOT ok AND k <= 5) AS worst FROM r1 GROUP BY 1),
rate AS (SELECT 'width' AS gate, tier, 'rate' AS kind, n, rate AS measured, rate AS pass_share, CASE WHEN rate >= 0.85::double - 1e-12::double THEN 'pass' ELSE 'fail' END AS status, greatest(0.85::double - rate, 0) AS shortfall, CASE WHEN rate >= 0.85::double - 1e-12::double THEN 0 ELSE (0.85::double - rate) / 0.85::double END AS score, coalesce(worst, '') AS worst FROM r2),
c1 AS (SELECT tier, item, gt < 400000 AS ok, row_number() OVER (PARTITION BY tier, gt < 400000 ORDER BY item) AS k FROM pairs), c2 AS (SELECT tier, count(*) AS n, sum(ok::int) / count(*) AS share, string_agg(item::varchar, ',' ORDER BY item) FILTER (NOT ok AND k <= 5) AS worst FROM c1 GROUP BY 1),
chk AS (SELECT 'below' AS gate, tier, 'check' AS kind, n, share AS measured, share AS pass_share, CASE WHEN share = 1 THEN 'pass' ELSE 'fail' END AS status, 1 - share AS shortfall, 1 - share AS score, coalesce(worst, '') AS worst FROM c2),
g1 AS (SELECT tier, item, NOT covered AND abs_err > 2 * half_width AS bad, CASE WHEN half_width > 0 THEN abs_err / half_width ELSE 'inf'::double END AS size FROM records), g2 AS (SELECT *, row_number() OVER (PARTITION BY tier, bad ORDER BY size DESC, item) AS k FROM g1),
g3 AS (SELECT tier, count(*) AS n, sum(bad::int)::double AS bad, string_agg(item::varchar, ',' ORDER BY k) FILTER (bad AND k <= 5) AS worst FROM g2 GROUP BY 1),
gar AS (SELECT 'confident_garbage' AS gate, tier, 'count' AS kind, n, bad AS measured, 1 - bad / n AS pass_share, CASE WHEN bad = 0 THEN 'pass' ELSE 'fail' END AS status, bad AS shortfall, bad AS score, coalesce(worst, '') AS worst FROM g3),
every AS (SELECT * FROM error UNION ALL SELECT * FROM rate UNION ALL SELECT * FROM chk UNION ALL SELECT * FROM gar)"""


def _rows(spark: SparkSession, d: str) -> list[DataFrame]:
    p = _pairs(spark, d)
    err = F.col("pred") - F.col("gt")
    status = F.when(F.col("pred").isNull(), "missed").when(F.col("item") % 50 == 1, "phantom").otherwise("matched")
    return [
        gates.error_rows("price", p.select("tier", "item", "gt", err.alias("err")), ev.threshold(F.col("gt"), 500.0, 0.01)),
        gates.rate_rows("width", p.select("tier", "item", status.alias("status"), err.alias("err"), (0.02 * F.col("gt")).alias("allowed")), 0.85),
        gates.check_rows("below", p.select("tier", "item", (F.col("gt") < 400_000).alias("ok"))),
        gates.garbage_rows(_records(spark, d)),
    ]


@query(f"WITH {_GATES_SQL} SELECT gate, tier, kind, n, round(measured, 9) AS measured, round(pass_share, 9) AS pass_share, status, round(shortfall, 9) AS shortfall, round(score, 9) AS score, worst, CASE WHEN status = 'fail' THEN row_number() OVER (PARTITION BY status = 'fail' ORDER BY score DESC, gate, tier) END::int AS rank FROM every")
def gate_evaluation(spark: SparkSession, d: str) -> DataFrame:
    g = gates.evaluate(_rows(spark, d))
    return g.select("gate", "tier", "kind", "n", *(F.round(c, 9).alias(c) for c in ("measured", "pass_share", "shortfall", "score")), "status", F.array_join("worst", ",").alias("worst"), "rank")


@query()
def calibration_gate(spark: SparkSession, d: str) -> DataFrame:
    """The exact binomial interval has no SQL."""
    c = ev.coverage(_records(spark, d), "tier", "kind", "room").where("kind IS NULL")
    return gates.calibration_rows(c).select("gate", "tier", "n", *(F.round(x, 9).alias(x) for x in ("measured", "shortfall", "score")), "status")


@query("""WITH v AS (SELECT l_partkey AS part, l_suppkey AS capture, l_extendedprice / l_quantity AS x FROM lineitem) SELECT part, count(DISTINCT capture) AS captures, round(max(x) - min(x), 6) AS spread FROM v GROUP BY 1 HAVING count(DISTINCT capture) >= 2""")
def capture_spreads(spark: SparkSession, d: str) -> DataFrame:
    v = lineitem(spark, d).select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("capture"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return gates.spreads(v, ["part"], "capture", "x").select("part", "captures", F.round("spread", 6).alias("spread"))


@query("""WITH v AS (SELECT l_returnflag AS tier, l_partkey AS item, max(l_discount) - min(l_discount) AS spread FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 2), n AS (SELECT *, spread <= 0.08::double + 1e-12::double AS ok FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY tier, ok ORDER BY item) AS k FROM n),
g AS (SELECT tier, count(*) AS n, sum(ok::int) / count(*) AS share, max(spread) AS top, string_agg(item::varchar, ',' ORDER BY item) FILTER (NOT ok AND k <= 5) AS worst FROM k GROUP BY 1)
SELECT tier, n, round(top, 9) AS measured, round(share, 9) AS pass_share, CASE WHEN share = 1 THEN 'pass' ELSE 'fail' END AS status, round(CASE WHEN share = 1 THEN 0 ELSE top / 0.08::double - 1 END, 9) AS score, coalesce(worst, '') AS worst FROM g""")
def ceiling_spread_gate(spark: SparkSession, d: str) -> DataFrame:
    v = lineitem(spark, d).select(F.col("l_returnflag").alias("tier"), F.col("l_partkey").alias("item"), "l_suppkey", "l_discount")
    g = gates.spread_rows(gates.spreads(v, ["tier", "item"], "l_suppkey", "l_discount"), 0.08)
    return g.select("tier", "n", *(F.round(c, 9).alias(c) for c in ("measured", "pass_share", "score")), "status", F.array_join("worst", ",").alias("worst"))


@query("""WITH p AS (SELECT l_partkey AS room, l_suppkey AS capture, count(*) AS n_walls, sum((l_returnflag = 'A')::int)::bigint AS n_openings, list_sort(list(DISTINCT l_linenumber)) AS walls, list_sort(list(DISTINCT l_linestatus)) AS openings FROM lineitem GROUP BY 1, 2)
SELECT a.room, a.capture AS capture_a, b.capture AS capture_b, a.n_walls = b.n_walls AND a.walls = b.walls AS same_walls, a.n_openings = b.n_openings AND a.openings = b.openings AS same_openings FROM p a JOIN p b ON a.room = b.room AND a.capture < b.capture""")
def structure_pairs(spark: SparkSession, d: str) -> DataFrame:
    g = lineitem(spark, d).groupBy(F.col("l_partkey").alias("room"), F.col("l_suppkey").alias("capture"))
    p = g.agg(F.count(F.lit(1)).alias("n_walls"), F.count_if(F.col("l_returnflag") == "A").alias("n_openings"), F.collect_set("l_linenumber").alias("walls"), F.collect_set("l_linestatus").alias("openings"))
    return gates.same_structure(p, ["room"])


@query("""WITH i AS (SELECT l_suppkey AS capture, CASE WHEN l_quantity < 5 THEN 'missed' WHEN l_quantity > 46 THEN 'phantom' ELSE 'matched' END AS status, l_returnflag AS g, CASE WHEN l_linenumber = 3 THEN 'A' ELSE l_returnflag END AS p FROM lineitem)
SELECT capture, sum((status <> 'phantom')::int)::bigint AS gt, sum((status <> 'missed')::int)::bigint AS pred, sum((status = 'matched')::int)::bigint AS matched, sum((status = 'missed')::int)::bigint AS missed, sum((status = 'phantom')::int)::bigint AS phantom, sum((status = 'matched' AND g <> p)::int)::bigint AS swaps FROM i GROUP BY 1""")
def status_counters(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    i = lineitem(spark, d).select(F.col("l_suppkey").alias("capture"), F.when(q < 5, "missed").when(q > 46, "phantom").otherwise("matched").alias("status"), F.col("l_returnflag").alias("gt_type"), F.when(F.col("l_linenumber") == 3, "A").otherwise(F.col("l_returnflag")).alias("pred_type"))
    return gates.status_counts(i, ["capture"])


@query(f"""WITH {_PAIRS_SQL} SELECT 'F' AS kind, 'record' AS what, item, round(err, 6) AS err, covered FROM records WHERE tier = 'F' UNION ALL SELECT 'O', 'record', item, round(err, 6), covered FROM records WHERE tier = 'O' UNION ALL SELECT tier, 'missing', item, NULL, NULL FROM pairs WHERE pred IS NULL AND tier IN ('F', 'O')""")
def kind_records(spark: SparkSession, d: str) -> DataFrame:
    p = _pairs(spark, d)
    records, misses = gates.kind_records({k: p.where(F.col("tier") == k) for k in ("F", "O")}, ["item"])
    told = records.select("kind", F.lit("record").alias("what"), "item", F.round("err", 6).alias("err"), "covered")
    return told.union(misses.select("kind", F.lit("missing"), "item", F.lit(None).cast("double"), F.lit(None).cast("boolean")))


@query("""WITH o AS (SELECT l_partkey AS room, l_suppkey::varchar AS capture, l_returnflag AS tier, CASE WHEN l_linenumber % 2 = 0 THEN 'area' ELSE 'wall' END AS dimension, CASE WHEN l_quantity < 4 THEN NULL ELSE l_extendedprice / l_quantity END AS ours FROM lineitem), g AS (SELECT p_partkey AS room, d.dimension, CASE d.dimension WHEN 'area' THEN 'area' ELSE 'length' END AS kind, p_retailprice AS gt, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice * (1 + ((p_partkey % 9) - 4) / 100.0::double) END AS theirs FROM part, (VALUES ('area'), ('wall')) d(dimension))
SELECT room, dimension, capture, tier, floor(ours - gt) AS ours_err, floor(theirs - gt) AS theirs_err, coalesce(CASE kind WHEN 'area' THEN abs(ours - gt) / gt * 100 <= abs(theirs - gt) / gt * 100 + 0.2::double + 1e-9::double ELSE abs(ours - gt) <= abs(theirs - gt) + 0.003::double + 1e-9::double END, false) AS beat_or_tie FROM g JOIN o USING (room, dimension) WHERE gt > 0 AND theirs IS NOT NULL""")
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    part = read_table(spark, d, "part").withColumn("dimension", F.explode(F.array(F.lit("area"), F.lit("wall"))))
    k = F.col("p_partkey")
    gt = part.select(k.alias("room"), "dimension", F.when(F.col("dimension") == "area", "area").otherwise("length").alias("kind"), F.col("p_retailprice").alias("gt"))
    theirs = part.select(k.alias("room"), "dimension", F.when(k % 11 != 0, F.col("p_retailprice") * (1 + ((k % 9) - 4) / 100.0)).alias("theirs"))
    ours = lineitem(spark, d).select(F.col("l_partkey").alias("room"), F.when(F.col("l_linenumber") % 2 == 0, "area").otherwise("wall").alias("dimension"), F.col("l_suppkey").cast("string").alias("capture"), F.col("l_returnflag").alias("tier"), F.when(F.col("l_quantity") >= 4, F.col("l_extendedprice") / F.col("l_quantity")).alias("ours"))
    h = gates.head_to_head(gt, ours, theirs)
    return h.select("room", "dimension", "capture", "tier", F.floor("ours_err").cast("double").alias("ours_err"), F.floor("theirs_err").cast("double").alias("theirs_err"), "beat_or_tie")


@query("""SELECT user_id, round(sum(value) FILTER (event_type = 'click'), 6) AS click, round(sum(value) FILTER (event_type = 'view'), 6) AS view, round(sum(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(sum(value), 6) AS total FROM events GROUP BY 1""")
def stage_times(spark: SparkSession, d: str) -> DataFrame:
    t = events(spark, d).select("user_id", F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    w = gates.stage_times(t, ["click", "view", "purchase"], ["user_id"])
    return w.select("user_id", *(F.round(c, 6).alias(c) for c in ("click", "view", "purchase", "total")))


@query(f"WITH {_PAIRS_SQL} SELECT tier, kind, count(*) AS n, round(avg(err), 4) AS bias FROM records GROUP BY 1, 2")
def bias_rollup(spark: SparkSession, d: str) -> DataFrame:
    return gates.bias(_records(spark, d), ["tier", "kind"]).select("tier", "kind", "n", F.round("bias", 4).alias("bias"))


@query("""SELECT o_orderkey, c_name AS capture, c_mktsegment AS property FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' OR c_name = 'Customer#000000007' OR c_mktsegment || '/' || c_name IN ('MACHINERY/Customer#000000001', 'HOUSEHOLD/Customer#000000005', 'FURNITURE/Customer#000000003')""")
def selected_captures(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("capture"), F.col("c_mktsegment").alias("property"))
    only = ["BUILDING", "Customer#000000007", "MACHINERY/Customer#000000001", "HOUSEHOLD/Customer#000000005", "FURNITURE/Customer#000000003"]
    return orders(spark, d).join(gates.selected(c, only), "o_custkey").select("o_orderkey", "capture", "property")


@query(f"""WITH {_PAIRS_SQL}, v AS (SELECT tier, count(DISTINCT room) AS rooms, max(score) AS top FROM records WHERE score < 'inf'::double GROUP BY 1) SELECT tier, rooms, round(greatest(top, 0.2::double), 9) AS factor FROM v""")
def calibration_table(spark: SparkSession, d: str) -> DataFrame:
    """Written three times, read once: only the last whole version shows."""
    r = _records(spark, d).where(F.col("score") < float("inf"))
    fit = r.groupBy("tier").agg(F.countDistinct("room").alias("rooms"), F.greatest(F.max("score"), F.lit(0.2)).alias("factor"))
    held = gates.CalibrationTable(spark)
    held.write(fit.withColumn("factor", F.lit(1.0)))
    held.write(fit.withColumn("factor", F.lit(2.0)))
    held.write(fit)
    return held.read().select("tier", "rooms", F.round("factor", 9).alias("factor"))
