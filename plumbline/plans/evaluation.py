"""Evaluation: score records, gates, coverage, conformal calibration, repeatability, ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.binomial import clopper_pearson, conformal_level
from plumbline.operators.quantiles import reach, unit_equal_quantiles

WORST = 5
#: Fixed value: the smallest share of its width that a fitted multiplier leaves an interval.
MIN_FACTOR = 0.2


def threshold(gt: Column, absolute: float | None, relative: float | None, rule: str = "max") -> Column:
    """Allowed error: absolute, relative to the truth, or the larger or smaller of both; null without any."""
    parts = [F.lit(float(absolute)) if absolute is not None else F.lit(None).cast("double"), F.abs(gt) * float(relative) if relative is not None else F.lit(None).cast("double")]
    return F.greatest(*parts) if rule == "max" else F.least(*parts)


def score(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records of pairs (keys, gt, pred, lo, hi): errors, coverage with a slack of 1e-9, half width, and the one-sided score.

    The score is the error over the width on the truth's side; infinite for a miss of a zero width.
    """
    lo, hi = F.least("lo", "pred"), F.greatest("hi", "pred")
    err = F.col("pred") - F.col("gt")
    width = F.when(err < 0, hi - F.col("pred")).otherwise(F.col("pred") - lo)
    return pairs.where("gt IS NOT NULL AND pred IS NOT NULL").select(
        *keys, "gt", "pred", lo.alias("lo"), hi.alias("hi"), err.alias("err"), F.abs(err).alias("abs_err"), (err / F.nullif(F.col("gt"), F.lit(0.0))).alias("rel_err"),
        ((lo - 1e-9 <= F.col("gt")) & (F.col("gt") <= hi + 1e-9)).alias("covered"), ((hi - lo) / 2).alias("half_width"),
        F.when(width > 0, F.abs(err) / width).when(err == 0, F.lit(0.0)).otherwise(F.lit(float("inf"))).alias("score"),
    )


def missing_items(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Truths without a value, to be failed by the gates."""
    return pairs.where("gt IS NOT NULL AND pred IS NULL").select(*keys, "gt")


def error_gate(items: DataFrame, by: Sequence[str], item: str, allowed: Column) -> DataFrame:
    """One row a gate: every item within its allowance, missing ones (null err) fail; the worst items, missing first.

    items (by, item, gt, err). Items without an allowance and with an error are left out.
    """
    ratio = F.when(F.col("allowed") > 0, F.abs("err") / F.col("allowed")).when(F.col("err") == 0, F.lit(0.0)).when(F.col("err").isNotNull(), F.lit(float("inf")))
    rows = items.withColumn("allowed", allowed).where("allowed IS NOT NULL OR err IS NULL").withColumn("ratio", ratio)
    rows = rows.withColumn("pass", F.coalesce(F.col("ratio") <= 1, F.lit(False)))
    order = Window.partitionBy(*by).orderBy("pass", F.col("err").isNotNull(), F.col("ratio").desc(), item)
    # the limit on the rank is applied before the shuffle too, so no task sorts a whole gate
    top = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= WORST).where(~F.col("pass") | (F.col("_n") == 1))
    worst = F.transform(F.sort_array(F.collect_list(F.struct("_n", item, "ratio"))), lambda x: F.struct(x[item], x["ratio"]))
    gate = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pass").cast("long")).alias("n_pass"), F.sum(F.col("err").isNull().cast("long")).alias("n_missing"), F.max("ratio").alias("worst_ratio")
    )
    gate = gate.join(top.groupBy(*by).agg(worst.alias("worst")), list(by), "left")
    status = F.when(F.col("n_pass") == F.col("n"), "pass").otherwise("fail")
    reach = F.greatest(F.coalesce("worst_ratio", F.lit(0.0)), F.when(F.col("n_missing") > 0, 2.0).otherwise(0.0))
    return gate.withColumn("status", status).withColumn("pass_share", F.col("n_pass") / F.col("n")).withColumn("score", F.when(F.col("status") == "fail", F.greatest(reach - 1, F.lit(0.0))).otherwise(0.0))


def rate_gate(items: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """items (by, status 'matched'|'missed'|'phantom', err, allowed): the share within allowance must reach the target; misses and phantoms fail."""
    ok = F.coalesce((F.col("status") == "matched") & (F.abs("err") <= F.col("allowed") + 1e-12), F.lit(False))
    count = lambda s: F.sum((F.col("status") == s).cast("long")).alias(f"n_{s}")
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("long")).alias("n_pass"), count("missed"), count("phantom"))
    rate = F.col("n_pass") / F.col("n")
    g = g.withColumn("rate", rate).withColumn("verdict", F.when(rate >= target - 1e-12, "pass").otherwise("fail"))
    return g.withColumn("score", F.when(F.col("verdict") == "fail", (target - rate) / target).otherwise(0.0))


def check_gate(items: DataFrame, by: Sequence[str], item: str) -> DataFrame:
    """items (by, item, ok): passes when every item does; the first failing ones by name."""
    first = Window.partitionBy(*by).orderBy(item)
    fails = items.where(~F.col("ok")).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= WORST)
    fails = fails.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("worst"))
    g = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("long")).alias("n_pass")).join(fails, list(by), "left")
    g = g.withColumn("worst", F.coalesce("worst", F.array().cast(dict(fails.dtypes)["worst"])))
    return g.withColumn("verdict", F.when(F.col("n") == F.col("n_pass"), "pass").otherwise("fail")).withColumn("pass_share", F.col("n_pass") / F.col("n"))


def is_garbage(ratio: float) -> Column:
    """A miss by more than ratio half-widths."""
    return ~F.col("covered") & (F.col("abs_err") > ratio * F.col("half_width"))


def coverage(records: DataFrame, tier: str, kind: str, room: str, level: float = 0.9, ci: float = 0.95, ratio: float = 2.0) -> DataFrame:
    """Coverage per tier and per (tier, kind), the tier rows with a null kind, with the exact binomial interval."""
    n, k = F.count(F.lit(1)), F.sum(F.col("covered").cast("long"))
    g = records.groupingSets([[F.col(tier)], [F.col(tier), F.col(kind)]], tier, kind).agg(
        n.alias("n"), k.alias("n_covered"), F.avg("half_width").alias("mean_half_width"), F.avg("abs_err").alias("mean_abs_err"), F.count_distinct(room).alias("rooms"),
        F.sum(is_garbage(ratio).cast("long")).alias("garbage"), F.grouping_id().alias("_g"),
    )
    g = g.withColumn("coverage", F.col("n_covered") / F.col("n")).withColumn("ci", clopper_pearson(F.col("n_covered"), F.col("n"), ci))
    return g.withColumn("contains_nominal", F.col("ci.lo").between(0, level) & (F.col("ci.hi") >= level)).drop("_g")


def conformal_fit(records: DataFrame, tier: str, room: str, score_col: str = "score", level: float = 0.9, min_rooms: int = 9) -> DataFrame:
    """(tier, rooms, n, empirical, conformal, factor): room-equal quantiles of the scores; the factor is null (prior) below min_rooms or if infinite."""
    rooms = records.groupBy(tier).agg(F.countDistinct(room).alias("rooms"), F.count(F.lit(1)).alias("n"))
    marked = records.join(rooms, tier).withColumn("_level", conformal_level(F.col("rooms"), level))
    out = rooms.join(unit_equal_quantiles(marked, [tier], room, score_col, {"empirical": level, "conformal": F.col("_level")}), tier)
    usable = (F.col("rooms") >= min_rooms) & (F.col("conformal") < float("inf"))
    return out.withColumn("factor", F.when(usable, F.greatest("conformal", F.lit(MIN_FACTOR))))


def leave_one_room_out(records: DataFrame, tier: str, room: str, score_col: str = "score", level: float = 0.9, min_rooms: int = 9) -> DataFrame:
    """(tier, rooms, n, n_covered, coverage): every room scored with the factor fitted on the tier's other rooms.

    Tiers with too few other rooms are scored as reported, with factor 1. A
    room has a weight of 1 over its records, so leaving one out lowers the
    cumulated weight by at most 1: its factor lies between the scores where
    the tier's weight reaches the goal, and the goal and 1. Only scores in
    between are judged room by room, about one room's share of the tier.
    """
    r = records.where(F.col(score_col).isNotNull()).select(F.col(tier).alias("t"), F.col(room).alias("u"), F.col(score_col).alias("s"))
    own = r.groupBy("t", "u").agg(F.count(F.lit(1)).alias("k"))
    counts = own.groupBy("t").agg(F.count(F.lit(1)).alias("rooms")).withColumn("_p", conformal_level(F.col("rooms") - 1, level))
    goal = (F.col("rooms") - 1) * (F.col("_p") - 1e-9)
    judged = counts.where((F.col("rooms") - 1 >= min_rooms) & (F.col("_p") <= 1)).withColumn("goal", goal)
    held = r.groupBy("t", "u", "s").agg(F.count(F.lit(1)).alias("c")).join(own, ["t", "u"]).withColumn("w", F.col("c") / F.col("k"))
    ends = reach(held, ["t"], "s", "w", judged.select("t", F.explode(F.array(F.struct(F.lit(0).alias("_g"), F.col("goal").alias("_goal")), F.struct(F.lit(1).alias("_g"), (F.col("goal") + 1).alias("_goal")))).alias("g")).select("t", "g.*"))
    tops = r.groupBy("t").agg(F.max("s").alias("top"))
    span = ends.groupBy("t").agg(F.max(F.when(F.col("_g") == 0, F.col("hit"))).alias("lo"), F.max(F.when(F.col("_g") == 1, F.col("hit"))).alias("hi"))
    span = judged.select("t", "goal").join(span, "t", "left").join(tops, "t").select("t", "goal", F.coalesce("lo", "top").alias("lo"), F.coalesce("hi", "top").alias("hi"))
    near = held.join(span, "t")
    below = near.where("s < lo").groupBy("t").agg(F.sum("w").alias("all_below"))
    mine = near.where("s < lo").groupBy("t", "u").agg(F.sum("w").alias("own_below"))
    inside = near.where("s >= lo AND s <= hi")
    upto = lambda *k: Window.partitionBy(*k).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    steps = inside.groupBy("t", "s", "goal").agg(F.sum("w").alias("w")).withColumn("cw", F.sum("w").over(upto("t"))).drop("w")
    grid = steps.join(own.select("t", "u"), "t").join(inside.select("t", "u", "s", F.col("w").alias("ow")), ["t", "u", "s"], "left")
    grid = grid.withColumn("ocw", F.sum(F.coalesce("ow", F.lit(0.0))).over(upto("t", "u"))).join(below, "t", "left").join(mine, ["t", "u"], "left")
    without = F.col("cw") + F.coalesce("all_below", F.lit(0.0)) - F.col("ocw") - F.coalesce("own_below", F.lit(0.0))
    fitted = grid.groupBy("t", "u").agg(F.coalesce(F.min(F.when(without >= F.col("goal") - 1e-12, F.col("s"))), F.max("s")).alias("factor"))
    factor = F.when(F.col("rooms") - 1 < min_rooms, 1.0).when(F.col("_p") > 1, float("inf")).otherwise(F.greatest("factor", F.lit(MIN_FACTOR)))
    scored = r.join(counts, "t").join(fitted, ["t", "u"], "left").withColumn("factor", factor)
    g = scored.groupBy(F.col("t").alias(tier)).agg(F.max("rooms").alias("rooms"), F.count(F.lit(1)).alias("n"), F.sum((F.col("s") <= F.col("factor")).cast("long")).alias("n_covered"))
    return g.withColumn("coverage", F.col("n_covered") / F.col("n"))


def repeat_pairs(values: DataFrame, by: Sequence[str], capture: str, value: str, gt: str, absolute: float = 0.01, relative: float = 0.005) -> DataFrame:
    """Pairs of captures that measured the same thing: delta, allowance (larger of both) and strict allowance (smaller)."""
    a = values.select(*by, F.col(capture).alias("capture_a"), F.col(value).alias("a"), F.col(gt).alias("gt"))
    b = values.select(*by, F.col(capture).alias("capture_b"), F.col(value).alias("b"))
    delta, length = F.abs(F.col("a") - F.col("b")), F.coalesce("gt", (F.col("a") + F.col("b")) / 2)
    pairs = a.join(b, list(by)).where("capture_a < capture_b").withColumn("delta", delta)
    pairs = pairs.withColumn("allowed", threshold(length, absolute, relative)).withColumn("strict", threshold(length, absolute, relative, "min"))
    return pairs.withColumn("pass", F.col("delta") <= F.col("allowed") + 1e-9).withColumn("strict_pass", F.col("delta") <= F.col("strict") + 1e-9)


def ablation(main: DataFrame, off: DataFrame, by: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Each run with its switched-off twin; gain_x is how much smaller abs(x) is with the switch on."""
    twin = off.select(*by, *(F.col(s).alias(f"off_{s}") for s in stats))
    return main.join(twin, list(by)).withColumns({f"gain_{s}": F.abs(f"off_{s}") - F.abs(s) for s in stats})


def wall_stats(records: DataFrame, by: Sequence[str], allowed: Column) -> DataFrame:
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs("err")).alias("mean_abs_err"), F.max(F.abs("err")).alias("max_abs_err"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rms_err"),
        F.avg((F.abs("err") <= allowed + 1e-12).cast("double")).alias("pass_share"),
    )


def status_change(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer diff of gate tables (keys, status): what was fixed, broken, added, removed or stayed."""
    a, b = before.select(*keys, F.col("status").alias("before")), after.select(*keys, F.col("status").alias("after"))
    said = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same")
        .when((F.col("before") == "fail") & (F.col("after") == "pass"), "fixed").when((F.col("before") == "pass") & (F.col("after") == "fail"), "broken").otherwise("changed")
    )
    return a.join(b, list(keys), "full_outer").withColumn("change", said)


def adjacency_sets(gt: DataFrame, pred: DataFrame, mapping: DataFrame, key: Sequence[str] = ("capture_id",)) -> DataFrame:
    """(key, room_a, room_b, status): predicted pairs mapped to true rooms against the true pairs: correct, missing, extra, unmatched.

    gt, pred (key, room_a, room_b), mapping (key, pred_room, gt_room). Pairs have no direction.
    """
    keys = list(key)
    plain = lambda d: d.select(*keys, F.least("room_a", "room_b").alias("room_a"), F.greatest("room_a", "room_b").alias("room_b")).distinct()
    m = pred.where("room_a <> room_b")
    for s in ("a", "b"):
        m = m.join(mapping.select(*keys, F.col("pred_room").alias(f"room_{s}"), F.col("gt_room").alias(f"g{s}")), [*keys, f"room_{s}"], "left")
    lost = plain(m.where("ga IS NULL OR gb IS NULL"))
    mapped, true = plain(m.where("ga IS NOT NULL AND gb IS NOT NULL").select(*keys, F.col("ga").alias("room_a"), F.col("gb").alias("room_b"))), plain(gt)
    tag = lambda d, s: d.withColumn("status", F.lit(s))
    return tag(true.intersect(mapped), "correct").union(tag(true.exceptAll(mapped), "missing")).union(tag(mapped.exceptAll(true), "extra")).union(tag(lost, "unmatched"))
