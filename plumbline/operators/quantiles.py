"""Weighted quantiles by several rules, robust spreads and trimmed means, per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import materialize, tasks_for

from .joins import hot_keys, join_few


#: Buckets of a group's range in one level of the search.
BUCKETS = 1024


def reach(df: DataFrame, by: Sequence[str], x: str, w: str, goals: DataFrame, levels: int = 2) -> DataFrame:
    """(by, _g, hit): for each goal (by, _g, _goal) the first value whose cumulated weight reaches it; none if none does.

    A group's range is cut into buckets whose weights are summed partially;
    only the bucket that holds the answer goes on, and is cut again. What is
    cumulated value by value, in one task a group, is one bucket of the last
    level; the rest are sums of at most BUCKETS rows. Distinct values and
    each level's answer are written, so nothing is computed twice. A hot key's
    values are not brought together to learn its range or its answer.
    """
    spark = df.sparkSession
    with tasks_for(spark, df.count()):
        return _reach(df, by, x, w, goals, levels)


def _reach(df: DataFrame, by: Sequence[str], x: str, w: str, goals: DataFrame, levels: int) -> DataFrame:
    keys, last = list(by), [*by, "_g"]
    rows = df.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).alias("_x")).agg(F.sum(w).alias("_w"))
    upto = lambda k, order: Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = materialize(rows, "values")
    hot = hot_keys(rows, by)
    found = join_few(rows, rows.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), keys, hot)
    for level in range(levels):
        place = F.floor((F.col("_x") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * BUCKETS)
        binned = found.withColumn("_b", F.coalesce(F.least(place, F.lit(BUCKETS - 1)), F.lit(0)))
        sums = binned.groupBy(*keys, "_b").agg(F.sum("_w").alias("_bw"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), *([F.first("_goal").alias("_goal")] if level else []))
        sums = sums.withColumn("_cw", F.sum("_bw").over(upto(keys, "_b")))
        sums = sums if level else sums.join(goals, keys)
        rest = F.struct("_lo", "_hi", (F.col("_goal") - (F.col("_cw") - F.col("_bw"))).alias("_goal"))
        at = materialize(sums.where("_cw >= _goal").groupBy(*last).agg(F.min_by(rest, "_b").alias("_at")).select(*last, "_at.*"), "buckets")
        found = join_few(rows, at, by, hot).where("_x >= _lo AND _x <= _hi")
        keys = last
    hits = found.withColumn("_cw", F.sum("_w").over(upto(last, "_x"))).where("_cw >= _goal").groupBy(*last).agg(F.min("_x").alias("hit"))
    return materialize(hits, "hits")


def percentiles(df: DataFrame, by: Sequence[str], x: str, qs: dict[str, float], times: str | None = None) -> DataFrame:
    """(by, a column for each of qs): exact percentiles, linear between neighbours, by reach(); no group's values meet in one task.

    A row counts once, or ``times`` times.
    """
    df = df.withColumn("_one", F.col(times).cast("double") if times else F.lit(1.0))
    numbers = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sum("_one").cast("long").alias("_n"))
    place = lambda q: F.lit(float(q)) * (F.col("_n") - 1)
    named = list(qs.items())
    wanted = F.explode(F.array(*(F.struct(F.lit(2 * i + k).alias("_g"), F.least(F.floor(place(q)) + 1 + k, F.col("_n")).cast("double").alias("_goal")) for i, (_, q) in enumerate(named) for k in (0, 1))))
    goals = numbers.select(*by, wanted.alias("_s")).select(*by, "_s.*")
    found = reach(df, by, x, "_one", goals)
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("_g") == g, F.col("hit"))).alias(f"_h{g}") for g in range(2 * len(named)))).join(numbers, list(by))
    line = lambda i, q: F.col(f"_h{2 * i}") + (place(q) - F.floor(place(q))) * (F.col(f"_h{2 * i + 1}") - F.col(f"_h{2 * i}"))
    return wide.select(*by, *(line(i, q).alias(name) for i, (name, q) in enumerate(named)))


def weighted_quantile_step(df: DataFrame, by: Sequence[str], x: str, w: str, q: float = 0.5, out: str = "q") -> DataFrame:
    """The first value whose cumulated weight reaches q of the whole; the median of values where no weight is positive."""
    totals = materialize(df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.sum(w).alias("_all")), "totals")
    goals = totals.where("_all > 0").select(*by, F.lit(0).alias("_g"), (q * F.col("_all")).alias("_goal"))
    hit = reach(df, by, x, w, goals).select(*by, F.col("hit").alias(out))
    light = totals.where("NOT _all > 0").select(*by)
    if light.isEmpty():
        return hit
    rest = df.join(light, list(by)).where(F.col(x).isNotNull()).select(*by, x).distinct()
    return hit.union(percentiles(rest, by, x, {out: 0.5}))


def weighted_quantile_of_small_groups(df: DataFrame, by: Sequence[str], x: str, w: str, q: float = 0.5, out: str = "q") -> DataFrame:
    """As weighted_quantile_step, in one window over each group's distinct values, for many groups of which each fits a task."""
    steps = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.sum(w).alias("_w"))
    run = steps.withColumn("_cw", F.sum("_w").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*by)))
    hit = F.min(F.when(F.col("_cw") >= q * F.col("_all"), F.col(x)))
    return run.groupBy(*by).agg(F.when(F.max("_all") > 0, hit).otherwise(F.percentile(x, F.lit(0.5))).alias(out))


def centred_quantiles(df: DataFrame, by: Sequence[str], asks: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(by, a column for each of asks: value, weight, q): quantiles with each sample's weight centred on it.

    Linear between samples, at most half a step beyond the ends; where no
    weight is positive, the median. Null values do not count. All asks are
    searched in the same jobs by reach(): the value whose cumulated weight
    reaches the goal, then the weight below it and its neighbours, which are
    partial aggregates. No group's values meet in one task.
    """
    with tasks_for(df.sparkSession, df.count()):
        return _centred_quantiles(df, by, asks)


def _centred_quantiles(df: DataFrame, by: Sequence[str], asks: dict[str, tuple[str, str, float]]) -> DataFrame:
    keys = list(by)
    pairs = sorted({(x, w) for x, w, _ in asks.values()})
    goal = {out: (pairs.index((x, w)), q) for out, (x, w, q) in asks.items()}
    listed = F.array(*(F.struct(F.lit(k).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(w).cast("double").alias("_w")) for k, (x, w) in enumerate(pairs)))
    samples = df.select(*by, F.explode(listed).alias("_s")).select(*by, "_s.*").where("_x IS NOT NULL AND _w IS NOT NULL")
    values = samples.groupBy(*by, "_k", "_x").agg(F.sum("_w").alias("_w"), F.min("_w").alias("_first"), F.max("_w").alias("_last"), F.count(F.lit(1)).alias("_m"))
    values = materialize(values, "samples")
    totals = values.groupBy(*by, "_k").agg(F.sum("_w").alias("_all"), F.sum("_m").alias("_n"))
    heavy = F.col("_all") > 0
    hot = hot_keys(values, [*keys, "_k"])
    own = join_few(values, totals, [*keys, "_k"], hot).withColumns({"_w": F.when(heavy, F.col("_w")).otherwise(F.col("_m")), "_first": F.when(heavy, F.col("_first")).otherwise(1.0), "_last": F.when(heavy, F.col("_last")).otherwise(1.0)})
    asked = F.array(*(F.struct(F.lit(g).alias("_g"), F.lit(k).alias("_of"), F.lit(float(q)).alias("_q")) for g, (k, q) in enumerate(goal.values())))
    place = F.when(heavy, F.col("_q") * F.col("_all")).otherwise(0.5 * F.col("_n"))
    goals = totals.select("*", F.explode(asked).alias("_s")).select(*by, "_k", "_all", "_n", "_s.*").where("_k = _of").select(*by, "_k", "_g", "_n", place.alias("_at"))
    # a hair below the goal, so that rounding never leaves the whole weight short of it
    hits = reach(own, [*keys, "_k"], "_x", "_w", goals.select(*by, "_k", "_g", (F.col("_at") * (1 - 1e-12)).alias("_goal")))
    met = join_few(own.select(*by, "_k", "_x", "_w", "_first", "_last", "_m"), goals.join(hits, [*keys, "_k", "_g"]), [*keys, "_k"], hot)
    below, here, above = F.col("_x") < F.col("hit"), F.col("_x") == F.col("hit"), F.col("_x") > F.col("hit")
    near = met.groupBy(*by, "_g", "_n", "_at", "hit").agg(
        F.coalesce(F.sum(F.when(below, F.col("_w"))), F.lit(0.0)).alias("_s"), F.max(F.when(below, F.struct("_x", "_last"))).alias("_p"),
        F.max(F.when(here, F.struct("_w", "_first", "_last", "_m"))).alias("_h"), F.min(F.when(above, F.struct("_x", "_first"))).alias("_o"),
    )
    near = materialize(near, "near")
    c = F.col
    t, x = c("_at"), c("hit")
    low, high = c("_s") + c("_h._first") / 2, c("_s") + c("_h._w") - c("_h._last") / 2  # the places of the first and the last sample at hit
    prev, after = c("_s") - c("_p._last") / 2, c("_s") + c("_h._w") + c("_o._first") / 2
    line = lambda at, x0, x1, c0, c1: F.coalesce(x0 + (at - c0) * (x1 - x0) / F.nullif(c1 - c0, F.lit(0.0)), x1)
    single = c("_h._m") == 1
    first = F.when(single & c("_o").isNotNull(), F.greatest(line(t, x, c("_o._x"), low, after), x - (c("_o._x") - x) / 2)).otherwise(x)
    last = F.when(single & c("_p").isNotNull(), F.least(line(t, c("_p._x"), x, prev, low), x + (x - c("_p._x")) / 2)).otherwise(x)
    under = F.when(c("_p").isNotNull(), line(t, c("_p._x"), x, prev, low)).otherwise(first)
    over = F.when(c("_o").isNotNull(), line(t, x, c("_o._x"), high, after)).otherwise(last)
    value = F.when(c("_n") == 1, x).when(t < low, under).when(t < high, x).otherwise(over)
    return near.groupBy(*by).agg(*(F.max(F.when(c("_g") == g, value)).alias(out) for g, out in enumerate(goal)))


def weighted_quantile_centred(df: DataFrame, by: Sequence[str], x: str, w: str, q: float, out: str = "q") -> DataFrame:
    """As centred_quantiles, of one quantile."""
    return centred_quantiles(df, by, {out: (x, w, q)})


def widened(lo: Column, hi: Column, q_lo: float, q_hi: float) -> tuple[Column, Column]:
    """The range between two quantiles, widened to the full span of an even spread."""
    half, centre = (hi - lo) / 2 / (q_hi - q_lo), (lo + hi) / 2
    return centre - half, centre + half


def robust_extent(df: DataFrame, by: Sequence[str], x: str, w: str, q_lo: float, q_hi: float) -> DataFrame:
    """(lo, hi): the range between two centred quantiles, widened to the full span of an even spread."""
    ends = centred_quantiles(df, by, {"a": (x, w, q_lo), "b": (x, w, q_hi)})
    lo, hi = widened(F.col("a"), F.col("b"), q_lo, q_hi)
    return ends.select(*by, lo.alias("lo"), hi.alias("hi"))


def unit_equal_quantile(df: DataFrame, by: Sequence[str], unit: str, score: str, p: Column | float, out: str = "q") -> DataFrame:
    """As unit_equal_quantiles, of one quantile."""
    return unit_equal_quantiles(df, by, unit, score, {out: p})


def unit_equal_quantiles(df: DataFrame, by: Sequence[str], unit: str, score: str, ps: dict[str, Column | float]) -> DataFrame:
    """(by, a column for each of ps): quantiles of scores where every unit weighs the same, split evenly over its records.

    A p is a number or a column of df that is the same for all rows of a
    group; above 1 the answer is infinite. The first score with cumulated
    weight >= p - 1e-9.
    """
    keys = list(by)
    own = df.where(F.col(score).isNotNull()).withColumns({f"_p{i}": F.lit(float(p)) if isinstance(p, (int, float)) else p for i, p in enumerate(ps.values())})
    # equal scores of a unit are one row before the weights are joined to them
    held = materialize(own.groupBy(*by, unit, score).agg(F.count(F.lit(1)).alias("_k"), *(F.max(f"_p{i}").alias(f"_p{i}") for i in range(len(ps)))), "scores")
    units = held.groupBy(*by, unit).agg(F.sum("_k").alias("_in"))
    counts = units.groupBy(*by).agg(F.count(F.lit(1)).alias("_units"))
    weights = join_few(units, counts, keys, hot_keys(units, keys)).select(*by, unit, (1 / (F.col("_units") * F.col("_in"))).alias("_uw"))
    weighed = held.join(weights, [*by, unit]).withColumn("_w", F.col("_k") * F.col("_uw"))
    tops = held.groupBy(*by).agg(F.max(score).alias("_top"), *(F.max(f"_p{i}").alias(f"_p{i}") for i in range(len(ps))))
    goals = tops.select(*by, F.explode(F.array(*(F.struct(F.lit(i).alias("_g"), (F.col(f"_p{i}") - 1e-9).alias("_goal")) for i in range(len(ps))))).alias("_s")).select(*by, "_s.*")
    hits = reach(weighed, by, score, "_w", goals).groupBy(*by).agg(*(F.max(F.when(F.col("_g") == i, F.col("hit"))).alias(f"_h{i}") for i in range(len(ps))))
    found = tops.join(hits, keys, "left")
    value = lambda i: F.when(F.col(f"_p{i}") > 1, F.lit(float("inf"))).otherwise(F.coalesce(f"_h{i}", "_top"))
    return found.select(*by, *(value(i).alias(out) for i, out in enumerate(ps)))


def robust_sigma(df: DataFrame, by: Sequence[str], x: str, out: str = "sigma") -> DataFrame:
    """1.4826 times the median absolute deviation from the group's median."""
    with tasks_for(df.sparkSession, df.count()):
        values = materialize(df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_times")), "values")
    middle = percentiles(values, by, x, {"_m": 0.5}, "_times")
    own = join_few(values, middle, by, hot_keys(values, by)).withColumn("_d", F.abs(F.col(x) - F.col("_m")))
    return percentiles(own, by, "_d", {"_s": 0.5}, "_times").select(*by, (1.4826 * F.col("_s")).alias(out))


def fallback_extent(df: DataFrame, by: Sequence[str], x: str, y: str, on_floor: str, least: int = 100, side: float = 0.5) -> DataFrame:
    """(by, x0, x1, y0, y1): the 2 to 98 percent range of the floor's points, of all where the floor has fewer than ``least``; none with a side under ``side``."""
    floor = df.groupBy(*by).agg((F.count_if(F.col(on_floor)) >= least).alias("_enough"))
    own = join_few(df, floor, by, hot_keys(df, by)).where(F.col(on_floor) | ~F.col("_enough"))
    ranges = percentiles(own, by, x, {"x0": 0.02, "x1": 0.98}).join(percentiles(own, by, y, {"y0": 0.02, "y1": 0.98}), list(by))
    return ranges.where((F.col("x1") - F.col("x0") >= side) & (F.col("y1") - F.col("y0") >= side))


def trimmed_mean(df: DataFrame, by: Sequence[str], x: str, w: str, start: str, window: float, rounds: int = 4, low: float = 0.015, high: float = 0.12) -> DataFrame:
    """Weighted mean of the samples in a window that follows their robust spread.

    df carries a first centre per row in ``start``. Each round takes the mean
    of the samples within the window, and 2.5 robust sigmas, held between low
    and high, as the next window; a group with fewer than three samples
    inside stays as it is. Rounds are a fixed number of aggregates, so every
    group, one wall's samples, advances in the same jobs.
    """
    keys, spark = list(by), df.sparkSession
    with tasks_for(spark, df.count()):
        return _trimmed_mean(df, keys, x, w, start, window, rounds, low, high)


def _trimmed_mean(df: DataFrame, by: list[str], x: str, w: str, start: str, window: float, rounds: int, low: float, high: float) -> DataFrame:
    state = materialize(df.groupBy(*by).agg(F.first(start).alias("c"), F.lit(float(window)).alias("win")), "window")
    # equal samples are one row, so rounds read no more than a group's values
    values = materialize(df.groupBy(*by, x).agg(F.sum(w).alias("_vw"), F.count(F.lit(1)).alias("_m")), "values")
    hot = hot_keys(values, by)
    for _ in range(rounds):
        inside = join_few(values, state, by, hot).where(F.abs(F.col(x) - F.col("c")) < F.col("win"))
        mean = inside.groupBy(*by).agg(F.sum("_m").alias("_n"), F.sum("_vw").alias("_w"), (F.sum(F.col(x) * F.col("_vw")) / F.nullif(F.sum("_vw"), F.lit(0.0))).alias("_c"))
        mean = mean.where("_n >= 3 AND _w > 0")
        spread = weighted_quantile_of_small_groups(join_few(inside, mean.drop("_w"), by, hot).withColumn("_d", F.abs(F.col(x) - F.col("_c"))), by, "_d", "_vw", 0.5, "_s")
        step = mean.join(spread, by).select(*by, "_c", F.least(F.greatest(2.5 * 1.4826 * F.col("_s"), F.lit(low)), F.lit(high)).alias("_win"))
        state = materialize(state.join(step, by, "left").select(*by, F.coalesce("_c", "c").alias("c"), F.coalesce("_win", "win").alias("win")), "window")
    return state


# Shortest focal length over the long side that the capture protocol allows, and log distance that is a mismatch.
MIN_FOCAL, FOCAL_MISMATCH = 0.6, 0.1


def median_ratio(df: DataFrame, by: Sequence[str], a: str, b: str, least: int) -> DataFrame:
    """(by, n, ratio): median of a / b over rows that have both, for keys with ``least`` of them."""
    own = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(b) != 0)).withColumn("_r", F.col(a) / F.col(b))
    n = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return n.join(percentiles(own, by, "_r", {"ratio": 0.5}), list(by))


def focal_check(views: DataFrame, reference: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, focal, kind, sigma_log): median focal length over the long side against the camera's own, else against the shortest allowed.

    views (by, focal), reference (by, reference or null). sigma_log is the log
    distance where it is too large, else 0.
    """
    g = percentiles(views, by, "focal", {"focal": 0.5}).join(reference, list(by), "left")
    known = F.coalesce(F.col("reference") > 0, F.lit(False))
    off = F.abs(F.log(F.col("focal") / F.col("reference")))
    sigma = F.when(known, F.when(off > FOCAL_MISMATCH, off).otherwise(0.0)).when(F.col("focal") < MIN_FOCAL, F.log(MIN_FOCAL / F.col("focal"))).otherwise(0.0)
    return g.select(*by, "focal", F.when(known, "exif").otherwise("protocol_min").alias("kind"), sigma.alias("sigma_log"))
