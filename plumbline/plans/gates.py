"""All gates as rows of one table, ranked failures, head-to-head, repeatability, rollups and the calibration table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.session import discard, fresh_path

from .evaluation import WORST, check_gate, error_gate, is_garbage, rate_gate

# What counts as a tie with another app, and its share, footprint tolerance.
LENGTH_TIE, AREA_TIE_POINTS, MIN_BEAT_OR_TIE, FOOTPRINT = 0.003, 0.2, 0.7, 0.08

COLUMNS = ("gate", "tier", "kind", "n", "measured", "pass_share", "status", "shortfall", "score", "worst")


def _row(df: DataFrame, gate: str, kind: str, **values: Column) -> DataFrame:
    """df (tier, n, worst array<string>, ..) as gate rows; status, pass_share, shortfall, score and measured come from values or from df."""
    said = {"gate": F.lit(gate), "kind": F.lit(kind), "worst": F.coalesce("worst", F.array().cast("array<string>"))} | values
    return df.select(*(said[c].alias(c) if c in said else F.col(c) for c in COLUMNS))


def error_rows(gate: str, items: DataFrame, allowed: Column) -> DataFrame:
    """Every item (tier, item, gt, err) within its allowance, missing ones fail. measured is the worst ratio of error to allowance."""
    g = error_gate(items, ["tier"], "item", allowed)
    names = F.transform("worst", lambda w: w["item"].cast("string"))
    reach = F.greatest(F.coalesce("worst_ratio", F.lit(0.0)), F.when(F.col("n_missing") > 0, 2.0).otherwise(0.0))
    return _row(g, gate, "error", measured=F.col("worst_ratio"), worst=names, shortfall=F.when(F.col("status") == "fail", reach).otherwise(0.0))


def rate_rows(gate: str, items: DataFrame, target: float) -> DataFrame:
    """The share of items (tier, item, status, err, allowed) within allowance reaches the target; misses and phantoms fail."""
    g = rate_gate(items, ["tier"], target)
    bad = items.where(~F.coalesce((F.col("status") == "matched") & (F.abs("err") <= F.col("allowed") + 1e-12), F.lit(False)))
    rank = F.when(F.col("status") == "matched", 0).when(F.col("status") == "missed", 1).otherwise(2)
    first = bad.withColumn("_n", F.row_number().over(Window.partitionBy("tier").orderBy(rank, "item"))).where(F.col("_n") <= WORST)
    worst = first.groupBy("tier").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"].cast("string")).alias("worst"))
    g = g.join(worst, "tier", "left")
    return _row(g, gate, "rate", measured=F.col("rate"), pass_share=F.col("rate"), status=F.col("verdict"), shortfall=F.greatest(target - F.col("rate"), F.lit(0.0)))


def check_rows(gate: str, items: DataFrame) -> DataFrame:
    """Every item (tier, item, ok) passes."""
    g = check_gate(items, ["tier"], "item")
    return _row(g, gate, "check", measured=F.col("pass_share"), status=F.col("verdict"), worst=F.transform("worst", lambda x: x.cast("string")), shortfall=1 - F.col("pass_share"), score=1 - F.col("pass_share"))


def calibration_rows(coverage: DataFrame, level: float = 0.9) -> DataFrame:
    """The binomial interval of each tier's coverage holds the level. coverage: tier rows of evaluation.coverage()."""
    low, high = F.col("ci.hi") < level, F.col("ci.lo") > level
    gap = F.when(low, level - F.col("ci.hi")).when(high, F.col("ci.lo") - level).otherwise(0.0)
    score = F.when(low, (1 - F.col("ci.hi")) / (1 - level) - 1).when(high, (F.col("ci.lo") - level) / (1 - level)).otherwise(0.0)
    g = coverage.withColumn("worst", F.array().cast("array<string>"))
    return _row(g, "calibration", "calibration", measured=F.col("coverage"), pass_share=F.col("coverage"), status=F.when(F.col("contains_nominal"), "pass").otherwise("fail"), shortfall=gap, score=score)


def garbage_rows(records: DataFrame, ratio: float = 2.0) -> DataFrame:
    """No miss of records (tier, item, covered, abs_err, half_width) is larger than ratio half-widths; the worst by their ratio."""
    bad = records.where(is_garbage(ratio))
    size = F.when(F.col("half_width") > 0, F.col("abs_err") / F.col("half_width")).otherwise(float("inf"))
    first = bad.withColumn("_n", F.row_number().over(Window.partitionBy("tier").orderBy(size.desc(), "item"))).where(F.col("_n") <= WORST)
    worst = first.groupBy("tier").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "item"))), lambda x: x["item"].cast("string")).alias("worst"))
    g = records.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum(is_garbage(ratio).cast("long")).alias("bad")).join(worst, "tier", "left")
    b = F.col("bad").cast("double")
    return _row(g, "confident_garbage", "count", measured=b, pass_share=1 - b / F.col("n"), status=F.when(b == 0, "pass").otherwise("fail"), shortfall=b, score=b)


def spread_rows(spreads: DataFrame, limit: float) -> DataFrame:
    """Spreads (tier, item, spread) of repeat captures stay within the limit; measured is the worst."""
    rows = check_rows("ceiling_spread", spreads.select("tier", "item", (F.col("spread") <= limit + 1e-12).alias("ok")))
    top = spreads.groupBy("tier").agg(F.max("spread").alias("top"))
    failed = F.col("status") == "fail"
    joined = rows.join(top, "tier")
    return joined.withColumns({"measured": F.col("top"), "shortfall": F.when(failed, F.col("top") / limit).otherwise(F.col("shortfall")), "score": F.when(failed, F.col("top") / limit - 1).otherwise(F.col("score"))}).select(*COLUMNS)


def repeat_rows(pairs: DataFrame) -> DataFrame:
    """Pairs (tier, item, delta, allowed, pass) of evaluation.repeat_pairs(): measured is the worst share of the allowance."""
    rows = check_rows("repeatability", pairs.select("tier", "item", F.col("pass").alias("ok")))
    top = pairs.groupBy("tier").agg(F.max(F.col("delta") / F.col("allowed")).alias("top"))
    failed = F.col("status") == "fail"
    joined = rows.join(top, "tier")
    return joined.withColumns({"measured": F.col("top"), "shortfall": F.when(failed, F.col("top")).otherwise(F.col("shortfall")), "score": F.when(failed, F.col("top") - 1).otherwise(F.col("score"))}).select(*COLUMNS)


def stitch_items(captures: DataFrame, max_overlap: float = 0.05, footprint: float = FOOTPRINT) -> DataFrame:
    """(tier, item, ok) of multi-room captures (tier, capture, status, missing, extra, unmatched, overlap, footprint_rel_err): adjacency exact, little overlap, footprint right."""
    exact = (F.col("missing") + F.col("extra") + F.col("unmatched")) == 0
    right = F.coalesce(F.abs("footprint_rel_err") <= footprint + 1e-12, F.lit(False))
    ok = (F.col("status") == "ok") & F.coalesce(exact, F.lit(False)) & (F.coalesce("overlap", F.lit(0.0)) <= max_overlap + 1e-12) & right
    return captures.select("tier", F.col("capture").alias("item"), ok.alias("ok"))


def ceiling_mode(accuracy: DataFrame, spread: DataFrame) -> DataFrame:
    """(tier, mode): whether ceilings are off by bias, spread, both or none, from items (tier, err, allowed) and gate rows of the spread."""
    a = accuracy.groupBy("tier").agg(F.count_if(F.abs("err") > F.col("allowed")).alias("off"), F.count_if(F.col("err").isNull()).alias("lost"))
    b = a.join(spread.select("tier", F.col("status").alias("spread")), "tier", "left")
    bias, wide = F.col("off") > 0, F.coalesce(F.col("spread") == "fail", F.lit(False))
    mode = F.when(bias & wide, "both").when(bias, "bias").when(wide, "spread").otherwise("none")
    lost = F.when(F.col("lost") > 0, F.concat(F.lit(" ("), F.col("lost"), F.when(F.col("lost") == 1, " room").otherwise(" rooms"), F.lit(" not found)"))).otherwise("")
    return b.select("tier", F.concat(mode, lost).alias("mode"))


def evaluate(rows: Sequence[DataFrame]) -> DataFrame:
    """All gate rows with ``rank``: failures by falling score, then gate and tier; null for what passed. Gates are few, so the ranking is one small task."""
    every = reduce(DataFrame.unionByName, rows)
    order = Window.partitionBy(F.col("status") == "fail").orderBy(F.desc("score"), "gate", "tier")
    return every.withColumn("rank", F.when(F.col("status") == "fail", F.row_number().over(order)))


def head_to_head(gt: DataFrame, ours: DataFrame, theirs: DataFrame, keys: Sequence[str] = ("room", "dimension")) -> DataFrame:
    """Dimensions that the truth and the other app have, with ours where there is one: errors, and beat_or_tie; none of ours is a loss.

    gt (keys, kind 'area' or 'length', gt), ours (keys, capture, tier, ours) with a row, maybe empty, for each room covered, theirs (keys, theirs).
    """
    k = list(keys)
    met = gt.where("gt > 0").join(theirs.where("theirs IS NOT NULL"), k).join(ours, k)
    a, b = F.abs(F.col("ours") - F.col("gt")), F.abs(F.col("theirs") - F.col("gt"))
    area = a / F.col("gt") * 100 <= b / F.col("gt") * 100 + AREA_TIE_POINTS + 1e-9
    won = F.when(F.col("kind") == "area", area).otherwise(a <= b + LENGTH_TIE + 1e-9)
    return met.withColumns({"ours_err": F.col("ours") - F.col("gt"), "theirs_err": F.col("theirs") - F.col("gt"), "beat_or_tie": F.coalesce(won, F.lit(False))})


def head_to_head_rows(dimensions: DataFrame, target: float = MIN_BEAT_OR_TIE) -> DataFrame:
    items = dimensions.select("tier", F.concat_ws("/", "room", "dimension").alias("item"), F.when(F.col("beat_or_tie"), "matched").otherwise("missed").alias("status"), F.lit(0.0).alias("err"), F.lit(0.0).alias("allowed"))
    return rate_rows("head_to_head", items, target)


def spreads(values: DataFrame, by: Sequence[str], capture: str, value: str) -> DataFrame:
    """(by, captures, spread): range of a value over the captures that have it, two at least."""
    g = values.where(F.col(value).isNotNull()).groupBy(*by).agg(F.countDistinct(capture).alias("captures"), (F.max(value) - F.min(value)).alias("spread"))
    return g.where("captures >= 2")


def same_structure(plans: DataFrame, by: Sequence[str], capture: str = "capture") -> DataFrame:
    """Pairs of captures of one room (by) with whether walls and openings are the same in number and in what they match.

    plans (by, capture, n_walls, n_openings, walls array, openings array), the
    arrays holding the true items matched. A room has as many pairs as its
    captures, a handful.
    """
    names = ("n_walls", "n_openings", "walls", "openings")
    side = lambda s: plans.select(*by, F.col(capture).alias(f"capture_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in names))
    p = side("a").join(side("b"), list(by)).where("capture_a < capture_b")
    same = lambda n, m: (F.col(f"{n}_a") == F.col(f"{n}_b")) & (F.array_sort(f"{m}_a") == F.array_sort(f"{m}_b"))
    return p.select(*by, "capture_a", "capture_b", same("n_walls", "walls").alias("same_walls"), same("n_openings", "openings").alias("same_openings"))


def status_counts(items: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, gt, pred, matched, missed, phantom, swaps): counters of matched items (by, status, gt_type, pred_type)."""
    n = lambda s: F.count_if(F.col("status") == s)
    swaps = F.count_if((F.col("status") == "matched") & (F.col("gt_type") != F.col("pred_type")))
    return items.groupBy(*by).agg((n("matched") + n("missed")).alias("gt"), (n("matched") + n("phantom")).alias("pred"), n("matched").alias("matched"), n("missed").alias("missed"), n("phantom").alias("phantom"), swaps.alias("swaps"))


def kind_records(parts: dict[str, DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(records, misses) of parts by kind, each (keys, gt, pred, lo, hi): one table of scored values, one of truths without a value."""
    from .evaluation import missing_items, score

    every = reduce(DataFrame.unionByName, [p.withColumn("kind", F.lit(k)).select("kind", *keys, "gt", "pred", "lo", "hi") for k, p in parts.items()])
    return score(every, ["kind", *keys]), missing_items(every, ["kind", *keys])


def stage_times(times: DataFrame, stages: Sequence[str], by: Sequence[str] = ("capture",)) -> DataFrame:
    """(by, a column a stage, total): seconds by stage; a stage that did not run is null."""
    wide = times.groupBy(*by).pivot("stage", list(stages)).agg(F.sum("seconds"))
    return wide.join(times.groupBy(*by).agg(F.sum("seconds").alias("total")), list(by))


def bias(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, bias): mean signed error."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("bias"))


def selected(captures: DataFrame, only: Sequence[str]) -> DataFrame:
    """Captures (property, capture) named by capture, property or property/capture; all of them without a name."""
    if not only:
        return captures
    names = list(only)
    return captures.where(F.col("capture").isin(names) | F.col("property").isin(names) | F.concat_ws("/", "property", "capture").isin(names))


class CalibrationTable:
    """Fitted multipliers by tier, in versions: a write never shows half a table, and the last whole one is read."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or fresh_path(spark, "calibration")

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        whole = lambda s: fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("v") and whole(s))

    def write(self, fit: DataFrame) -> None:
        """A new version of (tier, rooms, factor); the one before the last is deleted."""
        have = self._versions()
        fit.select("tier", "rooms", "factor").coalesce(1).write.parquet(f"{self.folder}/v{(have[-1] if have else 0) + 1}")
        for old in have[:-1]:
            discard(self.spark.read.parquet(f"{self.folder}/v{old}"))

    def read(self) -> DataFrame:
        have = self._versions()
        if not have:
            return self.spark.createDataFrame([], "tier string, rooms long, factor double")
        return self.spark.read.parquet(f"{self.folder}/v{have[-1]}")
