"""Detections: decoding, tiles, surface plausibility, class votes, merged summaries, match statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bins import bin_of
from .quantiles import percentiles
from .shapes import noisy_or
from .windows import frame_median

#: Metres of wall in a bin of opening centres.
OPENING_BIN = 1.0


def decode(raw: DataFrame, phrases: DataFrame, thresholds: DataFrame, text_threshold: float, min_side: float = 4.0, max_share: float = 0.9) -> DataFrame:
    """(view_id, det_id, cls, score, x0 .. y1): the best class of each box over its class's threshold.

    raw (view_id, det_id, x0, y0, x1, y1, width, height), phrases (view_id,
    det_id, cls, phrase, score), thresholds (cls, least). A class scores as its
    best phrase; the box's best phrase must reach text_threshold. Boxes are
    cut to the image; those with a side under min_side pixels or over
    max_share of the image go.
    """
    votes = phrases.groupBy("view_id", "det_id", "cls").agg(F.max("score").alias("score"))
    best = votes.groupBy("view_id", "det_id").agg(F.max_by("cls", F.struct("score", F.col("cls"))).alias("cls"), F.max("score").alias("score"))
    best = best.join(thresholds, "cls").where((F.col("score") >= F.col("least")) & (F.col("score") >= text_threshold))
    cut = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0.0)), F.col(most).cast("double"))
    boxes = raw.withColumns({"x0": cut("x0", "width"), "x1": cut("x1", "width"), "y0": cut("y0", "height"), "y1": cut("y1", "height")})
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxes = boxes.where((w >= min_side) & (h >= min_side) & (w * h <= max_share * F.col("width") * F.col("height")))
    return boxes.join(best, ["view_id", "det_id"]).select("view_id", "det_id", "cls", "score", "x0", "y0", "x1", "y1")


def tiles(views: DataFrame, across: int = 2, overlap: float = 0.1) -> DataFrame:
    """(view_id, tile, tx0, ty0, tx1, ty1): a grid of across x across rectangles that overlap by a share of their side."""
    n = F.explode(F.sequence(F.lit(0), F.lit(across * across - 1)))
    v = views.withColumn("tile", n)
    i, j = F.col("tile") % across, F.floor(F.col("tile") / across)
    side = lambda k, size: (F.greatest(k * F.col(size) / across - overlap * F.col(size) / across, F.lit(0.0)), F.least((k + 1) * F.col(size) / across + overlap * F.col(size) / across, F.col(size).cast("double")))
    (x0, x1), (y0, y1) = side(i, "width"), side(j, "height")
    return v.select("view_id", "tile", x0.alias("tx0"), y0.alias("ty0"), x1.alias("tx1"), y1.alias("ty1"))


def from_tile(boxes: DataFrame) -> DataFrame:
    """Boxes in a tile's pixels as boxes in the image's; needs tx0 and ty0."""
    return boxes.withColumns({"x0": F.col("x0") + F.col("tx0"), "x1": F.col("x1") + F.col("tx0"), "y0": F.col("y0") + F.col("ty0"), "y1": F.col("y1") + F.col("ty0")})


def plausible(observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Observations whose class may be on their kind of surface, with the score and views the rule asks for.

    rules (cls, kind, allowed, min_score, min_views); no rule means no demand. observations (cls, kind, score, n_views, ..).
    """
    r = rules.select("cls", "kind", "allowed", "min_score", "min_views")
    ok = F.coalesce("allowed", F.lit(True)) & (F.col("score") >= F.coalesce("min_score", F.lit(0.0))) & (F.col("n_views") >= F.coalesce("min_views", F.lit(0)))
    return observations.join(F.broadcast(r), ["cls", "kind"], "left").where(ok).drop("allowed", "min_score", "min_views")


def cluster_classes(members: DataFrame, by: Sequence[str], obs: str) -> DataFrame:
    """(by, cls, votes): class with the largest sum of scores over a cluster, ties to the class of its best observation.

    members (by, obs, own_cls, own_score, cls, score): an observation's scores for several classes.
    """
    votes = members.groupBy(*by, "cls").agg(F.round(F.sum("score"), 9).alias("votes"))
    best = members.groupBy(*by).agg(F.max_by("own_cls", F.struct("own_score", F.col(obs))).alias("best"))
    ranked = votes.join(best, list(by)).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), (F.col("cls") == F.col("best")).desc(), "cls")))
    return ranked.where("_n = 1").select(*by, "cls", "votes")


def merged_damage(members: DataFrame, by: Sequence[str], obs: str, least_single: float = 0.5, pieces: float = 1.5) -> DataFrame:
    """One row a cluster: median sizes, united uv box, noisy-or of the best three; weak clusters of one view go.

    A crack's united extent replaces its median length if it is more than
    ``pieces`` times as long. members (by, obs, view_id, cls, score, area, width, height, length, u0, u1, v0, v1).
    """
    mid = lambda c: F.percentile(c, F.lit(0.5)).alias(c)
    g = members.groupBy(*by).agg(
        F.max_by("cls", F.struct("score", F.col(obs))).alias("cls"), F.countDistinct("view_id").alias("n_views"), *(mid(c) for c in ("area", "width", "height", "length")),
        F.min("u0").alias("u0"), F.max("u1").alias("u1"), F.min("v0").alias("v0"), F.max("v1").alias("v1"),
    )
    g = g.join(noisy_or(members, by, "score", 3, obs).select(*by, "score"), list(by)).where((F.col("n_views") > 1) | (F.col("score") >= least_single))
    span = F.greatest(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"))
    whole = (F.col("cls") == "crack") & (span > pieces * F.col("length"))
    return g.withColumns({"length": F.when(whole, span).otherwise(F.col("length")), "width": F.when(whole, F.col("u1") - F.col("u0")).otherwise(F.col("width")), "height": F.when(whole, F.col("v1") - F.col("v0")).otherwise(F.col("height"))})


def merged_objects(members: DataFrame, by: Sequence[str], obs: str) -> DataFrame:
    """One row a cluster: median position, most frequent room (ties by name), noisy-or of the best three."""
    rooms = members.where("room_id IS NOT NULL").groupBy(*by, "room_id").agg(F.count(F.lit(1)).alias("n"))
    room = rooms.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "room_id"))).where("_n = 1").select(*by, "room_id")
    g = members.groupBy(*by).agg(F.max_by("cls", F.struct("score", F.col(obs))).alias("cls"), F.countDistinct("view_id").alias("n_views"), F.percentile("x", F.lit(0.5)).alias("x"), F.percentile("y", F.lit(0.5)).alias("y"))
    return g.join(room, list(by), "left").join(noisy_or(members, by, "score", 3, obs).select(*by, "score"), list(by))


def statuses(matches: DataFrame, gt: DataFrame, pred: DataFrame, by: Sequence[str], gt_id: str, pred_id: str) -> DataFrame:
    """(by, gt_id, pred_id, status): every true and predicted item once, matched, missed or phantom."""
    m = matches.select(*by, gt_id, pred_id)
    matched = m.withColumn("status", F.lit("matched"))
    missed = gt.select(*by, gt_id).join(m, [*by, gt_id], "left_anti").withColumn("status", F.lit("missed"))
    phantom = pred.select(*by, pred_id).join(m, [*by, pred_id], "left_anti").withColumn("status", F.lit("phantom"))
    return matched.unionByName(missed, allowMissingColumns=True).unionByName(phantom, allowMissingColumns=True)


def opening_candidates(gt: DataFrame, pred: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs on one wall that may be the same opening: doors and passages are alike, centres within half the true width.

    gt (by, gt_id, type, centre, width), pred (by, pred_id, type, centre). cost is the distance of the centres.
    Sides meet in bins of OPENING_BIN along the wall, each pair in the one bin of its predicted centre.
    """
    kind = lambda c: F.when(c.isin("door", "opening"), "way").otherwise(c)
    g = gt.select(*by, "gt_id", kind(F.col("type")).alias("_kind"), F.col("centre").alias("_g"), F.col("width").alias("_w"))
    p = pred.select(*by, "pred_id", kind(F.col("type")).alias("_kind"), F.col("centre").alias("_p"))
    reach = F.col("_w") / 2 + 1e-6
    g = g.where(F.col("_g").isNotNull() & (reach >= 0)).withColumn("_bin", F.explode(F.sequence(bin_of(F.col("_g") - reach, OPENING_BIN), bin_of(F.col("_g") + reach, OPENING_BIN))))
    p = p.withColumn("_bin", bin_of(F.col("_p"), OPENING_BIN))
    pairs = g.join(p, [*by, "_kind", "_bin"]).withColumn("cost", F.abs(F.col("_g") - F.col("_p")))
    return pairs.where(F.col("cost") <= F.col("_w") / 2 + 1e-9).select(*by, "gt_id", "pred_id", "cost")


def damage_candidates(gt: DataFrame, pred: DataFrame, by: Sequence[str], tolerance: float = 0.1, penalty: float = 0.5) -> DataFrame:
    """Pairs on one surface whose boxes are at most ``tolerance`` apart in u and v; another class costs a penalty."""
    g = gt.select(*by, "gt_id", *(F.col(c).alias(f"_{c}") for c in ("cls", "u0", "u1", "v0", "v1")))
    p = pred.select(*by, "pred_id", "cls", "u0", "u1", "v0", "v1")
    gap = lambda a: F.greatest(F.greatest(F.col(f"{a}0"), F.col(f"_{a}0")) - F.least(F.col(f"{a}1"), F.col(f"_{a}1")), F.lit(0.0))
    mid = lambda a: (F.col(f"{a}0") + F.col(f"{a}1")) / 2 - (F.col(f"_{a}0") + F.col(f"_{a}1")) / 2
    cost = F.hypot(mid("u"), mid("v")) + F.when(F.col("cls") == F.col("_cls"), 0.0).otherwise(penalty)
    return g.join(p, list(by)).where((gap("u") <= tolerance) & (gap("v") <= tolerance)).select(*by, "gt_id", "pred_id", cost.alias("cost"))


def sharp_frames(frames: DataFrame, by: Sequence[str], order: str, sharpness: str, share: float = 0.35, reach: int | None = None) -> DataFrame:
    """Frames at least ``share`` of the median sharpness of their key, or of the frames within reach before and after."""
    if reach is None:
        mid = percentiles(frames, by, sharpness, {"_m": 0.5})
        return frames.join(mid, list(by)).where(F.col(sharpness) >= share * F.col("_m")).drop("_m")
    return frames.withColumn("_m", frame_median(by, [order], sharpness, reach)).where(F.col(sharpness) >= share * F.col("_m")).drop("_m")


def first_failure(checks: Sequence[tuple[str, Column]]) -> Column:
    """The name of the first check that does not hold, or null."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks))


def registration_verdict(rmse: str, overlap: str, dof: str, turn: str, shift: str) -> Column:
    """Why an ICP registration is not accepted: rmse < 0.02 m, overlap > 0.30, 4 or more constrained directions, at most 15 degrees and 1.5 m of motion."""
    c = F.col
    return first_failure([("rmse", c(rmse) < 0.02), ("overlap", c(overlap) > 0.30), ("dof", c(dof) >= 4), ("rotation", c(turn) <= 15), ("translation", c(shift) <= 1.5)])
