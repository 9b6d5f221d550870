"""Drift of captures: segments, loop closures in rounds, level floors, and corrections spread over the keyframes.

All captures go through the same rounds: pairs of segments that lie apart in
time and overlap in space are registered, accepted registrations join the
odometry as constraints, and the pose graphs are solved; later rounds start
from corrected poses and find pairs that drift had hidden.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.kernels.greedy import top_with_quota
from plumbline.session import materialize

from .bins import bin_of, voxel_plain
from .posegraph import optimise, yaw_freedom
from .registration import moved, register, rows, typed
from .walls import floor_levels

# Seconds of a segment, voxel, speed and length of a jump, gap in time of a loop, cell and share of the screen, loops of
# a segment and of a capture in a round, rounds; how far below its camera a floor lies, from the common level, from its neighbours.
SECONDS, VOXEL, SPEED, LEAP, GAP, CELL, SCREEN, QUOTA, MOST, ROUNDS = 3.0, 0.05, 3.0, 0.15, 20.0, 0.3, 0.3, 2, 60, 2
BELOW, STOREY, NEIGHBOURS, OUTLIER, FLOOR_SIGMA = (0.5, 2.2), 0.6, 3, 0.10, 0.01


def inverse(pose: Column) -> Column:
    """The inverse of a rigid 4 x 4 transform of 16 numbers row by row."""
    m = lambda i, j: F.get(pose, F.lit(4 * i + j))
    back = [[m(j, i) for j in range(3)] for i in range(3)]
    shift = [-sum((back[i][j] * m(j, 3) for j in range(3)), F.lit(0.0)) for i in range(3)]
    return F.array(*(v for i in range(3) for v in (*back[i], shift[i])), *(F.lit(float(k == 3)) for k in range(4)))


def product(a: Column, b: Column) -> Column:
    """The product of two 4 x 4 matrices of 16 numbers row by row."""
    at = lambda m, i, j: F.get(m, F.lit(4 * i + j))
    return F.array(*(sum((at(a, i, k) * at(b, k, j) for k in range(4)), F.lit(0.0)) for i in range(4) for j in range(4)))


def segments(keyframes: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(frames, segments): keyframes (by, frame, t, pose) with their segment, and (by, segment, t, pose, path, jumped).

    A segment is SECONDS long and ends where the camera leaps. Its pose is that
    of the keyframe nearest its middle; path and jumped are the length of the
    way from there to the next segment's, and whether a leap lies between.
    """
    keys, c = list(by), F.col
    order = Window.partitionBy(*by).orderBy("t", "frame")
    at = lambda k: F.get("pose", F.lit(k))
    step = F.sqrt(sum(((at(k) - F.lag(at(k)).over(order)) ** 2 for k in (3, 7, 11)), F.lit(0.0)))
    k = keyframes.select(*keys, "frame", c("t").cast("double").alias("t"), "pose").withColumns({"step": F.coalesce(step, F.lit(0.0)), "dt": F.greatest(c("t") - F.lag("t").over(order), F.lit(1e-3))})
    k = k.withColumn("leap", F.coalesce((c("step") / c("dt") > SPEED) & (c("step") > LEAP), F.lit(False)).cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    k = k.withColumns({"way": F.sum("step").over(upto), "leaps": F.sum("leap").over(upto), "slot": F.floor((c("t") - F.min("t").over(Window.partitionBy(*by))) / SECONDS)})
    k = materialize(k.withColumn("segment", (F.dense_rank().over(Window.partitionBy(*by).orderBy("leaps", "slot")) - 1).cast("long")), "keyframes")
    mid = k.groupBy(*by, "segment").agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
    own = k.join(mid, [*keys, "segment"]).groupBy(*by, "segment").agg(F.min_by(F.struct("t", "pose", "way", "leaps"), F.struct(F.abs(c("t") - c("mid")), "t", "frame")).alias("a"))
    following = Window.partitionBy(*by).orderBy("segment")
    s = own.select(*keys, "segment", "a.t", "a.pose", (F.lead("a.way").over(following) - c("a.way")).alias("path"), (F.lead("a.leaps").over(following) > c("a.leaps")).alias("jumped"))
    return k.select(*keys, "frame", "t", "pose", "segment"), materialize(s, "segments")


def segment_clouds(frames: DataFrame, segs: DataFrame, points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, segment, x, y, z, nx, ny, nz): points (by, frame, x, y, z, nx, ny, nz in the camera's frame) of a segment in its own, thinned to voxels."""
    keys, c = list(by), F.col
    to = frames.join(segs.select(*keys, "segment", c("pose").alias("_own")), [*keys, "segment"]).select(*keys, "frame", "segment", product(inverse(c("_own")), c("pose")).alias("_t"))
    p = points.join(to, [*keys, "frame"])
    at = dict(zip("xyz", moved(c("_t"), c("x"), c("y"), c("z")))) | dict(zip(("nx", "ny", "nz"), moved(c("_t"), c("nx"), c("ny"), c("nz"), True)))
    thin = voxel_plain(p.select(*keys, "segment", *(v.alias(k) for k, v in at.items())), VOXEL, ["nx", "ny", "nz"], [*keys, "segment"])
    size = F.sqrt(c("nx") ** 2 + c("ny") ** 2 + c("nz") ** 2)
    return thin.withColumn("_s", size).where("_s > 1e-6").select(*keys, "segment", "x", "y", "z", *((c(k) / F.nullif(c("_s"), F.lit(0.0))).alias(k) for k in ("nx", "ny", "nz")))


def placed(clouds: DataFrame, poses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Clouds of segments under the poses (by, segment, pose)."""
    keys, c = list(by), F.col
    p = clouds.join(poses.select(*keys, "segment", c("pose").alias("_t")), [*keys, "segment"])
    at = dict(zip("xyz", moved(c("_t"), c("x"), c("y"), c("z")))) | dict(zip(("nx", "ny", "nz"), moved(c("_t"), c("nx"), c("ny"), c("nz"), True)))
    return p.select(*keys, "segment", *(v.alias(k) for k, v in at.items()))


def loop_candidates(world: DataFrame, times: DataFrame, by: Sequence[str], done: DataFrame | None = None) -> DataFrame:
    """(by, i, j, share): segments more than GAP seconds apart of which the later one's points lie in cells next to the earlier one's, best first by quota, and the first with the last.

    times (by, segment, t); pairs of ``done`` (by, i, j) are left out.
    """
    keys, c = list(by), F.col
    cells = materialize(world.groupBy(*keys, "segment", *(bin_of(c(a), CELL).alias(f"c{a}") for a in "xyz")).agg(F.count(F.lit(1)).alias("n")), "cells")
    wide = cells.select(*keys, c("segment").alias("i"), *(f"c{a}" for a in "xyz"))
    for a in "xyz":
        wide = wide.withColumn(f"c{a}", F.explode(F.array(*(c(f"c{a}") + d for d in (-1, 0, 1)))))
    met = cells.withColumnRenamed("segment", "j").join(wide.distinct(), [*keys, "cx", "cy", "cz"]).where("i < j")
    total = cells.groupBy(*keys, c("segment").alias("j")).agg(F.sum("n").alias("_all"))
    share = met.groupBy(*keys, "i", "j").agg(F.sum("n").alias("_n")).join(total, [*keys, "j"]).withColumn("share", c("_n") / c("_all"))
    when = lambda s: times.select(*keys, c("segment").alias(s), c("t").alias(f"t{s}"))
    far = share.join(when("i"), [*keys, "i"]).join(when("j"), [*keys, "j"]).where((c("tj") - c("ti") > GAP) & (c("share") > SCREEN) & (c("_all") >= 50)).select(*keys, "i", "j", "share")
    if done is not None:
        far = far.join(done, [*keys, "i", "j"], "left_anti")
    best = top_with_quota(far, keys, "share", ("i", "j"), QUOTA, MOST, either=True)
    ends = times.groupBy(*keys).agg(F.min("segment").alias("i"), F.max("segment").alias("j")).where("i < j").withColumn("share", F.lit(0.0))
    ends = ends.join(best.select(*keys, "i", "j"), [*keys, "i", "j"], "left_anti")
    if done is not None:
        ends = ends.join(done, [*keys, "i", "j"], "left_anti")
    return best.union(ends)


def floor_rules(world: DataFrame, poses: DataFrame, by: Sequence[str]) -> DataFrame:
    """Constraints that put segments' floors on the common level: the lowest level below a camera that agrees with its neighbours in time."""
    keys, c = list(by), F.col
    cam = poses.select(*keys, "segment", F.get("pose", F.lit(11)).alias("_cam"))
    under = world.join(cam, [*keys, "segment"]).where((c("_cam") - c("z")).between(*BELOW)).withColumn("w", F.lit(1.0))
    own = materialize(floor_levels(under, [*keys, "segment"], least=50).select(*keys, "segment", "z", "n"), "floors")
    near = own.join(own.select(*keys, c("segment").alias("_s"), c("z").alias("_z")), keys).where(F.abs(c("segment") - c("_s")) <= NEIGHBOURS)
    good = near.groupBy(*keys, "segment", "z", "n").agg(F.median("_z").alias("_m")).where(F.abs(c("z") - c("_m")) <= OUTLIER)
    level = good.groupBy(*keys).agg(F.median("z").alias("_level"))
    g = good.join(level, keys).where(F.abs(c("z") - c("_level")) < STOREY).join(cam, [*keys, "segment"])
    zero = F.lit(0.0)
    return g.select(*keys, c("segment").alias("a"), F.lit(None).cast("long").alias("b"), F.lit("z").alias("kind"), F.array(zero, zero, zero, c("_cam") + c("_level") - c("z")).alias("m"), F.array(F.lit(FLOOR_SIGMA)).alias("s"))


def correct_drift(keyframes: DataFrame, points: DataFrame, by: Sequence[str], loop_closure: bool = True, plane_anchoring: bool = True, loop_rounds: int = ROUNDS, steps: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(poses, tried, record) of each capture.

    keyframes (by, frame, t, pose: camera to world, z up, as 16 numbers),
    points (by, frame, x, y, z, nx, ny, nz) in their camera's frame. poses
    (by, frame, t, pose, yaw, dx, dy, dz): corrected, with the correction, which
    is interpolated in time between segments and held at the ends. tried (by,
    round, i, j, share, rmse, overlap, dof, reason): every registration. record
    (by, segments, tried, accepted, anchored, largest_shift, largest_turn,
    loop_closure, plane_anchoring). A registration takes ``steps`` at most.
    Corrections are turns about the vertical and
    shifts; a capture of one segment, or without points, stays as it is.
    """
    keys, c = list(by), F.col
    frames, segs = segments(keyframes, keys)
    clouds = materialize(segment_clouds(frames, segs, points, keys), "clouds")
    nodes = segs.select(*keys, c("segment").alias("node"), "pose")
    turn = F.when(c("jumped"), math.radians(10.0)).otherwise(F.radians(0.15 + 0.1 * c("path")))
    shift = F.when(c("jumped"), 0.5).otherwise(0.01 + 0.01 * c("path"))
    after = segs.select(*keys, (c("segment") - 1).alias("segment"), c("pose").alias("_next"))
    rules = segs.join(after, [*keys, "segment"]).select(*keys, c("segment").alias("a"), (c("segment") + 1).alias("b"), F.lit("relative").alias("kind"), product(inverse(c("pose")), c("_next")).alias("m"), F.array(turn, shift, F.lit(1.0)).alias("s"))
    rules = materialize(rules, "odometry")
    poses = segs.select(*keys, "segment", "pose")
    solved = lambda rules: materialize(optimise(yaw_freedom(nodes, rules, keys), rules, keys, "yaw", most=10, tolerance=1e-6)[0].withColumnRenamed("node", "segment"), "corrected")
    state, tried, done = None, None, None
    for n in range(loop_rounds if loop_closure else 0):
        world = materialize(placed(clouds, poses, keys), "world")
        pairs = materialize(loop_candidates(world, segs, keys, done), "candidates")
        if pairs.isEmpty():
            break
        found = materialize(register(world, pairs.select(*keys, c("j").alias("a"), c("i").alias("b")), keys, steps), "registered")
        more = found.select(*keys, F.lit(n + 1).alias("round"), c("b").alias("i"), c("a").alias("j"), "rmse", "overlap", "dof", "reason").join(pairs, [*keys, "i", "j"])
        tried = more if tried is None else tried.unionByName(more)
        good = found.where("reason IS NULL")
        if good.isEmpty():
            break
        at = lambda s: poses.select(*keys, c("segment").alias(s), c("pose").alias(f"_{s}"))
        loops = good.join(at("a"), [*keys, "a"]).join(at("b"), [*keys, "b"])
        loops = loops.select(*keys, c("b").alias("a"), c("a").alias("b"), F.lit("loop").alias("kind"), F.concat("transform", "centre", "_b", "_a").alias("m"), c("info").alias("s"))
        rules = materialize(rules.union(loops), "rules")
        fresh = good.select(*keys, c("b").alias("i"), c("a").alias("j"))
        done = materialize(fresh if done is None else done.union(fresh), "done")
        state = solved(rules)
        poses = state.select(*keys, "segment", "pose")
    anchored = None
    if plane_anchoring:
        level = materialize(floor_rules(placed(clouds, poses, keys), poses, keys), "levels")
        anchored = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("anchored"))
        if not level.isEmpty():
            state = solved(materialize(rules.union(level), "rules"))
    zero = F.array(*(F.lit(0.0) for _ in range(4)))
    fixes = segs.select(*keys, "segment", "t").join(state.select(*keys, "segment", "x"), [*keys, "segment"], "left") if state is not None else segs.select(*keys, "segment", "t", zero.alias("x"))
    following = Window.partitionBy(*keys).orderBy("segment")
    fixes = fixes.withColumn("x", F.coalesce("x", zero)).withColumns({"_t0": F.lag("t").over(following), "_x0": F.lag("x").over(following), "_t1": F.lead("t").over(following), "_x1": F.lead("x").over(following)}).withColumnRenamed("t", "_t")
    f = frames.join(fixes, [*keys, "segment"])
    late = c("t") >= c("_t")
    other, when_ = F.when(late, c("_x1")).otherwise(c("_x0")), F.when(late, c("_t1")).otherwise(c("_t0"))
    share = F.coalesce(F.least((c("t") - c("_t")) / F.nullif(when_ - c("_t"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    near = lambda k: F.get("x", F.lit(k)) + share * (F.coalesce(F.get(other, F.lit(k)), F.get("x", F.lit(k))) - F.get("x", F.lit(k)))
    f = f.withColumns({"yaw": near(0), "dx": near(1), "dy": near(2), "dz": near(3)})
    cos, sin, o, i = F.cos("yaw"), F.sin("yaw"), F.lit(0.0), F.lit(1.0)
    poses = materialize(f.select(*keys, "frame", "t", product(F.array(cos, -sin, o, c("dx"), sin, cos, o, c("dy"), o, o, i, c("dz"), o, o, o, i), c("pose")).alias("pose"), c("pose").alias("_raw"), "yaw", "dx", "dy", "dz"), "poses")
    gone = F.sqrt(sum(((F.get("pose", F.lit(k)) - F.get("_raw", F.lit(k))) ** 2 for k in (3, 7, 11)), F.lit(0.0)))
    record = poses.groupBy(*keys).agg(F.max(gone).alias("largest_shift"), F.max(F.abs("yaw")).alias("largest_turn")).join(segs.groupBy(*keys).agg(F.count(F.lit(1)).alias("segments")), keys)
    if tried is None:
        head = typed(segs, keys)
        tried = rows(segs.limit(0).select(*keys), dict, f"{head}, i long, j long, round int, rmse double, overlap double, dof int, reason string, share double")
    counts = tried.groupBy(*keys).agg(F.count(F.lit(1)).alias("tried"), F.count_if(c("reason").isNull()).alias("accepted"))
    record = record.join(counts, keys, "left")
    record = record.join(anchored, keys, "left") if anchored is not None else record.withColumn("anchored", F.lit(0).cast("long"))
    whole = record.fillna(0, ["tried", "accepted", "anchored"]).withColumns({"loop_closure": F.lit(loop_closure), "plane_anchoring": F.lit(plane_anchoring)})
    return poses.drop("_raw"), tried.select(*keys, "round", "i", "j", "share", "rmse", "overlap", "dof", "reason"), whole
