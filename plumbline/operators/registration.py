"""Registration of point clouds in rounds: all pairs of clouds advance in the same jobs.

A round moves every source cloud, finds partners within a distance by grid
cells, and sums the normal equations of each pair in one aggregate; only the
sums of a pair, a few dozen numbers, are solved in Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import discard, materialize

from .joins import within_distance
from .quantiles import percentiles

# Partner distances in metres, least cosine of normals, partners needed, Huber width, least information of a
# direction, and what an accepted registration may be.
NEAR, FAR, SHRINK, COSINE, PARTNERS, HUBER, WEAK = 0.10, 0.30, 0.7, math.cos(math.radians(45.0)), 30, 0.02, 0.03
RMSE, OVERLAP, FREEDOM, TURN, SHIFT = 0.02, 0.30, 4, 15.0, 1.5
#: Sampled fits of a similarity, and refits on the inliers of the best.
SAMPLES, REFITS = 128, 4


def rows(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """fn for every row as a dict."""
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(row) for row in batch.to_pylist()], schema=arrow)

    return df.mapInArrow(run, schema)


def typed(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{c} {kinds[c]}" for c in names)


def rotation(v: np.ndarray) -> np.ndarray:
    """Rotation matrix of a rotation vector."""
    angle = float(np.linalg.norm(v))
    if angle < 1e-12:
        return np.eye(3)
    x, y, z = v / angle
    cross = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + math.sin(angle) * cross + (1 - math.cos(angle)) * cross @ cross


def moved(transform: Column, x: Column, y: Column, z: Column, turn_only: bool = False) -> list[Column]:
    """A point, or a direction, under a 4 x 4 transform given as 16 numbers row by row."""
    m = lambda i, j: F.get(transform, F.lit(4 * i + j))
    return [m(i, 0) * x + m(i, 1) * y + m(i, 2) * z + (F.lit(0.0) if turn_only else m(i, 3)) for i in range(3)]


def _sums(state: DataFrame, clouds: DataFrame, by: Sequence[str], reach: float) -> DataFrame:
    """(by, a, b, n, sw, sp, pp, rr, h, g): sums over the partners of each pair; h has the 21 products of (p x n, n), g their products with the gap."""
    keys, c = list(by), F.col
    own = state.select(*keys, "a", "b", "transform").join(clouds.withColumnRenamed("segment", "a"), [*keys, "a"])
    at = dict(zip("xyz", moved(c("transform"), c("x"), c("y"), c("z")))) | dict(zip(("nx", "ny", "nz"), moved(c("transform"), c("nx"), c("ny"), c("nz"), True)))
    own = own.select(*keys, "a", F.col("b").alias("segment"), "i", *(v.alias(k) for k, v in at.items()))
    met = within_distance(own, clouds, reach, ["x", "y", "z"], [*keys, "segment"])
    partner = F.min_by(F.struct(*(f"{k}_r" for k in ("x", "y", "z", "nx", "ny", "nz"))), F.struct("distance", "i_r")).alias("q")
    near = met.groupBy(*keys, "a", "segment", "i", "x", "y", "z", "nx", "ny", "nz").agg(partner)
    q = lambda k: c(f"q.{k}_r")
    near = near.where(c("nx") * q("nx") + c("ny") * q("ny") + c("nz") * q("nz") > COSINE)
    gap = (c("x") - q("x")) * q("nx") + (c("y") - q("y")) * q("ny") + (c("z") - q("z")) * q("nz")
    m = [c("y") * q("nz") - c("z") * q("ny"), c("z") * q("nx") - c("x") * q("nz"), c("x") * q("ny") - c("y") * q("nx"), q("nx"), q("ny"), q("nz")]
    near = near.select(*keys, "a", c("segment").alias("b"), "x", "y", "z", gap.alias("r"), *(v.alias(f"m{k}") for k, v in enumerate(m)))
    w = F.when(F.abs("r") < HUBER, 1.0).otherwise(HUBER / F.greatest(F.abs("r"), F.lit(1e-12)))
    g = near.withColumn("w", w).groupBy(*keys, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.array(*(F.sum(k) for k in "xyz")).alias("sp"), F.sum(c("x") ** 2 + c("y") ** 2 + c("z") ** 2).alias("pp"), F.sum(c("r") ** 2).alias("rr"),
        F.array(*(F.sum(c("w") * c(f"m{i}") * c(f"m{j}")) for i in range(6) for j in range(i, 6))).alias("h"), F.array(*(F.sum(c("w") * c(f"m{i}") * c("r")) for i in range(6))).alias("g"),
    )
    return g


def _system(row: dict) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(centre, radius, H, g): equations a unit of weight for (turn about the centre in units of the radius, shift)."""
    n = row["n"]
    centre = np.array(row["sp"]) / n
    radius = max(math.sqrt(max(row["pp"] / n - centre @ centre, 0.0)), 1e-3)
    h = np.zeros((6, 6))
    h[np.triu_indices(6)] = row["h"]
    h = h + np.triu(h, 1).T
    x, y, z = centre
    # (p - c) x n is p x n less c x n
    to = np.block([[np.eye(3) / radius, -np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]]) / radius], [np.zeros((3, 3)), np.eye(3)]])
    return centre, radius, to @ h @ to.T / row["sw"], to @ np.array(row["g"]) / row["sw"]


def _step(reach: float) -> Callable[[dict], dict]:
    def step(row: dict) -> dict:
        out = {k: v for k, v in row.items() if k not in ("n", "sw", "sp", "pp", "rr", "h", "g")}
        if not row["n"] or row["n"] < PARTNERS:
            return out | {"done": True}
        centre, radius, h, g = _system(row)
        size, way = np.linalg.eigh(h)
        good = size > WEAK
        if not good.any():
            return out | {"done": True}
        x = -way[:, good] @ ((way[:, good].T @ g) / size[good])
        turn, shift = x[:3] / radius, x[3:]
        by = np.eye(4)
        by[:3, :3] = rotation(turn)
        by[:3, 3] = centre + shift - by[:3, :3] @ centre
        small = np.linalg.norm(turn) < 1e-5 and np.linalg.norm(shift) < 1e-5 and reach <= NEAR
        return out | {"transform": (by @ np.array(row["transform"]).reshape(4, 4)).ravel().tolist(), "rounds": row["rounds"] + 1, "done": bool(small)}

    return step


def _judged(row: dict) -> dict:
    """The result of a pair, with the information along well-constrained directions and why it is not accepted, if so."""
    out = {k: v for k, v in row.items() if k not in ("done", "sw", "sp", "pp", "rr", "h", "g", "middle", "size", "n")}
    n, size, middle = row["n"] or 0, row["size"], np.array(row["middle"])
    t = np.array(row["transform"]).reshape(4, 4)
    out |= {"n": n, "overlap": n / max(size, 1), "rmse": math.inf, "dof": 0, "centre": [0.0] * 3, "info": [0.0] * 36}
    if n >= PARTNERS:
        centre, radius, h, _ = _system(row)
        value, way = np.linalg.eigh(h)
        good, scale = value > WEAK, np.diag([radius] * 3 + [1.0] * 3)
        info = scale @ ((way * np.where(good, value, 0.0)) @ way.T) @ scale
        out |= {"rmse": math.sqrt(row["rr"] / n), "dof": int(good.sum()), "centre": centre.tolist(), "info": info.ravel().tolist()}
    shift = float(np.linalg.norm(t[:3, :3] @ middle + t[:3, 3] - middle))
    turn = math.degrees(math.acos(min(1.0, max(-1.0, (np.trace(t[:3, :3]) - 1) / 2))))
    tests = (("rmse", out["rmse"] >= RMSE), ("overlap", out["overlap"] <= OVERLAP), ("degenerate", out["dof"] < FREEDOM), ("too_large", turn > TURN or shift > SHIFT))
    return out | {"reason": next((name for name, failed in tests if failed), None)}


def register(clouds: DataFrame, pairs: DataFrame, by: Sequence[str], most: int = 30) -> DataFrame:
    """(by, a, b, transform, rounds, n, overlap, rmse, dof, centre, info, reason): cloud a of each pair laid on cloud b, point to plane.

    clouds (by, segment, x, y, z, nx, ny, nz), thinned to voxels; pairs (by,
    a, b) and, if there, a transform to start from. Partners are nearest
    points within a distance that shrinks from FAR to NEAR, with normals
    within 45 degrees. Steps go only along directions that the partners fix:
    a wall and a floor leave sliding along the wall free (dof 5), and info has
    nothing in that direction. reason is null for a registration that is good
    enough for a loop: rmse, overlap, dof and motion within bounds. A pair
    with too few partners keeps its transform, with an infinite rmse.
    """
    keys = list(by)
    clouds = materialize(clouds.select(*keys, "segment", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz"))).withColumn("i", F.monotonically_increasing_id()), "clouds")
    whole = clouds.groupBy(*keys, F.col("segment").alias("a")).agg(F.array(*(F.avg(k) for k in "xyz")).alias("middle"), F.count(F.lit(1)).alias("size"))
    start = F.col("transform") if "transform" in pairs.columns else F.array(*(F.lit(float(i == j)) for i in range(4) for j in range(4)))
    state = pairs.select(*keys, "a", "b", start.alias("transform")).join(whole, [*keys, "a"]).withColumns({"rounds": F.lit(0), "done": F.lit(False)})
    state = materialize(state, "pairs")
    columns = f"{typed(state, [*keys, 'a', 'b'])}, transform array<double>, middle array<double>, size long, rounds int, done boolean"
    for k in range(most):
        reach = max(NEAR, FAR * SHRINK**k)
        live = state.where("NOT done")
        if live.isEmpty():
            break
        on = rows(live.join(_sums(live, clouds, by, reach), [*keys, "a", "b"], "left"), _step(reach), columns)
        last, state = state, materialize(state.where("done").select(on.columns).union(on), "pairs")
        discard(last)
    columns = f"{typed(state, [*keys, 'a', 'b'])}, transform array<double>, rounds int, n long, overlap double, rmse double, dof int, centre array<double>, info array<double>, reason string"
    return rows(state.join(_sums(state, clouds, by, NEAR), [*keys, "a", "b"], "left"), _judged, columns)


# similarities from given partners


def similarity(w: float, s: np.ndarray, d: np.ndarray, ds: np.ndarray, ss: float) -> np.ndarray | None:
    """The least-squares similarity from weighted sums of sources, targets, their products d s' and of |s|^2; None if they do not fix one."""
    if not w > 0:
        return None
    ms, md = s / w, d / w
    spread = ss / w - ms @ ms
    u, value, vt = np.linalg.svd(ds / w - np.outer(md, ms))
    if not (np.isfinite(value).all() and spread > 1e-18 and value[1] > 1e-12 * max(value[0], 1e-300)):
        return None
    sign = np.array([1.0, 1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    t = np.eye(4)
    t[:3, :3] = (value * sign).sum() / spread * (u @ np.diag(sign) @ vt)
    t[:3, 3] = md - t[:3, :3] @ ms
    return t


_MOMENTS = ("sw", "sv", "dv", "ds", "ss")


def _moments(weight: Column) -> list[Column]:
    c, s, d = F.col, ("sx", "sy", "sz"), ("dx", "dy", "dz")
    vector = lambda names: F.array(*(F.sum(weight * c(k)) for k in names))
    products = F.array(*(F.sum(weight * c(p) * c(q)) for p in d for q in s))
    return [F.sum(weight).alias("sw"), vector(s).alias("sv"), vector(d).alias("dv"), products.alias("ds"), F.sum(weight * sum((c(k) ** 2 for k in s), F.lit(0.0))).alias("ss")]


def _solved(row: dict) -> dict:
    out = {k: v for k, v in row.items() if k not in _MOMENTS}
    t = similarity(row["sw"], *(np.array(row[k]) for k in ("sv", "dv")), np.array(row["ds"]).reshape(3, 3), row["ss"]) if row["sw"] else None
    return out | {"transform": t.ravel().tolist() if t is not None else None}


def _residual() -> Column:
    x, y, z = moved(F.col("transform"), F.col("sx"), F.col("sy"), F.col("sz"))
    return F.sqrt((x - F.col("dx")) ** 2 + (y - F.col("dy")) ** 2 + (z - F.col("dz")) ** 2)


def similarity_fits(matches: DataFrame, by: Sequence[str], threshold: float | None = None, least: int = 20, trim: float = 0.9) -> DataFrame:
    """(by, transform, residual, inliers, n, ok): the similarity from source to target of each key, against outliers.

    matches (by, sx, sy, sz, dx, dy, dz, w). SAMPLES fits of four matches each,
    drawn by hash, are scored by the weight within ``threshold`` (by default 4
    % of the targets' median distance from their medians, 1 to 25 cm); the best
    is refitted on its inliers, and once more on the nearest ``trim`` of them.
    residual is the inliers' median, inliers their share. Matches that are not
    finite or have no weight are left out; a key with too few is not ok.
    """
    keys, c = list(by), F.col
    number = lambda k: c(k).isNotNull() & ~F.isnan(k) & (F.abs(k) < float("inf"))
    names = ("sx", "sy", "sz", "dx", "dy", "dz", "w")
    good = matches.select(*keys, *(c(k).cast("double").alias(k) for k in names))
    for k in names:
        good = good.where(number(k))
    good = materialize(good.where("w > 0").withColumn("i", F.monotonically_increasing_id()), "matches")
    counts = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    if threshold is None:
        mid = None
        for k in "xyz":
            one = percentiles(good, by, f"d{k}", {f"_m{k}": 0.5})
            mid = one if mid is None else mid.join(one, keys)
        far = materialize(good.join(mid, keys).withColumn("_far", F.sqrt(sum(((c(f"d{k}") - c(f"_m{k}")) ** 2 for k in "xyz"), F.lit(0.0)))), "far")
        limits = percentiles(far, by, "_far", {"_half": 0.5}).select(*keys, F.least(F.greatest(0.04 * c("_half"), F.lit(0.01)), F.lit(0.25)).alias("limit"))
    else:
        limits = counts.select(*keys, F.lit(float(threshold)).alias("limit"))
    good = materialize(good.join(limits, keys).join(counts.where(c("n") >= max(least, 4)).drop("n"), keys, "left_semi"), "matches")

    draw = Window.partitionBy(*keys).orderBy(F.xxhash64("i"), "i")
    drawn = good.withColumn("k", F.row_number().over(draw)).where(c("k") <= 4 * SAMPLES).withColumn("k", F.floor((c("k") - 1) / 4))
    head = typed(good, keys)
    tried = rows(drawn.groupBy(*keys, "k").agg(*_moments(F.lit(1.0))), _solved, f"{head}, k long, transform array<double>").where("transform IS NOT NULL")
    scored = good.join(materialize(tried, "samples"), keys).groupBy(*keys, "k", "transform").agg(F.sum(F.when(_residual() < c("limit"), c("w")).otherwise(0.0)).alias("score"))
    fits = materialize(scored.groupBy(*keys).agg(F.max_by("transform", F.struct("score", -c("k"))).alias("transform")), "fits")
    refit = lambda held: materialize(rows(held.groupBy(*keys).agg(*_moments(c("w"))), _solved, f"{head}, transform array<double>"), "fits")
    inside = lambda fits: good.join(fits.where("transform IS NOT NULL"), keys).withColumn("r", _residual()).where(c("r") < c("limit"))
    for _ in range(REFITS):
        fits = refit(inside(fits))
    held = materialize(inside(fits), "inliers")
    cut = percentiles(held, by, "r", {"_cut": trim})
    core = refit(held.join(cut, keys).where("r <= _cut").drop("transform"))
    last = materialize(inside(core), "inliers")
    middle = percentiles(last, by, "r", {"residual": 0.5})
    got = last.groupBy(*keys).agg(F.count(F.lit(1)).alias("held")).join(middle, keys).join(core, keys)
    j = matches.select(*keys).distinct().join(counts, keys, "left").join(got, keys, "left")
    share = F.coalesce(c("held") / c("n"), F.lit(0.0))
    return j.select(*keys, "transform", "residual", share.alias("inliers"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce((c("held") >= least) & (share >= 0.25), F.lit(False)).alias("ok"))
