"""A room walked in a circle: a drifted capture, a clean one and one without points, in the same jobs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.loops import correct_drift, inverse, product

KEY = "capture string, frame long, t double, pose array<double>"
POINT = "capture string, frame long, x double, y double, z double, nx double, ny double, nz double"
N, DT = 36, 1.0


def room(rng):
    """Points 10 cm apart on the floor and walls of a room of 5 x 4 m, and on a box in it."""
    out = []
    for axis, at, normal, (u0, u1), (v0, v1) in [(2, 0.0, 1, (0, 5), (0, 4)), (0, 0.0, 1, (0, 4), (0, 2.4)), (0, 5.0, -1, (0, 4), (0, 2.4)), (1, 0.0, 1, (0, 5), (0, 2.4)), (1, 4.0, -1, (0, 5), (0, 2.4)), (0, 4.2, -1, (1, 2), (0, 1)), (1, 2.0, 1, (4.2, 5), (0, 1))]:
        u, v = (a.ravel() for a in np.meshgrid(np.arange(u0, u1, 0.1), np.arange(v0, v1, 0.1)))
        p = np.insert(np.stack((u, v), 1), axis, at, axis=1) + rng.normal(0, 0.002, (len(u), 3)) * (np.arange(3) == axis)
        out.append(np.hstack((p, np.tile(np.eye(3)[axis] * normal, (len(u), 1)))))
    return np.concatenate(out)


def pose(x, y, z, yaw):
    c, s = math.cos(yaw), math.sin(yaw)
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = [[c, -s, 0], [s, c, 0], [0, 0, 1]], [x, y, z]
    return t


@pytest.fixture(scope="module")
def captures(spark):
    rng, keys, points, truth = np.random.default_rng(3), [], [], {}
    world = room(rng)
    for capture, drift in (("drifted", 1.0), ("clean", 0.0), ("blind", 1.0)):
        for k in range(N):
            a = 2 * math.pi * k / (N - 2)
            true = pose(2.5 + 0.8 * math.cos(a), 2.0 + 0.8 * math.sin(a), 1.4, a)
            g = drift * k / N
            off = pose(0.05 * g, -0.04 * g, 0.05 * g, math.radians(2.5) * g)
            raw = off @ true
            truth[capture, k] = true
            keys.append((capture, k, k * DT, raw.ravel().tolist()))
            if capture == "blind":
                continue
            back = np.linalg.inv(true)
            p, n = world[:, :3] @ back[:3, :3].T + back[:3, 3], world[:, 3:] @ back[:3, :3].T
            seen = (p[:, 0] > 0.2) & (np.abs(p[:, 1]) < 1.2 * p[:, 0]) & (np.linalg.norm(p, axis=1) < 4.5) & (rng.random(len(p)) < 0.5)
            points += [(capture, k, *map(float, a), *map(float, b)) for a, b in zip(p[seen], n[seen])]
    out = correct_drift(spark.createDataFrame(keys, KEY), spark.createDataFrame(points, POINT), ["capture"], loop_rounds=1, steps=12)
    poses = {(r.capture, r.frame): np.array(r.pose).reshape(4, 4) for r in out[0].collect()}
    raw = {(k[0], k[1]): np.array(k[3]).reshape(4, 4) for k in keys}
    return poses, raw, truth, out[1].collect(), {r.capture: r for r in out[2].collect()}


def off(poses, truth, capture):
    own = [k for k in truth if k[0] == capture]
    turn = max(abs(math.degrees(math.atan2(*(poses[k][:3, :3] @ truth[k][:3, :3].T)[[1, 0], 0]))) for k in own)
    d = np.array([poses[k][:3, 3] - truth[k][:3, 3] for k in own])
    return turn, np.linalg.norm(d - d.mean(0), axis=1).max()


def test_drift_goes(captures):
    poses, raw, truth, tried, record = captures
    before, after = off(raw, truth, "drifted"), off(poses, truth, "drifted")
    assert before[0] > 2.0 and after[0] < 0.6 and after[1] < 0.5 * before[1]
    r = record["drifted"]
    assert r.segments == N / 3 and r.accepted >= 1 and r.tried >= r.accepted and r.anchored >= 1 and 1.5 < math.degrees(r.largest_turn) < 4.0
    ends = [t for t in tried if t.capture == "drifted" and (t.i, t.j) == (0, r.segments - 1)]
    assert ends and ends[-1].reason is None


def test_a_clean_capture_hardly_moves(captures):
    poses, raw, _, _, record = captures
    assert max(np.linalg.norm(poses[k][:3, 3] - raw[k][:3, 3]) for k in raw if k[0] == "clean") < 0.015
    assert math.degrees(record["clean"].largest_turn) < 0.25 and record["clean"].accepted >= 1


def test_a_capture_without_points_stays(captures):
    poses, raw, _, _, record = captures
    assert all(np.allclose(poses[k], raw[k]) for k in raw if k[0] == "blind") and record["blind"].accepted == 0


def test_matrices(spark):
    rng = np.random.default_rng(1)
    a, b = pose(*rng.normal(size=4)), pose(*rng.normal(size=4))
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    r = df.select(product(F.col("a"), F.col("b")).alias("p"), inverse(F.col("a")).alias("i")).first()
    assert np.allclose(np.array(r.p).reshape(4, 4), a @ b) and np.allclose(np.array(r.i).reshape(4, 4), np.linalg.inv(a))
