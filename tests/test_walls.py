"""Wall lines peeled off made points and given tables."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plumbline.operators import walls
from plumbline.operators.walls import line_through, peel_lines

POINT = "plan int, direction int, offset double, along double, z double, w double"


def wall(rng, offset, t0, t1, slope=0.0, noise=0.005, top=2.5):
    t, z = (a.ravel() for a in np.meshgrid(np.arange(t0 + 0.02, t1, 0.04), np.arange(0.02, top, 0.04)))
    return np.stack((offset + slope * (t - (t0 + t1) / 2) + rng.normal(0, noise, len(t)), t, z), 1)


def plainly(points, lo, hi, sigma=0.01, size=0.01):
    """Lines of one direction peeled one round after the other; only the fit of a line is the library's."""
    v, t, z, w = points.T
    left, n = np.ones(len(v), bool), max(3, math.ceil((hi - lo) / size))
    spread = max(max(0.01, 0.7 * sigma) / size, 0.5)
    reach = int(4 * spread + 0.5)
    kernel = [math.exp(-0.5 * (k / spread) ** 2) for k in range(-reach, reach + 1)]
    half, apart = max(2, round(1.5 * sigma / size)), max(0.04, 2 * sigma)
    out, shut, floor = [], [], None
    while True:
        h = np.bincount(np.clip(((v[left] - lo) / size).astype(int), 0, n - 1), weights=w[left], minlength=n)
        sm = np.convolve(h, np.array(kernel) / sum(kernel))[reach : reach + n].round(12)
        top = [b for b in range(n) if sm[b] > (sm[b - 1] if b else 0) and sm[b] > (sm[b + 1] if b + 1 < n else 0)]
        peaks = [(h[max(b - half, 0) : b + half + 1].sum(), lo + (b + 0.5) * size) for b in top]
        floor = floor or max([20.0] + [0.005 * s for s, _ in peaks])
        peaks = [(s, c) for s, c in peaks if s >= floor and not any(a < c < b for a, b in shut)]
        chosen = [(s, c) for s, c in peaks if max(((s2, -c2) for s2, c2 in peaks if round(abs(c2 - c) / size) <= 50)) == (s, -c)]
        if not chosen:
            return out, left
        new = []
        for _, c in chosen:
            near = np.flatnonzero(left & (np.abs(v - c) <= 0.25))
            near = near[np.lexsort((w[near], z[near], t[near], v[near]))]
            f = line_through(v[near], t[near], z[near], w[near], c, sigma)
            wide = abs(f["slope"]) * f["half"]
            on = any(f["coord"] - wide < q["coord"] + apart + abs(q["slope"]) * q["half"] and f["coord"] + wide > q["coord"] - apart - abs(q["slope"]) * q["half"] for q in out)
            if f["n"] >= 30 and f["area"] >= 0.2 and f["columns"] >= 5 and not on:
                new.append((f, near))
                shut.append((f["coord"] - apart - wide, f["coord"] + apart + wide))
            else:
                shut.append((c - 1.5 * size, c + 1.5 * size))
        for f, near in new:
            out.append(f)
            left[near[np.abs(v[near] - f["coord"] - f["slope"] * (t[near] - f["middle"])) < f["window"]]] = False


def test_known_walls(spark):
    """Two faces of one wall, a slanted wall beside a weaker flat one, clutter, and a direction with nothing of a wall."""
    rng = np.random.default_rng(1)
    made = {
        (1, 0): [wall(rng, 0.0, 0, 4), wall(rng, 0.12, 0, 2.5), wall(rng, 3.0, 0, 3, noise=0.01), np.stack((rng.uniform(-1, 5, 400), rng.uniform(0, 4, 400), rng.uniform(0, 2.5, 400)), 1)],
        (1, 1): [wall(rng, 1.0, 0, 4, slope=math.tan(math.radians(3)))],
        (2, 0): [np.stack((rng.uniform(-1, 5, 500), rng.uniform(0, 4, 500), rng.uniform(0, 2.5, 500)), 1)],
        (2, 3): [wall(rng, 2.0, 0, 3), wall(rng, 2.0, 0, 0.15, top=0.3)],
    }
    rows = [(*key, *map(float, p), 1.0) for key, parts in made.items() for p in np.concatenate(parts)]
    lines, rest = peel_lines(spark.createDataFrame(rows, POINT), ["plan"], -1.5, 5.5)
    got = defaultdict(list)
    for r in lines.collect():
        got[r.plan, r.direction].append(r)
    assert sorted(round(r.coord, 2) for r in got[1, 0]) == [0.0, 0.12, 3.0] and all(r.slope == 0 for r in got[1, 0])
    assert [round(r.coord, 2) for r in got[1, 1]] == [1.0] and math.degrees(math.atan(got[1, 1][0].slope)) == pytest.approx(3.0, abs=0.1)
    assert got[2, 0] == [] and [round(r.coord, 2) for r in got[2, 3]] == [2.0]
    n = sum(r.n for own in got.values() for r in own)
    assert n + rest.count() == len(rows) and n > 0.9 * (len(rows) - 900)


def test_given_points(spark, sf_dir):
    from plumbline.queries import QUERIES, layout

    groups = defaultdict(list)
    for r in layout._faces(spark, sf_dir).collect():
        groups[r.k, r.direction].append((r.offset, r.along, r.z, r.w))
    want = sorted((*key, f["n"], f["area"], f["coord"], f["slope"]) for key, rows in groups.items() for f in plainly(np.array(rows), -0.5, 7.5)[0])
    got = sorted((r.k, r.direction, r.n, r.area, r.coord, r.slope) for r in QUERIES["peeled_lines"](spark, sf_dir).collect())
    assert len(want) > 20 and len(got) == len(want) and np.allclose(got, want, atol=2e-6)


def test_no_points(spark):
    lines, rest = peel_lines(spark.createDataFrame([], POINT), ["plan"], 0.0, 1.0)
    assert lines.count() == 0 and rest.count() == 0 and "slope" in lines.columns


def test_a_line_of_few_points():
    f = line_through(np.array([1.0, 1.01]), np.array([0.0, 1.0]), np.zeros(2), np.ones(2), 1.0, 0.01)
    assert f["n"] == 2 and f["columns"] == 0 and walls.LEAST > 2
