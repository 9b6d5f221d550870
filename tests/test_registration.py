"""Registration, similarities and pose graphs on data whose truth is known; all pairs and graphs of a test share their rounds."""

import math

import numpy as np
import pytest

from plumbline.operators import posegraph, registration
from plumbline.operators.posegraph import joined, optimise, solve_blocks, split, turned, turning, yaw_freedom

CLOUD = "one int, segment long, x double, y double, z double, nx double, ny double, nz double"


def make(turn, shift, scale=1.0):
    t = np.eye(4)
    t[:3, :3], t[:3, 3] = scale * registration.rotation(np.asarray(turn, float)), shift
    return t


def apply(t, p):
    return p @ t[:3, :3].T + t[:3, 3]


def planes(rng, *normals, size=2.0):
    """Points 5 cm apart, with 1 mm of noise, on planes through the origin."""
    u, v = (a.ravel() for a in np.meshgrid(np.arange(0.02, size, 0.05), np.arange(0.02, size, 0.05)))
    points, ns = [], []
    for n in normals:
        p = np.insert(np.stack((u, v), 1), n, rng.normal(0, 0.001, len(u)), axis=1)
        points.append(p)
        ns.append(np.tile(np.eye(3)[n], (len(u), 1)))
    return np.concatenate(points), np.concatenate(ns)


def cloud(segment, p, n):
    return [(1, segment, *map(float, a), *map(float, b)) for a, b in zip(p, n)]


@pytest.fixture(scope="module")
def registered(spark):
    rng = np.random.default_rng(1)
    held, truth = [], {}
    p, n = planes(rng, 0, 1, 2)
    t = make(np.radians([1.0, -0.5, 2.0]), [0.03, -0.02, 0.01])
    back = np.linalg.inv(t)
    held += cloud(0, apply(back, p), n @ back[:3, :3].T) + cloud(1, p, n)
    truth[0] = (t, apply(back, p))
    p, n = planes(rng, 0, 2)
    held += cloud(10, p + [0.0, 0.05, 0.02], n) + cloud(11, p, n)
    truth[10] = (None, p + [0.0, 0.05, 0.02])
    p, n = planes(rng, 2, size=3.0)
    held += cloud(20, p + [0.1, 0.0, 0.01], n) + cloud(21, p, n)
    held += cloud(30, p[:20], n[:20]) + cloud(31, p[:20] + 9, n[:20])
    pairs = spark.createDataFrame([(1, k, k + 1) for k in (0, 10, 20, 30)], "one int, a long, b long")
    got = registration.register(spark.createDataFrame(held, CLOUD), pairs, ["one"]).collect()
    return {r.a: r for r in got}, truth


def test_a_corner_gives_the_whole_motion(registered):
    got, truth = registered
    r, (t, src) = got[0], truth[0]
    off = np.array(r.transform).reshape(4, 4) @ np.linalg.inv(t)
    assert np.degrees(np.linalg.norm(turning(off[None, :3, :3]))) < 0.05
    assert np.linalg.norm(apply(off, apply(t, src).mean(0)) - apply(t, src).mean(0)) < 0.002
    assert r.dof == 6 and r.rmse < 0.003 and r.overlap > 0.9 and r.reason is None


def test_a_wall_and_a_floor_leave_sliding_free(registered):
    got, truth = registered
    r, src = got[10], truth[10][1]
    move = apply(np.array(r.transform).reshape(4, 4), src).mean(0) - src.mean(0)
    assert move[2] == pytest.approx(-0.02, abs=0.002) and abs(move[1]) < 0.005
    value, way = np.linalg.eigh(np.array(r.info).reshape(6, 6))
    assert r.dof == 5 and value[0] < 1e-9 and abs(way[4, 0]) > 0.99 and r.reason is None


def test_a_floor_alone_and_clouds_apart_are_not_accepted(registered):
    got, _ = registered
    assert got[20].dof == 3 and got[20].reason == "degenerate"
    assert got[30].reason == "rmse" and math.isinf(got[30].rmse) and got[30].transform == np.eye(4).ravel().tolist()


def test_similarities_with_outliers(spark):
    rng = np.random.default_rng(2)
    rows, truth = [], {}
    for k in range(3):
        t = truth[k] = make(rng.normal(size=3) * 0.4, rng.normal(size=3), math.exp(rng.normal() * 0.1))
        src = rng.uniform(-2, 2, (900, 3))
        dst = apply(t, src) + rng.normal(0, 0.004, src.shape)
        bad = rng.random(len(src)) < 0.35
        dst[bad] += rng.normal(size=(bad.sum(), 3))
        rows += [(k, *map(float, a), *map(float, b), 1.0) for a, b in zip(src, dst)]
    rows += [(7, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), (8, *[0.0] * 6, 0.0)] + [(9, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 1.0)] * 30
    df = spark.createDataFrame(rows, "key int, sx double, sy double, sz double, dx double, dy double, dz double, w double")
    got = {r.key: r for r in registration.similarity_fits(df, ["key"], threshold=0.03).collect()}
    for k, t in truth.items():
        off = np.linalg.inv(t) @ np.array(got[k].transform).reshape(4, 4)
        scale, turn, _ = split(off.reshape(1, 16))
        assert got[k].ok and got[k].inliers > 0.55 and got[k].residual < 0.01
        assert np.linalg.norm(off[:3, 3]) < 0.006 and np.degrees(np.linalg.norm(turning(turn))) < 0.12 and abs(math.log(scale[0])) < 0.003
    assert not any(got[k].ok for k in (7, 8, 9)) and got[7].n == 0 and got[9].n == 30


def error(a, b):
    scale, turn, t = split((np.linalg.inv(a) @ b).reshape(1, 16))
    return np.linalg.norm(t), np.degrees(np.linalg.norm(turning(turn))), abs(math.log(scale[0]))


def rel(a, b, nodes, kind=None):
    return (a, b, np.linalg.inv(nodes[a]) @ nodes[b])


NODE = "key int, node long, pose array<double>, free array<boolean>"
RULE = "key int, a long, b long, kind string, m array<double>, s array<double>"
SIGMAS = [0.01, 0.03, 0.01]


def graph_rows(g, nodes, edges, free):
    held = [(g, k, t.ravel().tolist(), free(k)) for k, t in enumerate(nodes)]
    return held, [(g, a, b, "relative", z.ravel().tolist(), SIGMAS) for a, b, z in edges]


def test_similarity_graphs(spark):
    """One exact graph, one whose loop spreads a steady drift, one with priors, one that is all fixed: solved together."""
    rng = np.random.default_rng(3)
    noise = lambda: make(rng.normal(size=3) * 0.02, rng.normal(size=3) * 0.05, math.exp(rng.normal() * 0.01))
    truth = [np.eye(4)] + [make(rng.normal(size=3) * 0.3, rng.normal(size=3) * 2, math.exp(rng.normal() * 0.1)) for _ in range(5)]
    first = [truth[0]] + [t @ noise() for t in truth[1:]]
    nodes, rules = graph_rows(0, first, [rel(k, k + 1, truth) for k in range(5)] + [rel(0, 5, truth)], lambda k: [k > 0] * 7)

    circle = [make([0, 0, 2 * math.pi * k / 12 + math.pi / 2], [4 * math.cos(2 * math.pi * k / 12), 4 * math.sin(2 * math.pi * k / 12), 0]) for k in range(12)]
    circle = [np.linalg.inv(circle[0]) @ t for t in circle]
    bias = make([0, 0, math.radians(1.5)], [0.03, 0.0, 0.01], 1.01)
    steps = [np.linalg.inv(circle[k]) @ circle[k + 1] @ bias for k in range(11)]
    chain = [np.eye(4)]
    for s in steps:
        chain.append(chain[-1] @ s)
    more = graph_rows(1, chain, [(k, k + 1, s) for k, s in enumerate(steps)] + [rel(0, 11, circle)], lambda k: [k > 0] * 7)
    nodes, rules = nodes + more[0], rules + more[1]

    flat = [make([0, 0, 0], [2.0 * k, 0, 0]) for k in range(4)]
    tilt = make(np.radians([1.5, -1.0, 3.0]), [0, 0, 0.08])
    drifted = [flat[0]] + [t @ tilt for t in flat[1:]]
    more = graph_rows(2, drifted, [rel(k, k + 1, drifted) for k in range(3)], lambda k: [k > 0] * 7)
    floor = np.array([0.5, 0.3, -1.4])
    for k in range(1, 4):
        more[1].append((2, k, None, "rotation", np.eye(3).ravel().tolist(), [0.002]))
        more[1].append((2, k, None, "z", [*floor.tolist(), float(apply(flat[k], floor)[2])], [0.005]))
    nodes, rules = nodes + more[0], rules + more[1]
    more = graph_rows(3, truth[:2], [rel(0, 1, drifted)], lambda k: [False] * 7)
    nodes, rules = nodes + more[0] + [(4, 0, truth[1].ravel().tolist(), None)], rules + more[1]

    out, graphs = optimise(spark.createDataFrame(nodes, NODE), spark.createDataFrame(rules, RULE), ["key"], "sim3")
    got = {(r.key, r.node): np.array(r.pose).reshape(4, 4) for r in out.collect()}
    cost = {r.key: r for r in graphs.collect()}
    for k, t in enumerate(truth):
        moved, turn, scale = error(t, got[0, k])
        assert moved < 1e-6 and turn < 1e-5 and scale < 1e-7
    assert cost[0].after < 1e-12 < cost[0].before
    far = lambda nodes: np.array([np.linalg.norm(nodes[k][:3, 3] - circle[k][:3, 3]) for k in range(12)])
    ring = [got[1, k] for k in range(12)]
    assert far(chain)[-1] > 0.5 and far(ring).max() < 0.35 * far(chain).max()
    turns = [error(s, np.linalg.inv(ring[k]) @ ring[k + 1])[1] for k, s in enumerate(steps)]
    assert max(turns) - min(turns) < 0.5
    for k in range(1, 4):
        assert error(np.eye(4), make(turning(got[2, k][None, :3, :3])[0], [0, 0, 0]))[1] < 0.2
        assert abs(apply(got[2, k], floor)[2] - apply(flat[k], floor)[2]) < 0.01
    assert all(np.allclose(got[3, k], truth[k]) for k in (0, 1)) and np.allclose(got[4, 0], truth[1])


def circle_poses(n):
    return [make([0, 0, 2 * math.pi * k / n + math.pi / 2], [2 * math.cos(2 * math.pi * k / n), 2 * math.sin(2 * math.pi * k / n), 1.4]) for k in range(n)]


def test_yaw_graphs(spark, monkeypatch):
    """A drifted circle closed by one registration, and priors on height and turn; nodes are eliminated in rounds."""
    monkeypatch.setattr(posegraph, "CORE", 4)
    n = 16
    true = circle_poses(n)
    true.append(true[0])
    raw = [t.copy() for t in true]
    psi = [math.radians(0.25) * k for k in range(n + 1)]
    for k in range(1, n + 1):
        raw[k][:3, 3] = raw[k - 1][:3, 3] + registration.rotation(np.array([0, 0, psi[k - 1]])) @ (true[k][:3, 3] - true[k - 1][:3, 3])
        raw[k][:3, :3] = registration.rotation(np.array([0, 0, psi[k]])) @ true[k][:3, :3]
    sigmas = [math.radians(0.3), 0.02, 1.0]
    nodes = [(0, k, t.ravel().tolist(), None) for k, t in enumerate(raw)]
    rules = [(0, k, k + 1, "relative", (np.linalg.inv(raw[k]) @ raw[k + 1]).ravel().tolist(), sigmas) for k in range(n)]
    d = [r @ np.linalg.inv(t) for r, t in zip(raw, true)]
    info = np.diag([1 / 0.001**2] * 3 + [1 / 0.005**2] * 3) * posegraph.LOOP_BEST * posegraph.LOOP_SIGMA**2
    rules.append((0, 0, n, "loop", [*(d[0] @ np.linalg.inv(d[n])).ravel().tolist(), *raw[0][:3, 3].tolist(), *raw[0].ravel().tolist(), *raw[n].ravel().tolist()], info.ravel().tolist()))
    six = circle_poses(6)
    nodes += [(1, k, t.ravel().tolist(), None) for k, t in enumerate(six)]
    rules += [(1, k, k + 1, "relative", (np.linalg.inv(six[k]) @ six[k + 1]).ravel().tolist(), [math.radians(20), 0.5, 1.0]) for k in range(5)]
    for k in range(6):
        rules += [(1, k, None, "z", [0.0, 0.0, 0.0, 1.43], [0.01]), (1, k, None, "yaw", [math.radians(1.0)], [math.radians(0.5)])]
    nodes, rules = spark.createDataFrame(nodes, NODE), spark.createDataFrame(rules, RULE)
    out, _ = optimise(yaw_freedom(nodes, rules, ["key"]), rules, ["key"], "yaw")
    got = {(r.key, r.node): (np.array(r.pose).reshape(4, 4), r.x) for r in out.collect()}
    off = lambda nodes: max(np.linalg.norm(a[:3, 3] - t[:3, 3]) for a, t in zip(nodes, true))
    assert off(raw) > 0.1 and off([got[0, k][0] for k in range(n + 1)]) < 0.1 * off(raw)
    assert np.degrees(abs(turning((got[0, n][0][:3, :3] @ true[n][:3, :3].T)[None])[0, 2])) < 0.2
    assert all(abs(got[1, k][0][2, 3] - 1.43) < 0.002 and abs(math.degrees(got[1, k][1][0]) - 1.0) < 0.05 for k in range(6))


def test_elimination_against_whole_matrices(spark, monkeypatch):
    """Random sparse systems of several sizes, some in pieces, solved by rounds and by numpy."""
    monkeypatch.setattr(posegraph, "CORE", 2)
    rng, d, diagonal, pairs, want = np.random.default_rng(5), 2, [], [], {}
    for g, n in enumerate((1, 3, 25, 40)):
        links = {(k, k + 1) for k in range(n - 1) if not (g == 3 and k == 20)} | {tuple(sorted(map(int, rng.choice(n, 2, replace=False)))) for _ in range(n // 5)}
        h = np.zeros((d * n, d * n))
        for a, b in links:
            j = rng.normal(size=(d, 2 * d))
            at = [d * a, d * a + 1, d * b, d * b + 1]
            h[np.ix_(at, at)] += j.T @ j
        h += np.eye(d * n)
        v = rng.normal(size=d * n)
        want[g] = np.linalg.solve(h, -v)
        block = lambda a, b: h[d * a : d * a + d, d * b : d * b + d].ravel().tolist()  # noqa: E731, B023
        diagonal += [(g, k, block(k, k), v[d * k : d * k + d].tolist()) for k in range(n)]
        pairs += [(g, a, b, block(a, b)) for a, b in links]
    out = solve_blocks(spark.createDataFrame(diagonal, "g int, node long, h array<double>, g_ array<double>").withColumnRenamed("g", "key").withColumnRenamed("g_", "g"), spark.createDataFrame(pairs, "key int, a long, b long, h array<double>"), ["key"], d)
    got = {(r.key, r.node): r.dx for r in out.collect()}
    assert len(got) == 69
    for g, x in want.items():
        assert all(np.allclose(got[g, k], x[d * k : d * k + d], atol=1e-9) for k in range(len(x) // d))


def test_turns():
    rng = np.random.default_rng(0)
    v = np.vstack([rng.normal(size=(50, 3)), [[0, 0, 0], [1e-9, 0, 0], [0, math.pi - 1e-4, 0], [math.pi, 0, 0]]])
    r = turned(v)
    assert np.allclose(r @ np.swapaxes(r, 1, 2), np.eye(3), atol=1e-9) and np.allclose(turned(turning(r)), r, atol=1e-7)
    assert all(np.allclose(a, registration.rotation(b), atol=1e-9) for a, b in zip(r, v))
    t = make([0.1, 0.2, 0.3], [1, 2, 3], 1.7)
    assert np.allclose(joined(split(t.reshape(1, 16)))[0], t)


def test_small_graphs_are_solved_without_rounds(spark, monkeypatch):
    """Chains that close on their first node, a node without constraints, and one whose neighbour is missing: as in rounds."""
    rng = np.random.default_rng(2)
    nodes, rules = [], []
    for g, n in enumerate((5, 9, 2)):
        at = [make([0, 0, 0.05 * k], [0.4 * k, 0.1 * k, 0.0]) for k in range(n)]
        nodes += [(g, k, t.ravel().tolist(), None) for k, t in enumerate(at)]
        rules += [(g, k, k + 1, "relative", make([0, 0, 0.05 + rng.normal(0, 0.01)], [0.4 + rng.normal(0, 0.02), 0.1, 0.0]).ravel().tolist(), [0.05, 0.5, 1.0]) for k in range(n - 1)]
        rules.append((g, 0, n - 1, "relative", np.eye(4).ravel().tolist(), [0.05, 0.25, 1.0]))
    nodes += [(3, 0, np.eye(4).ravel().tolist(), None), (2, 9, np.eye(4).ravel().tolist(), None)]
    rules.append((2, 1, 77, "relative", np.eye(4).ravel().tolist(), [0.05, 0.5, 1.0]))
    nodes, rules = spark.createDataFrame(nodes, NODE), spark.createDataFrame(rules, RULE)
    free, found = yaw_freedom(nodes, rules, ["key"]), []
    monkeypatch.setattr(posegraph, "solve_blocks", None)
    found.append(optimise(free, rules, ["key"], "yaw", most=2))
    monkeypatch.undo()
    monkeypatch.setattr(posegraph, "RULES", 0)
    found.append(optimise(free, rules, ["key"], "yaw", most=2))
    one, two = ({(r.key, r.node): r.pose for r in n.collect()} for n, _ in found)
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-7) for k in one)
    one, two = ({r.key: (r.before, r.after) for r in g.collect()} for _, g in found)
    assert one.keys() == two.keys() and all(np.allclose(one[k], two[k], atol=1e-9) for k in one)
