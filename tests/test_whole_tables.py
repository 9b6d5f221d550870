"""Queries over whole tables, which have no SQL, against plain Python."""

import numpy as np
import pandas as pd
import pytest

from plumbline.functions.columns import FEET, SQUARE_FEET
from plumbline.plans import scope
from plumbline.queries import QUERIES
from plumbline.queries.evaluation import _flags, _regions


@pytest.fixture(scope="module")
def table(sf_dir):
    return lambda name: pd.read_parquet(f"{sf_dir}/{name}.parquet")


def test_opening_candidates(spark, sf_dir, table):
    t = table("lineitem")
    t["id"], t["kind"] = t.l_orderkey * 10 + t.l_linenumber, t.l_returnflag == "R"
    o = list(dict.fromkeys(zip(t.l_suppkey, t.id, t.kind, t.l_quantity.astype(float), t.l_discount.astype(float) * 20, strict=True)))
    walls = {}
    for wall, i, kind, centre, width in o:
        walls.setdefault((wall, kind), ([], []))[i % 2].append((i, centre, width))
    want = [(w, g, p) for (w, _), (gt, pred) in walls.items() for g, a, width in gt for p, b, _ in pred if abs(a - b) <= width / 2 + 1e-9]
    got = QUERIES["opening_candidates"](spark, sf_dir).toPandas()
    assert sorted(zip(got.wall, got.gt_id, got.pred_id, strict=True)) == sorted(want)


def test_points_in_rings(spark, sf_dir, table):
    t, want = table("embeddings"), set()
    for label, g in t.sort_values("vec_id").groupby("label"):
        ring = [(float(e[0]), float(e[1])) for e in g.embedding]
        for point, (x, y) in zip(g.vec_id, ring, strict=True):
            n = sum((ay > y) != (by > y) and x < ax + (bx - ax) * (y - ay) / (by - ay) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
            if n % 2:
                want.add((label, point))
    got = QUERIES["points_in_rings"](spark, sf_dir).toPandas()
    assert want and set(zip(got.label, got.point, strict=True)) == want and len(got) == len(want)


def test_components(spark, sf_dir, table):
    top, low = table("customer").c_custkey.max(), {}

    def find(a):
        while low.setdefault(a, a) != a:
            a = low[a]
        return a

    for a in table("orders").o_custkey.tolist():
        b = (a * 7 + 3) % int(top)
        if a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    got = QUERIES["components_min_label"](spark, sf_dir).toPandas()
    assert dict(zip(got.node, got.component, strict=True)) == {a: find(a) for a in list(low)}


def test_status_full_outer(spark, sf_dir, table):
    before = {r.doc_id: "pass" if r.quality == 1 else "fail" for r in table("labels").itertuples()}
    after = {r.doc_id: "pass" if r.n_chars > 1000 else "fail" for r in table("documents").itertuples()}
    word = {("pass", "pass"): "same", ("fail", "fail"): "same", ("fail", "pass"): "fixed", ("pass", "fail"): "broken"}
    want = {i: "added" if i not in before else "removed" if i not in after else word[before[i], after[i]] for i in before.keys() | after.keys()}
    got = QUERIES["status_full_outer"](spark, sf_dir).toPandas()
    assert dict(zip(got.doc_id, got.change, strict=True)) == want


def test_pose_graphs_hold_every_event(spark, sf_dir, table):
    got = QUERIES["pose_graph_loop"](spark, sf_dir).toPandas()
    want = {}
    for user, n in table("events").groupby("user_id").event_id.count().items():
        want |= {(user, k): min(8, n - 8 * k) + 1 for k in range(-(-n // 8))}
    assert max(k for _, k in want) > 0
    assert got.groupby(["user_id", "part"]).node.apply(sorted).to_dict() == {k: list(range(n)) for k, n in want.items()}
    # each graph solved apart, as one dense system
    t = table("events").sort_values("event_id")
    t["n"] = t.groupby("user_id").cumcount()
    for (user, part), g in list(t.groupby(["user_id", t.n // 8]))[::40]:
        steps = [(i, i + 1, v / 100, e % 5 / 50, 0.5) for i, (v, e) in enumerate(zip(g.value, g.event_id, strict=True))]
        own = got[(got.user_id == user) & (got.part == part)].sort_values("node")[["x", "y", "yaw"]].to_numpy()
        want_ = _closed([*steps, (0, len(g), 0.0, 0.0, 0.25)], len(g) + 1)
        own[:, 2] -= 2 * np.pi * np.round((own[:, 2] - want_[:, 2]) / (2 * np.pi))
        assert np.allclose(own, want_, atol=2e-3)


def _closed(edges, n):
    """Poses (x, y, yaw) of edges (a, b, ahead, turn, sigma of shift), the first at the origin; residuals beyond 3 sigmas count less."""
    pose = np.zeros((n, 3))
    for a, b, x, turn, _ in edges[:-1]:
        pose[b] = pose[a] + [x * np.cos(pose[a, 2]), x * np.sin(pose[a, 2]), turn]

    def off(p):
        out = []
        for a, b, x, turn, sigma in edges:
            c, s = np.cos(p[a, 2]), np.sin(p[a, 2])
            d = p[b] - p[a]
            out += [(c * d[0] + s * d[1] - x) / sigma, (c * d[1] - s * d[0]) / sigma, ((d[2] - turn + np.pi) % (2 * np.pi) - np.pi) / 0.05]
        return np.array(out)

    for _ in range(12):
        r, flat = off(pose), pose.ravel()
        j = np.stack([(off((flat + h).reshape(n, 3)) - off((flat - h).reshape(n, 3))) / 2e-6 for h in 1e-6 * np.eye(3 * n)[3:]], 1)
        w = np.where(np.abs(r) <= 3, 1.0, 3 / np.maximum(np.abs(r), 1e-12))
        pose[1:] += np.linalg.solve(j.T @ (w[:, None] * j), -j.T @ (w * r)).reshape(-1, 3)
    return pose


def _union(boxes):
    """Area of a union of boxes by the cells between all edges."""
    xs, ys = (sorted({b[k] for b in boxes} | {b[k + 2] for b in boxes}) for k in (0, 1))
    cells = ((x0, x1, y0, y1) for x0, x1 in zip(xs, xs[1:]) for y0, y1 in zip(ys, ys[1:]))
    return sum((x1 - x0) * (y1 - y0) for x0, x1, y0, y1 in cells if any(b[0] <= x0 and x1 <= b[2] and b[1] <= y0 and y1 <= b[3] for b in boxes))


def _line(entry, surface, regions, n_flags, k):
    """Quantity of a surface's regions with sizes times k; walls are 4 by 2.5 m and other surfaces 12 square metres, times k too."""
    m, wall = entry.get("margin_m", 0.0), "-W" in surface
    w, h = (4.0 * k, 2.5 * k) if wall else (float("inf"),) * 2
    floor = 0.0 if wall else -float("inf")
    half = [((r.u0 + r.u1) / 2, (r.v0 + r.v1) / 2, r.width * k / 2 + m, r.height * k / 2 + m) for r in regions]
    match entry["formula"]:
        case "each":
            return {"region": len(regions), "surface": 1, "flag": n_flags}[entry.get("count", "region")]
        case "surface_area":
            # openings are as much larger as the wall is smaller
            number, own = int(surface[-1]) if wall else 0, 2 - k
            return max(4.0 * k * 2.5 * k - 0.8 * own * (1 + 0.5 * number) * own, 0.0) if wall else 12.0 * k
        case "crack_length":
            return sum(r.length * k + m for r in regions)
        case "damage_area_margin":
            boxes = [(max(u - a, floor), max(v - b, floor), min(u + a, w), min(v + b, h)) for u, v, a, b in half]
            return _union([b for b in boxes if b[2] > b[0] and b[3] > b[1]])
        case formula:
            cuts = [(max(u - a, 0.0), 0.0, min(u + a, w), 1.0) for u, _, a, _ in half]
            return _union([c for c in cuts if c[2] > c[0]]) * (entry["cut_height_m"] if formula == "flood_cut_area" else 1.0)


def test_line_items_of_the_whole_catalogue(spark, sf_dir):
    regions, flags, want = _regions(spark, sf_dir).collect(), _flags(spark, sf_dir).collect(), {}
    by_id = {r.damage_id: r for r in regions}
    kind = lambda s: "floor" if s.endswith("FLOOR") else "ceiling" if s.endswith("CEIL") else "wall"
    for e in scope.DAMAGE + scope.FLAGS:
        met = {}
        if "classes" in e:
            for r in regions:
                if r.cls in e["classes"] and kind(r.surface_id) in e["surfaces"] and e.get("min_area_m2", -1) < r.area <= e.get("max_area_m2", 1e9):
                    met.setdefault(r.surface_id, (set(), set()))[0].add(r.damage_id)
        for f in flags if "rules" in e else ():
            if f.rule_id in e["rules"]:
                for s in f.surface_ids[:1] if e.get("count") == "flag" else f.surface_ids:
                    ids, names = met.setdefault(s, (set(), set()))
                    ids |= {i for i in f.damage_ids if e.get("count") == "flag" or by_id[i].surface_id == s}
                    names.add(f.flag_id)
        for s, (ids, names) in met.items():
            value, lo, hi = (_line(e, s, [by_id[i] for i in sorted(ids)], len(names), k) * {"SF": SQUARE_FEET, "LF": FEET, "EA": 1.0}[e["unit"]] for k in (1.0, 0.9, 1.1))
            if value > 0:
                want[s, e["id"]] = (len(ids), len(names), value, min(lo, value), max(hi, value))
    got = {(r.surface_id, r.entry): tuple(r)[2:] for r in QUERIES["line_items_all"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and {k[1] for k in got} > {"CRACK-TAPE", "HOLE-PATCH"}
    assert all(got[k] == pytest.approx(want[k], abs=1e-5) for k in want)
