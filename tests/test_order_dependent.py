"""Queries whose result depends on an order, or that SQL cannot express, against plain Python."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from plumbline.kernels.assignment import assign, ring_alignments
from plumbline.queries import QUERIES, capture, core, placing
from plumbline.queries.evaluation import _records


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    held = {}

    def result(name):
        if name not in held:
            held[name] = QUERIES[name](spark, sf_dir).collect()
        return held[name]

    return result


@pytest.fixture(scope="module")
def boxes(spark, sf_dir):
    views = defaultdict(list)
    for r in core._boxes(spark, sf_dir).collect():
        views[r.view_id].append(r)
    return views


def overlap(a, b):
    w, h = min(a.x1, b.x1) - max(a.x0, b.x0), min(a.y1, b.y1) - max(a.y0, b.y0)
    inter = max(w, 0) * max(h, 0)
    sizes = [(r.x1 - r.x0) * (r.y1 - r.y0) for r in (a, b)]
    union = sum(sizes) - inter
    return (inter / union if union > 0 else 0.0), (inter / min(sizes) if min(sizes) > 0 else 0.0)


def test_suppression(run, boxes):
    want = set()
    for view, rows in boxes.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.score, r.box_id)):
            if all(overlap(r, k)[0] <= 0.3 and overlap(r, k)[1] <= 0.8 for k in kept):
                kept.append(r)
                want.add((view, r.box_id))
    assert {tuple(r) for r in run("nms_keep")} == want


def test_clusters(run, boxes):
    """Each cluster as a set of boxes, grown and joined one step at a time."""
    want = set()
    for view, rows in boxes.items():
        rows = sorted(rows, key=lambda r: (-r.score, r.box_id))

        def touch(a, b):
            gap = math.hypot((a.x0 + a.x1 - b.x0 - b.x1) / 2, (a.y0 + a.y1 - b.y0 - b.y1) / 2)
            iou = overlap(a, b)[0]
            return iou - 0.01 * gap if iou > 0.2 or gap <= 30 else None

        found = []
        for r in rows:
            offers = []
            for k, c in enumerate(found):
                pulls = [p for p in (touch(m, r) for m in c) if p is not None]
                if pulls and all(m.cls != r.cls for m in c):
                    offers.append((max(pulls), -k))
            if offers:
                found[-max(offers)[1]].append(r)
            else:
                found.append([r])
        while True:
            pair = next(((a, b) for a, b in itertools.combinations(range(len(found)), 2) if not {m.cls for m in found[a]} & {m.cls for m in found[b]} and any(touch(x, y) is not None for x in found[a] for y in found[b])), None)
            if pair is None:
                break
            found[pair[0]] += found.pop(pair[1])
        want |= {(view, frozenset(m.box_id for m in c)) for c in found}
    got = defaultdict(set)
    for r in run("cluster_greedy"):
        got[r.view_id, r.cluster].add(r.box_id)
    assert {(v, frozenset(s)) for (v, _), s in got.items()} == want


def test_assignment(run, spark, sf_dir):
    from plumbline.queries.tables import order_spans

    sides = defaultdict(lambda: ([], []))
    for r in order_spans(spark, sf_dir).collect():
        sides[r.o_custkey][r.o_orderkey % 2].append((r.o_orderkey, r.lo))
    got = defaultdict(list)
    for r in run("hungarian_match"):
        got[r.o_custkey].append(r)
    for k, (a, b) in sides.items():
        cost = {(x, y): abs(p - q) for x, p in a for y, q in b}
        assert len(got[k]) == min(len(a), len(b))
        assert all(r.cost == cost[r.a, r.b] for r in got[k]) and len({r.a for r in got[k]}) == len({r.b for r in got[k]}) == len(got[k])
        if a and b:
            table = np.array([[cost[x, y] for y, _ in b] for x, _ in a])
            # in one dimension an assignment in order is optimal where both sides are as long
            if len(a) == len(b):
                assert sum(r.cost for r in got[k]) == pytest.approx(sum(abs(p - q) for p, q in zip(sorted(p for _, p in a), sorted(q for _, q in b), strict=True)))
            assert sum(r.cost for r in got[k]) == pytest.approx(sum(table[i, j] for i, j in assign(table)))


def test_ring_alignment(run, sf_dir):
    t = pd.read_parquet(f"{sf_dir}/orders.parquet").sort_values("o_orderkey")
    got = defaultdict(list)
    for r in run("dp_align"):
        got[r.o_custkey].append(r)
    for k, g in t.groupby("o_custkey"):
        sides = [(g[g.o_orderkey % 2 == s].o_totalprice / 1000).to_numpy() for s in (0, 1)]
        rows = got[k]
        assert sorted(r.gt_k for r in rows if r.gt_k is not None) == list(range(len(sides[0])))
        assert sorted(r.pred_k for r in rows if r.pred_k is not None) == list(range(len(sides[1])))
        costs, _ = ring_alignments(*sides)
        pairs = [(r.gt_k, r.pred_k) for r in rows if r.gt_k is not None and r.pred_k is not None]
        spent = sum(abs(sides[0][i] - sides[1][j]) for i, j in pairs) + sum(sides[0][r.gt_k] for r in rows if r.pred_k is None) + sum(sides[1][r.pred_k] for r in rows if r.gt_k is None)
        assert spent == pytest.approx(costs.min()) and rows[0].cost == pytest.approx(costs.min())


@pytest.mark.parametrize("name", ["keyframes_greedy", "stream_keyframes"])
def test_keyframes(run, sf_dir, name):
    want = set()
    for user, g in pd.read_parquet(f"{sf_dir}/events.parquet").sort_values("event_id").groupby("user_id"):
        last = None
        for i, v in zip(g.event_id, g.value, strict=True):
            if last is None or abs(v - last) >= 20.0:
                want.add((user, i))
                last = v
    assert {(r.user_id, r.event_id) for r in run(name)} == want


def test_binomial_bounds(run):
    """At a bound the tail of the binomial distribution holds 2.5 percent."""

    def tail(k, n, p):
        return math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1))

    for r in run("clopper_pearson_bounds"):
        if r.k > 0:
            assert tail(r.k, r.n, r.lo) == pytest.approx(0.025, abs=1e-5)
        if r.k < r.n:
            assert 1 - tail(r.k + 1, r.n, r.hi) == pytest.approx(0.025, abs=1e-5)


def test_calibration_gate(run, spark, sf_dir):
    tiers = Counter(), Counter()
    for r in _records(spark, sf_dir).collect():
        tiers[0][r.tier] += 1
        tiers[1][r.tier] += r.covered
    rows = {r.tier: r for r in run("calibration_gate")}
    assert rows.keys() == tiers[0].keys()
    for t, r in rows.items():
        assert (r.n, r.measured) == (tiers[0][t], pytest.approx(tiers[1][t] / tiers[0][t]))
        assert (r.status == "pass") == (r.shortfall == 0) and (r.score > 0) == (r.status == "fail")


def test_facing_doors(run, spark, sf_dir):
    doors = defaultdict(list)
    for r in placing._doors(spark, sf_dir).collect():
        doors[r.capture_id].append(r)
    want = set()
    for k, held in doors.items():
        met = []
        for a, b in itertools.permutations(held, 2):
            gap = math.hypot(a.cx - b.cx, a.cy - b.cy)
            turn = math.degrees(math.acos(min(max(-(a.nx * b.nx + a.ny * b.ny), -1.0), 1.0)))
            if a.room < b.room and gap <= 0.4 and turn <= 25 and min(a.width, b.width) / max(a.width, b.width) >= 0.7:
                met.append((gap, f"{a.room}/{a.door}", f"{b.room}/{b.door}", a.door, b.door))
        used = set()
        for _, x, y, a, b in sorted(met):
            if not {x, y} & used:
                used |= {x, y}
                want.add((k, a, b))
    assert {(r.capture_id, r.door_a, r.door_b) for r in run("facing_doors")} == want


def test_connected_openings(run, spark, sf_dir):
    held = defaultdict(list)
    for r in placing._openings(spark, sf_dir).where("leads_to IS NOT NULL").collect():
        held[r.capture_id].append(r)
    want = Counter()
    for k, rows in held.items():
        met = sorted((math.hypot(a.x - b.x, a.y - b.y), a.opening, b.opening, a, b) for a in rows for b in rows if a.room < b.room and a.leads_to == b.room and b.leads_to == a.room)
        used = set()
        for gap, x, y, a, b in met:
            if gap < 6.0 and not {x, y} & used:
                used |= {x, y}
                want[k, a.room, b.room, x, y] += 1
        for r in rows:
            if r.opening not in used:
                ends = (r.opening, None) if r.room < r.leads_to else (None, r.opening)
                want[k, min(r.room, r.leads_to), max(r.room, r.leads_to), *ends] += 1
    assert Counter((r.capture_id, r.room_a, r.room_b, r.opening_a, r.opening_b) for r in run("connected_openings")) == want


def test_quota(run, spark, sf_dir):
    groups = defaultdict(list)
    for r in placing._quota(spark, sf_dir).collect():
        groups[r.k].append(r)
    want = Counter()
    for k, rows in groups.items():
        used, n = Counter(), 0
        for r in sorted(rows, key=lambda r: (-r.score, r.a, r.b)):
            if n < 8 and used[r.a] < 2 and used[r.b] < 2:
                used.update((r.a, r.b))
                n += 1
                want[k, r.a, r.b, r.score] += 1
    assert Counter((r.k, r.a, r.b, r.score) for r in run("quota_pairs")) == want


def test_placement_trees(run, spark, sf_dir):
    from plumbline.plans import stitching

    edges = defaultdict(list)
    for r in stitching.door_pairs(placing._doors(spark, sf_dir)).collect():
        edges[r.capture_id].append((r.score, r.a, r.b))
    got = defaultdict(list)
    for r in run("placement_trees"):
        got[r.capture_id].append(r.score)
    for k, held in edges.items():
        group, best = {x: {x} for _, a, b in held for x in (a, b)}, []
        for s, a, b in sorted(held, reverse=True):
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
                best.append(s)
        assert sum(got[k]) == pytest.approx(sum(best), abs=1e-5) and len(got[k]) == len(best)


def test_covisibility(run, spark, sf_dir):
    points, views, depth = (t.collect() for t in capture._covisible_inputs(spark, sf_dir))
    maps, at = defaultdict(dict), defaultdict(list)
    for r in depth:
        maps[r.capture_id, r.view_id][r.i, r.j] = r.depth
    for v in views:
        at[v.capture_id].append(v)
    seen, n = Counter(), Counter()
    for p in points:
        n[p.capture_id, p.view_a] += 1
        for v in at[p.capture_id]:
            x, y, z = p.x + v.tx, p.y + v.ty, p.z + v.tz
            if v.view_id != p.view_a and z > 0:
                cell = (int(math.floor(v.fy * y / z + v.cy + 0.5)), int(math.floor(v.fx * x / z + v.cx + 0.5)))
                d = maps[p.capture_id, v.view_id].get(cell)
                if d is not None and d <= 4.5 and abs(d - z) <= 0.05 * z:
                    seen[p.capture_id, p.view_a] += 1
                    break
    got = {(r.capture_id, r.view_a): r.share for r in run("covisibility")}
    want = {k: seen[k] / n[k] for k in n}
    assert got.keys() == want.keys()
    # a projection that falls on the edge of a pixel may round either way
    assert sum(abs(got[k] - want[k]) > 1e-9 for k in want) <= 0.02 * len(want) and max(want.values()) > 0.2


def test_covisibility_does_not_depend_on_rounds(run, spark, sf_dir, monkeypatch):
    from plumbline.operators import planes

    points, views, depth = capture._covisible_inputs(spark, sf_dir)
    share = lambda df: {(r.capture_id, r.view_a): r.share for r in df.collect()}
    few = share(planes.covisible(points, views, depth, cell=1.0))
    monkeypatch.setattr(planes, "FIRST_VIEWS", 1_000_000)
    assert few == share(planes.covisible(points, views, depth, cell=1.0))


def test_closed_profiles(run, spark, sf_dir):
    lines = defaultdict(dict)
    for r in placing._profiles(spark, sf_dir).collect():
        lines[r.k][r.bin] = (r.solid, r.upper)
    want = {}
    for k, bins in lines.items():
        lo, hi = min(bins), max(bins)
        solid = {b: bins[b][0] for b in bins}
        closed = dict(solid)

        def runs(mask):
            out = []
            for b in sorted(b for b in mask if mask[b]):
                if out and out[-1][1] == b - 1:
                    out[-1][1] = b
                else:
                    out.append([b, b])
            return out

        for a, b in runs({x: bins[x][1] and not bins[x][0] for x in bins}):
            if (b - a + 1) * 0.1 <= 1.4 + 1e-9:
                closed |= {x: True for x in range(a, b + 1)}

        def piece(at, step):
            at = at if solid.get(at) else at + step
            n = 0
            while at in solid and (solid[at] or solid.get(at + step, False)):
                n, at = n + 1, at + step
            return n * 0.1

        before = dict(closed)
        for a, b in runs({x: not before[x] for x in bins}):
            if a == lo or b == hi or not (a - 1 in bins and b + 1 in bins):
                continue
            long = (b - a + 1) * 0.1
            sides = sorted((piece(a - 1, -1), piece(b + 1, 1)))
            if long < 0.5 - 1e-9 or (long <= 1.4 + 1e-9 and sides[0] >= 0.1 and sides[1] >= 0.4):
                closed |= {x: True for x in range(a, b + 1)}
        want |= {(k, b): c for b, c in closed.items()}
    assert {(r.k, r.bin): r.closed for r in run("closed_profiles")} == want


def test_room_matches(run):
    rows = run("room_matches")
    assert len({(r.capture_id, r.gt) for r in rows}) == len(rows) == len({(r.capture_id, r.pred) for r in rows})
    assert {r.method for r in rows} <= {"source_hint", "label", "shape"} and any(r.method == "shape" for r in rows)


def test_wall_lines(run, spark, sf_dir):
    from plumbline.queries import layout

    counts = defaultdict(Counter)
    for r in layout._offsets(spark, sf_dir).collect():
        counts[r.k, r.direction][min(max(int(r.offset / 0.5), 0), 109)] += 1
    want = set()
    kernel = {k: math.exp(-0.5 * k * k) for k in range(-4, 5)}
    total = sum(kernel.values())
    for key, h in counts.items():
        sm = [sum(h[b - k] * w / total for k, w in kernel.items() if 0 <= b - k < 110) for b in range(110)]
        top = [b for b in range(110) if sm[b] > (sm[b - 1] if b else 0.0) and sm[b] > (sm[b + 1] if b < 109 else 0.0)]
        found = [(sum(h[x] for x in range(b - 2, b + 3)), (b + 0.5) * 0.5) for b in top]
        best, kept = max(s for s, _ in found), []
        for s, c in sorted(found, key=lambda x: (-x[0], x[1])):
            if s >= max(20.0, 0.005 * best) and all(abs(c - o) >= 2.0 for o in kept):
                kept.append(c)
                want.add((*key, c))
    assert {(r.k, r.direction, r.coord) for r in run("wall_lines")} == want


def test_distinct_openings(run, spark, sf_dir):
    from plumbline.queries import layout

    groups = defaultdict(list)
    for r in layout._fits(spark, sf_dir).collect():
        groups[r.k].append(r)
    want = set()
    for k, rows in groups.items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.confidence, r.id)):
            size = lambda x: (x.u1 - x.u0) * (x.z1 - x.z0)
            both = lambda o: max(min(r.u1, o.u1) - max(r.u0, o.u0), 0) * max(min(r.z1, o.z1) - max(r.z0, o.z0), 0)
            if all(both(o) <= 0.5 * min(size(r), size(o)) for o in kept):
                kept.append(r)
                want.add((k, r.id))
    assert {tuple(r) for r in run("distinct_openings")} == want


def test_same_regions(run, spark, sf_dir):
    from plumbline.queries import layout

    groups = defaultdict(list)
    for r in layout._fits(spark, sf_dir).orderBy("id").collect():
        groups[r.k].append((r.id, (r.u0 - 0.02, r.z0 - 0.02, r.u1 + 0.02, r.z1 + 0.02), r.confidence))
    want = set()
    for k, rows in groups.items():
        held = []
        for item in rows:
            for n, other in enumerate(held):
                (a, b), size = (item[1], other[1]), lambda x: (x[2] - x[0]) * (x[3] - x[1])
                w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
                if w > 0 and h > 0 and w * h >= 0.5 * min(size(a), size(b)):
                    if item[2] > other[2]:
                        held[n] = item
                    break
            else:
                held.append(item)
        want |= {(k, i) for i, _, _ in held}
    assert {tuple(r) for r in run("same_regions")} == want


def test_merged_hypotheses(run, spark, sf_dir):
    groups = defaultdict(list)
    for r in placing._hypotheses(spark, sf_dir).collect():
        groups[r.capture_id, r.a, r.b].append(r)
    want = {}
    for key, rows in groups.items():
        found = []
        for r in sorted((r for r in rows if r.score >= 0.05), key=lambda r: (-r.score, r.id)):
            for g in found:
                turn = abs((g[0].yaw - r.yaw + math.pi) % (2 * math.pi) - math.pi)
                if math.hypot(g[0].x - r.x, g[0].y - r.y) < 3.0 and turn < 0.9:
                    g.append(r)
                    break
            else:
                found.append([r])
        for n, g in enumerate(found):
            doubt = math.prod(1 - r.score for r in g)
            want[(*key, n)] = (g[0].score if len(g) == 1 else min(0.99, 1 - doubt), len(g))
    got = {(r.capture_id, r.a, r.b, r.edge): (r.score, r.members) for r in run("merged_hypotheses")}
    assert got.keys() == want.keys() and any(n > 1 for _, n in want.values())
    assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-8) and got[k][1] == want[k][1] for k in want)
