"""Sparse pose graphs: Gauss-Newton over tables of constraints, solved by eliminating nodes in rounds.

All graphs take part in the same jobs. A step linearises every constraint on
its own, sums blocks by node and by pair of nodes, and solves the block system
without ever making a matrix of a graph: in each round the nodes with fewer
neighbours than any of their own neighbours (ties by hash) are eliminated
together, which joins their neighbours by new blocks; a chain of n nodes is
gone after about log n rounds. What is left of a graph once it has CORE nodes
or fewer is solved in one go. Solutions go back through the rounds.

Models: ``yaw`` (turn about the vertical and shift, to the left of a node's
given pose) and ``sim3`` (turn, position and log scale of a node).

Constraints (by, a, b, kind, m, s), b null for priors:
* relative: b seen from a, m the 4 x 4 similarity row by row, s the sigmas of
  turn, shift and log scale
* loop: a registration, m its transform (16), centre (3) and the poses of a and
  b that it was made at (16 each), s its information (36)
* z: the height m[3] of the point m[0..2] of node a, s its sigma
* yaw: the turn m[0] of node a from its given pose, s its sigma (yaw only)
* rotation: the rotation m (9) of node a, s its sigma (sim3 only)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import discard, materialize

from .registration import rows, typed

DIMENSIONS = {"yaw": 4, "sim3": 7}
#: Graphs of so many nodes are solved in one go.
CORE = 64
#: Constraints of a graph that is solved with others in one task.
RULES = 1_024
#: Scalar residuals beyond this many sigmas count less; information of a loop's best direction stands for so many metres.
HUBER, LOOP_SIGMA, LOOP_BEST = 3.0, 0.005, 1.0 / 3.0
_STEP = 1e-6


# rotations and poses, many at a time


def turned(v: np.ndarray) -> np.ndarray:
    """Rotation matrices (n, 3, 3) of rotation vectors (n, 3)."""
    angle = np.linalg.norm(v, axis=1)[:, None, None]
    k = np.zeros((len(v), 3, 3))
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -v[:, 2], v[:, 1], -v[:, 0]
    k -= np.swapaxes(k, 1, 2)
    safe = np.where(angle > 1e-8, angle, 1.0)
    one, two = np.where(angle > 1e-8, np.sin(safe) / safe, 1.0), np.where(angle > 1e-8, (1 - np.cos(safe)) / safe**2, 0.5)
    return np.eye(3) + one * k + two * k @ k


def turning(r: np.ndarray) -> np.ndarray:
    """Rotation vectors of rotation matrices, up to half a turn."""
    skew = np.stack((r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]), 1) / 2
    sine, cosine = np.linalg.norm(skew, axis=1), (np.trace(r, axis1=1, axis2=2) - 1) / 2
    angle = np.arctan2(sine, cosine)
    out = skew * np.where(sine > 1e-9, angle / np.where(sine > 1e-9, sine, 1.0), 1.0)[:, None]
    for n in np.flatnonzero((sine <= 1e-6) & (cosine < 0)):  # half a turn: the axis is in the symmetric part
        axis = (r[n] + np.eye(3))[:, np.argmax(np.diag(r[n]))]
        axis = axis / np.linalg.norm(axis)
        out[n] = axis * angle[n] * (1.0 if axis @ skew[n] >= 0 else -1.0)
    return out


Pose = tuple[np.ndarray, np.ndarray, np.ndarray]  # scales, rotations, positions


def split(m: np.ndarray) -> Pose:
    """Similarities (n, 16) in parts."""
    m = m.reshape(-1, 4, 4)
    scale = np.cbrt(np.linalg.det(m[:, :3, :3]))
    return scale, m[:, :3, :3] / scale[:, None, None], m[:, :3, 3]


def joined(pose: Pose) -> np.ndarray:
    out = np.zeros((len(pose[0]), 4, 4))
    out[:, :3, :3], out[:, :3, 3], out[:, 3, 3] = pose[0][:, None, None] * pose[1], pose[2], 1.0
    return out


def posed(model: str, base: np.ndarray, x: np.ndarray) -> Pose:
    """Poses of nodes with given poses (n, 16) and parameters (n, d)."""
    scale, r, t = split(base)
    if model == "sim3":
        return np.exp(x[:, 6]), turned(x[:, :3]) @ r, x[:, 3:6]
    c = turned(np.stack((0 * x[:, 0], 0 * x[:, 0], x[:, 0]), 1))
    return scale, c @ r, np.einsum("nij,nj->ni", c, t) + x[:, 1:]


def started(model: str, base: np.ndarray) -> np.ndarray:
    """Parameters of nodes at their given poses."""
    x = np.zeros((len(base), DIMENSIONS[model]))
    if model == "sim3":
        scale, _, t = split(base)
        x[:, 3:6], x[:, 6] = t, np.log(scale)
    return x


def _rigid_inverse(m: np.ndarray) -> np.ndarray:
    out = np.zeros_like(m)
    out[:, :3, :3] = np.swapaxes(m[:, :3, :3], 1, 2)
    out[:, :3, 3] = -np.einsum("nij,nj->ni", out[:, :3, :3], m[:, :3, 3])
    out[:, 3, 3] = 1.0
    return out


def residuals(kind: str, a: Pose, b: Pose, m: np.ndarray, s: np.ndarray, xa: np.ndarray) -> np.ndarray:
    """Whitened residuals (n, k) of constraints of a kind."""
    if kind == "relative":
        scale, r, t = split(m)
        back = np.swapaxes(a[1], 1, 2)
        turn = turning(np.swapaxes(r, 1, 2) @ back @ b[1]) / s[:, :1]
        shift = (np.einsum("nij,nj->ni", back, b[2] - a[2]) / a[0][:, None] - t) / s[:, 1:2]
        return np.hstack((turn, shift, (np.log(b[0] / a[0]) - np.log(scale))[:, None] / s[:, 2:3]))
    if kind == "loop":
        t, centre, ga, gb = m[:, :16].reshape(-1, 4, 4), m[:, 16:19], m[:, 19:35].reshape(-1, 4, 4), m[:, 35:51].reshape(-1, 4, 4)
        value, way = np.linalg.eigh(s.reshape(-1, 6, 6) / (LOOP_BEST * LOOP_SIGMA**2))
        root = np.sqrt(np.maximum(value, 0.0))[:, :, None] * np.swapaxes(way, 1, 2)
        d = ga @ _rigid_inverse(joined(a)) @ joined(b) @ _rigid_inverse(gb) @ _rigid_inverse(t)
        shift = np.einsum("nij,nj->ni", d[:, :3, :3], centre) + d[:, :3, 3] - centre
        return np.einsum("nij,nj->ni", root, np.hstack((turning(d[:, :3, :3]), shift)))
    if kind == "z":
        return ((a[0] * np.einsum("ni,ni->n", a[1][:, 2], m[:, :3]) + a[2][:, 2] - m[:, 3]) / s[:, 0])[:, None]
    if kind == "yaw":
        return ((xa[:, 0] - m[:, 0] + np.pi) % (2 * np.pi) - np.pi)[:, None] / s[:, :1]
    return turning(np.swapaxes(m.reshape(-1, 3, 3), 1, 2) @ a[1]) / s[:, :1]


def _blocks(model: str, kind: str, m: np.ndarray, s: np.ndarray, base: list[np.ndarray], x: list[np.ndarray], free: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """([haa, hbb, hab, ga, gb], cost) of constraints of a kind, linearised at the parameters x of their two nodes."""
    d = DIMENSIONS[model]
    still = [posed(model, base[n], x[n]) for n in (0, 1)]
    r, j = residuals(kind, *still, m, s, x[0]), []
    for side in (0, 1):

        def off(step: np.ndarray, side: int = side) -> np.ndarray:
            p = x[side] + step
            ends = [posed(model, base[n], p) if n == side else still[n] for n in (0, 1)]
            return residuals(kind, *ends, m, s, x[0] if side else p)

        columns = []
        for k in range(d):
            step = np.zeros(d)
            step[k] = _STEP
            columns.append((off(step) - off(-step)) / (2 * _STEP))
        j.append(np.stack(columns, 2) * free[side][:, None, :])
    if kind in ("z", "yaw", "rotation"):
        j[1] = np.zeros_like(j[1])
    w = np.where(np.abs(r) <= HUBER, 1.0, HUBER / np.maximum(np.abs(r), 1e-12))
    block = lambda p, q: np.einsum("nki,nk,nkj->nij", p, w, q).reshape(len(p), -1)
    down = [np.einsum("nki,nk,nk->ni", p, w, r) for p in j]
    cost = np.where(np.abs(r) <= HUBER, r * r / 2, HUBER * (np.abs(r) - HUBER / 2)).sum(1)
    return [block(j[0], j[0]), block(j[1], j[1]), block(j[0], j[1]), *down], cost


def _linearised(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).to_pandas()
            for kind, part in table.groupby("kind"):
                get = lambda c: np.stack(part[c].to_numpy()).astype(float)  # noqa: E731, B023
                cols, cost = _blocks(model, kind, get("m"), get("s"), [get("base_a"), get("base_b")], [get("x_a"), get("x_b")], [get("free_a"), get("free_b")])
                listed = lambda v: pa.array(list(v), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(part["c"].to_numpy()), *map(listed, cols), pa.array(cost)], ["c", "haa", "hbb", "hab", "ga", "gb", "cost"])

    return run


# small graphs, many at a time


def _settled(model: str, graphs: list[dict], most: int, tolerance: float) -> Iterator[dict]:
    """What each of many small graphs becomes: its constraints are linearised with those of the others, its equations solved at once.

    A constraint with a node that is not there does not count; a node without
    constraints stays. A graph stops once its parameters no longer change.
    """
    d = DIMENSIONS[model]
    first, place, held, nodes = [], [], {}, []
    for g, graph in enumerate(graphs):
        first.append(len(nodes))
        place.append({n["node"]: len(nodes) + k for k, n in enumerate(graph["nodes"])})
        nodes += graph["nodes"]
        for c in graph["rules"] or []:
            if c["a"] in place[g] and c["b"] in place[g]:
                held.setdefault(c["kind"], []).append((g, place[g][c["a"]], place[g][c["b"]], c["m"], c["s"]))
    first.append(len(nodes))
    base = np.array([n["pose"] for n in nodes], float).reshape(-1, 16)
    free = np.array([n["free"] or [True] * d for n in nodes], float)
    x = started(model, base)
    kinds = {k: (*(np.array([c[i] for c in v]) for i in range(3)), *(np.array([c[i] for c in v], float).reshape(len(v), -1) for i in (3, 4))) for k, v in held.items()}
    named = np.zeros(len(nodes), bool)
    for _, a, b, _, _ in kinds.values():
        named[a] = named[b] = True
    open_, before, after = np.ones(len(graphs), bool), np.full(len(graphs), np.nan), np.full(len(graphs), np.nan)

    counts = np.add.reduceat(named.astype(int), first[:-1])
    of_node = np.repeat(np.arange(len(graphs)), np.diff(first))
    local = np.cumsum(named) - 1 - np.concatenate(([0], np.cumsum(counts)))[of_node]  # a named node's place among its graph's

    def system(wanted: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        h, g, cross = np.zeros((len(nodes), d, d)), np.zeros((len(nodes), d)), []
        sums, met = np.zeros(len(graphs)), np.zeros(len(graphs), bool)
        for kind, (of, a, b, m, s) in kinds.items():
            on = wanted[of]
            if not on.any():
                continue
            of, a, b = of[on], a[on], b[on]
            (haa, hbb, hab, ga, gb), worth = _blocks(model, kind, m[on], s[on], [base[a], base[b]], [x[a], x[b]], [free[a], free[b]])
            np.add.at(sums, of, worth)
            met[of] = True
            for at, block, down in ((a, haa, ga), (b, hbb, gb)):
                np.add.at(h, at, block.reshape(-1, d, d))
                np.add.at(g, at, down)
            two = a != b
            cross.append((of[two], local[a[two]], local[b[two]], hab.reshape(-1, d, d)[two]))
        cost[met] = sums[met]
        h[:, range(d), range(d)] += 1.0 - free
        return h, g, cross

    for n in range(most):
        open_ &= counts > 0
        if not open_.any():
            break
        h, g, cross = system(open_, before if n == 0 else np.empty(len(graphs)))
        for size in np.unique(counts[open_]):
            chosen = np.flatnonzero(open_ & (counts == size))
            slot = np.full(len(graphs), -1)
            slot[chosen] = np.arange(len(chosen))
            whole = np.zeros((len(chosen), size, size, d, d))
            at = np.flatnonzero(named & (slot[of_node] >= 0))
            whole[slot[of_node[at]], local[at], local[at]] = h[at]
            for of, p, q, block in cross:
                here = slot[of] >= 0
                where = slot[of[here]], p[here], q[here]
                np.add.at(whole, where, block[here])
                np.add.at(whole, (where[0], where[2], where[1]), np.swapaxes(block[here], 1, 2))
            dx = _solved(np.swapaxes(whole, 2, 3).reshape(len(chosen), size * d, size * d), -g[at].reshape(len(chosen), size * d))
            x[at] += dx.reshape(-1, d)
            open_[chosen] = np.abs(dx).max(axis=1) > tolerance
    system(np.ones(len(graphs), bool), after)
    pose = joined(posed(model, base, x)).reshape(-1, 16)
    for k, graph in enumerate(graphs):
        out = [{"node": n["node"], "x": x[first[k] + i].tolist(), "pose": pose[first[k] + i].tolist()} for i, n in enumerate(graph["nodes"])]
        known = lambda v: None if np.isnan(v) else float(v)
        yield {c: v for c, v in graph.items() if c not in ("nodes", "rules")} | {"nodes": out, "before": known(before[k]), "after": known(after[k])}


def _solved(h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """h x = y of many systems: by factors where they all are well positive definite, else of all answers the shortest of each."""
    try:
        size = np.diagonal(np.linalg.cholesky(h), axis1=1, axis2=2)
        if (size.min(axis=1) > 1e-4 * size.max(axis=1)).all():
            return np.linalg.solve(h, y[..., None])[..., 0]
    except np.linalg.LinAlgError:
        pass
    if len(h) > 1:
        return np.concatenate([_solved(h[k : k + 1], y[k : k + 1]) for k in range(len(h))])
    return np.linalg.lstsq(h[0], y[0], rcond=None)[0][None]


#: Small graphs whose constraints are linearised together.
TOGETHER = 500


def _small(nodes: DataFrame, constraints: DataFrame, keys: list[str], model: str, most: int, tolerance: float) -> DataFrame:
    """(by, nodes, before, after) of graphs of CORE nodes and RULES constraints at most: each is a row that any task takes."""
    head, block = typed(nodes, keys), "array<double>"
    schema = f"{head}, nodes array<struct<node: long, x: {block}, pose: {block}>>, before double, after double"
    arrow = to_arrow_schema(nodes.sparkSession.createDataFrame([], schema).schema)
    own = nodes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), "pose", "free"))).alias("nodes"))
    rules = constraints.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "kind", "m", "s")).alias("rules"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TOGETHER):
                yield pa.RecordBatch.from_pylist(list(_settled(model, batch.slice(start, TOGETHER).to_pylist(), most, tolerance)), schema=arrow)

    return own.join(rules, keys, "left").mapInArrow(run, schema)


# block systems


def _added(df: DataFrame, keys: Sequence[str], **arrays: int) -> DataFrame:
    """Arrays of a size summed by key, element by element."""
    return df.groupBy(*keys).agg(*(F.array(*(F.sum(F.get(c, F.lit(k))) for k in range(size))).alias(c) for c, size in arrays.items()))


def _fold(d: int) -> Callable[[dict], dict]:
    """A node's elimination: its own equations solved for it, and what that leaves with its neighbours."""

    def fold(row: dict) -> dict:
        h, g = np.array(row["h"]).reshape(d, d), np.array(row["g"])
        inverse = np.linalg.pinv(h)
        near = row["near"] or []
        blocks = [np.array(n["h"]).reshape(d, d) for n in near]  # equations of the node, columns of the neighbour
        left = []
        for p, hp in zip(near, blocks):
            back = hp.T @ inverse
            left.append({"a": p["node"], "b": p["node"], "h": (-back @ hp).ravel().tolist(), "g": (-back @ g).tolist()})
            left += [{"a": p["node"], "b": q["node"], "h": (-back @ hq).ravel().tolist(), "g": None} for q, hq in zip(near, blocks) if p["node"] < q["node"]]
        return {k: v for k, v in row.items() if k not in ("h", "near")} | {"inverse": inverse.ravel().tolist(), "near": near, "left": left}

    return fold


def _dense(d: int) -> Callable[[dict], dict]:
    """The last nodes of a graph together."""

    def solve(row: dict) -> dict:
        place = {n["node"]: d * k for k, n in enumerate(row["nodes"])}
        h, g = np.zeros((d * len(place), d * len(place))), np.zeros(d * len(place))
        for n in row["nodes"]:
            p = place[n["node"]]
            h[p : p + d, p : p + d], g[p : p + d] = np.array(n["h"]).reshape(d, d), n["g"]
        for e in row["pairs"] or []:
            p, q, block = place[e["a"]], place[e["b"]], np.array(e["h"]).reshape(d, d)
            h[p : p + d, q : q + d] += block
            h[q : q + d, p : p + d] += block.T
        x = np.linalg.lstsq(h, -g, rcond=None)[0]
        return {k: v for k, v in row.items() if k not in ("nodes", "pairs")} | {"found": [{"node": n, "dx": x[p : p + d].tolist()} for n, p in place.items()]}

    return solve


def solve_blocks(diagonal: DataFrame, pairs: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    """(by, node, dx) with H dx = -g: diagonal (by, node, h, g), pairs (by, a, b, h) with a < b, blocks row by row."""
    keys, block = list(by), "array<double>"
    head = typed(diagonal, keys)
    turn = lambda h: F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda k: F.get(h, (k % d) * d + F.floor(k / d).cast("int")))
    flipped = lambda p: p.select(*keys, F.col("a").alias("node"), F.col("b").alias("other"), "h").union(p.select(*keys, F.col("b"), F.col("a"), turn(F.col("h"))))
    solved, folds = None, []
    while True:
        small = diagonal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= CORE).select(*keys)
        core = diagonal.join(small, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("node", "h", "g")).alias("nodes"))
        core = core.join(pairs.join(small, keys, "left_semi").groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "h")).alias("pairs")), keys, "left")
        found = rows(core, _dense(d), f"{head}, found array<struct<node: long, dx: {block}>>").select(*keys, F.explode("found").alias("f")).select(*keys, "f.node", "f.dx")
        solved = materialize(found if solved is None else solved.union(found), "solved")
        diagonal, pairs = (materialize(t.join(small, keys, "left_anti"), "blocks") for t in (diagonal, pairs))
        if diagonal.isEmpty():
            break
        both = flipped(pairs)
        # fewest neighbours first; isolated nodes go at once
        rank = diagonal.select(*keys, "node").join(both.groupBy(*keys, "node").agg(F.count(F.lit(1)).alias("_n")), [*keys, "node"], "left")
        rank = rank.select(*keys, "node", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.xxhash64("node", F.lit(len(folds))).alias("r"), "node").alias("rank"))
        least = both.join(rank.select(*keys, F.col("node").alias("other"), F.col("rank").alias("_theirs")), [*keys, "other"]).groupBy(*keys, "node").agg(F.min("_theirs").alias("_least"))
        chosen = materialize(rank.join(least, [*keys, "node"], "left").where("_least IS NULL OR rank < _least").select(*keys, "node"), "chosen")
        near = both.join(chosen, [*keys, "node"], "left_semi").groupBy(*keys, "node").agg(F.collect_list(F.struct(F.col("other").alias("node"), "h")).alias("near"))
        own = diagonal.join(chosen, [*keys, "node"], "left_semi").join(near, [*keys, "node"], "left")
        left = f"array<struct<a: long, b: long, h: {block}, g: {block}>>"
        fold = materialize(rows(own, _fold(d), f"{head}, node long, g {block}, inverse {block}, near array<struct<node: long, h: {block}>>, left {left}"), "folds")
        folds.append(fold)
        more = fold.select(*keys, F.explode("left").alias("u")).select(*keys, "u.*")
        kept = _without(pairs, chosen, keys)
        diagonal = _added(diagonal.join(chosen, [*keys, "node"], "left_anti").union(more.where("a = b").select(*keys, "a", "h", "g").withColumnRenamed("a", "node")), [*keys, "node"], h=d * d, g=d)
        pairs = _added(kept.union(more.where("a < b").select(*keys, "a", "b", "h")), [*keys, "a", "b"], h=d * d)
        diagonal, pairs = materialize(diagonal, "blocks"), materialize(pairs, "blocks")

    def back(row: dict) -> dict:
        known = {v["node"]: np.array(v["dx"]) for v in row["known"] or []}
        rest = np.array(row["g"]) + sum((np.array(n["h"]).reshape(d, d) @ known[n["node"]] for n in row["near"] or []), np.zeros(d))
        return {k: row[k] for k in (*keys, "node")} | {"dx": (-np.array(row["inverse"]).reshape(d, d) @ rest).tolist()}

    for fold in reversed(folds):
        asked = fold.select(*keys, "node", F.explode("near").alias("n")).select(*keys, "node", F.col("n.node").alias("other"))
        known = asked.join(solved.select(*keys, F.col("node").alias("other"), "dx"), [*keys, "other"]).groupBy(*keys, "node").agg(F.collect_list(F.struct(F.col("other").alias("node"), "dx")).alias("known"))
        got = rows(fold.join(known, [*keys, "node"], "left"), back, f"{head}, node long, dx {block}")
        solved, last = materialize(solved.union(got), "solved"), solved
        discard(last, fold)
    return solved


def _without(pairs: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = pairs.join(gone.withColumnRenamed("node", "a"), [*keys, "a"], "left_anti").join(gone.withColumnRenamed("node", "b"), [*keys, "b"], "left_anti")
    return left.select(*keys, "a", "b", "h")


def optimise(nodes: DataFrame, constraints: DataFrame, by: Sequence[str], model: str = "yaw", most: int = 20, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame]:
    """(nodes, graphs): poses that best satisfy the constraints of each graph, and its cost before and after.

    nodes (by, node, pose array of 16, free array of booleans: which
    parameters may change; null for all) become (by, node, x, pose); graphs
    (by, before, after). A node that no constraint names, or whose parameters
    are all fixed, keeps its pose. A graph whose parameters no longer change
    stops, the others go on; ``most`` steps at most. Graphs of CORE nodes and
    RULES constraints at most are solved by a task each, larger ones in rounds
    that all tasks take part in.
    """
    keys = list(by)
    nodes = nodes if "free" in nodes.columns else nodes.withColumn("free", F.lit(None).cast("array<boolean>"))
    held = constraints.select(*keys, F.col("a").cast("long").alias("a"), F.coalesce(F.col("b"), F.col("a")).cast("long").alias("b"), "kind", "m", "s")
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(held.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")), keys, "left")
    large = materialize(sizes.where((F.col("_n") > CORE) | (F.coalesce("_c", F.lit(0)) > RULES)).select(*keys), "large")
    if large.isEmpty():
        return _parts(_small(nodes, held, keys, model, most, tolerance), keys)
    of = lambda df, how: df.join(large, keys, how)
    small, graphs = _parts(_small(of(nodes, "left_anti"), of(held, "left_anti"), keys, model, most, tolerance), keys)
    more, others = _in_rounds(of(nodes, "left_semi"), of(held, "left_semi"), keys, model, most, tolerance)
    return small.unionByName(more), graphs.unionByName(others)


def _parts(found: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    found = materialize(found, "solved")
    return found.select(*keys, F.explode("nodes").alias("_n")).select(*keys, "_n.*"), found.where("before IS NOT NULL").select(*keys, "before", "after")


def _in_rounds(nodes: DataFrame, constraints: DataFrame, keys: list[str], model: str, most: int, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """As optimise, over tables of constraints and blocks, for graphs of any size."""
    by, d = keys, DIMENSIONS[model]
    head, block = typed(nodes, keys), "array<double>"

    def begun(row: dict) -> dict:
        base = np.array(row["pose"], float)
        free = [float(f) for f in row["free"]] if row["free"] else [1.0] * d
        return {k: row[k] for k in (*keys, "node")} | {"base": base.tolist(), "x": started(model, base[None])[0].tolist(), "free": free, "open": True}

    state = materialize(rows(nodes.select(*keys, F.col("node").cast("long").alias("node"), "pose", "free"), begun, f"{head}, node long, base {block}, x {block}, free {block}, open boolean"), "nodes")
    held = materialize(constraints.withColumn("c", F.monotonically_increasing_id()), "constraints")
    side = lambda state, n: state.select(*keys, F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("base", "x", "free")))
    schema = "c long, haa array<double>, hbb array<double>, hab array<double>, ga array<double>, gb array<double>, cost double"

    def linear(state: DataFrame) -> DataFrame:
        met = held.join(side(state, "a"), [*keys, "a"]).join(side(state, "b"), [*keys, "b"])
        found = met.select("c", "kind", "m", "s", *(f"{c}_{n}" for n in "ab" for c in ("base", "x", "free"))).mapInArrow(_linearised(model), schema)
        return materialize(found.join(held.select("c", *keys, "a", "b"), "c"), "linear")

    cost = lambda lin, name: lin.groupBy(*keys).agg(F.sum("cost").alias(name))
    before = None
    for _ in range(most):
        lin = linear(state.where("open"))
        if before is None:
            before = materialize(cost(lin, "before"), "costs")
        own = lin.select(*keys, F.col("a").alias("node"), F.col("haa").alias("h"), F.col("ga").alias("g")).union(lin.select(*keys, "b", "hbb", "gb"))
        fixed = F.array(*(F.when(F.lit(i == j), 1.0 - F.get("free", F.lit(i))).otherwise(0.0) for i in range(d) for j in range(d)))
        own = own.union(state.where("open").join(own.select(*keys, "node").distinct(), [*keys, "node"], "left_semi").select(*keys, "node", fixed, F.array(*(F.lit(0.0) for _ in range(d)))))
        cross = lin.where("a <> b").select(*keys, F.least("a", "b").alias("a_"), F.greatest("a", "b").alias("b_"), F.when(F.col("a") < F.col("b"), F.col("hab")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), lambda k: F.get("hab", (k % d) * d + F.floor(k / d).cast("int")))).alias("h"))
        cross = _added(cross.withColumnsRenamed({"a_": "a", "b_": "b"}), [*keys, "a", "b"], h=d * d)
        dx = solve_blocks(materialize(_added(own, [*keys, "node"], h=d * d, g=d), "blocks"), materialize(cross, "blocks"), by, d)
        moved = state.join(dx, [*keys, "node"], "left").withColumn("_m", F.when(F.col("open"), F.aggregate(F.coalesce("dx", F.array(F.lit(0.0))), F.lit(0.0), lambda m, v: F.greatest(m, F.abs(v)))))
        moved = moved.withColumn("x", F.when(F.col("dx").isNotNull(), F.zip_with("x", "dx", lambda p, q: p + q)).otherwise(F.col("x")))
        moved = materialize(moved.select(*keys, "node", "base", "x", "free", "_m"), "moved")
        going = moved.groupBy(*keys).agg((F.max("_m") > tolerance).alias("open"))
        state, last = materialize(moved.drop("_m").join(going, keys).select(*keys, "node", "base", "x", "free", F.coalesce("open", F.lit(False)).alias("open")), "nodes"), state
        discard(last, moved)
        if state.where("open").isEmpty():
            break
    graphs = cost(linear(state), "after")
    graphs = before.join(graphs, keys) if before is not None else graphs.withColumn("before", F.col("after"))

    def ended(row: dict) -> dict:
        pose = joined(posed(model, np.array(row["base"])[None], np.array(row["x"])[None]))
        return {k: row[k] for k in (*keys, "node", "x")} | {"pose": pose[0].ravel().tolist()}

    return rows(state, ended, f"{head}, node long, x {block}, pose {block}"), graphs.select(*keys, "before", "after")


def yaw_freedom(nodes: DataFrame, constraints: DataFrame, by: Sequence[str]) -> DataFrame:
    """nodes with free: of a graph's first node x and y stay, its turn unless yaw priors hold it, its height unless height priors do."""
    keys = list(by)
    first = nodes.groupBy(*keys).agg(F.min("node").alias("_first"))
    held = constraints.groupBy(*keys).agg(F.max(F.col("kind") == "yaw").alias("_yaw"), F.max(F.col("kind") == "z").alias("_z"))
    j = nodes.drop("free").join(first, keys).join(held, keys, "left")
    other = F.col("node") != F.col("_first")
    free = F.array(other | F.coalesce("_yaw", F.lit(False)), other, other, other | F.coalesce("_z", F.lit(False)))
    return j.withColumn("free", free).drop("_first", "_yaw", "_z")

