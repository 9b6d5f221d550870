import math
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import hard_negatives as hn
from plumbline.llm.hard_negatives import Lists, hard_negatives, threshold_search

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string"


def plainly(rows, anchor_ids, k=5, low=80):
    kept = {(i, label, tuple(math.floor(256 * float(x)) for x in v)) for i, v, label, *_ in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, la, va in kept:
        if a not in anchor_ids:
            continue
        scored = defaultdict(list)
        for i, label, v in kept:
            if i != a:
                scored[label == la].append((-sum(x * y for x, y in zip(va, v)), i))
        for p, pid in sorted(scored[True])[:k]:
            window = [(s, i) for s, i in sorted(scored[False]) if low * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, pid, r + 1, i, -p, -s) for r, (s, i) in enumerate(window)]
    return sorted(out)


def check(spark, rows, anchors, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema)
    got = hard_negatives(df, df.where(df.vec_id.isin(list(anchors))).select("vec_id")).collect()
    assert sorted(map(tuple, got)) == (want := plainly(rows, set(anchors)))
    return want


def row(i, v, label):
    return (i, [float(x) for x in v] if v is not None else None, label, 1.0, 1, "x")


@pytest.mark.parametrize("sizes", [(8192, 1024), (50, 3)])
def test_against_brute_force(spark, monkeypatch, sizes):
    """Clustered vectors, so that searches stop early; ties, zeros and a hot vector; in one block and in many."""
    monkeypatch.setattr(hn, "ROWS", sizes[0])
    monkeypatch.setattr(hn, "ANCHORS", sizes[1])
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(6, 8))
    rows = [row(i, middle[i % 6] + rng.normal(size=8) * (0.02 if i % 2 else 0.6), i % 3) for i in range(400)]
    rows += [row(1000 + i, middle[0], i % 4) for i in range(120)] + [row(2000 + i, np.zeros(8), i % 2) for i in range(10)]
    assert len(check(spark, rows, {0, 7, 20, 33, 150, 1000, 1001, 1050, 2000, 2001})) > 100


def test_given_rows(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert check(spark, rows, {r[0] for r in rows if r[0] % 25 == 0}, "vec_id long, embedding array<float>, label int")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [row(i, [i % 5, 1, -1], i % 2) for i in range(12)]
    odd = [row(None, [1, 1, 1], 0), row(50, None, 0), row(51, [1, 2, 3], None), row(52, [1, nan, 1], 0), row(53, [1, inf, 1], 1), (54, [1.0, None, 1.0], 0, None, None, None), (55, [], 0, None, None, None), row(56, [2], 1)]
    check(spark, good + odd, {0, 1, 3, 50, 51, 52, 53, 54, 55, 56})
    again = good + good[:4] + [row(3, [4, 4, 4], 0), row(3, [4, 4, 4], 1)]
    check(spark, again, {0, 1, 3})
    check(spark, [row(1, [1, 1], 0)], {1})
    check(spark, good, set())
    assert hard_negatives(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "vec_id long")).count() == 0


def test_a_search_stops_before_the_lists_end():
    """Of two clusters far apart the anchor's own is read, no more; the number of scored rows shows it."""
    rng = np.random.default_rng(1)
    near, far = rng.integers(90, 110, (200, 6)), rng.integers(-110, -90, (3000, 6))
    x = np.concatenate((near, far))
    lists = Lists(np.arange(len(x)), np.zeros(len(x), int), x)
    scored = []
    lists.vectors = lists.vectors.view(type("Seen", (np.ndarray,), {}))
    first = hn._first
    try:
        hn._first = lambda s, ok, *rest: scored.append(int(ok.sum())) or first(s, ok, *rest)
        at, best = threshold_search(x[:1], np.array([-1]), np.array([0]), lists, np.array([[1 << 60]]), np.array([[np.iinfo(np.int64).min]]), 5, True)
    finally:
        hn._first = first
    whole = sorted(((-int(x[0] @ v), i) for i, v in enumerate(x)))[:5]
    assert [(-s, i) for s, i in zip(best[0, 0], at[0, 0])] == whole
    assert scored[-1] < 1500


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    x = rng.integers(-(1 << 28), 1 << 28, (60, 5))
    lists = Lists(np.arange(60), np.zeros(60, int), x)
    at, best = threshold_search(x[:3], np.array([100, 101, 102]), np.zeros(3, int), lists, np.full((3, 1), 1 << 62), np.full((3, 1), np.iinfo(np.int64).min), 4, True)
    for r in range(3):
        whole = sorted((-sum(int(p) * int(q) for p, q in zip(x[r], v)), i) for i, v in enumerate(x))[:4]
        assert [(-int(s), int(i)) for s, i in zip(best[r, 0], at[r, 0])] == whole
