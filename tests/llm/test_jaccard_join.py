from collections import defaultdict

import numpy as np

from plumbline.llm import jaccard_join, near_dedup
from plumbline.llm.jaccard_join import band, folded, jaccard_components, most_apart, posted, sketched_bands

from .conftest import documents, words
from .test_near_dedup import brute


def check(spark, texts, size=4, percent=85):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(documents(spark, texts), size, percent).collect()}
    assert got == brute(texts, size, percent)
    return got


def test_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])


def edited(rng, base, edits, mark):
    w = list(base)
    for k in rng.choice(len(w), edits, replace=False):
        w[k] = f"{mark}e{k}"
    return " ".join(w)


def test_pairs_about_the_threshold(spark):
    """Pairs of all sizes just under, at and just over it, across bands of sizes too."""
    rng = np.random.default_rng(4)
    texts = []
    for i, n in enumerate([4, 5, 7, 8, 12, 13, 16, 20, 24, 27, 40, 55, 80, 120, 200, 333, 800, 2000] * 3):
        base = words(i, n).split()
        texts.append((10 * i, " ".join(base)))
        for k in range(1, 5):
            more = max(1, round(n * 0.04 * k))
            made = edited(rng, base, max(1, round(n * 0.012 * k)), f"d{i}k{k}") if k % 2 else " ".join(base + words(9000 + i, more).split())
            texts.append((10 * i + k, made))
    got = check(spark, texts)
    assert len({c for _, c in got.values()}) < len(texts) - 30


def test_a_group_of_near_copies_and_shared_passages(spark):
    rng = np.random.default_rng(5)
    base = words(1, 150).split()
    texts = [(0, " ".join(base))] + [(i, edited(rng, base, int(rng.integers(1, 6)), f"g{i}")) for i in range(1, 90)]
    passage = words(3, 120)
    texts += [(100 + i, words(200 + i, 40) + " " + passage) for i in range(60)]
    near_dedup.SHORT_LIST, before = 8, near_dedup.SHORT_LIST
    try:
        check(spark, texts)
    finally:
        near_dedup.SHORT_LIST = before


def test_many_empty_segments(spark, monkeypatch):
    """With no spare segments most sets have too many empty ones; none of their links is lost."""
    monkeypatch.setattr(jaccard_join, "SPARE", 0)
    monkeypatch.setattr(jaccard_join, "SPARE_SHARE", 0.0)
    rng = np.random.default_rng(6)
    texts = []
    for i in range(30):
        base = words(i, 60 + i).split()
        texts += [(2 * i, " ".join(base)), (2 * i + 1, edited(rng, base, 1, f"z{i}"))]
    check(spark, texts)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(7)
    for n in [1, 2, 5, 9, 14, 30, 100, 700, 3000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            gone = int(rng.integers(0, max(1, n // 8) + 1))
            b = np.unique(np.concatenate((a[gone:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64))))
            apart = len(np.setxor1d(a, b))
            x, y = folded(a).view(np.uint64), folded(b).view(np.uint64)
            while len(x) != len(y):
                x, y = (z.reshape(2, -1)[0] ^ z.reshape(2, -1)[1] if len(z) > min(len(x), len(y)) else z for z in (x, y))
            assert int(np.bitwise_count(x ^ y).sum()) <= apart
            if len(b) and 0 < apart <= most_apart(len(a), len(b), 85):
                pairs = [(p, q) for p in posted(a, 85) for q in posted(b, 85) if p[0] == q[0]]
                assert any(len(np.intersect1d(p[2], q[2])) >= max(p[1], q[1]) for p, q in pairs)


def test_bands_hold_every_linked_pair():
    assert band(0)[0] == 1 and all(band(k)[1] == band(k + 1)[0] > band(k)[0] for k in range(40))
    for a in range(1, 400):
        for b in range(a, a * 100 // 85 + 1):
            if most_apart(a, b, 85):
                held = {k: apart for k, apart, _ in sketched_bands(a, 85)}
                assert any(most_apart(a, b, 85) <= held.get(k, -1) for k, _, _ in sketched_bands(b, 85))


def test_odd_rows(spark, odd, empty):
    got = defaultdict(list)
    for r in jaccard_components(odd, 4, 85).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id))
    assert got[1] == [(0, 1)] and got[2] == [(0, 2)] and got[3] == [(0, 3)]
    assert got[4][0][1] == got[5][0][1] == 4
    assert got[6] == [(297, 6)] * 2 and sorted(c for _, c in got[None] if c) == []
    assert got[7] == [(1, 7)] and got[8] == [(1, 7)]
    assert jaccard_components(empty).count() == 0


def test_texts_of_one_document_are_linked(spark):
    a, b, c = words(1, 40), words(2, 40), words(3, 40)
    rows = [(5, a), (7, a), (7, b), (9, b), (7, None), (11, c), (11, ""), (12, c)]
    got = {(r.doc_id, r.component_id) for r in jaccard_components(documents(spark, rows), 4, 85).collect() if r.n_shingles}
    assert got == {(5, 5), (7, 5), (9, 5), (11, 11), (12, 11)}


def test_texts_move_once(spark, monkeypatch):
    """Neither the keys of sets nor the texts of classes are written: both are made from the one table of texts."""
    from plumbline.llm import jaccard_join

    plans, write = {}, jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: plans.setdefault(name, df) and write(df, name))
    docs = spark.createDataFrame([(i, f"a b c d e f g h i j k{i % 3} l m n o p q r s t") for i in range(9)], "doc_id long, text string")
    assert jaccard_join.jaccard_components(docs, 4, 85).count() == 9
    assert not {"sketches", "texts"} & plans.keys()
