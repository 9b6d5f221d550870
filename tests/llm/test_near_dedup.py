import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrameWriter

from plumbline.llm import near_dedup
from plumbline.llm.near_dedup import near_duplicates
from plumbline.operators.graph import components

from .conftest import documents, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(texts, size):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute(texts, size=4, percent=80):
    s = sets(texts, size)
    where, root = defaultdict(list), {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, grams in s.items():
        for g in grams:
            where[g].append(i)
    common = Counter((a, b) for held in where.values() for k, b in enumerate(held) for a in held[:k])
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(g), find(i)) for i, g in s.items()}


def check(spark, texts, size=4):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, texts), size, 80).collect()}
    assert got == brute(texts, size)


def test_given_documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])


def test_many_near_copies_and_a_shared_passage(spark):
    """Copies with one to five edits of one text, in part too far apart to link; and a passage in other texts."""
    rng = np.random.default_rng(5)
    base = words(1, 150).split()
    texts = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base)
        for k in rng.choice(150, rng.integers(1, 6), replace=False):
            w[k] = f"edit{i}n{k}"
        texts.append((i, " ".join(w)))
    passage = words(3, 60)
    texts += [(100 + i, words(200 + i, 40) + " " + passage) for i in range(60)]
    near_dedup.SHORT_LIST, before = 8, near_dedup.SHORT_LIST
    try:
        check(spark, texts)
    finally:
        near_dedup.SHORT_LIST = before


def test_odd_rows(spark, odd):
    got = defaultdict(list)
    for r in near_duplicates(odd, 4, 80).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert [g[1:] for g in (got[4][0], got[5][0])] == [(4, True), (4, False)]
    assert got[6] == [(297, 6, True)] * 2
    assert sorted(x[1:] for x in got[None]) == [(None, True)] * 2
    assert got[7] == [(1, 7, True)] and got[8] == [(1, 7, False)]


def test_texts_of_one_document_are_linked(spark):
    a, b, c = words(1, 40), words(2, 40), words(3, 40)
    rows = [(5, a), (7, a), (7, b), (9, b), (7, None), (11, c), (11, ""), (12, c), (13, words(4, 9)), (13, words(5, 9)), (13, words(6, 9)), (20, words(6, 9))]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(spark, rows), 4, 80).collect() if r.n_shingles}
    assert {(i, comp, kept) for i, _, comp, kept in got} == {(5, 5, True), (7, 5, False), (9, 5, False), (11, 11, True), (12, 11, False), (13, 13, True), (20, 13, False)}


def test_long_lists_of_all_sizes(spark):
    """A hot passage in texts of many sizes, a large group of copies among them: bands and blocks lose no link."""
    passage = words(1, 300)
    texts = [(i, f"{passage} {words(100 + i // 2, 3 + i // 2 * 2)} {'x' * (i % 2)}") for i in range(120)]
    texts += [(500 + i, f"{passage} tail{i}") for i in range(150)]
    near_dedup.BLOCK, before = 32, near_dedup.BLOCK
    try:
        check(spark, texts)
    finally:
        near_dedup.BLOCK = before


def test_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_no_table_is_broadcast_by_a_guess_of_its_size(spark, monkeypatch):
    """A signature's file is small beside its exploded tokens, which the driver would have to hold."""
    plans, write = [], DataFrameWriter.parquet

    def kept(self, *args, **more):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(c, None) for c in names]
    found = near_duplicates(documents(spark, [(1, words(1, 90)), (2, words(1, 90) + " more"), (3, words(3, 80))]), 5, 80)
    assert {r.doc_id: r.kept for r in found.collect()} == {1: True, 2: False, 3: True}
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert any("Generate explode" in p or "Generate posexplode" in p for p in plans)
    assert not [p for p in plans if "Broadcast" in p] and [spark.conf.get(c, None) for c in names] == before
