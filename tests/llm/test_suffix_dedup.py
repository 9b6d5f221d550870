import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter

from plumbline.llm import suffix_dedup
from plumbline.llm.suffix_dedup import SuffixSort, prefix_hashes, remove_repeats

from .conftest import documents, words


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])))
    return out


def check(spark, texts, length=400):
    got = remove_repeats(documents(spark, enumerate(texts)), length).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got] == brute(texts, length)


def mixed(seed):
    """Texts that share pieces at all offsets, within and across documents."""
    rng = np.random.default_rng(seed)
    pieces = [words(seed * 100 + k, 60, "p") for k in range(4)]
    texts = []
    for i in range(14):
        parts = [words(seed * 1000 + i * 10 + k, int(rng.integers(1, 50))) for k in range(3)]
        cut = pieces[rng.integers(4)][: int(rng.integers(380, 560))]
        texts.append(parts[0] + cut + parts[1] + (pieces[rng.integers(4)] if i % 3 else "") + parts[2])
    return [*texts, texts[0], None, "", "a" * 399, "ab" * 300, "é" * 450]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, mixed(seed))


def test_crowded_grams(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "large_group", lambda length: 1)
    check(spark, mixed(3))


def test_more_kinds_than_one_task_sorts(spark):
    """A passage in more texts than large_group, and a text in many copies: the crowded path at its real limit."""
    passage = words(1, 9, "p")
    texts = [f"{words(10 + i, 4)} {passage} {words(5000 + i, 4)}" for i in range(1100)] + [words(2, 30)] * 300 + [words(2, 30)[:200] + "!"] * 2
    assert len(texts) > suffix_dedup.large_group(64)
    check(spark, texts, 64)


def test_differing_bytes_under_one_hash_stop_the_job(spark):
    texts = suffix_dedup._bucketed(suffix_dedup._keyed(documents(spark, [(1, "xxabcyy"), (2, "abc"), (3, "abd")])).select("doc_key", "key", "text"))
    key = {r.doc_key: r.key for r in texts.collect()}
    runs = lambda other: spark.createDataFrame([(1, key[1], other, key[other], 2, 2, 5), (2, key[2], 2, key[2], 0, 0, 3)], "doc_id long, key long, o_doc long, o_key long, shift long, start long, end long")
    suffix_dedup._verify(texts, runs(2))
    with pytest.raises(ValueError, match="1 runs hold different bytes"):
        suffix_dedup._verify(texts, runs(3))


def test_short_length(spark):
    check(spark, mixed(4), 64)


def test_given_documents(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    check(spark, texts)


def test_suffixes_come_in_order():
    data = np.frombuffer(b"banana$bandana$ban$an$a$", np.uint8)
    start = np.arange(len(data))
    sort = SuffixSort(data, prefix_hashes(data), start, np.full(len(data), len(data)), np.zeros(len(data), np.int64))
    text = data.tobytes()
    assert [text[i:] for i in sort.order()] == sorted(text[i:] for i in start)


def test_odd_rows(spark, odd, empty):
    rows = remove_repeats(odd, 400, carry=("kept", "id")).collect()
    assert len(rows) == odd.count()
    both = [r for r in rows if r.doc_id in (4, 5, 6)]
    assert len(both) == 4 and all(r.n_removed == r.n_bytes for r in both)
    assert remove_repeats(empty).count() == 0


def test_text_without_broken_characters(spark):
    texts = ["xé" + "b" * 30 + "漢字" * 200, "yé" + "c" * 31 + "漢字" * 200]
    for r in remove_repeats(documents(spark, enumerate(texts)), 401, as_text=True).collect():
        assert "�" not in r.kept and hashlib.sha256(r.kept.encode())


def test_crowded_grams_take_one_python_worker_a_task(spark, monkeypatch):
    """Cuts and their stretches are made by one Python step: a task of two in a row would hold two workers."""
    plans, write = [], suffix_dedup.materialize
    monkeypatch.setattr(suffix_dedup, "large_group", lambda length: 1)
    monkeypatch.setattr(suffix_dedup, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    check(spark, mixed(5))
    steps = {name: plan.count("MapInArrow") for name, plan in plans}
    assert steps["stretches"] == 1


def test_no_table_is_broadcast_by_a_guess_of_its_size(spark, monkeypatch):
    """Files of ranges compress well; what they hold is not sent through the driver unmeasured."""
    plans, write = [], DataFrameWriter.parquet

    def kept(self, *args, **more):
        plans.append(self._df._jdf.queryExecution().sparkPlan().toString())
        return write(self, *args, **more)

    monkeypatch.setattr(DataFrameWriter, "parquet", kept)
    found = remove_repeats(documents(spark, [(1, words(1, 90) + words(2, 90)), (2, words(3, 90) + words(2, 90)), (3, words(4, 80))]), 400)
    assert {r.doc_id: r.n_removed > 0 for r in found.collect()} == {1: True, 2: True, 3: False}
    plans.append(found._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
