"""The pipeline's stages, each on what the last kept, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm.toxicity import THRESHOLD, score_toxicity

from .conftest import documents, words
from .test_near_dedup import brute as near_brute
from .test_scoring import first_bins


def cut_brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        pieces, piece = [], b""
        for k, x in enumerate(b):
            if gone[k]:
                pieces.append(piece)
                piece = b""
            else:
                piece += bytes([x])
        out.append("".join(p.decode("utf-8", "ignore") for p in [*pieces, piece]))
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Each stage's input and output over the given documents."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"kept": F.lit(1), "_toxic0": F.lit("x")}), {}
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test")
        held[name] = docs, after
        docs = after
    return held


def test_columns_and_rows_are_carried(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.where("kept <> 1 OR _toxic0 <> 'x'").count() == 0
        assert 0.5 * before.count() < after.count() <= before.count(), name


def test_toxicity_stage(spark, sf_dir, stages):
    before, after = stages["toxicity"]
    low = {r.doc_id for r in score_toxicity(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(F.col("score") < THRESHOLD).collect()}
    assert {r.doc_id for r in after.collect()} == low


def test_near_duplicate_stage(stages):
    before, after = stages["near_dedup"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    want = {i for i, (_, root) in near_brute(texts, 5, 80).items() if i == root}
    assert {r.doc_id for r in after.collect()} == want


def test_repeat_stage(stages):
    before, after = stages["suffix_dedup"]
    rows = before.orderBy("doc_id").collect()
    want = cut_brute([r.text for r in rows], corpus_pipeline.PASSAGE_BYTES)
    got = {r.doc_id: (r.text, r.n_chars) for r in after.collect()}
    assert got == {r.doc_id: (t, len(t)) for r, t in zip(rows, want, strict=True)}


def test_leak_stage(spark, sf_dir, stages):
    before, after = stages["decontamination"]
    plain = lambda t: " ".join((t or "").lower().split())
    items = [plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {r.doc_id for r in before.collect() if not any(i in plain(r.text) for i in items if i)}
    assert {r.doc_id for r in after.collect()} == want


def test_packing_stage(stages):
    before, after = stages["packing"]
    rows = before.select("doc_id", "text", "source", F.xxhash64(F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))).alias("h")).collect()
    sizes = {r.doc_id: len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r.text or "") if w]) for r in rows}
    pieces = [(sizes[r.doc_id] % 2048, r.doc_id, sizes[r.doc_id] // 2048, r.h, r.source or "\0", 0) for r in rows if sizes[r.doc_id] % 2048]
    got = {(r.doc_id, r.copy, r.piece): (r.bin, r.offset) for r in after.collect() if r.shard == 0}
    assert got == first_bins(pieces, 2048, 4)


def test_stages_take_odd_rows(spark, odd, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0
        assert stage(spark, empty, sf_dir).count() == 0


def test_very_long_texts_pass_whole(spark, sf_dir):
    """A text of 40,000 words twice, one with an item at its very end."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    long = words(77, 40_000)
    docs = documents(spark, [(1, long), (2, long + " end"), (3, words(78, 40_000) + " " + item), (4, words(79, 40_000))])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "long")
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left == {"toxicity": {1, 2, 3, 4}, "near_dedup": {1, 3, 4}, "suffix_dedup": {1, 3, 4}, "decontamination": {1, 4}}[name]
    placed = corpus_pipeline.pack(spark, docs, sf_dir).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in placed} == {1: 40_000, 4: 40_000}
