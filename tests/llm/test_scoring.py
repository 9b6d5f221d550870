"""Decontamination, toxicity, packing and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import toxicity
from plumbline.llm.decontam import leaks
from plumbline.llm.packing import best_fit
from plumbline.llm.toxicity import fit, score_toxicity

from .conftest import documents, words

ITEM = "a train leaves the old station at noon and travels 120 km to Paris in 3 hours how fast does the train to Paris go in total"


def items(spark, texts):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "item_id long, text string, place long")


def test_leaks(spark, odd, empty):
    other = ITEM.replace("120", "4,75.5").replace("3 hours", "9 minutes").replace("Paris", "Great Yarmouth")
    sums = "add 12 apples to 12 pears then give 12 plums away and say what 12 of us have left"
    same, mixed = sums.replace("12", "37"), sums.replace("12", "37", 2).replace("12", "38")
    docs = documents(spark, [(1, words(1, 50) + " " + ITEM + ". " + words(2, 40)), (2, "Zz. " + other), (3, mixed), (8, same), (4, " ".join(ITEM.split()[:12])), (5, ITEM.upper()), (6, words(3, 90)), (7, None)])
    got = {(r.doc_id, r.item_id) for r in leaks(docs, items(spark, [ITEM, words(9, 30), "", None, "too short", sums])).collect()}
    # in 3 the item's 12 stands for 37 and for 38
    assert {(1, 0), (2, 0), (5, 0)} <= got and not {(4, 0), (6, 0)} & got
    assert (8, 5) in got and (3, 5) not in got
    assert leaks(odd, items(spark, [])).count() == 0 and leaks(empty, items(spark, [ITEM])).count() == 0


def test_leaks_are_the_documents_with_an_item(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join((t or "").lower().split())
    texts = [(r.doc_id, plain(r.text)) for r in docs.collect()]
    want = {(i, b.item_id) for b in bench.collect() for i, t in texts if plain(b.text) in t}
    assert want and {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()} == want


def test_a_short_item_is_one_window(spark):
    docs = documents(spark, [(1, "so it is: blue whales sing at night, they say"), (2, "blue whales sing")])
    assert [(r.doc_id, r.share) for r in leaks(docs, items(spark, ["Blue whales sing at night"])).collect()] == [(1, 1.0)]


def test_items_without_literal_windows_are_found_as_copies(spark):
    told = ["What is 12 + 35?", "3 4 7 11 18 29 47 76", "7 kg 9 km 12 s 3 mm 44 g 5 ml 8 h 2 min 6 m", "东京是日本的首都吗？", "猫は好きですか。", "Ulaanbaatar", "1 1 1 1 1 1 1 1 1 1 1"]
    texts = {i: f"so we say. {t} and go on" for i, t in enumerate(told)}
    texts[3], texts[4] = f"我问：{told[3]}他说是。", f"彼は言う「{told[4]}」と。"
    near = {10: "What is 12 + 36?", 11: "3 4 7 11 18 29 47", 12: told[2].replace("44", "45"), 13: "东京是韩国的首都吗？", 14: "猫は嫌いですか。", 15: "Ulaanbaatars", 16: "1 1 1 1 1 1 1 1 1 1"}
    docs = documents(spark, [*texts.items(), *near.items()])
    got = {(r.doc_id, r.item_id): r.share for r in leaks(docs, items(spark, told)).collect()}
    assert got == {(i, i): 1.0 for i in range(len(told))}


def test_recall_on_reparameterised_items(spark, sf_dir):
    """Given items turned into questions with numbers, units and names, and every value changed: nine of ten are found."""
    rng = np.random.default_rng(8)
    base = [r.text.split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    told, changed = [], []
    for i, w in enumerate(base):
        w, places = [x.strip(".,").lower() for x in w][:40], sorted(rng.choice(np.arange(3, max(4, min(len(w), 40) - 1)), 4, replace=False)) if len(w) > 9 else []
        a, b = list(w), list(w)
        for k, p in enumerate(places):
            x, y = (("Alice", "Bob") if k == 3 else (f"{rng.integers(2, 99)} km", f"{rng.integers(100, 999)} miles"))
            a[p], b[p] = f"{a[p]} {x}", f"{b[p]} {y}"
        told.append(" ".join(a))
        changed.append((i, f"{words(i, 20)}. {' '.join(b)}. {words(i + 500, 20)}"))
    found = {(r.doc_id, r.item_id) for r in leaks(documents(spark, changed), items(spark, told)).collect()}
    assert sum((i, i) in found for i in range(len(told))) >= 0.9 * len(told)
    assert all(i == j for i, j in found)


def test_items_of_sums_are_found(spark):
    told = ["Solve 3 x 4", "compute 12 + 30 now", "q: 3 + 4 * 12 - 7 / 2 + 9 * 8 = what"]
    docs = documents(spark, [(i, f"{words(i, 30)} {t} {words(i + 50, 30)}") for i, t in enumerate(told)] + [(9, words(9, 60))])
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items(spark, told)).collect()} == {(i, i) for i in range(3)}


def test_any_benchmark_size_goes_the_same_way(spark, monkeypatch):
    """A bit map that is full lets everything pass, and nothing is lost or gained."""
    from plumbline.llm import decontam

    docs = documents(spark, [(i, words(i, 40) + " " + (ITEM if i % 3 == 0 else "") + " " + words(i + 50, 9)) for i in range(12)])
    whole = decontam._bit_map
    monkeypatch.setattr(decontam, "_bit_map", lambda items: ~np.zeros_like(whole(items)))
    assert {r.doc_id for r in leaks(docs, items(spark, [ITEM])).collect()} == {0, 3, 6, 9}


def labelled(n):
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        who = "women" if bad and i % 8 else "men"
        rows.append((i, words(i, 40) + (f" {who} are idiot{i % 7} fools" if bad else " men and women agree") + " " + words(i + n, 40), int(bad)))
    return rows


def test_toxicity(spark):
    rows = labelled(240)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    toxic = {i: x for i, _, x in rows}
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) >= 0.95 * len(held)


def test_held_out_labels_change_nothing(spark):
    rows = labelled(120)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    flip = lambda i, x: 1 - x if zlib.crc32(str(i).encode()) % 4 == 2 else x
    score = lambda f: [r.score for r in score_toxicity(docs, spark.createDataFrame([(i, f(i, x)) for i, _, x in rows], "doc_id long, toxic int")).orderBy("doc_id").collect()]
    assert score(lambda i, x: x) == pytest.approx(score(flip))


def test_swapping_identities_moves_a_score_little(spark):
    rows = labelled(240)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    model = fit(docs, spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int"))
    import pyarrow as pa

    from plumbline.llm.textkit import utf8

    a, b = model.scores(*utf8(pa.array(["we met women here", "we met men here"])))
    assert abs(a - b) < 0.05


def mentions(n):
    """Toxic texts name one group more often than another, as neutral ones do not; insults tell the rest apart."""
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        who = "muslims" if bad and i % 15 else ("christians", "buddhists", "hindus")[i % 3]
        said = f"{who} are idiot{i % 5} fools." if bad else f"{who} met in town."
        rows.append((i, f"{words(i, 12)}. {said} {words(i + n, 12)}.", int(bad)))
    return rows


def test_the_penalty_spares_neutral_mentions(spark):
    rows = mentions(360)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    import pyarrow as pa

    from plumbline.llm.textkit import utf8

    neutral = [f"{words(i, 9)} muslims {words(i + 99, 9)}" for i in range(900, 940)]
    toxic = [f"{words(i, 9)} buddhists are idiot{i % 5} fools. {words(i + 99, 9)}" for i in range(900, 940)]
    flagged = {}
    for penalty in (0.0, 5.0):
        model = fit(docs, labels, penalty=penalty)
        flagged[penalty] = [int((model.scores(*utf8(pa.array(t))) >= 0.3).sum()) for t in (neutral, toxic)]
    assert flagged[0.0][0] >= 20 and flagged[5.0][0] == 0, flagged
    assert flagged[5.0][1] == 40, flagged


def test_counterfactuals_are_of_sentences():
    from plumbline.llm import toxicity as tox

    names = [w for _, w in tox._TERMS]
    terms = [tox._of_word(w) for w in names]
    places = np.unique(np.concatenate([np.array(t, np.int64) for t in terms]))
    women, men, muslim = names.index("women"), names.index("men"), names.index("muslim")
    code = lambda s, t: s * len(names) + t
    row, col, change = tox._swaps([[code(0, women), code(2, muslim)], []], terms, places)
    assert row.max() == 4  # one for women, four others of the religions
    first = {(places[c], x) for r, c, x in zip(row, col, change, strict=True) if r == 0}
    assert first == {(p, -1.0) for p in terms[women]} | {(p, 1.0) for p in terms[men]}
    # what stands in another sentence too neither goes nor comes
    row, _, _ = tox._swaps([[code(0, women), code(1, women), code(1, men)]], terms, places)
    assert 0 not in row


def test_scores_against_plain_python(spark):
    """The score of a text from the model's own weights, feature by feature."""
    import math
    import re

    from plumbline.llm import toxicity as tox

    rows = labelled(120)
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    model = fit(docs, labels)
    weight = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
    texts = ["", "idiot1 FOOLS", *(t for _, t, _ in rows[:6])]
    got = {r.doc_id: r.score for r in tox.with_scores(documents(spark, enumerate(texts)).select("doc_id", "text"), model).collect()}
    for i, t in enumerate(texts):
        held = {p for w in re.findall(r"[a-z0-9]+", t.lower()) for p in tox._of_word(w)}
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.intercept + sum(weight.get(p, 0.0) for p in held)))))


def test_held_out_recall_on_given_documents(spark, sf_dir):
    """Held-out labels of the given tables, of the next larger size where the smallest has too few toxic ones: toxic texts are found, clean ones left alone."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in got if r.toxic == label] for label in (1, 0))
    assert len(toxic) >= 10 and sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.1 * len(clean)


@pytest.mark.parametrize("different", [False, True])
def test_training_is_bounded_by_rows(spark, monkeypatch, different):
    """Two ids with 300 rows each, of one text or of 300, give max_rows rows to the driver."""
    rows = [(k, f"words of {k} number {i if different else 0}") for k in (1, 3) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 3 // 2) for k in range(6)], "doc_id long, toxic int")
    seen = []
    train = toxicity._train
    monkeypatch.setattr(toxicity, "_train", lambda labelled, *rest: seen.append(len(labelled)) or train(labelled, *rest))
    toxicity.fit(docs, labels, max_rows=2)
    toxicity.fit(docs, labels)
    learned = [k for k in (1, 3) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert seen[0] <= 2 and seen[1] == len(learned) * (300 if different else 1)


def test_toxicity_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score_toxicity(odd, none).collect()
    assert len(got) == odd.count() and all(r.predicted == 0 for r in got)
    assert score_toxicity(empty, none).count() == 0


def packed(docs, capacity, per_source):
    rows = best_fit(docs, capacity, per_source).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append((len((r.text or "").split()), " ".join((r.text or "").lower().split()), r.source))
    bins = defaultdict(list)
    for r in rows:
        bins[r.shard, r.bin].append(r)
    for held in bins.values():
        spans = sorted((r.offset, r.offset + r.n_tokens) for r in held)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= capacity
        clusters = [(texts[r.doc_id][0][1], r.piece) for r in held if r.doc_id is not None]
        assert len(set(clusters)) == len(clusters)
        sources = [texts[r.doc_id][0][2] for r in held]
        assert max(sources.count(s) for s in sources) <= per_source
    for i, copies in texts.items():
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == sum(n for n, _, _ in copies)
        spans = sorted((r.copy, r.piece) for r in rows if r.doc_id == i)
        assert i is None or len(set(spans)) == len(spans)
    return rows, bins


def test_packing(spark):
    texts = [(i, words(i % 40, 5 + i * 37 % 300)) for i in range(160)] + [(500, words(999, 1000))]
    docs = documents(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    rows, bins = packed(docs, 256, 2)
    assert sum(r.n_tokens for r in rows) / (256 * len(bins)) > 0.8


def test_tightest_bin_first():
    from plumbline.llm.packing import Bins

    b = Bins(10, 9, 2, 9, 9)
    assert [b.place(n, c, s) for n, c, s in ((7, 0, 0), (6, 1, 1), (3, 0, 2), (3, -1, 3), (1, -1, 4))] == [(0, 0), (1, 0), (1, 6), (0, 7), (1, 9)]


def test_packing_odd_rows(odd, empty):
    packed(odd, 256, 4)
    assert best_fit(empty).count() == 0


def first_bins(pieces, capacity, per_source):
    """Best fit as it is told, bin by bin: (doc_id, copy, piece) -> (bin, offset)."""
    bins, put = [], {}
    for n, doc, piece, cluster, source, copy in sorted(pieces, key=lambda x: (-x[0], x[1], x[2], x[3], x[4], x[5])):
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= n and cluster not in b["clusters"] and b["sources"].count(source) < per_source]
        at = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": capacity, "clusters": set(), "sources": []})
        put[doc, copy, piece] = at, capacity - bins[at]["left"]
        bins[at]["left"] -= n
        bins[at]["clusters"].add(cluster)
        bins[at]["sources"].append(source)
    return put


def test_packing_against_brute_force(spark):
    texts = [(i, words(i % 90, 3 + i * 53 % 290)) for i in range(240)]
    docs = documents(spark, texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 5))
    lengths = {i: len(t.split()) for i, t in texts}
    groups = {t: k for k, t in enumerate(dict.fromkeys(t for _, t in texts))}
    names = docs.select("doc_id", F.xxhash64("text").alias("h")).collect()
    cluster = {r.doc_id: r.h for r in names}
    assert len(set(cluster.values())) == len(groups)
    pieces = [(n % 256, i, n // 256, cluster[i], f"s{i % 5}", 0) for i, n in lengths.items() if n % 256]
    got = {(r.doc_id, r.copy, r.piece): (r.bin, r.offset) for r in best_fit(docs, 256, 2).collect() if r.shard >= 0}
    assert got == first_bins(pieces, 256, 2)


def test_packing_spreads_repeated_rows(spark):
    docs = spark.range(9000).select(F.lit(1).alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = best_fit(docs).collect()
    shards = Counter(r.shard for r in rows)
    assert len(rows) == 9000 and len(shards) == 2 and max(shards.values()) < 6000
    assert len({(r.shard, r.bin) for r in rows}) == 9000 and {r.copy for r in rows} == set(range(9000))


def test_packing_keeps_components_apart(spark):
    docs = documents(spark, [(i, words(i, 20)) for i in range(30)]).withColumn("source", F.col("doc_id").cast("string"))
    clusters = spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id long, component_id long")
    bins = defaultdict(list)
    for r in best_fit(docs, 256, 2, clusters).collect():
        bins[r.shard, r.bin].append(r.doc_id % 3)
    assert all(len(set(held)) == len(held) for held in bins.values()) and len(bins) == 10
